"""Text clean-up, pages, tweets in batch and as a stream."""

import json
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from auctionlens.functions.text import clean_text, sequences, tidy, tokens
from auctionlens.operators import pages, tweets
from auctionlens.sources import readers
from auctionlens.streaming import tweets as live

MESSY = ["  a'b\"c\nd%e  f ", "Café ① ﬁn 中", "", "\t x \r\n y "]


def test_clean_text_equals_its_python_form(spark):
    df = spark.createDataFrame([(m,) for m in [*MESSY, None]], "t string")
    got = [r[0] for r in df.select(clean_text(F.col("t"))).collect()]
    assert got == [*map(tidy, MESSY), None]
    assert got[:2] == ["a b c d e f", "Cafe 1 fin"]


def test_tokens_and_phrases(spark):
    df = spark.createDataFrame([(" Not  GOOD at all",), ("",), ("one",)], "t string")
    assert [r[0] for r in df.select(tokens(F.col("t"))).collect()] == [["not", "good", "at", "all"], [], ["one"]]
    grams = [r[0] for r in df.select(tokens(F.col("t"), 3)).collect()]
    assert "not good at" in grams[0] and "at all" in grams[0] and len(grams[0]) == 4 + 3 + 2
    assert grams[1:] == [[], ["one"]]


PAGE = """<html><head><title>It's 100% &amp; more</title>
<meta name="Description" content=" First "><meta name="descr-x" content="Second  one">
<meta name="KEYWORDS" content="red, green ,blue"><meta name="keywords"></head>
<body><script>var t = "<p>no</p>";</script><a href="#">Home</a><a>42</a><a> </a><a>Café <b>bar</b></a>
<img src="x" alt="Logo"><img alt="7"><img alt=""><img src="y">
<p>one<p>two <i>words</i><div>outside</div><p>three</p></body></html>"""


def record(spark, html):
    df = spark.createDataFrame([(1, "http://a.example", html)], "page_id bigint, url string, html string")
    return pages.page_features(df).drop("page_id", "domain").first().asDict()


def test_page_record(spark):
    page = record(spark, PAGE)
    assert page == {
        "title": "It s 100 & more",
        "meta_description": "Second one",
        "meta_keywords": ["red", "green", "blue"],
        "ref_titles": ["Home", "Cafe bar"],
        "img_alt_titles": ["Logo"],
        "content": ["one", "two words", "three"],
    }
    empty = record(spark, "")
    assert empty["title"] == "" and empty["content"] == []


def test_markup_that_ends_early(spark):
    page = record(spark, "<p title='a > b'>1 < 2 &lt; 3 &copy; &am<a href=\"x\">Zürich&nbsp;</a><article><p>end<!-- <p>no")
    assert page["content"] == ["1 < 2 < 3 &amZurich", "end"] and page["ref_titles"] == ["Zurich"]
    assert record(spark, "<title>a</title><p>b<script>c")["content"] == ["b"]
    assert record(spark, "<a>&nbsp;</a><a> 7 </a><img alt='x > y'><img alt=z><p")["img_alt_titles"] == ["x > y", "z"]
    assert record(spark, "<meta name=keywords content=''><meta name=description content='&eacute;t&eacute; 5%'>") == {
        "title": "", "meta_description": "ete 5", "meta_keywords": [], "ref_titles": [], "img_alt_titles": [], "content": [],
    }


def test_a_tag_with_many_attributes_needs_no_stack(spark):
    page = record(spark, "<img " + "a='b' " * 50_000 + " alt='far'>" + "<p>" + "<b x=\"y\">w </b>" * 50_000)
    assert page["img_alt_titles"] == ["far"] and len(page["content"][0]) == 2 * 50_000 - 1


def test_page_jobs(spark):
    df = spark.createDataFrame(
        [(1, "http://A.example/x?y", PAGE), (2, "a.example:80/z", "<title>home Home</title>"), (3, "b.example", None)],
        "page_id bigint, url string, html string",
    )
    features = pages.page_features(df)
    assert rows(features.select("page_id", "domain")) == [(1, "a.example"), (2, "a.example")]
    counts = {(r["domain"], r["term"]): r["n"] for r in pages.page_anchor_counts(features).collect()}
    assert counts[("a.example", "home")] == 3 and ("a.example", "") not in counts


def test_whole_pages_are_read(spark):
    long = "<p>" + "word " * 200_000 + "end</p>"
    df = spark.createDataFrame([(1, "http://a.example", long)], "page_id bigint, url string, html string")
    content = pages.page_features(df).first()["content"][0]
    assert content.endswith("word end") and len(content) == 5 * 200_000 + 3


def tweet(i, text="hello", lang="en", **more):
    return json.dumps(dict(id=i, created_at=f"t{i}", text=text, lang=lang, user={"screen_name": f"u{i}"}, **more))


LINES = [
    tweet(1), tweet(2, lang="fr"), "not json", '{"delete": {"id": 9}}', "", tweet(3, text="The Ruby way"), '{"id": 4, "te',
]


def test_tweet_file(spark, tmp_path):
    (tmp_path / "t.json").write_text("\n".join(LINES))
    parsed = readers.read_tweets(spark, str(tmp_path / "t.json"))
    assert parsed.count() == 3
    assert rows(tweets.tweet_select(parsed)) == [("t1", "hello", "u1"), ("t3", "The Ruby way", "u3")]
    assert tweets.tweet_track(parsed, "python, ruby").count() == 1
    assert tweets.tweet_track(parsed, []).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join(LINES[:3]))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def work_off():
        incoming = live.stream_tweets(spark, str(source), files_per_batch=1)
        live.start_selection(incoming, out, checkpoint, once=True).awaitTermination()

    work_off()
    (source / "b.json").write_text("\n".join(LINES[3:]))
    work_off()
    work_off()
    batch = tweets.tweet_select(readers.read_tweets(spark, str(source)))
    assert rows(spark.read.parquet(out)) == rows(batch)
    assert len(rows(batch)) == 2
    tracked = live.selected(live.stream_tweets(spark, str(source)), "ruby")
    query = tracked.writeStream.format("memory").queryName("tracked").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r["screen_name"] for r in spark.table("tracked").collect()] == ["u3"]


@pytest.fixture
def scored(spark, tmp_path):
    (tmp_path / "lex.tsv").write_text("good\t3\nbad\t-3\nnot good\t-2\n")
    lexicon = readers.read_lexicon(spark, str(tmp_path / "lex.tsv"))
    data = [
        (1, "good good day", "WA"), (2, "bad night", "TX"), (3, "unknown", "WA"), (4, "", None), (5, None, "TX"),
        (6, "not good day day", None),
    ]
    return spark.createDataFrame(data, "tweet_id bigint, text string, state string"), lexicon


def test_sentiment(scored):
    df, lexicon = scored
    assert rows(lexicon) == [("bad", -3), ("good", 3), ("not good", -2)]
    assert dict(rows(tweets.tweet_sentiment(df, lexicon))) == {1: 6, 2: -3, 3: 0, 4: 0, 5: 0, 6: 3}
    assert dict(rows(tweets.tweet_sentiment(df, lexicon, max_words=2)))[6] == 1
    terms = dict(rows(tweets.term_sentiment(df, lexicon)))
    assert terms == {"day": 4.5, "night": -3.0, "unknown": 0.0, "not": 3.0}
    assert rows(tweets.happiest_state(df, lexicon).select("state", "mean_sentiment")) == [("WA", 3.0)]


def test_frequency_counts_every_token_once(scored):
    df, _ = scored
    share = dict(rows(tweets.term_frequency(df)))
    assert sum(share.values()) == pytest.approx(1) and share["day"] == pytest.approx(3 / 10)


def test_hashtags_come_from_entities(spark, tmp_path):
    tags = [["a", "b"], ["a"], ["c"], []]
    lines = [tweet(i, text="#zzz", entities={"hashtags": [{"text": t} for t in ts]}) for i, ts in enumerate(tags)]
    (tmp_path / "h.json").write_text("\n".join(lines))
    entities = tweets.hashtag_entities(readers.read_tweets(spark, str(tmp_path / "h.json")))
    assert [tuple(r) for r in tweets.top_hashtags(entities, 2).collect()] == [("a", 2), ("b", 1)]


def test_line_count(spark, tmp_path):
    (tmp_path / "a").write_text("x\ny\n")
    (tmp_path / "b").write_text("z\n")
    files = {n: spark.read.text(str(tmp_path / n)) for n in "ab"}
    assert rows(tweets.line_count(files)) == [("a", 2), ("b", 1)]


LONG = [f"w{i % 997}" for i in range(60_000)]


def long_text(spark):
    """60,000 words: taken apart anew for every word or character, they would take many minutes."""
    return spark.createDataFrame([(1, " ".join(LONG) + " Needle"), (2, "w1 w2"), (3, ""), (4, None)], "tweet_id bigint, text string")


def test_phrases_take_time_in_proportion_to_the_text(spark):
    scored = {"w1 w2": 2, "w2": -1, "w996 w0 w1": 5}
    lexicon = spark.createDataFrame(list(scored.items()), "term string, score int")
    began = time.perf_counter()
    got = dict(tweets.tweet_sentiment(long_text(spark), lexicon, max_words=3).collect())
    runs = [" ".join(LONG[i : i + n]) for n in (1, 2, 3) for i in range(len(LONG) - n + 1)]
    assert got == {1: sum(scored.get(r, 0) for r in runs), 2: 1, 3: 0, 4: 0}
    assert time.perf_counter() - began < 60


def test_keywords_take_time_in_proportion_to_the_text(spark):
    began = time.perf_counter()
    keywords = spark.createDataFrame([("needle",), ("w2",), ("absent",)], "keyword string")
    assert rows(tweets.tweet_track_many(long_text(spark), keywords).select("tweet_id")) == [(1,), (2,)]
    assert time.perf_counter() - began < 60


def test_sequences_are_those_of_characters(spark):
    texts = ["", "a", "abab", "a\nb\r\n c", "ä\U0001f600x\U0001f600\U0001f600", None]
    df = spark.createDataFrame([(i, t, n) for i, t in enumerate(texts) for n in (1, 2, 4)], "i int, t string, n int")
    for r in df.select("t", "n", sequences(F.col("t"), F.col("n")).alias("got")).collect():
        wanted = None if r.t is None else {r.t[i : i + r.n] for i in range(len(r.t) - r.n + 1)}
        # A run from the middle of a character beyond 16 bits may come besides; no keyword holds one.
        assert (r.got is None) if wanted is None else wanted <= set(r.got) and all("?" in x or "�" in x for x in set(r.got) - wanted)
