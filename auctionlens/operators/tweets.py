"""Tweet selection, sentiment and term statistics; every transform also runs on a stream
unless it aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionlens.functions.predicates import matches_any
from auctionlens.functions.text import sequences, tokens


def tweet_select(tweets: DataFrame) -> DataFrame:
    """English tweets as time, text and sender."""
    return tweets.where(F.col("lang") == "en").select(
        "created_at", "text", F.col("user.screen_name").alias("screen_name")
    )


def tweet_track(tweets: DataFrame, keywords: Sequence[str] | str) -> DataFrame:
    """Tweets naming any of the keywords (a list or a comma-separated text)."""
    words = keywords.split(",") if isinstance(keywords, str) else keywords
    return tweets.where(matches_any(F.col("text"), words))


#: Characters of a keyword by which it is looked up.
GRAM = 4


def keyword_index(keywords: DataFrame) -> DataFrame:
    """gram, size, keyword: every different keyword of the ``keyword`` column under its first characters; blank ones do not count."""
    clean = F.lower(F.regexp_replace("keyword", r"^\s+|\s+$", ""))
    words = keywords.select(clean.alias("keyword")).where("keyword <> ''").distinct()
    size = F.least(F.length("keyword"), F.lit(GRAM))
    return words.select(F.substr("keyword", F.lit(1), size).alias("gram"), size.alias("size"), "keyword")


def tweet_track_many(tweets: DataFrame, keywords: DataFrame) -> DataFrame:
    """``tweet_track`` for keyword lists of any length: one plan, whatever the list.

    The keywords are an index by their first characters, which is joined to the
    different character sequences of each text; only where these meet is the text
    searched for the keyword. A short index is broadcast by its size, and then
    nothing but hits is shuffled. Sequences are as long as some keyword's entry is.
    """
    index = keyword_index(keywords)
    sizes = index.agg(F.collect_set("size")).scalar()  # at most GRAM numbers
    text, size = F.lower("text"), F.col("size")
    each = tweets.select("tweet_id", "text", sizes.alias("sizes")).select("tweet_id", "text", F.explode("sizes").alias("size"))
    grams = F.array_distinct(sequences(text, size))
    parts = each.select("tweet_id", F.explode_outer(grams).alias("gram")).where("gram IS NOT NULL")
    maybe = parts.join(index.select("gram", "keyword"), "gram").select(F.col("tweet_id").alias("found_id"), "keyword").distinct()
    named = (F.col("tweet_id") == F.col("found_id")) & text.contains(F.col("keyword"))
    return tweets.join(maybe, named, "left_semi")


def line_count(files: dict[str, DataFrame]) -> DataFrame:
    """Rows per named file."""
    frames = [df.agg(F.lit(name).alias("file"), F.count(F.lit(1)).alias("lines")) for name, df in files.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _scored_terms(tweets: DataFrame, lexicon: DataFrame, keep: Sequence[str], max_words: int) -> DataFrame:
    """One row per tweet term with its score (NULL outside the lexicon); empty tweets keep one row.

    The lexicon decides the join: a short one is broadcast and the terms stay
    where they are.
    """
    terms = tweets.select(*keep, F.explode_outer(tokens(F.col("text"), max_words)).alias("term"))
    return terms.join(lexicon.select("term", "score"), "term", "left")


def _score() -> Column:
    return F.sum(F.coalesce(F.col("score"), F.lit(0))).cast("bigint").alias("sentiment")


def tweet_sentiment(tweets: DataFrame, lexicon: DataFrame, max_words: int = 1) -> DataFrame:
    """Sum of the term scores of every tweet, 0 when nothing is known."""
    return _scored_terms(tweets, lexicon, ["tweet_id"], max_words).groupBy("tweet_id").agg(_score())


def _each(terms: Column) -> Column:
    """Explode for use with a NOT NULL filter behind it.

    An inner explode would make the optimizer test the array for emptiness
    first, and so tokenise every text twice.
    """
    return F.explode_outer(terms).alias("term")


def term_sentiment(tweets: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Mean score of the tweets a term outside the lexicon occurs in, each tweet counted once."""
    tweet = _scored_terms(tweets, lexicon, ["tweet_id"], 1).groupBy("tweet_id").agg(
        _score(), F.collect_set(F.when(F.col("score").isNull(), F.col("term"))).alias("terms")
    )
    return (
        tweet.select("sentiment", F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.sum("sentiment").alias("total"), F.count(F.lit(1)).alias("tweets"))
        .select("term", F.try_divide(F.col("total").cast("double"), F.col("tweets").cast("double")).alias("sentiment"))
    )


def term_frequency(tweets: DataFrame) -> DataFrame:
    """Occurrences of each term over the occurrences of all terms."""
    terms = tweets.select(_each(tokens(F.col("text")))).where("term IS NOT NULL")
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").cast("double").alias("total")).scalar()
    return counts.select("term", (F.col("n").cast("double") / total).alias("frequency"))


def state_sentiment(tweets: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Mean tweet score per state; tweets without a state are left out."""
    placed = tweets.where("state IS NOT NULL")
    scores = _scored_terms(placed, lexicon, ["tweet_id", "state"], 1).groupBy("tweet_id", "state").agg(_score())
    return scores.groupBy("state").agg(
        F.try_divide(F.sum("sentiment").cast("double"), F.count(F.lit(1)).cast("double")).alias("mean_sentiment")
    )


def happiest_state(tweets: DataFrame, lexicon: DataFrame) -> DataFrame:
    return state_sentiment(tweets, lexicon).orderBy(F.desc("mean_sentiment"), "state").limit(1)


def top_hashtags(hashtags: DataFrame, k: int = 10) -> DataFrame:
    """The most frequent hashtags of the hashtag entities; ties by name."""
    return (
        hashtags.groupBy("hashtag")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "hashtag")
        .limit(k)
    )


def hashtag_entities(tweets: DataFrame) -> DataFrame:
    """One row per hashtag entity of nested tweets."""
    return tweets.select(F.explode("entities.hashtags").alias("h")).select(F.col("h.text").alias("hashtag"))
