"""Bag search, retrieval packing and source divergence on small tables, against brute force and exact round trips."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from auctionlens.llm import bag_search, common, divergence, retrieval_packing

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = ("n", "term", "terms", "tf", "m", "hash", "place", "members", "slab", "kept", "total", "chunk", "shard", "start",
           "ids", "length", "n_terms", "digest", "by_source", "item", "item_id", "score", "rank", "docs", "part")


def prose(r, n, words):
    return " ".join(r.choice(words) + ("," if r.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    words = ["w%s" % "abcdefghij"[i % 10] + "xyz"[i % 3] * (i // 10 + 1) for i in range(60)] + ["Été", "straße", "x1", "42"]
    made = [(i, prose(r, r.randint(1, 60), words), r.choice("ed"), "s%d" % min(r.randint(0, 9), 4), 1) for i in range(150)]
    copies = [(200 + i, made[3][1], "e", "s%d" % (i % 2), 1) for i in range(40)]
    odd = [
        (300, None, "e", "s0", None), (301, "", None, None, 0), (302, None, None, "s9", 1), (303, "12 %% .", "only", "one", 1),
        (None, made[5][1], "e", None, 1), (None, made[5][1], "e", None, 1), (304, made[5][1], "e", "s0", 1),
        (305, made[7][1], "d", "s1", 1), (305, made[7][1], "d", "s1", 1), (305, made[8][1], "d", "s1", 1),
        (306, prose(r, 9000, words), "d", "s2", 1), (307, "WAX ÉTÉ Straße STRASSE", "d", "s2", 1),
    ]
    return made + copies + odd


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in CLASHES}).repartition(3).cache()


@pytest.fixture(scope="module")
def items(spark, rows):
    asked = [(1, rows[3][1]), (2, rows[5][1] + " " + rows[5][1]), (3, "nothing of it"), (4, None), (5, ""), (6, "wax"),
             (1, rows[3][1]), (1, rows[9][1]), (None, rows[7][1]), (7, "Été 42 x1 42")]
    return spark.createDataFrame(asked, "item_id bigint, text string").withColumns({c: F.lit("x") for c in CLASHES if c != "item_id"})


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- bag search --------------------------------------------------------------------------------------------


def searched(rows, items, top):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    bags = [Counter(term.findall(lower(r[1]))) for r in rows]
    n_docs, n_terms = sum(map(bool, bags)), sum(b.total() for b in bags)
    df = Counter(t for b in bags for t in b)
    out = []
    for item_id, text in {(i, t or "") for i, t in items}:
        found = []
        for row, bag in zip(rows, bags):
            m = 75 + (25 * bag.total() * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m))
                for t in term.findall(lower(text)) if t in bag
            )
            if score > 0:
                found.append((-score, row[0] is None, row[0]))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item_id, i + 1, d, -s) for i, (s, _, d) in enumerate(found[:top])]
    return Counter(out)


@pytest.mark.parametrize("slab, cells", [(500_000, 4_000_000), (30, 7)])
def test_search_is_brute_force(docs, items, rows, monkeypatch, slab, cells):
    monkeypatch.setattr(bag_search, "SLAB", slab)
    monkeypatch.setattr(bag_search, "CELLS", cells)
    asked = [tuple(r) for r in items.select("item_id", "text").collect()]
    for top in (20, 3):
        got = Counter(tuple(r) for r in bag_search.search(docs, items, top).collect())
        assert got == searched(rows, asked, top)


def test_search_scores_a_class_once(docs, items):
    counted = bag_search.bags(docs, ["wax", "wbx", "été"]).cache()
    found = bag_search.classes(counted, 100, 1000).collect()
    held = counted.where(F.size("terms") > 0)
    assert len(found) == len({(r.m, tuple(r.terms), tuple(r.tf)) for r in found}) < held.count()
    assert max(len(r.members) for r in found) == 20  # of more than 40 copies, no more than a ranking can hold


def test_search_without_rows(docs, items):
    kind = "item_id bigint, rank int, doc_id bigint, score bigint"
    for df in (bag_search.search(docs.where("false"), items), bag_search.search(docs, items.where("false"))):
        assert df.count() == 0 and df.schema.simpleString() == "struct<%s>" % kind.replace(" ", ":").replace(",:", ",")


def test_terms_of_a_long_text_are_counted_in_chunks(monkeypatch):
    text = ("ab cd-ef " * 5000).encode()
    whole = common.term_counts(text, common.term_table(True))
    monkeypatch.setattr(common, "CHUNK_BYTES", 100)
    assert common.term_counts(text, common.term_table(True)) == whole == {b"ab": 5000, b"cd": 5000, b"ef": 5000}
    assert common.term_counts(b"x" * 1000, common.term_table(True)) == {b"x" * 1000: 1}
    assert common.term_counts(None, common.term_table(True)) == {}


# --- source divergence -------------------------------------------------------------------------------------


def diverged(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        lang, source, bag = lang or "", source or "", Counter(term.findall(lower(text)))
        groups[lang].add(source)
        df[lang].update(bag.keys())
        counts[lang, source].update(bag)
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]

        def p(names):
            own = {t: sum(counts[lang, s][t] for s in names) for t in kept}
            whole = sum(own.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (n + 2) // whole for t, n in own.items()}

        q = p(sources)
        for a in sources:
            pa = p([a])
            pairs = sorted(((-sum(f(x, p([b])[t]) for t, x in pa.items()), b.encode()) for b in sources if b != a))
            best = sorted((-f(pa[t], q[t]), t.encode()) for t in kept if counts[lang, a][t] and pa[t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", best)):
                out += [(lang, a, part, x.decode(), -v, i + 1) for i, (v, x) in enumerate(found)]
    return Counter(out)


@pytest.mark.parametrize("entries, cells", [(4_000_000, 2_000_000), (50, 20)])
def test_divergence_is_brute_force(docs, rows, monkeypatch, entries, cells):
    monkeypatch.setattr(divergence, "ENTRIES", entries)
    monkeypatch.setattr(divergence, "CELLS", cells)
    got = Counter(tuple(r) for r in divergence.divergence(docs, 5, 4).collect())
    want = diverged(rows, 5, 4)
    assert got == want
    assert {k[:2] for k in want} >= {("", ""), ("", "s9"), ("e", "")}


def test_divergence_takes_each_text_once(docs):
    texts = divergence.collapsed(docs).collect()
    assert len(texts) == len({(r.lang, r.text) for r in texts})
    most = max(texts, key=lambda r: sum(s.n for s in r.by_source))
    assert {s.source: s.n for s in most.by_source}.keys() >= {"s0", "s1"}
    assert sum(s.n for r in texts for s in r.by_source) == docs.count()


def test_divergence_without_rows(docs):
    assert divergence.divergence(docs.where("false")).count() == 0


def test_shares_are_exact_beyond_64_bits():
    n = np.array([0, 5, 10**13], np.int64)
    assert divergence.shares(n, 3 * 10**13).tolist() == [1 + 10**9 * (int(x) + 2) // (3 * 10**13) for x in n]
    assert divergence.shares(n[:2], 7).tolist() == [1 + 2 * 10**9 // 7, 1 + 10**9]


# --- retrieval packing -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(retrieval_packing.tokenizer_path())


@pytest.mark.parametrize("capacity, shard", [(2048, 2048), (64, 20), (100, 50)])
def test_packing_round_trip(docs, rows, tokenizer, capacity, shard):
    pieces = retrieval_packing.pack_documents(docs, capacity=capacity, shard=shard).collect()
    ids = [np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4") for r in rows]
    # Every id of every row lies in one piece: rows that share an id are told apart by their checksums.
    want = Counter()
    by_id = defaultdict(list)
    for p in pieces:
        by_id[p.doc_id].append(p)
    for (doc_id, *_), own in zip(rows, ids):
        want[doc_id] += len(own)
        cut = {(p.start, p.length, p.ids_crc32) for p in by_id[doc_id] if p.doc_tokens == len(own)}
        at = 0
        while at < len(own):
            fits = [n for s, n, crc in cut if s == at and zlib.crc32(own[at : at + n].tobytes()) == crc and at + n <= len(own)]
            assert fits, (doc_id, at)
            at += fits[0]
    assert {d: sum(p.length for p in own) for d, own in by_id.items()} == want
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    short = 0
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]]
        size = sum(n for _, n in own)
        assert size == capacity or size & (size - 1) == 0
        short += size < capacity
    assert short <= capacity.bit_length() * -(-len(rows) // shard) * 2


def test_packing_windows_hold_neighbours():
    r = random.Random(1)
    topics = [np.arange(100 * i, 100 * i + 100) for i in range(4)]
    ids = [np.array(r.choices(list(topics[i % 4]), k=40) + [1], "<u4") for i in range(80)]
    windows = list(retrieval_packing.fill(np.array([41] * 80), retrieval_packing.Index(ids), 205))
    pure = sum(len({at % 4 for at, _, _ in w}) == 1 for w in windows)
    assert len(windows) == 16 and pure >= 13
    assert Counter(at for w in windows for at, _, _ in w) == Counter(range(80))


def test_packing_is_the_same_each_time(docs):
    got = [sorted(map(str, retrieval_packing.pack_documents(docs, capacity=64, shard=20).collect())) for _ in range(2)]
    assert got[0] == got[1]
    assert retrieval_packing.pack_documents(docs.where("false")).count() == 0


def test_ids_are_the_tokenizers(tokenizer):
    known = retrieval_packing.Ids(retrieval_packing.tokenizer_path())
    assert known.fast is not None
    texts = ["", " ", "a<|endoftext|>b", "don't  stop\n\n\tnow ", "Été 中文 😀👍🏽  \x85\x1c x y", "1234 56٣", "x" * 5000, " " * 5000,
             "".join(chr(c) for c in range(1, 0x3000)), "é‍\u0000z"]
    for text in texts:
        assert known.of_text(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    # A vocabulary of another kind goes through the tokenizer itself.
    other = retrieval_packing.Ids(retrieval_packing.tokenizer_path("word_bpe_49k.json"))
    assert other.fast is None and len(other.of_text("some words"))


def test_powers():
    assert [retrieval_packing.powers(n) for n in (0, 1, 6, 2047)] == [[], [1], [4, 2], [1 << i for i in range(10, -1, -1)]]
