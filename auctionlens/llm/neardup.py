"""Near-duplicate documents with MinHash bands and odd sketches.

A document is its set of distinct five-word shingles. Equal sets form one class.
Classes that share a band of MinHash values are candidates; an odd sketch (the
parity bitmap of the MinHash samples) estimates their similarity by the
population count of the XOR, and what it lets through is confirmed on the full
sets. Components of confirmed links are found by star contraction.

Groups of copies never become pairs: first every class meets only the leaders of
its buckets and is linked to the most similar one; then the classes of a bucket
that are still in different components are compared, in blocks of bounded size
that return those pairs alone which pass the sketch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionlens.llm.common import byte_codes, mix, multipliers, text_chunks, word_hashes, word_spans, written

WORDS, PERCENT = 5, 75
#: A pair at 75 % shares none of the bands with a probability of (1 - 0.75 ** 4) ** 32 = 5e-6.
BANDS, ROWS = 32, 4
SKETCH_BITS = 1024
#: Bits of the parity bitmap of the full set, which bounds the symmetric difference from below.
PARITY_BITS = 2048
#: A pair goes to the full sets unless its estimate is this far below the threshold: about 5 standard errors.
MARGIN = 0.20
#: Classes of a bucket that meet in one task at most: twice as many.
BLOCK = 512

SIGNATURE = (
    "doc_id bigint, text_hash binary, n_shingles bigint, digest binary, bands array<bigint>, sketch array<bigint>, "
    "parity array<bigint>"
)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text; none for a text without words."""
    codes, k = byte_codes(lower=True), multipliers(WORDS + 1, 31)
    for _, data, offsets in text_chunks(texts):
        starts, ends, rows = word_spans(data, offsets)
        words = word_hashes(data, starts, ends, codes)
        n = max(0, len(words) - WORDS + 1)
        grams = np.zeros(n, np.uint64)
        for i in range(WORDS):
            grams += words[i : i + n] * k[i]
        grams = mix(grams)
        first = np.searchsorted(rows, np.arange(len(offsets)))
        for a, b in zip(first, first[1:]):
            if b - a >= WORDS:
                yield np.unique(grams[a : b - WORDS + 1])
            elif b > a:
                terms = np.append(words[a:b] * k[: b - a], k[WORDS:] * np.uint64(b - a))
                yield mix(terms.sum(dtype=np.uint64, keepdims=True))
            else:
                yield np.zeros(0, np.uint64)


def min_hashes(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The 32-bit minimum of each of the hash functions (a x + b) >> 32."""
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        part = shingles[i : i + 1024, None] * a
        part += b
        np.minimum(best, part.min(axis=0), out=best)
    return best >> np.uint64(32)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """The parity bitmap of (function, minimum) as 64-bit words."""
    place = mix((np.arange(len(samples), dtype=np.uint64) << np.uint64(32)) | samples) % np.uint64(SKETCH_BITS)
    return parity_bits(place, SKETCH_BITS)


def parity_bits(place: np.ndarray, bits: int) -> np.ndarray:
    parity = np.bincount(place.astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(parity).view(np.int64)


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, size and digest of the shingle set, band keys, odd sketches of samples and set; null for an empty set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = multipliers(BANDS * ROWS, 41), multipliers(BANDS * ROWS, 42)
        weights, salt = multipliers(ROWS, 43), multipliers(BANDS, 44)
        for batch in batches:
            size, digest, bands, sketch, parity = [], [], [], [], []
            for s in shingle_sets(batch.column(1)):
                size.append(len(s))
                digest.append(set_digest(s))
                if not len(s):
                    for column in (bands, sketch, parity):
                        column.append(None)
                    continue
                samples = min_hashes(s, a, b)
                key = mix((samples.reshape(BANDS, ROWS) * weights).sum(axis=1, dtype=np.uint64) + salt)
                bands.append(key.view(np.int64))
                sketch.append(odd_sketch(samples))
                parity.append(parity_bits(s % np.uint64(PARITY_BITS), PARITY_BITS))
            longs = pa.list_(pa.int64())
            columns = [batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(digest, pa.binary()),
                       pa.array(bands, longs), pa.array(sketch, longs), pa.array(parity, longs)]
            names = ["doc_id", "text_hash", "n_shingles", "digest", "bands", "sketch", "parity"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text", text_hash()).mapInArrow(rows, SIGNATURE)


def text_hash() -> Column:
    """Tells the texts of rows apart that share a doc_id; a null text is an empty one."""
    return F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_hash")


def full_sets(docs: DataFrame) -> DataFrame:
    """The shingle set of every row as an array, with its digest."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(0)))
            columns = [pa.array([set_digest(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "shingles"])

    return docs.select("text").mapInArrow(rows, "digest binary, shingles array<bigint>")


def estimate(a: str, b: str):
    """Similarity from two odd sketches, null where the XOR is too full to tell."""
    samples = BANDS * ROWS
    odd = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.lit(1.0) + F.lit(SKETCH_BITS / (4.0 * samples)) * F.log(1 - 2 * odd / F.lit(float(SKETCH_BITS)))


def shared_buckets(reps: DataFrame) -> DataFrame:
    """(band, place, rep, a, n) of the buckets with several classes; ``n`` is the bucket's size, ``a`` its leader.

    That is the class with the smallest first document, so most buckets of a group have the same.
    """
    buckets = reps.select("rep", "first", F.posexplode("bands").alias("place", "band"))
    leader = F.min(F.struct("first", "rep"))["rep"].alias("a")
    leaders = buckets.groupBy("band").agg(leader, F.count("*").alias("n")).where("n > 1")
    return written(buckets.drop("first").join(leaders, "band"), "buckets")


def leader_pairs(buckets: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): each class with the leader, of all its buckets, that its sketch is nearest to."""
    pairs = buckets.where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    sketch = reps.select("rep", "sketch")
    scored = (
        pairs.join(sketch.toDF("a", "sa"), "a").join(sketch.toDF("b", "sb"), "b")
        .select("a", "b", estimate("sa", "sb").alias("similar")).where(F.col("similar") >= PERCENT / 100 - MARGIN)
    )
    return scored.groupBy("b").agg(F.max_by("a", F.struct("similar", -F.col("a"))).alias("a")).select("a", "b")


def block_pairs(buckets: DataFrame, reps: DataFrame, component: DataFrame) -> DataFrame:
    """(a, b): classes of one bucket in different components whose sketches are near; found in bounded blocks.

    A pair that shares several buckets is returned by the first of them alone.
    """
    slim = buckets.join(component, "rep", "left").select(
        "band", "place", "rep", "n", F.coalesce("component", "rep").alias("component")
    )
    # Buckets of several components; those of one are settled.
    open_ = slim.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    open_ = open_.where("low < high").select("band")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = written(
        slim.join(open_, "band").select("*", blocks.alias("blocks"), F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("own")),
        "open",
    )
    met = placed.join(reps.select("rep", "size", "sketch", "parity", "bands"), "rep").withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    member = F.struct("rep", "component", "own", "size", "sketch", "parity", "bands")
    groups = met.groupBy(
        "band", "place", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    ).agg(F.collect_list(member).alias("members"))
    # The estimate is at least the cut up to this many odd bits.
    cut = PERCENT / 100 - MARGIN
    most = SKETCH_BITS / 2 * (1 - np.exp(4 * BANDS * ROWS / SKETCH_BITS * (cut - 1)))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Unsigned, as the bits of a negative number would be counted in its absolute value.
        wide = lambda x: x.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        for batch in batches:
            found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for place, low, high, members in zip(*(batch.column(i) for i in range(4))):
                flat, place, same = members.values, place.as_py(), low.as_py() == high.as_py()
                rep, comp, block, size = (
                    flat.field(x).to_numpy(zero_copy_only=False) for x in ("rep", "component", "own", "size")
                )
                sketch, parity, bands = (wide(flat.field(x)).reshape(len(rep), -1) for x in ("sketch", "parity", "bands"))
                right = np.flatnonzero(block == high.as_py())
                for i in np.flatnonzero(block == low.as_py()):
                    at = right[comp[right] != comp[i]]
                    if same:
                        at = at[rep[at] > rep[i]]
                    at = at[np.bitwise_count(sketch[at] ^ sketch[i]).sum(axis=1, dtype=np.int64) <= most]
                    # Odd bits of the full sets: no more than the symmetric difference, so this loses no link.
                    odd = np.bitwise_count(parity[at] ^ parity[i]).sum(axis=1, dtype=np.int64)
                    at = at[odd * (100 + PERCENT) <= (size[at] + size[i]) * (100 - PERCENT)]
                    at = at[(bands[at] == bands[i]).argmax(axis=1) == place]
                    found_a.append(np.minimum(rep[at], rep[i]))
                    found_b.append(np.maximum(rep[at], rep[i]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], names=["a", "b"]
            )

    return groups.select("place", "low", "high", "members").mapInArrow(near, "a bigint, b bigint")


def candidate_sets(buckets: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The full sets of all classes that share a bucket; only texts of their first documents are taken apart again."""
    asked = written(classes.join(buckets.select("rep").distinct(), "rep", "left_semi"), "candidates")
    ids = written(asked.select(F.col("first").alias("doc_id")).distinct().orderBy("doc_id"), "ids")
    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    # Another text of such a document has another digest. The sets are shuffled once, by digest.
    sets = full_sets(texts).dropDuplicates(["digest"]).join(asked.select("digest", "rep"), "digest")
    return written(sets.select("rep", "shingles"), "sets")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    sizes = both.select("a", "b", common.alias("common"), union.alias("union"))
    return sizes.where(100 * F.col("common") >= PERCENT * F.col("union")).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(rep, component) of every linked class: alternating large and small stars, each round written once."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "links")
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.explode(F.array("u", "v"))
        small = large.join(least, "u").select(ends.alias("u"), F.col("m").alias("v"))
        edges = written(small.where("u <> v").distinct(), "links")
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            return edges.select(F.col("u").alias("rep"), F.col("v").alias("component")).union(
                edges.select("v", "v").distinct()
            )
        state = seen


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, digest of the shingle set, n_shingles, component_id and kept of every document.

    A class is known by its set's digest and numbered; its first document is the one
    with the smallest doc_id, which other classes may share.
    """
    signed = written(signatures(docs.select("doc_id", "text")), "signatures")
    linked = signed.where("n_shingles > 0 and doc_id is not null")
    classes = linked.groupBy("digest").agg(F.min("doc_id").alias("first"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    # Rows of one class have the same signature.
    reps = written(
        linked.withColumn("first", F.col("doc_id")).join(classes, ["digest", "first"])
        .select("rep", "first", F.col("n_shingles").alias("size"), "bands", "sketch", "parity").dropDuplicates(["rep"]),
        "reps",
    )
    buckets = shared_buckets(reps)
    sets = candidate_sets(buckets, classes, docs)
    stars = written(confirm(leader_pairs(buckets, reps), sets), "stars")
    rest = written(block_pairs(buckets, reps, components(stars)), "pairs")
    component = components(stars.union(confirm(rest, sets)))
    of_class = classes.join(component, "rep", "left").select(
        "digest", "first", F.coalesce("component", "rep").alias("component")
    )
    smallest = of_class.groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = of_class.join(smallest, "component").select("digest", "component_id")
    named = signed.join(of_class, "digest", "left").select(
        "doc_id", "text_hash", "digest", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component"),
    )
    own = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    return named.select(
        "doc_id", "text_hash", "digest", "n_shingles", own.alias("component_id"),
        F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    An empty or null text has no shingles and is its own component. A null
    doc_id is linked with nothing, has a null component and is kept. Rows that
    repeat a doc_id get a row each, and different texts of one doc_id are linked
    each for itself: they share a component only if links join them, though the
    smallest doc_id of two components may be the same. Other columns are not read.
    """
    return labelled(docs).select("doc_id", "n_shingles", "component_id", "kept")


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents without all but the smallest doc_id of every group, with all their columns.

    Of rows with equal doc_id and equal shingle set one stays; different texts of
    one doc_id stay both. Rows without a doc_id all stay.
    """
    kept = labelled(docs).where("kept and doc_id is not null")
    kept = kept.groupBy("doc_id", "digest").agg(F.min("text_hash").alias("text_hash")).select("doc_id", "text_hash")
    # The row is packed, so that no column's name can clash.
    rows = docs.select("doc_id", text_hash(), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    named = rows.join(kept, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return named.union(rows.where("doc_id is null")).select("row.*")
