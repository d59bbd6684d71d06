"""Operator 8: near-duplicate detection by SuperMinHash, banding, verification and union-find.

Texts become sets of 64-bit hashes of word shingles. SuperMinHash gives each element one random rank per permutation
place, places being drawn by a correlated permutation (Fisher-Yates) rank by rank; a text stops as soon as no later rank
can lower a value. 128 values make 32 bands of 4. Texts with one and the same set are one class from here on.

Buckets (classes that share a band) are never compared by all pairs. In two rounds the class of each bucket that
shares most bands with others is its pivot, every class of another component is verified against it on the full sets,
and links merge components. A bucket whose classes are one component is done. The classes of buckets that are still
open are then joined exactly: each is indexed by its rarest shingles only, so many that two sets above the threshold
must have one of them in common (prefix filter), pairs must be able to reach the threshold behind that place and by
their sizes, and pairs within one component aren't made. Every pair that shares a bucket is so either verified, or ruled
out, or in one component already. At the thresholds used here (0.8 and more) two texts share no band with a
probability under 5e-8.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. A text's set: its distinct runs of `words` words; with fewer
words the whole sequence is the one element; without words the set is empty and linked with nothing. Links: 100 *
intersection >= percent * union. Component: the smallest doc_id that can be reached. Defined cases: null text is empty;
a row with a null doc_id is kept, has no component and is linked with nothing; rows that repeat a doc_id are one
document, linked with what any of them is linked with; empty tables give no rows; other columns are not read. One very
long text is held by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_map, doc_columns, finish, join_counted, materialize, slices, utf8
from quillspark.llm.components import components
from quillspark.llm.words import LOWER, byte_mask, spans, word_hashes

PLACES, ROWS = 128, 4
BANDS = PLACES // ROWS
#: Rounds of pivots before the exact join of what is left.
ROUNDS = 2
WORD = ~byte_mask([0x20, *range(9, 14)])
SIGNED = "doc_id long, n_shingles long, class_a long, class_b long, bands array<long>"


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each text's distinct shingle hashes, sorted."""
    n_docs = len(offsets) - 1
    starts, ends = spans(WORD[data], offsets)
    word = word_hashes(LOWER[data], starts, ends, seed=8)
    doc = np.searchsorted(offsets, starts, "right") - 1
    count = np.bincount(doc, minlength=n_docs)
    factors = np.random.default_rng(88).integers(0, 1 << 63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    runs = max(0, len(word) - words + 1)
    h = np.zeros(runs, np.uint64)
    for k in range(words):
        h += word[k : k + runs] * factors[k]
    whole = doc[:runs] == doc[words - 1 :] if runs else np.zeros(0, bool)
    h, owner = finish(h[whole]), doc[:runs][whole]
    first = np.cumsum(count) - count
    few = np.flatnonzero((count > 0) & (count < words))
    if len(few):
        short = np.zeros(len(few), np.uint64)
        for k in range(words - 1):
            has = count[few] > k
            short[has] += word[first[few[has]] + k] * factors[k]
        h = np.concatenate([h, finish(short + count[few].astype(np.uint64))])
        owner = np.concatenate([owner, few])
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(n_docs + 1)).tolist()
    for a, b in zip(bounds[:-1], bounds[1:]):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[keep], np.append(0, np.cumsum(np.bincount(owner[keep], minlength=n_docs)))


def superminhash(h: np.ndarray, offsets: np.ndarray, places: int = PLACES) -> np.ndarray:
    """Signature rows; a value is the rank (upper 16 bits) and the random fraction (lower 48). All ones: empty set."""
    n = len(offsets) - 1
    best = np.full((n, places), ~np.uint64(0), np.uint64)
    flat = best.reshape(-1)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    drawn: list[np.ndarray] = []
    for rank in range(places):
        if not len(h):
            break
        r = finish(h + np.uint64((rank * 0x9E3779B97F4A7C15 + 0x1234567) % (1 << 64)))
        at = (rank + (r & np.uint64(0xFFFF)) % np.uint64(places - rank)).astype(np.uint8)
        drawn.append(at)
        place = at.copy()
        for t in range(rank - 1, -1, -1):
            place[place == drawn[t]] = t
        np.minimum.at(flat, owner * places + place, (np.uint64(rank) << np.uint64(48)) | (r >> np.uint64(16)))
        active = np.unique(owner)
        done = active[best[active].max(1) >> np.uint64(48) <= rank]
        if len(done):
            off = np.zeros(n, bool)
            off[done] = True
            keep = ~off[owner]
            h, owner, drawn = h[keep], owner[keep], [d[keep] for d in drawn]
    return best


def band_keys(signatures: np.ndarray) -> np.ndarray:
    factors = np.random.default_rng(99).integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    rows = signatures.reshape(len(signatures), BANDS, ROWS)
    h = np.zeros(rows.shape[:2], np.uint64)
    for k in range(ROWS):
        h = (h ^ rows[:, :, k]) * factors[k]
        h ^= h >> np.uint64(31)
    return finish(h + np.arange(BANDS, dtype=np.uint64))


def sign(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            h, ends = shingles(*utf8(batch.column("text")), words)
            bands = band_keys(superminhash(h, ends)).view(np.int64)
            raw = h.tobytes()
            edges = (ends * 8).tolist()
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(edges[:-1], edges[1:])), np.int64).reshape(-1, 2)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends)), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), lists], ["doc_id", "n_shingles", "class_a", "class_b", "bands"])

    return arrow_map(docs, run, SIGNED)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            h, ends = shingles(*utf8(batch.column("text")), words)
            raw, edges = h.tobytes(), (ends * 8).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([raw[a:b] for a, b in zip(edges[:-1], edges[1:])], pa.binary())], ["doc_id", "hashes"])

    return arrow_map(docs, run, "doc_id long, hashes binary")


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("ha").to_pylist(), batch.column("hb").to_pylist(), strict=True):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = np.concatenate([a, b])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _open(members: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """(key, rep, n, root, size) of the keys whose classes are in two components or more."""
    placed = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    several = placed.groupBy(key).agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).where("low != high").select(key, "size")
    return join_counted(placed, materialize(several, "several"), [key], ["rep"], "size")


def _sizes_fit(n, m, percent: int):
    return (n * 100 >= m * percent) & (m * 100 >= n * percent)


def _star_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Each bucket's classes with its pivot, the class that shares most bands with others."""
    degree = members.groupBy("rep").agg(F.sum("size").alias("degree"))
    pivots = members.join(degree, "rep").groupBy("key").agg(F.max(F.struct("degree", (-F.col("rep")).alias("least"), F.col("n").alias("m"), F.col("root").alias("to"))).alias("p"), F.first("size").alias("size"))
    pivots = materialize(pivots.select("key", "size", (-F.col("p.least")).alias("pivot"), F.col("p.m").alias("m"), F.col("p.to").alias("to")), "pivots")
    met = join_counted(members.drop("size"), pivots, ["key"], ["rep"], "size")
    return met.where((F.col("root") != F.col("to")) & _sizes_fit(F.col("n"), F.col("m"), percent)).select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b")).distinct()


def _prefix_pairs(members: DataFrame, sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components among the classes of open buckets that may reach the threshold.

    Shingles are ordered by how many of these classes have them, and then by hash.
    """
    active = members.select(F.col("rep").alias("doc_id")).distinct()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
                h = np.frombuffer(raw, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), doc_id))], ["token", "rep"])

    tokens = materialize(sets.join(active, "doc_id", "left_semi").mapInArrow(unpack, "token long, rep long"), "tokens")
    counted = join_counted(tokens, materialize(tokens.groupBy("token").agg(F.count("*").alias("c")), "token-counts"), ["token"], ["rep"])
    # One text's shingles are gathered, no more.
    own = counted.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("all")).withColumn("n", F.size("all").cast("long"))
    first = F.slice("all", F.lit(1), (F.col("n") - F.ceil(F.col("n") * percent / 100 - 1e-9) + 1).cast("int"))
    # A shingle of one class alone holds its place, but can't be in common.
    index = own.select("rep", "n", F.posexplode(first).alias("place", "t")).where("t.c > 1").select(F.col("t.token").alias("token"), "rep", "n", "place")
    rows = _open(materialize(index, "prefixes"), roots, "token")
    rows = materialize(rows, "open-prefixes")
    # All but the largest component of a token's classes meet all of them.
    most = rows.groupBy("token", "root").count().groupBy("token").agg(F.max_by("root", F.struct("count", "root")).alias("most"))
    few = rows.join(most, "token").where("root != most").select("token", F.col("rep").alias("other"), F.col("n").alias("m"), F.col("place").alias("at"), F.col("root").alias("to"))
    least = F.ceil((F.col("n") + F.col("m")) * percent / (100 + percent) - 1e-9)
    reach = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("at")) >= least
    counts = materialize(rows.groupBy("token").agg(F.count("*").alias("c")), "open-counts")
    return join_counted(rows, few, ["token"], ["rep"], counts=counts).where((F.col("root") != F.col("to")) & _sizes_fit(F.col("n"), F.col("m"), percent) & reach).select(F.least("other", "rep").alias("a"), F.greatest("other", "rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    docs = doc_columns(docs)
    signed = materialize(sign(docs, words), "signed")
    taking = signed.where("doc_id is not null and n_shingles > 0")
    classes = taking.groupBy("class_a", "class_b").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    rows = classes.select("rep", "n", F.explode("bands").alias("key"))
    shared = materialize(rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    members = materialize(join_counted(rows, shared, ["key"], ["rep"]).drop("c"), "members")
    sets = materialize(_sets(docs.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), words), "sets")
    spark = docs.sparkSession
    links = spark.createDataFrame([], "a long, b long")
    tested, roots = links, spark.createDataFrame([], "node long, root long")
    copies = taking.join(classes.select("class_a", "class_b", "rep"), ["class_a", "class_b"]).where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    for turn in range(ROUNDS + 1):
        members = materialize(_open(members, roots, "key"), "members")
        if members.isEmpty():
            break
        pairs = _star_pairs(members, percent) if turn < ROUNDS else _prefix_pairs(members, sets, roots, percent)
        pairs = materialize(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        found = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("hb")), "b").mapInArrow(_verify(percent), "a long, b long")
        links = links.unionByName(materialize(found, "found"))
        tested = tested.unionByName(pairs)
        if turn < ROUNDS:
            roots = components(links, turns=2, whole=False)
        members = members.select("key", "rep", "n")
    final = components(links.unionByName(copies))
    # Few nodes hang on another; both sides of this join are one row per doc_id or more.
    out = signed.select("doc_id", "n_shingles").join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group stays, with all its columns: that of the smallest doc_id; of rows that repeat it, one."""
    found = near_duplicates(docs, words, percent)
    gone = found.where("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    again = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return left
    single = left.join(again, "doc_id", "left_anti")
    return single.unionByName(left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
