"""Operator 5: exact substring deduplication by longest-previous-factor arrays.

A byte is removed if a string of `length` bytes that covers it also begins elsewhere, in another text or the same one:
elsewhere at all (`keep="none"`), or earlier in the order of (doc_id, place) so that first copies stay (`keep="first"`).

One suffix array over all texts would be one task's work, so suffixes are first brought together by content. Every
window of `length` bytes has an anchor: the 32-byte string in it with the smallest hash, the last of equals. Equal
windows have equal anchors at equal places, so only windows with one anchor need a common suffix array. Neighbouring
windows with the same anchor are a block. Steps:

1. Anchors that occur once drop out. Equal blocks become one with a weight, the number of its copies (by a digest of 64
   bits beside the anchor's 64).
2. The bytes of one copy of every block whose anchor repeats are fetched. Buckets of anchors become texts of bounded size;
   their suffixes are ranked by prefix doubling to `length` bytes, as far as windows lead to them, and previous and next
   smaller positions in suffix order tell which windows have an earlier (or, from the other end, a later) match of `length` bytes or more. A block of weight
   two or more takes part with two positions. All copies of a block get what was found for it.
3. Anchors with more different blocks than `DIFFERENT` don't fit one suffix array. One copy of each of their blocks is cut
   by the place of the anchor in the window into cells of CELL windows, under a longer key: all bytes that a cell's windows
   share. Equal windows have equal keys, so cells go through step 2 like blocks, with their blocks' weights. Where a key
   still has too many different cells, they are cut into single windows, whose key is all of their bytes: nothing differs
   under such a key, and its weight alone is the number of its positions.

Copies of a hot block, and blocks of a hot anchor, are joined in parts (`join_counted`). Ranges go back to their texts by
one join. Defined cases: null text is the empty text and has nothing to remove; rows are told apart by doc_id and
content; rows that repeat both are copies of each other, and with `keep="first"` all of them stay or go alike (they have
one place); a null doc_id is a doc_id of its own before all others; empty tables give no rows; other columns are not
read. One very long text is held by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_map, byte_table, doc_columns, finish, join_counted, materialize, partitions, slices, utf8
from quillspark.llm.suffixes import has_other, prefix_ranks
from quillspark.llm.words import spans

LENGTH, GRAM = 200, 32
#: Bits of a window key that hold the place; texts are worked in pieces of less than this.
PLACE_BITS = 22
PIECE = 1 << 21
#: Different blocks of an anchor that one suffix array takes: about 1 MB of bytes.
DIFFERENT = 4096
#: Windows of a cell.
CELL = 11
#: Anchors share a suffix array up to this size: below 64 KB it is sorted in the fewest turns and stays in the cache.
BUCKET_BYTES = 56 << 10
#: `at`: how far behind the first window's begin the anchor lies.
BLOCKS = "anchor long, digest long, doc_id long, row long, begin long, n int, at int"
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def window_anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every GRAM bytes, place of the anchor of every window)."""
    h = byte_table(5)[data]
    for k, factor in enumerate(_FACTORS):
        h = h[: -(1 << k)] * np.uint64(factor) + h[1 << k :]
    finish(h)
    low = np.uint64((1 << PLACE_BITS) - 1)
    # Smallest upper bits first, then the last place.
    least = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    width, have = length - GRAM + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return h, (low - (least & low)).astype(np.int64)


def blocks(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, windows, anchor's place behind the first window) of the blocks of texts that lie one after the other."""
    hashes, begins, sizes, places = [], [], [], []
    n = np.maximum(np.diff(offsets) - length + 1, 0)
    whole = np.repeat(np.tile([True, False], len(n)), np.stack([n, np.diff(offsets) - n], 1).ravel())
    for at in range(0, max(1, len(data) - length + 1), piece):
        part = data[at : at + piece + length - 1]
        if len(part) < length:
            break
        h, anchor = window_anchors(part, length)
        inside = np.flatnonzero(whole[at : at + len(anchor)])
        if not len(inside):
            continue
        anchor, start = anchor[inside], inside + at
        new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)))
        hashes.append(h[anchor[new]])
        begins.append(start[new])
        sizes.append(np.diff(np.append(new, len(start))))
        places.append(anchor[new] + at - start[new])
    if not hashes:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    return tuple(map(np.concatenate, (hashes, begins, sizes, places)))


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text): (doc_id, row) tells rows apart unless they are equal."""
    return doc_columns(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")


def _batch(anchor, body: bytes, begin, n, at, length: int, owner, offsets, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of BLOCKS; begin is a place in `body`, where all texts of the batch lie one after the other."""
    digest = np.fromiter((xxhash.xxh3_64_intdigest(body[a:b], 5) for a, b in zip(begin.tolist(), (begin + n + length - 1).tolist())), np.uint64, len(begin))
    of = pa.array(owner)
    columns = [pa.array(anchor.view(np.int64)), pa.array(digest.view(np.int64)), batch.column("doc_id").take(of), batch.column("row").take(of), pa.array(begin - offsets[owner]), pa.array(n.astype(np.int32)), pa.array(at.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in BLOCKS.split(", ")])


def _blocks(rows: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512 << 10):
            data, offsets = utf8(batch.column("text"))
            anchor, begin, n, at = blocks(data, offsets, length)
            yield _batch(anchor, data.tobytes(), begin, n, at, length, np.searchsorted(offsets, begin, "right") - 1, offsets, batch)

    return arrow_map(rows, run, BLOCKS)


def _anchors(rows: DataFrame, length: int) -> DataFrame:
    """(anchor) of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512 << 10):
            yield pa.RecordBatch.from_arrays([pa.array(blocks(*utf8(batch.column("text")), length)[0].view(np.int64))], ["anchor"])

    return arrow_map(rows.select("text"), run, "anchor long")


def cells(begin: np.ndarray, n: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(block, first window, windows, anchor's place, cell) of the cells of blocks; in a cell the anchor's place, divided by `width`, is one."""
    low, high = (at - n + 1) // width, at // width
    count = high - low + 1
    block = np.repeat(np.arange(len(begin)), count)
    cell = np.repeat(high, count) - (np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count))
    # Places fall from window to window: the cell's first window has the largest.
    first = np.minimum(at[block], (cell + 1) * width - 1)
    last = np.maximum((at - n + 1)[block], cell * width)
    return block, begin[block] + at[block] - first, first - last + 1, first, cell


def cut_cells(blocks: list[dict], width: int, length: int) -> pa.RecordBatch:
    """Rows of PARTS: the cells of blocks (with their bytes), under keys of all bytes that a cell's windows share."""
    begin = np.zeros(len(blocks), np.int64)
    n, at = (np.array([b[k] for b in blocks], np.int64) for k in ("n", "at"))
    block, first, size, place, cell = cells(begin, n, at, width)
    low = first + place - cell * width
    high = first + place + length - np.minimum((cell + 1) * width - 1, length - GRAM)
    out = []
    for k, a, m, p, x, y, c in zip(*(v.tolist() for v in (block, first, size, place, low, high, cell))):
        b = blocks[k]
        body = b["bytes"]
        part = body[a : a + m + length - 1]
        out.append((xxhash.xxh3_64_intdigest(body[x:y], c) - (1 << 63), xxhash.xxh3_64_intdigest(part, 5) - (1 << 63), b["c"], b["doc_id"], b["row"], b["begin"] + a, m, p, part, b["block_anchor"], b["block_digest"], b["off"] + a))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else ([],) * len(PART_TYPES), PART_TYPES)], PART_NAMES)


def _with_text(rows: DataFrame, per_row: DataFrame, *columns: str) -> DataFrame:
    """Texts with what belongs to them; null doc_ids match too."""
    key = rows.doc_id.eqNullSafe(per_row.doc_id) & (rows.row == per_row.row)
    return rows.join(per_row, key).select(rows.doc_id, rows.row, "text", *(per_row[c] for c in columns))


ORDER = ("doc_id", "row", "begin")
#: Blocks or their cells with bytes: key, content, weight, place in a text, windows, the anchor's place, and of which block
#: they are which part. The key of a block is its anchor.
PARTS = "anchor long, digest long, c long, doc_id long, row long, begin long, n int, at int, bytes binary, block_anchor long, block_digest long, off int"
PART_NAMES = [x.split()[0] for x in PARTS.split(", ")]
PART_TYPES = (pa.int64(),) * 6 + (pa.int32(),) * 2 + (pa.binary(),) + (pa.int64(),) * 2 + (pa.int32(),)
HITS = "anchor long, digest long, c long, begins array<int>, ends array<int>"


def _fetch(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(PARTS, hot) of the wanted blocks."""
    fields = ("anchor", "digest", "c", "begin", "n", "at", "hot")
    per_row = wanted.groupBy("doc_id", "row").agg(F.collect_list(F.struct(*fields)).alias("blocks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512 << 10):
            data, offsets = utf8(batch.column("text"))
            lists = batch.column("blocks")
            owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy())
            flat = lists.flatten()
            anchor, digest, c, begin, n, at, hot = (flat.field(k) for k in range(len(fields)))
            first = begin.to_numpy() + offsets[owner]
            body, of = data.tobytes(), pa.array(owner)
            bytes_of = pa.array([body[a:b] for a, b in zip(first.tolist(), (first + n.to_numpy() + length - 1).tolist())], pa.binary())
            columns = (anchor, digest, c, batch.column("doc_id").take(of), batch.column("row").take(of), begin, n, at, bytes_of, anchor, digest, pa.array(np.zeros(len(owner), np.int32)))
            yield pa.RecordBatch.from_arrays([*(x.cast(k) for x, k in zip(columns, PART_TYPES)), hot], [*PART_NAMES, "hot"])

    return arrow_map(_with_text(rows, per_row, "blocks"), run, PARTS + ", hot boolean")


def _cut(parts: DataFrame, width: int, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                yield cut_cells(batch.slice(begin, 512).to_pylist(), width, length)

    return arrow_map(parts.select(*PART_NAMES), run, PARTS)


def repeated_windows(body: np.ndarray, offsets: np.ndarray, weights: np.ndarray, length: int, keep: str) -> tuple[np.ndarray, np.ndarray]:
    """(which windows of texts that lie one after the other also occur elsewhere among them (`none`) or earlier (`first`),
    where each text's windows begin and the last one's end); with `none` a text of weight two or more is there twice."""
    n = np.maximum(np.diff(offsets) - length + 1, 0)
    ends = np.append(0, np.cumsum(n))
    place = np.repeat(offsets[:-1] - ends[:-1], n) + np.arange(ends[-1])
    rank = prefix_ranks(body, length, place)
    if keep == "first":
        return has_other(rank)[0], ends
    # Second positions lie behind all others.
    earlier, later = has_other(np.append(rank, rank[np.repeat(weights > 1, n)]))
    return (earlier | later)[: len(rank)], ends


def _suffixes(length: int, keep: str):
    """HITS of blocks that come sorted by anchor and place; ranges count from the block's begin."""
    names = [x.split()[0] for x in HITS.split(", ")]

    def work(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.concat_batches(held)
        weights = rows.column("c").to_numpy()
        hit, ends = repeated_windows(*utf8(rows.column("bytes")), weights, length, keep)
        first, last = spans(hit, ends)
        of = np.searchsorted(ends, first, "right") - 1
        count = np.bincount(of, minlength=len(weights))
        told = np.flatnonzero((count > 0) | (weights > 1))
        offsets = pa.array(np.append(0, np.cumsum(count[told])).astype(np.int32))
        ranges = [pa.ListArray.from_arrays(offsets, pa.array((x - ends[of]).astype(np.int32))) for x in (first, last + (length - 1))]
        return pa.RecordBatch.from_arrays([*(rows.column(c).take(pa.array(told)) for c in names[:3]), *ranges], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, before = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.select(["anchor", "digest", "c", "bytes"])
            anchor, ends, begin = batch.column("anchor").to_numpy(), utf8(batch.column("bytes"))[1], 0
            for k in np.flatnonzero(np.append(before not in (None, anchor[0]), anchor[1:] != anchor[:-1])).tolist():
                if size + ends[k] - ends[begin] > BUCKET_BYTES:
                    yield work([*held, batch.slice(begin, k - begin)])
                    held, size, begin = [], 0, k
            held.append(batch.slice(begin))
            size, before = size + ends[-1] - ends[begin], anchor[-1]
        if held:
            yield work(held)

    return run


def _other(c: str = "first"):
    """Whether a row is another copy than the first."""
    return ~F.struct(*ORDER).eqNullSafe(F.struct(*(F.col(f"{c}.{x}") for x in ORDER)))


def _ranges(taken: DataFrame, length: int, keep: str) -> DataFrame:
    """`begins` and `ends` of a part's removed ranges from those of its content's first copy: other copies go whole with "first"."""
    if keep == "none":
        return taken
    whole = F.col("first").isNotNull() & _other()
    return taken.withColumns({"begins": F.when(whole, F.array(F.lit(0))).otherwise(F.col("begins")), "ends": F.when(whole, F.array(F.col("n") + (length - 1))).otherwise(F.col("ends"))})


def _hits(parts: DataFrame, length: int, keep: str) -> DataFrame:
    n = partitions(parts.sparkSession)
    return arrow_map(parts.repartition(n, "anchor").sortWithinPartitions("anchor", *ORDER), _suffixes(length, keep), HITS)


def _wide_hits(blocks: DataFrame, length: int, keep: str) -> DataFrame:
    """HITS of blocks whose anchors have too many different ones, by cells and single windows."""
    found, parts = None, blocks
    for width in (CELL, 1):
        parts = materialize(_cut(parts, width, length), "cells")
        copies = parts.groupBy("anchor", "digest").agg(F.sum("c").alias("weight"), F.count("*").alias("c"), F.min(F.struct(*ORDER)).alias("first"))
        copies = materialize(copies, "cell-copies")
        if width == 1:
            # Under a key of a whole window nothing differs.
            twice = F.col("weight") > 1 if keep == "none" else F.lit(False)
            whole = F.when(twice, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
            hits = copies.select("anchor", "digest", "c", "first", whole.alias("begins"), F.transform(whole, lambda x: x + length).alias("ends"))
            wide = None
        else:
            differ = materialize(copies.groupBy("anchor").agg(F.count("*").alias("different"), F.sum("c").alias("every")), "cell-keys")
            wide = differ.where(F.col("different") > DIFFERENT).select("anchor", F.col("every").alias("c"))
            few = join_counted(copies, differ.drop("every"), ["anchor"], ["digest"], "different").where(F.col("different") <= DIFFERENT)
            # The bytes of one cell of each content.
            firsts = join_counted(parts.drop("c"), few.select("anchor", "digest", "c", "weight", "first"), ["anchor", "digest"], list(ORDER)).where(~_other())
            hits = _hits(firsts.withColumn("c", F.col("weight")).dropDuplicates(["anchor", "digest"]), length, keep).drop("c").join(few.select("anchor", "digest", "c", "first"), ["anchor", "digest"], "right" if keep == "first" else "inner")
            hits = hits.withColumns({x: F.coalesce(x, F.array().cast("array<int>")) for x in ("begins", "ends")})
        hits = materialize(hits, "cell-hits")
        taken = _ranges(join_counted(parts.drop("bytes", "c"), hits, ["anchor", "digest"], list(ORDER)), length, keep).where(F.size("begins") > 0)
        move = lambda c: F.transform(c, lambda x: x + F.col("off"))
        taken = taken.select(F.col("block_anchor").alias("anchor"), F.col("block_digest").alias("digest"), move("begins").alias("begins"), move("ends").alias("ends"))
        found = taken if found is None else found.unionByName(taken)
        if wide is None or wide.isEmpty():
            break
        parts = join_counted(parts.withColumnRenamed("c", "weight"), wide, ["anchor"], list(ORDER)).withColumn("c", F.col("weight")).select(*PART_NAMES)
    # A block's cells are as many as its windows at most.
    found = found.groupBy("anchor", "digest").agg(F.flatten(F.collect_list("begins")).alias("begins"), F.flatten(F.collect_list("ends")).alias("ends"))
    return found.join(blocks.select("anchor", "digest", "c"), ["anchor", "digest"]).select("anchor", "digest", "c", "begins", "ends")


def removed_ranges(docs: DataFrame, length: int = LENGTH, keep: str = "none") -> DataFrame:
    """(doc_id, row, begin, end) of bytes to remove; ranges may overlap."""
    if keep not in ("none", "first") or length < 2 * GRAM:
        raise ValueError(f'keep is "none" or "first", length at least {2 * GRAM}')
    rows = _rows(docs)
    counts = materialize(_anchors(rows, length).groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1"), "anchors")
    found = materialize(join_counted(_blocks(rows, length), counts, ["anchor"], list(ORDER)).drop("c"), "blocks")
    copies = materialize(found.groupBy("anchor", "digest").agg(F.count("*").alias("c"), F.min(F.struct(*ORDER, "n", "at")).alias("first")), "copies")
    differ = materialize(copies.groupBy("anchor").agg(F.count("*").alias("different")), "anchors")
    wanted = join_counted(copies, differ, ["anchor"], ["digest"], "different")
    wanted = wanted.select("anchor", "digest", "c", "first.*", (F.col("different") > DIFFERENT).alias("hot"))
    fetched = _fetch(rows, wanted, length)
    several = not differ.where(F.col("different") > DIFFERENT).isEmpty()
    fetched = materialize(fetched, "fetched") if several else fetched
    # Rows that repeat both doc_id and text give their blocks once each; one of them is enough.
    hits = _hits(fetched.where("not hot"), length, keep)
    if several:
        hits = hits.unionByName(_wide_hits(fetched.where("hot").drop("hot").dropDuplicates(["anchor", "digest"]), length, keep))
    hits = hits.groupBy("anchor", "digest", "c").agg(F.first("begins").alias("begins"), F.first("ends").alias("ends"))
    if keep == "first":
        hits = hits.join(copies.where("c > 1").select("anchor", "digest", F.col("c").alias("copies"), "first"), ["anchor", "digest"], "full")
        hits = hits.select("anchor", "digest", F.coalesce("c", "copies").alias("c"), "first", *(F.coalesce(x, F.array().cast("array<int>")).alias(x) for x in ("begins", "ends")))
    hits = materialize(hits, "hits")
    taken = _ranges(join_counted(found, hits, ["anchor", "digest"], list(ORDER)), length, keep)
    taken = taken.select("doc_id", "row", "begin", F.explode(F.arrays_zip(F.col("begins").alias("b"), F.col("ends").alias("e"))).alias("r"))
    return taken.select("doc_id", "row", (F.col("begin") + F.col("r.b")).alias("begin"), (F.col("begin") + F.col("r.e")).alias("end"))


def deduplicate(docs: DataFrame, length: int = LENGTH, keep: str = "none") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row; kept as bytes, since cuts may fall within a character."""
    rows = _rows(docs)
    # At most a range for each byte of a text; equal ranges of repeated rows meet here.
    ranges = removed_ranges(docs, length, keep).groupBy("doc_id", "row", "begin").agg(F.max("end").alias("end")).groupBy("doc_id", "row").agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends"))
    ranges = materialize(ranges, "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            data, offsets = utf8(batch.column("text"))
            body, out = data.tobytes(), []
            for d, a, b, begins, ends in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), batch.column("begins"), batch.column("ends")):
                text = body[a:b]
                if not begins.is_valid:
                    out.append((d, b - a, 0, 0, text))
                    continue
                s, e = begins.values.to_numpy(), ends.values.to_numpy()
                by = np.argsort(s, kind="stable")
                s, e = s[by], np.maximum.accumulate(e[by])
                first = np.append(True, s[1:] > e[:-1])
                s, e = s[first], e[np.append(first[1:], True)]
                kept = b"".join(text[x:y] for x, y in zip([0, *e.tolist()], [*s.tolist(), b - a]))
                out.append((d, b - a, b - a - len(kept), len(s), kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(),) * 4 + (pa.binary(),))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    key = rows.doc_id.eqNullSafe(ranges.doc_id) & (rows.row == ranges.row)
    return arrow_map(rows.join(ranges, key, "left").select(rows.doc_id, "text", "begins", "ends"), run, SCHEMA)


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
