"""Operator 6: benchmark decontamination by a BM25 inverted index of test items with block-max WAND.

The test items are indexed in posting lists: for each term the items that hold it, in order, with the term's BM25
contribution divided by the item's threshold, so that an item is found at a sum of 1. Each list is cut into blocks at
fixed item numbers; a block knows its largest contribution and a list its own. Training texts are queried passage by
passage: windows of twice the longest item's words, stepping by that length, so every run of an item's length lies whole
in a window. For each window, as WAND does,

1. terms are ordered by their lists' maxima, and those whose maxima together stay below 1 open no block by themselves;
   a window whose maxima sum to less than 1 is skipped whole,
2. only blocks that the other terms reach are opened, and of them those skipped whose block maxima of all the window's
   terms sum to less than 1,
3. the postings of the remaining blocks are summed by item.

Many windows go through each step together. All items that reach 1 are then verified: of an item's five-word shingles at
least `overlap` must be in the window, and of its question's and its answer's shingles at least half each. Where an item
has no answer column its last third is the answer.

The threshold loses nothing. A passage that holds at least `overlap` of an item's shingles lacks at most m of them, and
a term can be lacking only with all shingles that hold it; if each term's contribution is shared out evenly to its
shingles, the terms that are lacking weigh at most what the m heaviest shingles have together. An item's threshold is
its own score without that.

Shards of at most `shard_items` items or SHARD_BYTES of text are built on the driver one at a time and written to the
shared folder; tasks read them from there, hold HELD of them, and take every batch of texts through all shards in one
pass, so a row stays one row.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, after lower-casing A-Z. An item of fewer
than five words is one shingle. Defined cases: null or empty texts have no passage; items without words are never
found and a null item_id is no item; a null doc_id stays null; rows that repeat give repeated rows; of items that repeat
each id is reported once, with its best overlap; ties don't matter, as every item above the threshold is taken; empty
tables give no findings; other columns are kept by `keep_clean` and not read by `contamination`, whatever their names.
One very long text is held by one task, but its windows are worked in parts.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_map, distinct, doc_columns, finish, scratch, slices, small_batches, utf8
from quillspark.llm.files import Reader, Writer
from quillspark.llm.words import hashed_words

SCHEMA = "doc_id long, n_passages long, item_ids array<long>, best_overlap double"
K1, B, OVERLAP, PART_OVERLAP, BLOCK, SHINGLE = 1.5, 0.75, 0.8, 0.5, 16, 5
SHARD_ITEMS, SHARD_BYTES, HELD = 4096, 8 << 20, 2
SLICE, WINDOWS = 512 << 10, 2048
#: Pairs of a block and a term that are worked together, about.
PAIRS = 1 << 18
#: Sums of 64-bit floats are compared with 1 less this.
SLACK = 1e-9
PARTS = ("question", "answer", "whole")
_FACTORS = np.random.default_rng(66).integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def runs(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of `size` words; of fewer words, of the whole."""
    if not len(words):
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    h = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        h += words[k : k + len(h)] * _FACTORS[k]
    return finish(h)


def expand(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, place) of every place of ranges begin..begin+size."""
    which = np.repeat(np.arange(len(begin)), size)
    return which, np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(len(which))


def needed(words: np.ndarray, weight: dict[int, float], overlap: float) -> float:
    """The least score of a passage that holds `overlap` of an item's shingles; see the module."""
    size = min(SHINGLE, len(words))
    shingles, first = np.unique(runs(words), return_index=True)
    holds = [np.unique(words[a : a + size]).tolist() for a in first]
    among: dict[int, int] = {}
    for own in holds:
        for t in own:
            among[t] = among.get(t, 0) + 1
    share = sorted((sum(weight[t] / among[t] for t in own) for own in holds), reverse=True)
    lacking = len(shingles) - int(np.ceil(overlap * len(shingles) - 1e-9))
    return sum(share[lacking:])


class Index:
    """Posting lists and shingles of items, (item_id, question, answer) of texts; arrays only, so it is saved as one file."""

    def __init__(self, items: list[tuple[int, str, str | None]], overlap: float = OVERLAP):
        ids, bags, parts_of = [], [], []
        for item_id, question, answer in items:
            parts = [hashed_words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for t in (question or "", answer or "")]
            words = np.concatenate(parts)
            if not len(words):
                continue
            if not len(parts[1]):
                cut = len(words) - len(words) // 3
                parts = [words[:cut], words[cut:]]
            ids.append(item_id)
            bags.append(words)
            parts_of.append((*parts, words))
        self.ids, n = np.array(ids, np.int64), len(ids)
        self.longest = max(map(len, bags), default=0)
        #: Shingle length of each part (five words, or all of a shorter part), and its shingles, one item after the other.
        for k, name in enumerate(PARTS):
            own = [np.unique(runs(p[k])) for p in parts_of]
            setattr(self, f"{name}_size", np.array([max(1, min(SHINGLE, len(p[k]))) for p in parts_of], np.int64))
            setattr(self, f"{name}_ends", np.cumsum([0, *map(len, own)]))
            setattr(self, name, np.concatenate([np.zeros(0, np.uint64), *own]))
        counted = [np.unique(words, return_counts=True) for words in bags]
        item = np.repeat(np.arange(n), [len(t) for t, _ in counted])
        term = np.concatenate([np.zeros(0, np.uint64), *(t for t, _ in counted)])
        tf = np.concatenate([np.zeros(0), *(c for _, c in counted)])
        self.terms, term, df = np.unique(term, return_inverse=True, return_counts=True)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        size = np.array([len(b) for b in bags], np.float64)
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / max(size.mean() if n else 1.0, 1.0)))
        edges = np.searchsorted(item, np.arange(n + 1))
        for k in range(n):
            own = slice(edges[k], edges[k + 1])
            impact[own] /= needed(bags[k], dict(zip(self.terms[term[own]].tolist(), impact[own].tolist())), overlap)
        order = np.lexsort((item, term))
        self.items, self.impacts, term = item[order].astype(np.int32), impact[order], term[order]
        # Blocks of postings: one term and BLOCK item numbers each.
        self.n_ranges = -(-n // BLOCK)
        key = term.astype(np.int64) * max(1, self.n_ranges) + self.items // BLOCK
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.block_key = key[heads]
        self.block_at = np.append(heads, len(key))
        self.block_most = np.maximum.reduceat(self.impacts, heads) if len(heads) else np.zeros(0)
        first = np.searchsorted(self.block_key, np.arange(len(self.terms) + 1) * max(1, self.n_ranges))
        self.term_blocks = first
        self.term_most = np.maximum.reduceat(self.block_most, first[:-1]) if len(self.terms) else np.zeros(0)

    def save(self, folder: str, stem: str) -> str:
        """The file's place."""
        body = io.BytesIO()
        np.savez(body, **vars(self))
        out = Writer(folder, stem, ".npz")
        out.write(body.getvalue())
        out.close()
        return out.uri

    @classmethod
    def load(cls, uri: str) -> Index:
        file = Reader(uri)
        got = np.load(io.BytesIO(file.read(0, file.size)))
        file.close()
        index = cls.__new__(cls)
        for name in got.files:
            setattr(index, name, got[name])
        return index

    def candidates(self, words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all items that reach their threshold in a window; begin and end in words."""
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.terms) or not len(words):
            return nothing
        term = np.searchsorted(self.terms, words)
        known = np.flatnonzero(self.terms[np.minimum(term, len(self.terms) - 1)] == words)
        a = np.searchsorted(known, begin)
        window, place = expand(a, np.searchsorted(known, end) - a)
        pair = distinct(window * np.int64(len(self.terms)) + term[known[place]])
        window, term = pair // len(self.terms), pair % len(self.terms)
        if not len(pair):
            return nothing
        # 1. Terms by their lists' maxima; the light ones below a sum of 1 open no block, light windows fall.
        most = self.term_most[term]
        order = np.lexsort((most, window))
        window, term, most = window[order], term[order], most[order]
        heads = np.flatnonzero(np.append(True, window[1:] != window[:-1]))
        sizes = np.diff(np.append(heads, len(window)))
        upto = np.cumsum(most)
        upto -= np.repeat(upto[heads] - most[heads], sizes)
        # One running sum over all windows: its rounding error is far below this.
        heavy = np.flatnonzero(upto >= 1 - 1e-6)
        if not len(heavy):
            return nothing
        of = np.repeat(np.arange(len(heads)), sizes)
        blocks = np.diff(self.term_blocks)[term]
        most_heavy = np.zeros(len(term), bool)
        most_heavy[heavy] = True
        # Windows without a heavy term fall here, the others go on some at a time, so that memory has a bound.
        going = np.flatnonzero(np.bincount(of[heavy], minlength=len(heads)))
        cost = np.add.reduceat(blocks, heads)[going]
        found = [nothing]
        for group in np.split(going, np.flatnonzero(np.diff(np.cumsum(cost) // PAIRS)) + 1):
            own, at = expand(heads[group], sizes[group])
            found.append(self._blocks(window[heads[group]], term[at], own, most_heavy[at], blocks[at]))
        return tuple(np.concatenate(c) for c in zip(*found))

    def _blocks(self, window, term, of, heavy, blocks) -> tuple[np.ndarray, np.ndarray]:
        """Steps 2 and 3 for some windows; `of` is each term's window among them."""
        # 2. Blocks of heavy terms are opened; of the opened ones, the block maxima of all terms are summed.
        which, block = expand(self.term_blocks[term], blocks)
        slot = of[which] * self.n_ranges + self.block_key[block] % self.n_ranges
        bound = np.bincount(slot, self.block_most[block], len(window) * self.n_ranges)
        still = np.zeros(len(bound), bool)
        still[slot[heavy[which]]] = True
        still &= bound >= 1 - SLACK
        left = np.flatnonzero(still[slot])
        if not len(left):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # 3. Postings of what is left.
        owner, place = expand(self.block_at[block[left]], np.diff(self.block_at)[block[left]])
        pair, at = np.unique(window[of[which[left]]][owner] * np.int64(len(self.ids)) + self.items[place], return_inverse=True)
        full = pair[np.bincount(at, self.impacts[place]) >= 1 - SLACK]
        return full // len(self.ids), full % len(self.ids)

    def overlap(self, passage: Passage, item: int) -> float:
        """Share of the item's shingles among a passage's; 0 where question or answer falls short."""
        shares = []
        for name in PARTS:
            size, ends = int(getattr(self, f"{name}_size")[item]), getattr(self, f"{name}_ends")
            own = getattr(self, name)[ends[item] : ends[item + 1]]
            if size > len(passage.words):
                return 0.0
            shares.append(passage.share(own, size))
        return shares[2] if min(shares[:2]) >= PART_OVERLAP else 0.0


class Passage:
    """A window's words, and its shingles of each length that is asked for."""

    def __init__(self, words: np.ndarray):
        self.words, self.known = words, {}

    def share(self, own: np.ndarray, size: int) -> float:
        if not len(own):
            return 1.0
        if size not in self.known:
            self.known[size] = distinct(runs(self.words, size))
        has = self.known[size]
        return float((has[np.minimum(np.searchsorted(has, own), len(has) - 1)] == own).mean())


def windows(doc: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, text) of passages in terms of word positions; `doc` is each word's text."""
    edges = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(edges, len(doc)))
    n = np.maximum(1, -(-sizes // longest) - 1)
    first = np.repeat(np.cumsum(n) - n, n)
    begin = np.repeat(edges, n) + (np.arange(len(first)) - first) * longest
    return begin, np.minimum(begin + 2 * longest, np.repeat(edges + sizes, n)), doc[begin]


class Shards:
    """Indexes of all items: `uris` of files and the longest item's words. A task loads what it needs."""

    def __init__(self, uris: list[str], longest: int):
        self.uris, self.longest = uris, longest

    def scan(self, data: np.ndarray, offsets: np.ndarray, held: dict[str, Index], overlap: float = OVERLAP) -> list[tuple[int, dict[int, float]]]:
        """For each text: number of passages, and overlap by item_id of the items found in it."""
        out: list[tuple[int, dict[int, float]]] = [(0, {}) for _ in range(len(offsets) - 1)]
        if not self.longest or not len(out):
            return out
        words, doc = hashed_words(data, offsets)
        begin, end, owner = windows(doc, self.longest)
        for d, n in zip(*(c.tolist() for c in np.unique(owner, return_counts=True))):
            out[d] = (n, {})
        for uri in self.uris:
            index = held.get(uri)
            if index is None:
                while len(held) >= HELD:
                    held.pop(next(iter(held)))
                index = held[uri] = Index.load(uri)
            for at in range(0, len(begin), WINDOWS):
                passage, last = None, -1
                first, to = begin[at : at + WINDOWS], end[at : at + WINDOWS]
                base = int(first[0])
                for w, item in zip(*(c.tolist() for c in index.candidates(words[base : int(to.max())], first - base, to - base))):
                    if w != last:
                        passage, last = Passage(words[first[w] : to[w]]), w
                    share = index.overlap(passage, item)
                    if share >= overlap:
                        found, name = out[owner[at + w]][1], int(index.ids[item])
                        found[name] = max(share, found.get(name, 0.0))
        return out


def build(items: DataFrame, overlap: float = OVERLAP, shard_items: int = SHARD_ITEMS, shard_bytes: int = SHARD_BYTES, id_col: str = "item_id", question_col: str = "text", answer_col: str | None = None) -> Shards:
    """Indexes every item; the driver holds one shard's texts at a time."""
    answer = F.col(f"`{answer_col}`").cast("string") if answer_col else F.lit(None).cast("string")
    rows = items.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{question_col}`").cast("string").alias("q"), answer.alias("a")).where("i is not null")
    folder, uris, longest, held, size = scratch(items.sparkSession, "items"), [], 0, [], 0

    def close() -> None:
        nonlocal longest, held, size
        index = Index(sorted(held, key=str), overlap)
        longest = max(longest, index.longest)
        if len(index.ids):
            uris.append(index.save(folder, f"shard-{len(uris)}"))
        held, size = [], 0

    for r in rows.toLocalIterator():
        held.append(tuple(r))
        size += len(r.q or "") + len(r.a or "")
        if len(held) >= shard_items or size >= shard_bytes:
            close()
    if held:
        close()
    return Shards(uris, longest)


def contamination(docs: DataFrame, items: DataFrame, overlap: float = OVERLAP, **settings) -> DataFrame:
    """(doc_id, n_passages, item_ids, best_overlap, contaminated) of every row."""
    shards = build(items, overlap, **settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Index] = {}
        for batch in slices(batches, _slice(shards)):
            found = shards.scan(*utf8(batch.column("text")), held, overlap)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([sorted(x) for _, x in found], pa.list_(pa.int64())), pa.array([max(x.values(), default=0.0) for _, x in found], pa.float64())],
                ["doc_id", "n_passages", "item_ids", "best_overlap"],
            )

    return arrow_map(doc_columns(docs), run, SCHEMA).withColumn("contaminated", F.size("item_ids") > 0)


def _slice(shards: Shards) -> int:
    """Bytes of text that go through the shards together: more where shards have to be read again for each."""
    return SLICE if len(shards.uris) <= HELD else 8 * SLICE


def keep_clean(docs: DataFrame, items: DataFrame, overlap: float = OVERLAP, text_col: str = "text", **settings) -> DataFrame:
    """The rows in which no item is found, with all their columns."""
    small_batches(docs.sparkSession)
    shards = build(items, overlap, **settings)
    names = docs.columns
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Index] = {}
        for batch in batches:
            for part in slices(iter([batch.rename_columns([f"c{k}" for k in range(len(names))])]), _slice(shards), f"c{place}"):
                found = shards.scan(*utf8(part.column(place)), held, overlap)
                yield part.filter(pa.array([not x for _, x in found], pa.bool_())).rename_columns(names)

    return arrow_map(docs, run, docs.schema)
