"""Operator 10: byte-level BPE with reuse of content-defined chunks.

A rolling hash over the last 16 bytes cuts a text into chunks, so equal passages of different documents give equal
chunks, whatever precedes them. Every chunk that occurs twice or more is encoded once in the whole table:

1. each task writes the 128-bit digests of its chunks with the input split they come from, its cell;
2. digests are counted; a chunk that repeats is encoded in the smallest of its cells;
3. the ids go to all cells that hold the chunk: a folder for each cell, which is never larger than the cell's texts;
4. the texts are read again and put together, from their cell's chunks and from chunks that occur once.

Only digests and ids of repeated chunks move, never texts. A cell is a file and the place where a split of it begins;
a table that doesn't come straight from files is written first. Should Spark split the files otherwise the next time, the
folders don't fit and chunks are encoded anew: the result is the same.

Pieces and joins between safe cuts go to the library as longer texts; ids are dealt back by the bytes they stand for.

Of a chunk, the ids between its first and its last safe cut are reused. Joins are repaired by re-encoding everything from
the last safe cut before a join to the first one after it, together with one more piece on either side: the library's
ids must begin and end with the ids of these pieces. Where they don't, the region takes in its neighbours, twice as many
each time, until both agree or it is the whole text. A safe cut lies before a space that follows a character which isn't
white space. No rule of the pre-tokenizer reaches over such a place and none looks back. That holds for byte-level BPE as
`exact` tests it; with any other tokenizer whole texts go to the library.

Defined cases: null text is the empty text, which has no ids; a null doc_id stays null; repeated rows give repeated
rows; an empty table gives an empty result; other columns are not read. One very long text is held by one task.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_map, byte_table, doc_columns, join_counted, materialize, partitions, places, reads_files, scratch, slices, utf8
from quillspark.llm.files import store
from quillspark.llm.words import byte_mask, word_hashes

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
SCHEMA_IDS = "doc_id long, ids binary"
#: Letters of one byte, and of two bytes by their second byte after 0xC3.
LETTER = byte_mask([*range(65, 91), *range(97, 123)])
LATIN = byte_mask([*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)])
PRINTED = byte_mask(range(0x21, 0x7F))
WINDOW = 16
#: Bytes of parts that go to the library as one text.
TOGETHER = 1 << 12


def default_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class TwoAges:
    """A bounded cache: what was used since the last turn survives the next one."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def get(self, key):
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def turn(self, more: int = 1) -> None:
        """Before `more` entries come."""
        if self.young and len(self.young) + more > self.limit:
            self.old, self.young = self.young, {}

    def put(self, key, value) -> None:
        self.turn()
        self.young[key] = value


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def safe_cuts(data: np.ndarray) -> np.ndarray:
    """Positions of safe cuts: a space after a printable ASCII character or a letter of two bytes."""
    p = np.flatnonzero(data[1:] == 0x20) + 1
    before, second = data[p - 1], data[np.maximum(p - 2, 0)]
    return p[PRINTED[before] | ((before >= 0x80) & (second >= 0xC3) & (second <= 0xDF))]


def take(pool: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Parts of a pool, one after the other."""
    ends = np.cumsum(size)
    at = np.repeat(place - (ends - size), size)
    at += np.arange(len(at))
    return pool[at]


def token_bytes(tokenizer) -> dict[int, bytes]:
    """The bytes that each id of a byte-level BPE stands for."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
    known = byte_of.keys()
    return {k: bytes(map(byte_of.__getitem__, text)) if known >= set(text) else text.encode() for text, k in tokenizer.get_vocab(with_added_tokens=True).items()}


class Words:
    """Ids of pieces by two 64-bit hashes: sorted arrays of bounded length, so a piece takes some tens of bytes."""

    def __init__(self, limit: int):
        self.limit, self.turn = limit, 0
        self.key, self.second = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.place, self.size, self.used = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool, self.end = np.zeros(1 << 16, np.uint32), 0

    def find(self, key: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Where pieces are; -1: nowhere."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        at = np.where((self.key[at] == key) & (self.second[at] == second), at, -1)
        self.used[at[at >= 0]] = self.turn
        return at

    def add(self, key: np.ndarray, second: np.ndarray, new: np.ndarray, size: np.ndarray) -> None:
        """Adds pieces that are not there, in order of key; `new` has their ids in turn."""
        size = size.astype(np.int32)
        while self.end + len(new) > len(self.pool):
            self.pool = np.append(self.pool, np.zeros(len(self.pool), np.uint32))
        self.pool[self.end : self.end + len(new)] = new
        at = np.searchsorted(self.key, key)
        place = self.end + np.cumsum(size, dtype=np.int64) - size
        self.end += len(new)
        for name, value in (("key", key), ("second", second), ("place", place), ("size", size), ("used", np.full(len(key), self.turn, np.int32))):
            setattr(self, name, np.insert(getattr(self, name), at, value))

    def next(self) -> None:
        """Before a batch: beyond the limit the half that was used last stays."""
        self.turn += 1
        if len(self.key) > self.limit:
            keep = np.sort(np.argsort(-self.used, kind="stable")[: self.limit // 2])
            self.pool = np.append(take(self.pool, self.place[keep], self.size[keep]), np.zeros(1 << 16, np.uint32))
            self.key, self.second, self.size, self.used = (x[keep] for x in (self.key, self.second, self.size, self.used))
            self.place = np.cumsum(self.size, dtype=np.int64) - self.size
            self.end = int(self.size.sum())


class PieceEncoder:
    """Encodes parts of texts that begin and end where pre-tokens do, piece by piece: a distinct piece goes to the library
    once for as long as it is remembered."""

    def __init__(self, tokenizer, limit: int = 600_000):
        self.tokenizer, self.known, self.sizes = tokenizer, Words(limit), None

    def library(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of texts that lie one after the other, where each text's begin and the last one's end). Where a text ends with a
        printed character and the next begins with a space, a safe cut lies between them, so both go as one, and their ids
        are told apart by the bytes they stand for."""
        if self.sizes is None:
            tokens = token_bytes(self.tokenizer)
            self.sizes = np.zeros(max(tokens, default=0) + 1, np.int64)
            self.sizes[list(tokens)] = [len(x) for x in tokens.values()]
        filled, inner = np.diff(edges) > 0, edges[1:-1]
        joined = filled[:-1] & filled[1:] & (inner // TOGETHER == edges[:-2] // TOGETHER)
        near = np.flatnonzero(joined)
        joined[near] = PRINTED[data[inner[near] - 1]] & (data[inner[near]] == 0x20)
        at, body = np.concatenate([edges[:1], inner[~joined], edges[-1:]]).tolist(), data.tobytes()
        coded = self.tokenizer.encode_batch_fast([body[a:b].decode() for a, b in zip(at, at[1:])], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(c.ids for c in coded), np.uint32)
        ends = np.append(0, np.cumsum(self.sizes[ids]))
        found = np.searchsorted(ends, edges)
        if ends[-1] != edges[-1] or (ends[found] != edges).any():
            raise ValueError("an id reaches over a safe cut")
        return ids, found

    def alone(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text by itself."""
        coded = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(c.ids, np.uint32).tobytes() for c in coded]

    @staticmethod
    def cuts(data: np.ndarray) -> np.ndarray:
        """Safe cuts, and further ends of pre-tokens: before a comma or full stop after a letter, before a line's end after a
        printed character, and after such a line's end before another one."""
        p = np.flatnonzero((data[1:] == 0x2C) | (data[1:] == 0x2E)) + 1
        letter = LETTER[data[p - 1]] | (LATIN[data[p - 1]] & (data[np.maximum(p - 2, 0)] == 0xC3) & (p > 1))
        line = np.flatnonzero(data[1:] == 0x0A) + 1
        line = line[PRINTED[data[line - 1]]]
        after = line[line < len(data) - 1] + 1
        return places(len(data), safe_cuts(data), p[letter], line, after[PRINTED[data[after]]])

    def encode(self, data: np.ndarray, cuts: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of regions in turn, where each begins and the last one ends). Regions may be empty and may overlap."""
        low, high = np.searchsorted(cuts, begins, "right"), np.searchsorted(cuts, ends, "left")
        inner = np.maximum(high - low, 0)
        count = np.where(ends > begins, inner + 1, 0)
        region = np.repeat(np.arange(len(begins)), count)
        first = np.cumsum(count) - count
        nth = np.arange(len(region)) - first[region]
        at = low[region] + nth
        padded = np.append(cuts, 0)
        start = np.where(nth == 0, begins[region], padded[np.minimum(np.maximum(at - 1, 0), len(cuts))])
        stop = np.where(nth == count[region] - 1, ends[region], padded[np.minimum(at, len(cuts))])
        key, second = word_hashes(data, start, stop, 101), word_hashes(data, start, stop, 102)
        distinct, where, index = np.unique(key, return_index=True, return_inverse=True)
        if (second != second[where][index]).any():
            raise ValueError("two pieces have one hash")
        found = self.known.find(distinct, second[where])
        missing = np.flatnonzero(found < 0)
        if len(missing):
            a, b = start[where[missing]], stop[where[missing]]
            # Those that can go together come first.
            turn = np.argsort(~(PRINTED[data[b - 1]] & (data[a] == 0x20)), kind="stable")
            new, edges = self.library(take(data, a[turn], (b - a)[turn]), np.append(0, np.cumsum((b - a)[turn])))
            back = np.argsort(turn)
            sizes = np.diff(edges)[back]
            self.known.add(distinct[missing], second[where[missing]], take(new, edges[:-1][back], sizes), sizes)
            found = self.known.find(distinct, second[where])
        size = self.known.size[found][index].astype(np.int64)
        ids = take(self.known.pool, self.known.place[found][index], size)
        return ids, np.append(0, np.cumsum(size))[np.append(first, len(region))]


class Known:
    """Ids of the chunks of a cell, by digest: sorted arrays, so that a chunk takes little more than its ids."""

    def __init__(self, digests: np.ndarray, ids: list[bytes]):
        order = np.lexsort((digests[:, 1], digests[:, 0]))
        self.digests = digests[order]
        sorted_ids = [ids[k] for k in order.tolist()]
        self.pool = np.frombuffer(b"".join(sorted_ids), np.uint32)
        self.size = np.array([len(x) // 4 for x in sorted_ids], np.int64)
        self.place = np.cumsum(self.size) - self.size

    @classmethod
    def none(cls) -> Known:
        return cls(np.zeros((0, 2), np.int64), [])

    def find(self, digests: np.ndarray) -> np.ndarray:
        """Where each digest is; -1: nowhere."""
        if not len(self.digests) or not len(digests):
            return np.full(len(digests), -1)
        at = np.minimum(np.searchsorted(self.digests[:, 0], digests[:, 0]), len(self.digests) - 1)
        return np.where((self.digests[at] == digests).all(1), at, -1)


class Chunks:
    """The chunks of texts that lie one after the other, with their safe cuts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray, safe: np.ndarray):
        self.data, self.body, self.safe = data, data.tobytes(), safe
        self.bounds = places(len(data) + 1, cuts, offsets)
        self.first = np.searchsorted(safe, self.bounds[:-1], "right")
        self.last = np.searchsorted(safe, self.bounds[1:], "left") - 1
        #: Chunks with two safe cuts or more, between which ids are reused.
        self.usable = np.flatnonzero(self.last > self.first)
        self.chunk_of = np.searchsorted(self.bounds, offsets)

    def digests(self) -> np.ndarray:
        """128 bits of each usable chunk."""
        ends = zip(self.bounds[self.usable].tolist(), self.bounds[self.usable + 1].tolist())
        return np.frombuffer(b"".join(xxhash.xxh3_128_digest(self.body[a:b]) for a, b in ends), np.int64).reshape(-1, 2)

    def middles(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, end) of what is reused of usable chunks, by their places among these."""
        chunk = self.usable[places]
        return self.safe[self.first[chunk]], self.safe[self.last[chunk]]


class ChunkEncoder:
    """Whole texts by content-defined chunks; see the module."""

    def __init__(self, tokenizer, mask_bits: int = 8, pieces: int = 600_000):
        self.coder, self.mask_bits = PieceEncoder(tokenizer, pieces), mask_bits
        self.table = byte_table(10).astype(np.uint32)
        #: Texts in which a first repair did not agree.
        self.widened = 0

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Positions where a chunk may begin: the hash of the 16 bytes before fits the mask, and a character begins."""
        if len(data) <= WINDOW:
            return np.zeros(0, np.int64)
        h = self.table[data]
        for step, factor in ((1, 0x9E3779B1), (2, 0x85EBCA77), (4, 0xC2B2AE3D), (8, 0x27D4EB2F)):
            h = h[:-step] * np.uint32(factor) + h[step:]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        at = np.flatnonzero(h >> np.uint32(32 - self.mask_bits) == 0) + WINDOW
        at = at[at < len(data)]
        return at[(data[at] & 0xC0) != 0x80]

    def safe(self, data: np.ndarray) -> np.ndarray:
        return safe_cuts(data)

    def chunks(self, data: np.ndarray, offsets: np.ndarray) -> Chunks:
        return Chunks(data, offsets, self.cuts(data), self.safe(data))

    def encode(self, data: np.ndarray, offsets: np.ndarray, known: Known | None = None) -> list[bytes]:
        """Ids of every text of a batch, as little-endian unsigned 32-bit integers."""
        chunks, known = self.chunks(data, offsets), known or Known.none()
        self.coder.known.next()
        cuts = self.coder.cuts(data)
        n = len(chunks.usable)
        begin, end = chunks.middles(np.arange(n))
        there = known.find(chunks.digests()) if len(known.digests) else np.full(n, -1)
        anew = np.flatnonzero(there < 0)
        ids, ends = self.coder.encode(data, cuts, begin[anew], end[anew])
        # Segments in the order of the texts: a join, then a middle and a join for every chunk. Parts of one pool.
        text = np.searchsorted(offsets, begin, "right") - 1
        before = np.searchsorted(text, np.arange(len(offsets)))
        joins_of = np.diff(before) + 1
        first_join = np.cumsum(joins_of) - joins_of
        join_begin, join_end = np.empty(n + len(joins_of), np.int64), np.empty(n + len(joins_of), np.int64)
        after_middle = np.arange(n) + text + 1
        join_begin[first_join], join_begin[after_middle] = offsets[:-1], end
        join_end[after_middle - 1], join_end[first_join + joins_of - 1] = begin, offsets[1:]
        # One more piece on either side, within the middles.
        left, right = join_begin.copy(), join_end.copy()
        left[after_middle] = chunks.safe[chunks.last[chunks.usable] - 1]
        right[after_middle - 1] = chunks.safe[chunks.first[chunks.usable] + 1]
        joined, join_ends, agree = self._repair(data, chunks.body, cuts, join_begin, join_end, left, right)
        pool = np.concatenate([ids, known.pool, joined])
        place, size = np.empty(2 * n + len(joins_of), np.int64), np.empty(2 * n + len(joins_of), np.int64)
        # Of join j of a text and all before it, j + its text number middles came before.
        owner = np.repeat(np.arange(len(joins_of)), joins_of)
        slot = 2 * np.arange(len(join_begin)) - owner
        place[slot], size[slot] = len(ids) + len(known.pool) + join_ends[:-1], np.diff(join_ends)
        slot = 2 * after_middle - text - 1
        have = there >= 0
        place[slot[have]], size[slot[have]] = len(ids) + known.place[there[have]], known.size[there[have]]
        place[slot[anew]], size[slot[anew]] = ends[:-1], np.diff(ends)
        raw = take(pool, place, size).tobytes()
        total = np.append(0, np.cumsum(size))
        edges = (4 * total[np.append(2 * first_join - np.arange(len(joins_of)), len(size))]).tolist()
        out = [raw[a:b] for a, b in zip(edges, edges[1:])]
        for d in np.unique(owner[~agree]).tolist():
            out[d] = self._widen(chunks, int(offsets[d]), int(offsets[d + 1]))
        return out

    def _repair(self, data, body, cuts, begin, end, left, right) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of joins in turn, where each begins and the last one ends, whether the library's ids of left..right begin and
        end with the ids of the pieces on both sides)."""
        n = len(begin)
        sides, at = self.coder.encode(data, cuts, np.concatenate([left, end]), np.concatenate([begin, right]))
        keys = [(body[w:x], body[x:y], body[y:z]) for w, x, y, z in zip(left.tolist(), begin.tolist(), end.tolist(), right.tolist())]
        number: dict[tuple, int] = {}
        which = np.fromiter((number.setdefault(k, len(number)) for k in keys), np.int64, n)
        joined = [b"".join(k) for k in number]
        wide, wide_ends = self.coder.library(np.frombuffer(b"".join(joined), np.uint8), np.append(0, np.cumsum([len(x) for x in joined], dtype=np.int64)))
        heads, tails = np.diff(at)[:n], np.diff(at)[n:]
        size = np.diff(wide_ends)[which] - heads - tails
        agree = size >= 0
        place = wide_ends[which] + heads
        for a, b, m in ((wide_ends[which], at[:n], heads), (place + size, at[n:-1], tails)):
            fine = np.flatnonzero(agree)
            same = take(wide, a[fine], m[fine]) == take(sides, b[fine], m[fine])
            wrong = np.repeat(fine, m[fine])[~same]
            agree[wrong] = False
        size = np.where(agree, size, 0)
        return take(wide, place, size), np.append(0, np.cumsum(size)), agree

    def _widen(self, chunks: Chunks, low: int, high: int) -> bytes:
        """Ids of one text whose repairs did not all agree: regions take in their neighbours until they do."""
        self.widened += 1
        safe = chunks.safe[(chunks.safe > low) & (chunks.safe < high)]
        edges = np.concatenate([[low], safe, [high]])
        pieces = [chunks.body[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        out, at = [], 0
        while at < len(pieces):
            size = 1
            while True:
                # Pieces at..stop as one region, and with as many behind it: both must agree on what the region gives.
                stop, more = min(at + size, len(pieces)), min(at + 2 * size, len(pieces))
                wide = self.coder.alone([b"".join(pieces[at:stop]), b"".join(pieces[at:more]), b"".join(pieces[stop:more])])
                if stop == len(pieces) or wide[1] == wide[0] + wide[2]:
                    break
                size *= 2
            out.append(wide[0])
            at = stop
        return b"".join(out)


class Decoder:
    """ids -> text, as the library's byte-level decoder: bytes of all ids in turn, then UTF-8 with replacement."""

    def __init__(self, tokenizer):
        tokens = token_bytes(tokenizer)
        self.size, self.place = np.zeros((2, max(tokens, default=0) + 1), np.int64)
        self.size[list(tokens)] = [len(x) for x in tokens.values()]
        self.place[list(tokens)] = np.append(0, np.cumsum(self.size[list(tokens)]))[:-1]
        self.pool = np.frombuffer(b"".join(tokens.values()), np.uint8)

    def decode(self, ids: bytes) -> str:
        return self.decode_all([ids])[0]

    def decode_all(self, ids: list[bytes]) -> list[str]:
        """The texts of many texts' ids."""
        every = np.frombuffer(b"".join(ids), np.uint32)
        body = take(self.pool, self.place[every], self.size[every]).tobytes()
        ends = np.append(0, np.cumsum(self.size[every]))[np.append(0, np.cumsum([len(x) // 4 for x in ids], dtype=np.int64))].tolist()
        return [body[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


def exact(path: str) -> bool:
    """Whether the safe cuts hold for a tokenizer file: byte-level BPE with the usual pattern, nothing before it, and no added
    token that reaches over a space."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    before, model = told.get("pre_tokenizer") or {}, told.get("model") or {}
    plain = told.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    same = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    fine = all(not any(t.get(k) for k in ("lstrip", "rstrip", "single_word")) and not re.search(r"\s", t["content"]) for t in told.get("added_tokens", ()))
    return bool(plain and same and fine)


class WholeEncoder:
    """Whole texts through the library, for any tokenizer."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def encode(self, data: np.ndarray, offsets: np.ndarray, known: Known | None = None) -> list[bytes]:
        body, ends = data.tobytes(), offsets.tolist()
        return [np.array(c.ids, np.uint32).tobytes() for c in self.tokenizer.encode_batch_fast([body[a:b].decode() for a, b in zip(ends[:-1], ends[1:])], add_special_tokens=False)]


def _cells(docs: DataFrame) -> DataFrame:
    """(doc_id, text, cell): the cell is the split of a file that a row is read from."""
    docs = doc_columns(docs)
    if not reads_files(docs):
        docs = materialize(docs, "texts")
    return docs.withColumn("cell", F.xxhash64(F.input_file_name(), F.input_file_block_start()))


def _by_cell(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(cell, rows of that cell); rows of a split come together."""
    for batch in slices(batches, limit):
        cell = batch.column("cell").to_numpy()
        edges = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])).tolist() + [len(cell)]
        for a, b in zip(edges, edges[1:]):
            yield int(cell[a]), batch.slice(a, b - a)


def _read_cell(folder: str, cell: int, *columns: str) -> list[pa.ChunkedArray]:
    """Columns of what `_write_cells` wrote for a cell; empty where there is nothing."""
    system, path = store(f"{folder}/cell={cell}")
    if not system.get_file_info(path).is_file and system.get_file_info(path).type.name == "NotFound":
        return [pa.chunked_array([[]], pa.binary() if c == "ids" else pa.int64()) for c in columns]
    got = ds.dataset(path, format="parquet", filesystem=system).to_table(columns=list(columns))
    return [got.column(c) for c in columns]


def _write_cells(rows: DataFrame, name: str) -> str:
    """Writes a folder for each cell; a cell's rows never are more than its texts have chunks."""
    folder = scratch(rows.sparkSession, name)
    rows.repartition(partitions(rows.sparkSession), "cell").write.partitionBy("cell").parquet(folder)
    return folder


def _digests(a: pa.ChunkedArray, b: pa.ChunkedArray) -> np.ndarray:
    return np.stack([a.to_numpy(), b.to_numpy()], 1).astype(np.int64, copy=False).reshape(-1, 2)


def share_chunks(docs: DataFrame, vocabulary: str, mask_bits: int = 8) -> str | None:
    """Encodes every chunk that occurs twice or more once; a folder with a cell's chunks and ids. None: no chunk repeats."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(None, mask_bits)
        for cell, batch in _by_cell(batches, 4 << 20):
            every = encoder.chunks(*utf8(batch.column("text"))).digests()
            every = every[np.lexsort((every[:, 1], every[:, 0]))]
            first = np.flatnonzero(np.append(True, (every[1:] != every[:-1]).any(1))) if len(every) else np.zeros(0, np.int64)
            found, n = every[first], np.diff(np.append(first, len(every)))
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy()), pa.array(np.full(len(found), cell)), pa.array(n.astype(np.int64))], ["a", "b", "cell", "n"])

    every = materialize(arrow_map(docs, digests, "a long, b long, cell long, n long"), "chunks")
    shared = every.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("cell").alias("first"), F.count("*").alias("c")).where("n > 1").drop("n")
    shared = materialize(shared, "shared-chunks")
    if shared.isEmpty():
        return None
    todo = _write_cells(shared.select("a", "b", F.col("first").alias("cell")), "chunks-to-encode")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, now, wanted, seen = ChunkEncoder(load(vocabulary), mask_bits), None, Known.none(), np.zeros(0, bool)
        for cell, batch in _by_cell(batches):
            if cell != now:
                keys = _digests(*_read_cell(todo, cell, "a", "b"))
                now, wanted, seen = cell, Known(keys, [b""] * len(keys)), np.zeros(len(keys), bool)
            chunks = encoder.chunks(*utf8(batch.column("text")))
            digests = chunks.digests()
            at, first = np.unique(wanted.find(digests), return_index=True)
            new = (at >= 0) & ~seen[at] if len(seen) else np.zeros(len(at), bool)
            at, first = at[new], first[new]
            seen[at] = True
            encoder.coder.known.next()
            ids, ends = encoder.coder.encode(chunks.data, encoder.coder.cuts(chunks.data), *chunks.middles(first))
            raw, edges = ids.tobytes(), (4 * ends).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(digests[first, 0].copy()), pa.array(digests[first, 1].copy()), pa.array([raw[x:y] for x, y in zip(edges, edges[1:])], pa.binary())], ["a", "b", "ids"])

    coded = arrow_map(docs, encode, "a long, b long, ids binary")
    coded = materialize(coded.join(shared.drop("first"), ["a", "b"]), "coded-chunks")
    return _write_cells(join_counted(every.select("a", "b", "cell"), coded, ["a", "b"], ["cell"]).select("cell", "a", "b", "ids"), "cell-chunks")


def _coded(docs: DataFrame, vocabulary: str, make, schema: str) -> DataFrame:
    """Rows that `make` gives of (doc_id, ids of each text, decoder)."""
    whole = not exact(vocabulary)
    docs = doc_columns(docs).withColumn("cell", F.lit(0).cast("long")) if whole else _cells(docs)
    folder = None if whole else share_chunks(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(vocabulary)
        encoder, decoder = WholeEncoder(tokenizer) if whole else ChunkEncoder(tokenizer), Decoder(tokenizer)
        now, known = None, Known.none()
        for cell, batch in _by_cell(batches):
            if folder and cell != now:
                a, b, ids = _read_cell(folder, cell, "a", "b", "ids")
                now, known = cell, Known(_digests(a, b), ids.to_pylist())
            yield make(batch.column("doc_id"), encoder.encode(*utf8(batch.column("text")), known), decoder)

    return arrow_map(docs, run, schema)


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers, one row per input row."""
    return _coded(docs, vocabulary, lambda doc_id, ids, _: pa.RecordBatch.from_arrays([doc_id, pa.array(ids, pa.binary())], ["doc_id", "ids"]), SCHEMA_IDS)


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encodes and decodes every text; digests of the ids and of the decoded text. Decoding is the byte-level decoder's."""
    if not exact(vocabulary):
        raise ValueError(f"{vocabulary} is no byte-level BPE, whose decoder is known here; encode() takes it")

    def digests(doc_id, ids, decoder):
        back = [hashlib.sha256(x.encode()).hexdigest() for x in decoder.decode_all(ids)]
        return pa.RecordBatch.from_arrays([doc_id, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _coded(docs, vocabulary, digests, SCHEMA)
