"""Operator 9: token-id files with one shared zstandard dictionary.

`write` encodes every text, appends an end id and stores the ids in shards in ascending doc_id order. Each document is
a zstandard frame of its own, made with a dictionary that was trained on serialized id arrays of a bounded sample, so
that one short document can be read alone. A shard is: a header (magic, version, id width, SHA-256 of the dictionary),
the frames, an index (doc_id, begin, length, number of ids; 32 bytes each) and a footer (place of the index, number of
documents, number of ids, magic). `read` gives (doc_id, start, ids) from the files alone; `Shard.document` reads one.

Shards are ranges of doc_id whose bounds come from approximate percentiles of doc_id, so no task gets more than its
part. Encoding comes before the shuffle: only compressed ids move. Word by word the library's result doesn't depend on
the neighbours, as its pre-tokenizer drops white space and no rule reaches over it; each worker has each distinct word
encoded once by the library and keeps it in a bounded cache.

Defined cases: null text is the empty text (one id, the end id); rows with a null doc_id come first; rows that repeat a
doc_id follow each other in the order of their ids' bytes and are counted one by one; an empty table gives no rows;
other columns are not read. One very long text is held by one task. Ids need 32 bits; where the vocabulary fits 16,
frames hold 16-bit ids.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_map, doc_columns, materialize, partitions, scratch, slices, utf8
from quillspark.llm.files import Reader, Writer
from quillspark.llm.op10_bpe import TwoAges, load

MAGIC = b"QTOKENS1"
HEADER = "<8sHH32s"
ENTRY = np.dtype([("doc_id", "<i8"), ("begin", "<u8"), ("length", "<u8"), ("n", "<u8")])
FOOTER = "<QQQ8s"
NO_ID = -(1 << 63)
#: The dictionary is trained on at most this many texts, and is at most this large.
SAMPLE_ROWS, DICTIONARY_BYTES = 1000, 32 << 10
#: A sampled text gives so many spans of ids, evenly spread over the whole text, of so many bytes each at most.
SAMPLE_SPANS, SPAN_BYTES = 4, 1024
LEVEL = 1
#: Bytes of text that go through the word tables together.
TOGETHER = 8 << 20
#: Words of ASCII and Latin-1 letters; a line's end separates words as a space does.
PLAIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
SPACES = bytes.maketrans(b"\n", b" ")


class WordEncoder:
    """Whole texts, word by word, for a tokenizer that lowers letters, drops white space and marks the last id of each
    pre-token.

    Words of letters alone are one pre-token each, so many go to the library as one text and its ids are cut after
    every mark. A comma or full stop after a letter is a pre-token of its own, so such words are put together from
    their parts. Whatever else there is goes to the library one by one.
    """

    def __init__(self, tokenizer, width: np.dtype, limit: int = 400_000):
        self.tokenizer, self.width, self.cache = tokenizer, width, TwoAges(limit)
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[k for text, k in vocabulary.items() if text.endswith("</w>")]] = True

    def library(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(c.ids, self.width) for c in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def plain(self, words: list[bytes]) -> list[bytes]:
        """Words of letters alone."""
        out = []
        groups = [words[k : k + 2000] for k in range(0, len(words), 2000)]
        for group, ids in zip(groups, self.library([b" ".join(g) for g in groups]), strict=True):
            ends = ((np.flatnonzero(self.last[ids]) + 1) * self.width.itemsize).tolist()
            if len(ends) != len(group):
                out += [x.tobytes() for x in self.library(group)]
                continue
            raw, begin = ids.tobytes(), 0
            for end in ends:
                out.append(raw[begin:end])
                begin = end
        return out

    def learn(self, missing: set[bytes]) -> None:
        cache = self.cache
        cache.turn(len(missing))
        young, old = cache.young, cache.old
        composed, plain, other = [], set(), []
        for w in missing:
            if (ids := old.get(w)) is not None:
                young[w] = ids
            elif PLAIN.fullmatch(w):
                plain.add(w)
            elif w[-1:] in (b",", b".") and PLAIN.fullmatch(w, 0, len(w) - 1):
                composed.append(w)
            else:
                other.append(w)
        for w in composed:
            if (base := w[:-1]) not in young:
                if (ids := old.get(base)) is not None:
                    young[base] = ids
                else:
                    plain.add(base)
        named = list(plain)
        young.update(zip(named, self.plain(named), strict=True))
        stops = {c: x.tobytes() for c, x in zip((b",", b"."), self.library([b",", b"."]), strict=True)}
        for w in composed:
            young[w] = young[w[:-1]] + stops[w[-1:]]
        young.update(zip(other, (x.tobytes() for x in self.library(other)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, where each text begins and the last one ends)."""
        lines = pc.replace_substring(texts.fill_null(""), "\n", " ")
        # The normalizer lowers all letters anyway; only the special tokens' strings are matched before it.
        if b"<|" not in utf8(lines)[0].tobytes():
            lines = pc.ascii_lower(lines)
        split = pc.split_pattern(lines, " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        found = list(map(self.cache.young.get, words))
        holes = [k for k, ids in enumerate(found) if ids is None]
        if holes:
            self.learn({words[k] for k in holes})
            young = self.cache.young
            for k in holes:
                found[k] = young[words[k]]
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.width.itemsize
        place = np.cumsum(size) - size
        index = coded.indices.to_numpy(zero_copy_only=False)
        n = size[index]
        ends = np.concatenate([[0], np.cumsum(n)])
        take = np.repeat(place[index] - ends[:-1], n)
        take += np.arange(len(take))
        return np.frombuffer(b"".join(found), self.width)[take], ends[split.offsets.to_numpy() - split.offsets[0].as_py()]


@functools.lru_cache(maxsize=1)
def worker_encoder(vocabulary: str) -> WordEncoder:
    """One per Python worker, so that its cache outlives a task."""
    tokenizer = load(vocabulary)
    return WordEncoder(tokenizer, id_width(tokenizer))


def id_width(tokenizer) -> np.dtype:
    return np.dtype("<u2") if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")


def spread_spans(ids: bytes, width: int) -> list[bytes]:
    """Spans of a text's ids from its begin to its end; all ids of a short one."""
    if len(ids) <= SAMPLE_SPANS * SPAN_BYTES:
        return [ids]
    last = (len(ids) - SPAN_BYTES) // width
    begins = [last * k // (SAMPLE_SPANS - 1) * width for k in range(SAMPLE_SPANS)]
    return [ids[b : b + SPAN_BYTES] for b in begins]


def train_dictionary(docs: DataFrame, vocabulary: str, end_id: int) -> bytes:
    """A dictionary from id arrays of a bounded sample: the texts with the smallest hashes of their doc_id, encoded whole,
    of which spans are taken."""
    rows = doc_columns(docs, batch_bytes=TOGETHER).select("text", F.xxhash64("doc_id").alias("h"))
    width = id_width(load(vocabulary))
    tail = np.array([end_id], width).tobytes()

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary)
        for batch in slices(batches, TOGETHER):
            flat, ends = encoder.encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array([spread_spans(flat[a:b].tobytes() + tail, width.itemsize) for a, b in zip(ends[:-1], ends[1:])], pa.list_(pa.binary()))], ["spans"])

    # Only hashes are sorted; texts come up to the largest hash of the sample, and rows that repeat it are cut off.
    least = [r.h for r in rows.select("h").orderBy("h").limit(SAMPLE_ROWS).collect()]
    taken = arrow_map(rows.where(F.col("h") <= least[-1]).select("text"), spans, "spans array<binary>").limit(SAMPLE_ROWS).collect() if least else []
    samples = [bytes(x) for x in sorted(x for r in taken for x in r.spans)]
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, total // 8)), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        # Too little to train on: the samples themselves are the dictionary.
        return b"".join(samples)[-DICTIONARY_BYTES:] or tail * 8


def _bounds(docs: DataFrame, shards: int) -> list[int]:
    """Smallest doc_id of each shard but the first."""
    if shards < 2:
        return []
    parts = [k / shards for k in range(1, shards)]
    found = docs.select(F.percentile_approx("doc_id", F.array(*map(F.lit, parts)), F.lit(100 * shards)).alias("b")).first().b
    return sorted(set(found or []))


def write(docs: DataFrame, vocabulary: str, end_id: int, shards: int | None = None) -> DataFrame:
    """Writes the shards; returns the manifest (shard, uri, n_docs, n_ids, dictionary), itself kept in the shared folder."""
    spark = docs.sparkSession
    docs = doc_columns(docs, batch_bytes=TOGETHER)
    shards = shards or partitions(spark)
    width = id_width(load(vocabulary))
    dictionary = train_dictionary(docs, vocabulary, end_id)
    digest = hashlib.sha256(dictionary).digest()
    bounds = np.array(_bounds(docs, shards), np.int64)
    folder = scratch(spark, "token-files")
    keep = Writer(folder, "dictionary", ".zdict")
    keep.write(dictionary)
    keep.close()
    dictionary_uri = keep.uri

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary)
        shared = zstandard.ZstdCompressionDict(dictionary)
        shared.precompute_compress(level=LEVEL)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        tail = np.array([end_id], width).tobytes()
        for batch in slices(batches, TOGETHER):
            flat, ends = encoder.encode(batch.column("text"))
            ids = [flat[a:b].tobytes() + tail for a, b in zip(ends[:-1], ends[1:])]
            key = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.searchsorted(bounds, key, "right").astype(np.int32)), pa.array(key), pa.array([len(x) // width.itemsize for x in ids], pa.int64()), pa.array([packer.compress(x) for x in ids], pa.binary())],
                ["shard", "doc_id", "n", "frame"],
            )

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, shard, index = None, None, []
        rows = []

        def close():
            entries = np.array(index, ENTRY)
            at = out.write(entries.tobytes())
            total = int(entries["n"].sum())
            out.write(struct.pack(FOOTER, at, len(entries), total, MAGIC))
            out.close()
            rows.append((shard, out.uri, len(entries), total, dictionary_uri))

        for batch in batches:
            for s, doc_id, n, frame in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if s != shard:
                    if out:
                        close()
                    out, shard, index = Writer(folder, f"shard-{s:06d}", ".qtok"), s, []
                    out.write(struct.pack(HEADER, MAGIC, 1, width.itemsize, digest))
                index.append((doc_id, out.write(frame), len(frame), n))
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()))], ["shard", "uri", "n_docs", "n_ids", "dictionary"])

    manifest = (
        docs.mapInArrow(encode, "shard int, doc_id long, n long, frame binary")
        .repartitionById(shards, "shard")
        .sortWithinPartitions("shard", "doc_id", "n", "frame")
    )
    return materialize(arrow_map(manifest, save, "shard int, uri string, n_docs long, n_ids long, dictionary string"), "token-manifest")


class Shard:
    """One shard file: its index, and documents by position."""

    def __init__(self, uri: str, dictionary: bytes):
        self.file = Reader(uri)
        magic, _, self.width, digest = struct.unpack(HEADER, self.file.read(0, struct.calcsize(HEADER)))
        at, n, self.n_ids, closing = struct.unpack(FOOTER, self.file.read(self.file.size - struct.calcsize(FOOTER), struct.calcsize(FOOTER)))
        if magic != MAGIC or closing != MAGIC:
            raise ValueError(f"{uri} is no whole token file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri} was written with another dictionary")
        self.index = np.frombuffer(self.file.read(at, n * ENTRY.itemsize), ENTRY)
        self.unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def documents(self, begin: int, stop: int) -> list[np.ndarray]:
        """Ids of documents by position; their frames are read at once, as they lie one after the other."""
        rows = self.index[begin:stop]
        if not len(rows):
            return []
        first = int(rows["begin"][0])
        body = memoryview(self.file.read(first, int(rows["begin"][-1] + rows["length"][-1]) - first))
        places = (rows["begin"].astype(np.int64) - first).tolist()
        raw = (self.unpacker.decompress(body[a : a + n], max_output_size=size * self.width) for a, n, size in zip(places, rows["length"].tolist(), rows["n"].tolist()))
        return [np.frombuffer(x, f"<u{self.width}").astype("<u4") for x in raw]

    def document(self, k: int) -> np.ndarray:
        return self.documents(k, k + 1)[0]


def read_dictionary(uri: str) -> bytes:
    file = Reader(uri)
    return file.read(0, file.size)


def read(manifest: DataFrame, digest_only: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids or ids_crc32) of every document, from the files."""
    spark = manifest.sparkSession
    # One row per shard: the running sum is over as many rows as there are shards, a parameter of write().
    based = manifest.withColumn("base", F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).na.fill(0, ["base"])

    def load_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionaries: dict[str, bytes] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary"] not in dictionaries:
                    dictionaries[row["dictionary"]] = read_dictionary(row["dictionary"])
                shard = Shard(row["uri"], dictionaries[row["dictionary"]])
                n = shard.index["n"].astype(np.int64)
                start = row["base"] + np.cumsum(n) - n
                for begin in range(0, len(n), 256):
                    stop = min(begin + 256, len(n))
                    docs = shard.documents(begin, stop)
                    key = shard.index["doc_id"][begin:stop]
                    last = pa.array([zlib.crc32(d) for d in docs], pa.int64()) if digest_only else pa.array([d.tobytes() for d in docs], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64), mask=key == NO_ID), pa.array(start[begin:stop]), pa.array(n[begin:stop]), last], ["doc_id", "start", "n_tokens", "last"])

    rows = based.repartitionById(partitions(spark), "shard").mapInArrow(load_shards, f"doc_id long, start long, n_tokens long, last {'long' if digest_only else 'binary'}")
    return rows.withColumnRenamed("last", "ids_crc32" if digest_only else "ids")
