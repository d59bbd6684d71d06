"""Operator 7: substring deduplication over sliding spans of sentences.

A span begins at every sentence and takes as many consecutive sentences as give it `min_sentences` sentences and
`min_words` words, so chance repeats of very short sentences don't count. With `ends`, one also ends at every sentence and
takes as many before it, so that a repeated run which holds a span is covered from its first sentence to its last. Every span is hashed to 128 bits; spans of all
texts meet by hash; the span with the smallest (doc_id, sentence) is the first, and every sentence that any other span of
that hash covers is removed, whether in another text or further down the same one.

The hash table keeps, in this order, only 64-bit hashes that occur twice, then their spans; both steps are groupBys
with partial aggregation, whose result is joined to the spans in parts where a hash is hot (`join_counted`), so a span
that a third of all texts share is never gathered in one task.

A sentence ends after a word that ends in `.`, `!` or `?` (closing quotes or brackets may follow), and at a line's end;
words are what white space separates; spans compare by their words after lower-casing A-Z. A text without room for a
span has none. Defined cases: null text is the empty text; rows with a null doc_id keep their whole text and don't count
as first; rows that repeat a doc_id count as one document, so they aren't each other's copies; ties cannot arise, as
(doc_id, sentence) is the order; empty tables give no rows; other columns are not read. One very long text is held by
one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_map, doc_columns, finish, join_counted, materialize, slices, utf8
from quillspark.llm.words import LOWER, byte_mask, powers, spans, word_hashes

BLANK = byte_mask([0x20, *range(9, 14)])
STOP, CLOSING = byte_mask(b".!?"), byte_mask(b"\"')]}")
MIN_SENTENCES, MIN_WORDS = 2, 20
SPANS = "a long, b long, doc_id long, begin int, n int"
SCHEMA = "doc_id long, n_sentences long, n_removed long, kept_text string"


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word starts, word ends, first word of each sentence, text of each sentence, sentences before each text)."""
    starts, ends = spans(~BLANK[data], offsets)
    if not len(starts):
        nothing = np.zeros(0, np.int64)
        return starts, ends, nothing, nothing, np.zeros(len(offsets), np.int64)
    doc = np.searchsorted(offsets, starts, "right") - 1
    last, before = data[ends - 1], data[np.maximum(ends - 2, 0)]
    stop = STOP[last] | (CLOSING[last] & STOP[before] & (ends - starts > 1))
    lines = np.append(0, np.cumsum(data == 10))
    stop[:-1] |= (lines[starts[1:]] > lines[ends[:-1]]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(np.append(True, stop[:-1]))
    owner = doc[first]
    return starts, ends, first, owner, np.searchsorted(owner, np.arange(len(offsets)))


def span_rows(data: np.ndarray, offsets: np.ndarray, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, ends: bool = False) -> tuple[np.ndarray, ...]:
    """(hash, second hash, text, first sentence within the text, sentences) of every span."""
    starts, stops, first, owner, before = sentences(data, offsets)
    if not len(first):
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    bounds = np.append(first, len(starts))
    # The span's end: the first sentence edge with enough sentences and words, within the text.
    stop = np.maximum(np.arange(len(first)) + min_sentences, np.searchsorted(bounds, first + min_words, "left"))
    fits = stop <= before[owner + 1]
    at = np.flatnonzero(fits)
    to = stop[at]
    if ends:
        # For each sentence as the last: the latest sentence edge that leaves enough, within the text, unless that span is there already.
        edge = np.arange(1, len(first) + 1)
        start = np.minimum(edge - min_sentences, np.searchsorted(bounds, bounds[edge] - min_words, "right") - 1)
        new = start >= before[owner]
        new[new] = stop[start[new]] != edge[new]
        at, to = np.append(at, start[new]), np.append(to, edge[new])
    a, b = bounds[at], bounds[to]
    low = LOWER[data]
    power, inverse = powers(len(starts))
    out = []
    for seed in (71, 72):
        word = word_hashes(low, starts, stops, seed)
        total = np.append(np.uint64(0), np.cumsum(word * power, dtype=np.uint64))
        out.append(finish((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64)))
    return out[0], out[1], owner[at], at - before[owner[at]], to - at


def spans_of(docs: DataFrame, min_sentences: int, min_words: int, ends: bool = False) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2 << 20):
            a, b, owner, begin, n = span_rows(*utf8(batch.column("text")), min_sentences, min_words, ends)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), batch.column("doc_id").take(pa.array(owner)), pa.array(begin.astype(np.int32)), pa.array(n.astype(np.int32))], ["a", "b", "doc_id", "begin", "n"])

    return arrow_map(docs, run, SPANS)


def removed_spans(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, ends: bool = False) -> DataFrame:
    """(doc_id, begin, n): spans that are not the first of their hash; sentence numbers within the text, from 0."""
    rows = materialize(spans_of(docs.where("doc_id is not null"), min_sentences, min_words, ends), "spans")
    order = ["doc_id", "begin"]
    twice = materialize(rows.groupBy("a").agg(F.count("*").alias("c")).where("c > 1"), "hashes")
    repeated = materialize(join_counted(rows, twice, ["a"], order).drop("c"), "repeated")
    firsts = repeated.groupBy("a", "b").agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("c")).where("c > 1")
    firsts = materialize(firsts.select("a", "b", "c", F.col("first.doc_id").alias("first_doc"), F.col("first.begin").alias("first_begin")), "firsts")
    return join_counted(repeated, firsts, ["a", "b"], order).where((F.col("doc_id") != F.col("first_doc")) | (F.col("begin") != F.col("first_begin"))).select("doc_id", "begin", "n")


def deduplicate(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, ends: bool = False) -> DataFrame:
    """(doc_id, n_sentences, n_removed, kept_text) of every row."""
    docs = doc_columns(docs)
    # At most one range for each sentence of a text: the list is no larger than the text that it is joined to.
    ranges = removed_spans(docs, min_sentences, min_words, ends).groupBy("doc_id", "begin").agg(F.max("n").alias("n")).groupBy("doc_id").agg(F.collect_list("begin").alias("begins"), F.collect_list("n").alias("sizes"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            data, offsets = utf8(batch.column("text"))
            starts, _, first, _, before = sentences(data, offsets)
            edges, body = starts[first], data.tobytes()
            n_sentences, n_removed, kept = [], [], []
            for d, (begins, sizes) in enumerate(zip(batch.column("begins").to_pylist(), batch.column("sizes").to_pylist(), strict=True)):
                n = int(before[d + 1] - before[d])
                n_sentences.append(n)
                if not begins:
                    n_removed.append(0)
                    kept.append(body[offsets[d] : offsets[d + 1]])
                    continue
                change = np.zeros(n + 1, np.int64)
                np.add.at(change, begins, 1)
                np.add.at(change, np.add(begins, sizes), -1)
                gone = np.cumsum(change[:-1]) > 0
                cuts = np.append(edges[before[d] : before[d + 1]], offsets[d + 1])
                n_removed.append(int(gone.sum()))
                kept.append(body[offsets[d] : cuts[0]] + b"".join(body[cuts[k] : cuts[k + 1]] for k in np.flatnonzero(~gone)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_sentences, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([k.decode() for k in kept], pa.string())], ["doc_id", "n_sentences", "n_removed", "kept_text"])

    return arrow_map(docs.join(ranges, "doc_id", "left"), rebuild, SCHEMA)


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_sentences", "n_removed", F.octet_length("kept_text").cast("long").alias("kept_bytes"), F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
