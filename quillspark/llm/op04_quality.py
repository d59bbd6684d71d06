"""Operator 4: a byte-level convolutional network in numpy that scores text quality.

A text's UTF-8 bytes are read whole, in chunks of 256 bytes that overlap by the filter width less one. Each chunk goes
through learned filters over five bytes: one table of filter responses for each byte value and place, added up, then
ReLU. Every filter is max-pooled and mean-pooled within the chunk, and the chunks' pools are combined over the document
by mean and by maximum. A logistic layer on these gives one probability. The tables, filters and the logistic layer
are trained together by gradient descent with Adam on a bounded sample of labelled rows.

Bound of the sample (a parameter): `max_rows` labelled documents, those with the smallest hashes of their doc_id, whole.
Scoring covers every byte of every text.

Inputs of a score are the text's bytes alone. Defined cases: null or empty text is scored from zero pools (the bias
alone); rows with a null doc_id are scored; repeated rows give repeated rows; labels that are null or other than 0 and
1 aren't learnt from; without any usable label every score is 0.5; with one class only the scores lean to it; empty
tables give no rows; other columns are not read. One very long text is held by one task and worked in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_map, doc_columns, slices, small_batches, utf8

CHUNK, WIDTH, FILTERS = 256, 5, 16
STEP = CHUNK - WIDTH + 1
FEATURES = 4 * FILTERS
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
MAX_ROWS, EPOCHS, BATCH, RATE, DECAY = 2400, 5, 32, 0.01, 1e-4
#: Chunks whose filter responses are held at once.
HELD = 512


def cut(data: np.ndarray) -> np.ndarray:
    """Chunks of one text as rows of byte values; the last is filled up with 256, which no filter sees."""
    n = max(1, -(-max(len(data) - WIDTH + 1, 0) // STEP))
    rows = np.full((n, CHUNK), 256, np.int16)
    for k in range(n):
        part = data[k * STEP : k * STEP + CHUNK]
        rows[k, : len(part)] = part
    return rows


class Network:
    """tables: response of each filter to each byte value at each place (value 256: none)."""

    def __init__(self, seed: int = 4):
        r = np.random.default_rng(seed)
        self.tables = r.normal(0, 0.25, (WIDTH, 257, FILTERS)).astype(np.float32)
        self.tables[:, 256] = 0
        self.bias = np.full(FILTERS, 0.05, np.float32)
        self.weights = r.normal(0, 0.1, FEATURES).astype(np.float32)
        self.shift = np.zeros(1, np.float32)
        self.at, self.spread = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.tables, self.bias, self.weights, self.shift]

    def pools(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(responses, max pools, mean pools) of chunk rows, after ReLU; empty places count as zero."""
        x = np.broadcast_to(self.bias, (len(rows), STEP, FILTERS)).copy()
        for j in range(WIDTH):
            x += self.tables[j].take(rows[:, j : j + STEP], axis=0)
        np.maximum(x, 0, out=x)
        # Windows that reach into the filling don't count.
        count = np.clip((rows != 256).sum(1) - WIDTH + 1, 0, STEP)
        short = np.flatnonzero(count < STEP)
        for k in short:
            x[k, count[k] :] = 0
        return x, x.max(1), x.sum(1) / np.maximum(count, 1)[:, None]

    @staticmethod
    def combine(high: np.ndarray, mean: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Document features from chunk pools; begins: each document's first chunk."""
        n = np.diff(np.append(begins, len(high)))[:, None]
        return np.concatenate([np.add.reduceat(high, begins) / n, np.maximum.reduceat(high, begins), np.add.reduceat(mean, begins) / n, np.maximum.reduceat(mean, begins)], 1)

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(((features - self.at) / self.spread) @ self.weights + self.shift[0], -60, 60)))

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 4) -> None:
        """texts: chunk rows of each document."""
        r = np.random.default_rng(seed)
        first, second = ([np.zeros_like(p) for p in self.parameters()] for _ in range(2))
        # Classes count alike in the fit; train() then moves the shift to the share that the labels have.
        share = labels.mean()
        weight = np.where(labels == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)).astype(np.float32) if 0 < share < 1 else np.ones(len(labels), np.float32)
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for begin in range(0, len(order), BATCH):
                picked = order[begin : begin + BATCH]
                rows = np.concatenate([texts[k] for k in picked])
                begins = np.cumsum([0, *(len(texts[k]) for k in picked)])[:-1]
                step += 1
                for p, g, m, v in zip(self.parameters(), self.gradients(rows, begins, labels[picked], weight[picked]), first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                self.tables[:, 256] = 0

    def gradients(self, rows, begins, labels, weight) -> list[np.ndarray]:
        parts = [slice(k, min(k + HELD, len(rows))) for k in range(0, len(rows), HELD)]
        pooled = [self.pools(rows[p]) for p in parts] if len(parts) == 1 else [(None, *self.pools(rows[p])[1:]) for p in parts]
        high, mean = (np.concatenate([x[k] for x in pooled]) for k in (1, 2))
        n = np.diff(np.append(begins, len(rows)))
        doc = np.repeat(np.arange(len(begins)), n)
        features = self.combine(high, mean, begins)
        error = ((self.probability(features) - labels) * weight / len(begins)).astype(np.float32)
        back = error[:, None] * (self.weights / self.spread)[None, :]
        a, b, c, d = np.split(back, 4, axis=1)
        to_high = (a / n[:, None])[doc]
        to_mean = (c / n[:, None])[doc]
        # The maximum over chunks passes its gradient to the first chunk that has it.
        for own, grad, to in ((high, b, to_high), (mean, d, to_mean)):
            top = np.maximum.reduceat(own, begins)[doc]
            is_top = own == top
            seen = np.cumsum(is_top, 0)
            base = np.concatenate([np.zeros((1, FILTERS), seen.dtype), seen])[begins][doc]
            to += np.where(is_top & (seen - base == 1), grad[doc], 0)
        tables, bias = np.zeros_like(self.tables), np.zeros(FILTERS, np.float32)
        for p, (x, *_) in zip(parts, pooled):
            x = self.pools(rows[p])[0] if x is None else x
            count = np.clip((rows[p] != 256).sum(1) - WIDTH + 1, 1, STEP)
            g = np.where(x > 0, (to_mean[p] / count[:, None])[:, None, :], np.float32(0))
            place = x.argmax(1)
            k, f = np.indices(place.shape)
            g[k, place, f] += np.where(high[p] > 0, to_high[p], 0)
            flat = g.reshape(-1, FILTERS)
            for j in range(WIDTH):
                values = rows[p, j : j + STEP].reshape(-1)
                for f in range(FILTERS):
                    tables[j, :, f] += np.bincount(values, flat[:, f], 257)
            bias += flat.sum(0)
        centred = (features - self.at) / self.spread
        return [tables + DECAY * self.tables, bias, (error @ centred) + DECAY * self.weights, error.sum(keepdims=True)]

    def score(self, data: np.ndarray, offsets: np.ndarray, block: int = 128) -> np.ndarray:
        """Scores of whole texts that lie one after the other in `data`."""
        sizes = np.diff(offsets)
        n = np.maximum(1, -(-np.maximum(sizes - WIDTH + 1, 0) // STEP))
        begins = np.cumsum(n) - n
        total = int(n.sum())
        padded = np.append(data, np.zeros(CHUNK, np.uint8))
        doc = np.repeat(np.arange(len(n)), n)
        start = offsets[:-1][doc] + (np.arange(total) - begins[doc]) * STEP
        left = np.minimum(CHUNK, offsets[1:][doc] - start)
        high, mean = (np.empty((total, FILTERS), np.float32) for _ in range(2))
        for k in range(0, total, block):
            rows = padded[start[k : k + block, None] + np.arange(CHUNK)].astype(np.int16)
            for i in np.flatnonzero(left[k : k + block] < CHUNK):
                rows[i, max(left[k + i], 0) :] = 256
            _, high[k : k + block], mean[k : k + block] = self.pools(rows)
        return self.probability(self.combine(high, mean, begins))


def held_out(doc_id: Column) -> Column:
    """The fold that is never learnt from; a null doc_id is held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, label_col: str = "quality", fold=held_out) -> Network | None:
    """Fits a network on a bounded sample of labelled documents outside the held-out fold; None without any."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    usable = usable.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~fold(F.col("doc_id")))
    # Half from each class, as far as there are so many: at most max_rows ids, so they can be broadcast.
    hashed = usable.withColumn("h", F.xxhash64("doc_id")).distinct()
    picked = hashed.where("label = 1").orderBy("h", "doc_id").limit(max_rows // 2).unionByName(hashed.where("label = 0").orderBy("h", "doc_id").limit(max_rows // 2))

    sample = doc_columns(docs).join(F.broadcast(picked), "doc_id").select("doc_id", "label", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    got = sorted(sample.limit(2 * max_rows).collect(), key=lambda r: (r.doc_id, r.label, r.text))
    if not got:
        return None
    network = Network()
    texts = [cut(np.frombuffer(r.text, np.uint8)) for r in got]
    network.fit(texts, np.array([r.label for r in got], np.float32))
    ones, every = usable.agg(F.sum("label"), F.count("*")).first()
    network.shift += np.float32(np.log((ones + 1) / (every - ones + 1)))
    return network


def scorer(network: Network | None):
    def score(column: pa.Array) -> np.ndarray:
        data, ends = utf8(column)
        if network is None:
            return np.full(len(ends) - 1, 0.5)
        return network.score(data, ends).astype(np.float64)

    return score


def classify(docs: DataFrame, network: Network | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    score = scorer(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            p = score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return arrow_map(doc_columns(docs).withColumn("held_out", held_out(F.col("doc_id"))), run, SCHEMA)


def keep_good(docs: DataFrame, network: Network | None, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows that score `threshold` or more, with all their columns."""
    small_batches(docs.sparkSession)
    score = scorer(network)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = names.index(text_col)
        for batch in batches:
            for part in slices(iter([batch.rename_columns([f"c{k}" for k in range(len(names))])]), 4 << 20, f"c{place}"):
                yield part.filter(pa.array(score(part.column(place)) >= threshold)).rename_columns(names)

    return arrow_map(docs, run, docs.schema)
