import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import op10_bpe as B

PATH = B.default_vocabulary("byte_bpe_50k.json")
ODD = ["", " ", "   ", "a", "é", " a b  c   d\n\n e\t f", "x<|endoftext|>y <|endoftext|> z", "don't  we'll  go　 on", "日本語 の 文章 です。" * 20, "a" * 3000, "no-spaces-" * 500, "é à ü " * 300, "line\n next \r\n x  ", "   a b", "🙂 🙂🙂 ok", "1 22 333 4444  5 ", "abc \x85 d", "﻿ a"]


def brute(texts):
    t = B.load(PATH)
    ids = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    return ids, [t.decode(x, skip_special_tokens=False) for x in ids]


def mixed(seed, n=300):
    r = random.Random(seed)
    words = ["the", "ing", "tion,", "Über", "é", "\n", "  ", "don't", "12", "<|endoftext|>", "\t", " ", "?!", "日本", "a" * 40]
    return [r.choice(["", " "]).join(r.choice(words) + r.choice([" ", " ", "", "\n "]) for _ in range(r.randrange(0, 200))) for _ in range(n)]


@pytest.mark.parametrize("bits", [1, 4, 7])
def test_same_as_library(bits):
    texts = ODD + mixed(bits) * 2
    joined = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    t = B.load(PATH)
    got = B.ChunkEncoder(t, mask_bits=bits, pieces=50).encode(np.frombuffer(joined, np.uint8), offsets)
    ids, text = brute(texts)
    assert [np.frombuffer(g, np.uint32).tolist() for g in got] == ids
    d = B.Decoder(t)
    assert [d.decode(g) for g in got] == text


def test_query_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "same", "x"), (7, None, "x"), (7, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string")
    got = sorted(map(tuple, B.round_trip(docs, PATH).collect()), key=str)
    ids, text = brute([r[1] for r in rows])
    want = [(r[0], len(i), hashlib.sha256(np.array(i, np.uint32).tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for r, i, t in zip(rows, ids, text)]
    assert got == sorted(want, key=str)
    assert B.round_trip(docs.limit(0), PATH).count() == 0


class AnySpace(B.ChunkEncoder):
    """Cuts before any space and line's end, also within runs of white space, where pre-tokens do not end."""

    def safe(self, data):
        return np.flatnonzero((data[1:] == 0x20) | (data[1:] == 10)) + 1


@pytest.mark.parametrize("bits", [2, 5])
def test_repairs_widen_until_they_agree(bits):
    texts = ODD + mixed(bits)
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    encoder = AnySpace(B.load(PATH), mask_bits=bits)
    assert [np.frombuffer(g, np.uint32).tolist() for g in encoder.encode(data, offsets)] == brute(texts)[0]
    assert encoder.widened > 10


def test_each_repeated_chunk_is_encoded_once(spark, tmp_path):
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(400) for _ in range(5)]
    texts = [prose(r.randrange(200)) + " " + r.choice(shared) + " " + prose(r.randrange(200)) for _ in range(60)] + [prose(3)] * 40 + ["x" * 300] * 3
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    cells = B._cells(docs)
    folder = B.share_chunks(cells, PATH)
    encoder, counts = B.ChunkEncoder(B.load(PATH)), {}
    for t in texts:
        body = t.encode()
        for a, b in encoder.chunks(np.frombuffer(body, np.uint8), np.array([0, len(body)])).digests().tolist():
            counts[a, b] = counts.get((a, b), 0) + 1
    kept = spark.read.parquet(folder).collect()
    assert {(x.a, x.b) for x in kept} == {k for k, n in counts.items() if n > 1} and len(kept) == len({(x.cell, x.a, x.b) for x in kept})
    assert cells.select("cell").distinct().count() > 1 and len({(x.a, x.b) for x in kept}) > 20
    # What the parts of the table read from the folder is what was put there: with other ids in it the texts change.
    ids = {x.doc_id: x.ids for x in B.encode(docs, PATH).collect()}
    assert [np.frombuffer(ids[k], np.uint32).tolist() for k in range(len(texts))] == brute(texts)[0]
    key = {x: x for x in [(y.a, y.b) for y in kept]}
    assert len(key) == spark.read.parquet(folder).select("a", "b", "ids").distinct().count()


def test_other_tokenizers(spark):
    other = B.default_vocabulary("word_bpe_49k.json")
    assert B.exact(PATH) and not B.exact(other)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    t = B.load(other)
    got = {r.doc_id: np.frombuffer(r.ids, np.uint32).tolist() for r in B.encode(docs, other).collect()}
    assert [got[k] for k in range(len(ODD))] == [t.encode(x, add_special_tokens=False).ids for x in ODD]
    with pytest.raises(ValueError):
        B.round_trip(docs, other)


def test_text_above_a_megabyte(spark):
    text = "".join(mixed(9, 2500))
    text += " " + text[: 1 << 19]
    assert len(text.encode()) > 1 << 20
    docs = spark.createDataFrame([(1, text), (2, "z" * (1 << 20)), (3, text)], "doc_id long, text string").withColumn("cell", F.lit("clash"))
    got = {r.doc_id: r.ids for r in B.encode(docs, PATH).collect()}
    ids = brute([text])[0][0]
    assert got[1] == got[3] == np.array(ids, np.uint32).tobytes() and len(got) == 3


def test_pieces_go_to_the_library_together():
    """Parts between safe cuts share a call's text: far fewer texts than parts, with each part's own ids."""
    r = random.Random(6)
    parts = [" " + "".join(r.choices("abcdefgé", k=r.randrange(1, 9))) + r.choice("xyz.!") for _ in range(3000)] + [" a\n", "\n", "b", "", " é", " <|endoftext|>", " z", "日本", " ok"] * 3
    t = B.load(PATH)
    texts = []

    class Counting:
        def __getattr__(self, name):
            return getattr(t, name)

        def encode_batch_fast(self, given, **options):
            texts.extend(given)
            return t.encode_batch_fast(given, **options)

    edges = np.append(0, np.cumsum([len(p.encode()) for p in parts]))
    ids, at = B.PieceEncoder(Counting()).library(np.frombuffer("".join(parts).encode(), np.uint8), edges)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == brute(parts)[0]
    assert len(texts) < 60
    d = B.Decoder(t)
    every = [np.array(x, np.uint32).tobytes() for x in brute(ODD)[0]]
    assert d.decode_all(every) == [d.decode(x) for x in every] == ODD and d.decode_all([]) == []
