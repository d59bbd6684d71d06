import zlib

import numpy as np
import pyarrow as pa

from quillspark.llm import op09_token_files as T
from quillspark.llm.op10_bpe import default_vocabulary, load
from tests.llm.test_op10 import ODD, mixed

PATH = default_vocabulary("word_bpe_49k.json")


def test_words_same_as_library():
    t = load(PATH)
    texts = ODD + mixed(3) + ["ΑΣ ΑΣ. Σ", "é é e ́x", "İstanbul  ẞ", "it's 'S we'LL", "x\x1cy\x1dz\x85w v", "THE Cat. sat, ÀÉ× Ñandú"]
    for part in (texts, [x for x in texts if "<|" not in x]):
        ids, ends = T.WordEncoder(t, np.dtype("<u4")).encode(pa.array(["skipped", *part]).slice(1))
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [t.encode(x, add_special_tokens=False).ids for x in part]


def brute(rows):
    t = load(PATH)
    out, at = [], 0
    coded = [(d, np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4")) for d, x in rows]
    for d, ids in sorted(coded, key=lambda r: (r[0] is not None, r[0] or 0, len(r[1]))):
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_files(spark):
    rows = [(int(i), t) for i, t in zip(np.random.default_rng(1).permutation(400), ODD + mixed(4))] + [(None, "no id"), (7, "abc def"), (7, "abc def"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as start", "1 as frame").repartition(5)
    got = T.read(T.write(docs, PATH, 2, shards=3), digest_only=True)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)
    manifest = T.write(docs, PATH, 2, shards=3)
    ids = {(r.doc_id, r.start): np.frombuffer(r.ids, "<u4") for r in T.read(manifest).collect()}
    assert len(ids) == len(rows)
    first = manifest.orderBy("shard").first()
    shard = T.Shard(first.uri, T.read_dictionary(first.dictionary))
    assert shard.document(3)[-1] == 2 and shard.index["n"].sum() == first.n_ids


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert T.read(T.write(docs, PATH, 2)).count() == 0
