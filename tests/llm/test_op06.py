import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import op06_decontamination as D

SF = "/root/testdata/sf0.01"


def tokens(text):
    return [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", text or "")]


def grams(w, n):
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(items, text, overlap=0.8):
    """Verification of every item against every window, without an index."""
    bags = [(i, tokens(t)) for i, t in items if tokens(t)]
    longest = max((len(b) for _, b in bags), default=0)
    w, found = tokens(text), set()
    if not longest:
        return found
    for begin in range(0, max(1, len(w)), longest):
        window = w[begin : begin + 2 * longest]
        for i, bag in bags:
            cut = len(bag) - len(bag) // 3
            shares = []
            for part in (bag[:cut], bag[cut:], bag):
                n = max(1, min(5, len(part)))
                own = grams(part, n)
                shares.append(len(own & grams(window, n)) / len(own) if own else 1.0)
            if max(min(5, len(bag)), 1) <= len(window) and shares[2] >= overlap and min(shares[:2]) >= 0.5:
                found.add(i)
    return found


def scan(items, texts, overlap=0.8):
    """Texts through one index in memory."""
    index = D.Index([(i, t, None) for i, t in items], overlap)
    body = [t.encode() for t in texts]
    return D.Shards(["here"], index.longest).scan(np.frombuffer(b"".join(body), np.uint8), np.cumsum([0, *map(len, body)]), {"here": index}, overlap)


@pytest.mark.parametrize("overlap", [0.8, 0.5, 1.0])
def test_same_as_brute_force(overlap):
    r = random.Random(1)
    vocabulary = [f"w{i}" for i in range(150)] + ["É", "日本"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 40)))) for i in range(60)] + [(100, ""), (101, "?!"), (102, "one two three four five"), (103, "one two three four five")]
    texts = ["", "!!", "One, two... THREE four-five", "one two three four"]
    for _ in range(120):
        words = [r.choice(vocabulary) for _ in range(r.randrange(0, 300))]
        for _ in range(r.randrange(3)):
            leak = r.choice(items)[1].split()
            for _ in range(r.choice([0, 0, 0, 1, 2])):
                if leak:
                    leak[r.randrange(len(leak))] = "other"
            at = r.randrange(len(words) + 1)
            words[at:at] = leak
        texts.append(" ".join(words))
    assert [set(f) for _, f in scan(items, texts, overlap)] == [brute(items, t, overlap) for t in texts]


def test_threshold_loses_nothing_when_rare_words_are_lacking():
    """Items whose weight lies in a few rare words at one end, which the passage lacks."""
    common = " ".join(f"the{k}" for k in range(25))
    items = [(i, f"{common} rare{i} rarer{i} rarest{i}") for i in range(50)]
    texts = [f"{common} rare7 and more", common, f"x {common} rare7 rarer7 rarest7 y"]
    found = [set(f) for _, f in scan(items, texts)]
    assert found == [brute(items, t) for t in texts] and found[0] and found[2]


def test_five_thousand_items(spark):
    """Every item is planted once, whole or with one word changed; shards, blocks and one pass give what brute force gives."""
    r = random.Random(4)
    words = [f"v{k}" for k in range(3000)]
    items = [(i, " ".join(r.choices(words, k=r.randrange(5, 30)))) for i in range(5000)]
    texts = []
    for begin in range(0, 5000, 5):
        parts = []
        for _, t in items[begin : begin + 5]:
            w = t.split()
            if len(w) > 25:
                w[r.randrange(len(w))] = "changed"
            parts += [*r.choices(words, k=r.randrange(3, 40)), *w]
        texts.append(" ".join(parts))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: set(x.item_ids) for x in D.contamination(docs, table, shard_items=1100).collect()}
    assert got == {x.doc_id: set(x.item_ids) for x in D.contamination(docs, table).collect()}
    for k in range(0, 1000, 50):
        assert got[k] == brute(items, texts[k])
    assert sum(map(len, got.values())) > 4000


@pytest.mark.parametrize("shard", [4096, 8])
def test_whole_table(spark, shard):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = [(r.item_id, " ".join(tokens(r.text))) for r in items.collect()]
    got = {r.doc_id: set(r.item_ids) for r in D.contamination(docs, items, shard_items=shard).collect()}
    texts = {r.doc_id: " ".join(tokens(r.text)) for r in docs.collect()}
    for d, text in texts.items():
        assert got[d] >= {i for i, t in rows if f" {t} " in f" {text} "}
    clean = D.keep_clean(docs.withColumn("item_ids", docs.lang), items, shard_items=shard)
    assert {r.doc_id for r in clean.collect()} == {d for d, x in got.items() if not x} and len(clean.columns) == 6


@pytest.mark.parametrize("shard", [4096, 1])
def test_odd_rows(spark, shard):
    docs = spark.createDataFrame([(1, None), (None, "one two three four five"), (None, "y"), (2, "x " * 30_000), (2, "x"), (2, "x"), (3, "")], "doc_id long, text string").withColumn("item_ids", F.lit("clash"))
    items = spark.createDataFrame([(1, "one two three four five"), (1, "one two three four five"), (2, None), (None, "x"), (3, "")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = sorted(((r.doc_id, tuple(r.item_ids)) for r in D.contamination(docs, items, shard_items=shard).collect()), key=str)
    assert got == sorted([(1, ()), (None, (1,)), (None, ()), (2, ()), (2, ()), (2, ()), (3, ())], key=str)
    kept = D.keep_clean(docs, items, shard_items=shard)
    assert kept.columns == docs.columns and sorted((str(r.doc_id), r.text) for r in kept.collect() if r.text in ("x", "y", "")) == [("2", "x"), ("2", "x"), ("3", ""), ("None", "y")] and kept.count() == 6
    assert D.contamination(docs.limit(0), items).count() == 0
    assert all(not r.contaminated for r in D.contamination(docs, items.limit(0)).collect())


def test_text_above_a_megabyte(spark):
    item = "alpha beta gamma delta epsilon zeta"
    text = "filler words go here " * 60_000 + item + " and on" * 50_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = D.contamination(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).first()
    assert len(text) > 1 << 20 and list(row.item_ids) == [9] and row.best_overlap == 1.0
