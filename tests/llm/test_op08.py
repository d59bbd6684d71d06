import random
import re
from collections import defaultdict

import numpy as np
import pytest

from quillspark.llm import op08_near_dedup as N
from quillspark.llm.components import components, union_find


def sets(text, words):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(w) < words:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def brute(rows, words, percent):
    s = [(d, sets(t, words)) for d, t in rows]
    edges = [(a, b) for i, (a, x) in enumerate(s) for b, y in s[:i] if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y)]
    root = union_find(iter(edges))
    return sorted(((d, len(x), root.get(d, d), d is None or root.get(d, d) == d) for d, x in s), key=str)


def near_copies(seed, n=40):
    r = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(400)]
    out = []
    for _ in range(n):
        base = [r.choice(vocabulary) for _ in range(r.randrange(20, 160))]
        out.append(" ".join(base))
        for _ in range(r.randrange(0, 9)):
            copy = list(base)
            for _ in range(r.randrange(0, 7)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            out.append(r.choice([" ", "\n", "\t "]).join(copy) if r.random() < 0.8 else " ".join(base).lower())
    r.shuffle(out)
    return out


ODD = [None, "", "  \n", "a", "A", "a b", "A  B", "a b c", "x" * 5000, "é É", " lead", "same same same same same", "same same same same", "a\x0bb\x0cc\rd", "\x1f a b", "same same same same same same"]


@pytest.mark.parametrize("words", [1, 3, 5])
def test_sets(words):
    texts = ODD + near_copies(1, 5)
    body = [(t or "").encode() for t in texts]
    h, ends = N.shingles(np.frombuffer(b"".join(body), np.uint8), np.cumsum([0, *map(len, body)]), words)
    own = [set(h[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])]
    want = [sets(t, words) for t in texts]
    assert list(map(len, own)) == list(map(len, want))
    assert all(len(own[i] & own[j]) == len(want[i] & want[j]) for i in range(len(own)) for j in range(i))


def slow_superminhash(h, places):
    """The published loop, element by element, with the same random words."""
    best, p, q = [2**64 - 1] * places, list(range(places)), [-1] * places
    for i, x in enumerate(h):
        for j in range(places):
            r = int(N.finish(np.array([(int(x) + j * 0x9E3779B97F4A7C15 + 0x1234567) % 2**64], np.uint64))[0])
            k = j + (r & 0xFFFF) % (places - j)
            for t in (j, k):
                if q[t] != i:
                    q[t], p[t] = i, t
            p[j], p[k] = p[k], p[j]
            best[p[j]] = min(best[p[j]], (j << 48) | (r >> 16))
    return best


def test_superminhash():
    r = np.random.default_rng(2)
    sizes = [0, 1, 2, 7, 40, 300]
    h = r.integers(0, 2**63, sum(sizes), dtype=np.uint64)
    ends = np.cumsum([0, *sizes])
    got = N.superminhash(h, ends, 16)
    assert got.tolist() == [slow_superminhash(h[a:b], 16) for a, b in zip(ends[:-1], ends[1:])]
    x = r.integers(0, 2**63, 1000, dtype=np.uint64)
    pair = N.superminhash(np.concatenate([x[:900], x[100:]]), np.array([0, 900, 1800]))
    assert abs((pair[0] == pair[1]).mean() - 0.8) < 0.15


def test_components(spark):
    r = random.Random(7)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1300)] + [(5000, i) for i in range(5001, 5100)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "x long, y long").repartition(7)).collect()))
    want = {n: m for n, m in union_find(iter(edges)).items() if n != m}
    assert got == want


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_same_as_brute_force(spark, words, percent):
    ids = iter(random.Random(3).sample(range(10_000), 2000))
    rows = [(next(ids), t) for t in ODD + near_copies(words, 30)] + [(None, "a b c"), (12_000, "b c d e f g"), (12_000, "b c d e f g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as component_id", "1L as key")
    assert sorted(map(tuple, N.near_duplicates(docs, words, percent).collect()), key=str) == brute(rows, words, percent)
    kept = N.keep_one(docs, words, percent)
    assert kept.columns == docs.columns
    roots = {r[2] for r in brute(rows, words, percent)}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(roots, key=str)
    assert N.near_duplicates(docs.limit(0), words, percent).count() == 0


def test_chains_that_the_pivot_does_not_link(spark):
    """Steps of small edits: ends are far apart, all neighbours linked."""
    r = random.Random(11)
    text = [f"t{r.randrange(9999)}" for _ in range(120)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(text)))
        for _ in range(2):
            text[r.randrange(120)] = f"n{r.randrange(9999)}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, N.near_duplicates(docs, 3, 85).collect()), key=str) == brute(rows, 3, 85)
