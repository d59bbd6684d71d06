import hashlib
import random

import numpy as np
import pytest

from quillspark.llm import op05_suffix_dedup as D
from quillspark.llm import suffixes as X


@pytest.mark.parametrize("seed", range(4))
def test_suffix_order_and_factors(seed):
    r = np.random.default_rng(seed)
    text = np.concatenate([r.integers(97, 99, 150), np.tile([97, 98, 98], 30), np.full(40, 97), r.integers(0, 256, 60)]).astype(np.uint8)
    body = text.tobytes()
    for depth in (8, 13, 16, 40, 200):
        rank = X.prefix_ranks(text, depth)
        keys = [(body[i:] + bytes(depth))[:depth] for i in range(len(body))]
        assert [sorted(keys).index(k) for k in keys] == rank.tolist()
    want = [max([next((k for k in range(201) if k == 200 or j + k >= len(body) or i + k >= len(body) or body[i + k] != body[j + k])) for j in range(i)], default=0) for i in range(len(body))]
    assert X.longest_previous_factors(text, 200).tolist() == want
    values = r.permutation(200)
    assert X.nearest_smaller(values).tolist() == [max((j for j in range(i) if values[j] < values[i]), default=-1) for i in range(200)]


def brute(rows, length, keep):
    seen, order = {}, sorted(((d is not None, d or 0, k, (t or "").encode()) for k, (d, t) in enumerate(rows)), key=lambda x: x[:3])
    for has, d, k, b in order:
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i : i + length], []).append((has, d, k, i))
    out = []
    for has, d, k, b in order:
        gone = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - length + 1):
            at = seen[b[i : i + length]]
            if len(at) > 1 and (keep == "none" or at[0] != (has, d, k, i)):
                gone[i] += 1
                gone[i + length] -= 1 if i + length < len(gone) else 0
        gone = np.cumsum(gone[:-1]) > 0
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d if has else None, len(b), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(r.randrange(20, 120)) for _ in range(6)]
    common = prose(60)
    texts = ["", "x" * 199, "y" * 200, "z" * 500, "ab " * 200, prose(2000)]
    for _ in range(50):
        t = prose(r.randrange(1, 90))
        for _ in range(r.randrange(3)):
            p = r.choice(passages)
            a, b = sorted(r.randrange(len(p)) for _ in range(2))
            t += " " + (p if r.random() < 0.5 else p[a:b]) + prose(5)
        texts.append(t)
    texts += r.sample(texts, 5) + [prose(3) + common + prose(3) for _ in range(12)]
    ids = r.sample(range(5000), len(texts))
    return list(zip(ids, texts)) + [(9000, None), (None, passages[0] * 2)]


@pytest.mark.parametrize("hot", [256, 3])
@pytest.mark.parametrize("keep", ["none", "first"])
def test_same_as_brute_force(spark, monkeypatch, keep, hot):
    monkeypatch.setattr(D, "DIFFERENT", hot)
    monkeypatch.setattr(D, "BUCKET_BYTES", 5000)
    rows = corpus(hot)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' as row", "1 as begin").repartition(6)
    got = D.digests(D.deduplicate(docs, 200, keep))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 200, keep)


def test_pieces_and_repeats(spark):
    r = np.random.default_rng(1)
    data = r.integers(97, 100, 6000).astype(np.uint8)
    data[4000:4500] = data[100:600]
    offsets = np.array([0, 0, 1500, 1600, 6000])
    h, begin, n, at = D.blocks(data, offsets)
    h2, begin2, n2, at2 = D.blocks(data, offsets, piece=333)
    flat = lambda h, b, n: {int(x) + k: int(y) for y, x, m in zip(h, b, n) for k in range(m)}
    assert flat(h, begin, n) == flat(h2, begin2, n2) and len(flat(h, begin, n)) == 1301 + 4201
    # Cells of any width hold each window once, and the anchor's place falls by one from window to window.
    for width in (11, 1, 500):
        block, first, size, place, cell = D.cells(begin, n, at, width)
        assert sorted((int(b), int(f) + k, int(p) - k) for b, f, m, p in zip(block, first, size, place) for k in range(m)) == sorted((b, int(f) + k, int(p) - k) for b, (f, m, p) in enumerate(zip(begin, n, at)) for k in range(m))
        assert ((place // width == cell) & ((place - size + 1) // width == cell)).all()
    docs = spark.createDataFrame([(1, "q" * 50 + "w" * 300), (1, "q" * 50 + "w" * 300), (None, "a")], "doc_id long, text string")
    assert sorted(map(tuple, D.deduplicate(docs).select("doc_id", "n_removed").collect()), key=str) == [(1, 350), (1, 350), (None, 0)]
    assert D.deduplicate(docs.limit(0)).count() == 0


def test_text_above_a_megabyte_and_hot_groups(spark, monkeypatch):
    """A long text shares a passage with itself; a third of the rows are one text, and many more hold one passage."""
    monkeypatch.setattr("quillspark.llm.common.HOT_ROWS", 5)
    monkeypatch.setattr(D, "DIFFERENT", 16)
    r = random.Random(8)
    prose = lambda n: "".join(r.choices("abcdefgh ", k=n))
    passage, copy = prose(260), prose(900)
    rows = [(0, prose(530_000) + passage + prose(530_000) + passage)] + [(k, copy) for k in range(1, 40)] + [(k, prose(r.randrange(50)) + passage + prose(r.randrange(50))) for k in range(40, 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert len(rows[0][1]) > 1 << 20
    for keep in ("none", "first"):
        assert sorted(map(tuple, D.digests(D.deduplicate(docs, keep=keep)).collect()), key=str) == brute(rows, 200, keep)


def test_windows_of_a_bucket_take_few_sorted_suffixes(monkeypatch):
    """Blocks as buckets hold them, about 240 bytes with 40 windows: right for both rules, and below 4.5 sorted words a byte."""
    r = random.Random(5)
    prose = lambda n: "".join(r.choices("abcd ", k=n)).encode()
    texts = [prose(r.randrange(199, 300)) for _ in range(60)]
    texts += [t[:k] + b"#" + t[k + 1 :] for t in texts for k in (20, 230)] + texts[:9] + [b"", b"x" * 150]
    weights = np.array([1 + (k % 7 == 0) for k in range(len(texts))])
    sorted_words, sort, argsort = [], np.sort, np.argsort
    monkeypatch.setattr(np, "sort", lambda x, *a, **k: sorted_words.append(len(x)) or sort(x, *a, **k))
    monkeypatch.setattr(np, "argsort", lambda x, *a, **k: sorted_words.append(len(x)) or argsort(x, *a, **k))
    body, offsets = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    windows = [t[i : i + 200] for t in texts for i in range(len(t) - 199)]
    of = [k for k, t in enumerate(texts) for _ in range(len(t) - 199)]
    times = {}
    for w, k in zip(windows, of):
        times[w] = times.get(w, 0) + int(weights[k])
    hit, ends = D.repeated_windows(body, offsets, weights, 200, "none")
    assert hit.tolist() == [times[w] > 1 for w in windows] and ends[-1] == len(windows)
    assert sum(sorted_words) < 4.5 * len(body)
    assert D.repeated_windows(body, offsets, weights, 200, "first")[0].tolist() == [w in windows[:k] for k, w in enumerate(windows)]
    # Beyond 2 ** 21 bytes no word has room for two ranks and a place.
    large = np.concatenate([body, np.random.default_rng(2).integers(0, 256, 1 << 21).astype(np.uint8), body])
    place = np.append(np.arange(1000), np.arange(len(large) - len(body), len(large) - len(body) + 1000))
    got, small = X.prefix_ranks(large, 200, place), X.prefix_ranks(body, 200)[:1000]
    assert got[:1000].tolist() == got[1000:].tolist() and (got[:1000, None] == got[None, :1000]).tolist() == (small[:, None] == small).tolist()
