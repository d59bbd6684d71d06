import random
import re

import pytest

from quillspark.llm import op07_sentence_spans as S


def split(text):
    """[(sentence with what follows it, its words)], and what comes before the first."""
    words = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
    out, begin = [], 0
    for k, m in enumerate(words):
        gap = text[m.end() : words[k + 1].start()] if k + 1 < len(words) else ""
        if re.search(r"[.!?]$|.*[.!?][\"')\]}]$", m[0]) or "\n" in gap or k + 1 == len(words):
            part = words[begin : k + 1]
            end = words[k + 1].start() if k + 1 < len(words) else len(text)
            out.append((text[part[0].start() : end], [re.sub("[A-Z]", lambda c: c[0].lower(), w[0]) for w in part]))
            begin = k + 1
    return out, text[: words[0].start()] if words else text


def brute(rows, least, words):
    cut = [(d, *split(t or "")) for d, t in rows]
    seen = {}
    where = []
    for r, (d, s, _) in enumerate(cut):
        for i in range(len(s)):
            for j in range(i + least, len(s) + 1):
                own = [w for x in s[i:j] for w in x[1]]
                if len(own) >= words:
                    if d is not None:
                        where.append((tuple(own), d, i, j))
                        seen[tuple(own)] = min((d, i), seen.get(tuple(own), (d, i)))
                    break
    gone = {}
    for own, d, i, j in where:
        if seen[own] != (d, i):
            gone.setdefault(d, set()).update(range(i, j))
    out = []
    for d, s, head in cut:
        g = gone.get(d, set()) if d is not None else set()
        out.append((d, len(s), len([k for k in range(len(s)) if k in g]), head + "".join(x[0] for k, x in enumerate(s) if k not in g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least,words", [(1, 1), (2, 6), (3, 20)])
def test_same_as_brute_force(spark, least, words):
    r = random.Random(least)
    pool = [" ".join(r.choice(["a", "b", "É", "don't", "x.y", '"q."', "Z"]) for _ in range(r.randrange(1, 7))) + r.choice([".", "!", "?", '."', "\n", ".\n\n"]) for _ in range(25)]
    rows = []
    for i in r.sample(range(9999), 60):
        rows.append((i, r.choice(["", " ", "\n"]) + " ".join(r.choice(pool) for _ in range(r.randrange(0, 14))) + r.choice(["", " tail", " "])))
    passage = " ".join(r.choice(pool) for _ in range(9))
    rows += [(20_000 + i, f"Own {i} words here. {passage} End {i}") for i in range(5)] + [(30_000, None), (30_001, ""), (None, passage), (30_002, "no stop " * 20_000), (30_003, passage + " " + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as begin", "'k' as kept_text").repartition(5)
    got = S.deduplicate(docs, least, words)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, least, words)


def test_repeated_and_empty(spark):
    text = "One two three four five. Six seven eight nine ten. " * 2
    docs = spark.createDataFrame([(1, text), (1, text), (2, "Other. " + text)], "doc_id long, text string")
    got = sorted(map(tuple, S.digests(S.deduplicate(docs, 2, 10)).select("doc_id", "n_sentences", "n_removed").collect()))
    assert got == [(1, 4, 2), (1, 4, 2), (2, 5, 4)]
    assert S.deduplicate(docs.limit(0)).count() == 0
