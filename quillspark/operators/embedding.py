"""Pluggable model calls: embedders, generators, rewriters; a hashing embedder stands in where no model is at hand."""

import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T

BATCH, DIMENSIONS = 32, 64


def hashed(tokens: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Signed counts of hashed tokens, of length 1."""
    import xxhash

    v = np.zeros(dimensions)
    for t in tokens:
        h = xxhash.xxh3_64_intdigest(t)
        v[h % dimensions] += 1 if h >> 63 else -1
    n = np.linalg.norm(v)
    return v / n if n else v


def hashing_embedder(texts: list[str]) -> list[np.ndarray]:
    return [hashed(t.split()) for t in texts]


def embed(rows: DataFrame, embedder: Callable[[list[str]], list] = hashing_embedder, text: str = "text", prefix: str = "", batch: int = BATCH, normal: bool = True) -> DataFrame:
    """Adds `embedding`: model calls in batches, vectors of length 1. The default embedder gets search tokens."""
    content = F.array_join(T.tokens(F.col(text)), " ") if embedder is hashing_embedder else F.concat(F.lit(prefix), F.coalesce(F.col(text), F.lit("")))

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for k in range(0, len(texts), batch):
            for v in embedder(texts.iloc[k : k + batch].tolist()):
                v = np.asarray(v, np.float64)
                n = np.linalg.norm(v)
                out.append((v / n if normal and n else v).astype(np.float32))
        return pd.Series(out)

    return rows.withColumn("embedding", run(content))


def generate(prompts: DataFrame, model: Callable[[str], str], parallel: int = 1, attempts: int = 3, wait: float = 4.0) -> DataFrame:
    """(query_id, answer, error) from (query_id, prompt); at most `parallel` calls at a time."""

    def run(frames):
        for frame in frames:
            rows = []
            for query_id, prompt in zip(frame["query_id"], frame["prompt"]):
                try:
                    rows.append((query_id, with_retries(lambda: model(prompt), attempts, wait), None))  # noqa: B023
                except Exception as e:  # told per question, as the others go on
                    rows.append((query_id, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["query_id", "answer", "error"])

    return prompts.select("query_id", "prompt").repartition(parallel).mapInPandas(run, "query_id long, answer string, error string")


def with_retries(call: Callable, attempts: int = 3, wait: float = 4.0, most: float = 10.0):
    """Tries again after growing pauses; the last error is raised."""
    for k in range(attempts):
        try:
            return call()
        except Exception:
            if k == attempts - 1:
                raise
            time.sleep(min(most, wait * 2**k))
    return None


def rewrite(question: str, history: str, model: Callable[[str], str] | None, least: int = 10) -> str:
    """The question with its history folded in; the question itself on errors and on very short answers."""
    if not model or not history.strip():
        return question
    try:
        text = (model(f"{history}\n\n{question}") or "").strip()
    except Exception:  # a rewrite is only a help
        return question
    return text if len(text) >= least else question
