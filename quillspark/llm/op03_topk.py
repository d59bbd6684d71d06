"""Operator 3: exact top-k search with multi-resolution segment statistics.

Vectors are cut into 1, 4 and 16 segments; each segment keeps its mean and its deviation (the norm of what is left
without the mean). Within a segment of length L, q.x = L*mean(q)*mean(x) + (rest of q).(rest of x), and the second part is
at most dev(q)*dev(x), so summed over segments one gets an upper bound of the inner product; as
|q-x|^2 = |q|^2 + |x|^2 - 2 q.x, it is a lower bound of the distance. Bounds are taken coarse to fine; a candidate falls
as soon as its bound is below the query's k-th score so far, and survivors get the exact score. Bounds are widened by
more than their rounding error, and exact scores are 64-bit integers, so results are exact.

Vectors are packed into blocks of rows. A tile is a block of queries with a group of candidates; queries go once to
each group and candidates once to each query block, by equi-joins on the tile's key. Each tile returns its own top k for
each query; the tops are merged by one more pass that is again in parts. Numbers of groups and query blocks follow the
counts and the vectors' length, so memory per task is bounded and no task gets more than one tile at a time.

K-th scores are there before the bounds are used: the first group's tiles are worked first, and each query carries its
k-th score of that group to all the others; in every tile, at each level, queries first get exact scores for the
2k candidates with the best bounds. Queries are worked some at a time, like ones together; finer bounds and exact products are taken
for the candidates that survive for one of them. There is no other path, whatever the share of survivors.

Defined cases: vectors null, empty, of another length than the most common one, or holding null or non-finite
components take no part; a null vec_id takes no part; rows that repeat a vec_id are candidates each, save for a query of
that very vec_id, and repeat as queries only once per vec_id (the row whose vector is smallest in order); ties go to the
smaller vec_id; a scaled component that a double can't hold counts as the largest double, and a score that 64 bits can't
hold as the largest or smallest that they can; vectors with components so large that sums of products could be
rounded are scored with Python's integers; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialize

RESULT = "query_id long, rank int, vec_id long, score long"
#: Candidates of a group and queries of a block, about, and bytes of a group's vectors at most.
GROUP_ROWS, BLOCK_ROWS, GROUP_BYTES = 16_384, 4096, 16 << 20
LEVELS = (1, 4, 16)
#: Queries that are worked together.
TOGETHER = 64
MOST = (1 << 63) - 1


class Bounds:
    """Segment means and deviations of vectors, scaled so that a bound is one matrix product."""

    def __init__(self, x: np.ndarray):
        self.exact = x
        self.levels = []
        for n in LEVELS:
            cuts = np.unique(np.linspace(0, x.shape[1], n + 1).astype(int))[:-1]
            length = np.diff(np.append(cuts, x.shape[1])).astype(np.float64)
            mean = np.add.reduceat(x, cuts, 1) / length
            square = np.add.reduceat(x * x, cuts, 1)
            rest = np.sqrt(np.maximum(square - length * mean * mean, 0))
            self.levels.append(np.concatenate([mean * np.sqrt(length), rest], 1))
        self.slack = np.sqrt((x * x).sum(1))

    def alike(self) -> np.ndarray:
        """An order in which vectors with like means stand together."""
        return np.lexsort(self.levels[min(1, len(LEVELS) - 1)].T[::-1])


def search(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray | None = None, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, vec_id, score) of each query's k best: largest score first, ties to the smaller id.

    `least`: scores below which a query needs nothing. `counts`, if given, gets all pairs, the pairs that survive each
    level, and the exact products made.
    """
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(queries) or not len(vectors):
        return nothing
    least = np.full(len(queries), -np.inf) if least is None else least.astype(np.float64)
    # Up to here scores are exact in float64 in any order of summation.
    limit = np.sqrt(2.0**52 / queries.shape[1])
    big_q, big_v = np.abs(queries).max(1) > limit, np.abs(vectors).max(1) > limit
    found = [nothing]
    if big_q.any():
        found.append(_plain(np.flatnonzero(big_q), queries, query_ids, vectors, ids, k))
    if big_v.any():
        found.append(_plain(np.flatnonzero(~big_q), queries, query_ids, vectors[big_v], ids[big_v], k))
    some = np.flatnonzero(~big_q)
    x, own_ids = Bounds(vectors[~big_v]), ids[~big_v]
    every = Bounds(queries[some])
    if len(some) and len(own_ids):
        some = some[every.alike()]
        for begin in range(0, len(some), TOGETHER):
            rows = some[begin : begin + TOGETHER]
            i, j, score = _together(Bounds(queries[rows]), query_ids[rows], x, own_ids, least[rows], k, counts)
            found.append(best(rows[i], own_ids[j], score, k))
    return best(*(np.concatenate(c) for c in zip(*found)), k)


def _together(q: Bounds, query_ids: np.ndarray, x: Bounds, ids: np.ndarray, least: np.ndarray, k: int, counts: np.ndarray | None):
    """(query, candidate, score) of all pairs that may belong to a query's k best."""
    columns = np.arange(len(ids))
    dead = query_ids[:, None] == ids[None, :]
    told, products = [dead.size], 0
    for mine, its in zip(q.levels, x.levels):
        bound = mine @ its[columns].T
        bound[dead] = -np.inf
        # The candidates with the best bounds get their scores first; the k-th of them is what the others must reach.
        first = min(2 * k, len(columns))
        near = np.argpartition(bound, len(columns) - first, axis=1)[:, len(columns) - first :] if first < len(columns) else np.broadcast_to(np.arange(first), bound.shape)
        score = np.einsum("id,ijd->ij", q.exact, x.exact[columns[near]])
        score[np.take_along_axis(dead, near, 1)] = -np.inf
        products += score.size
        if first >= k > 0:
            least = np.maximum(least, np.partition(score, first - k, axis=1)[:, first - k])
        dead |= bound < (least - 1e-9 * (1 + q.slack * x.slack.max()))[:, None]
        told.append(dead.size - np.count_nonzero(dead))
        left = ~dead.all(0)
        columns, dead = columns[left], dead[:, left]
        if not len(columns):
            break
    told += [0] * (1 + len(q.levels) - len(told))
    exact = np.rint(q.exact @ x.exact[columns].T)
    if counts is not None:
        counts += np.array([*told, exact.size + products])
    exact[dead] = -np.inf
    if len(columns) > k:
        least = np.maximum(least, np.partition(exact, len(columns) - k, axis=1)[:, len(columns) - k])
    i, j = np.nonzero((exact >= least[:, None]) & (exact > -np.inf))
    return i, columns[j], exact[i, j].astype(np.int64)


def best(at: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, in order."""
    order = np.lexsort((vec, ~score, at))
    at, vec, score = at[order], vec[order], score[order]
    place = np.arange(len(at)) - np.searchsorted(at, at, "left")
    keep = place < k
    return at[keep], vec[keep], score[keep]


def _plain(rows, queries, query_ids, vectors, ids, k):
    out = []
    whole = [[int(c) for c in v] for v in vectors]
    for n in rows.tolist():
        q = [int(c) for c in queries[n]]
        scored = sorted((-max(-MOST - 1, min(MOST, sum(a * b for a, b in zip(q, v)))), int(i)) for v, i in zip(whole, ids) if i != query_ids[n])
        out += [(n, i, -s) for s, i in scored[:k]]
    return tuple(np.array(c, np.int64) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: float | None) -> DataFrame:
    """(vec_id, v): v as doubles, floor(scale * component) where a scale is given; rows that take part only."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine)
    if not scale:
        return rows
    largest = float(np.finfo(np.float64).max)

    def scaled(c: Column) -> Column:
        x = F.greatest(F.least(F.lit(float(scale)) * c, F.lit(largest)), F.lit(-largest))
        # Doubles beyond 2**52 have no fraction, and floor() would stop at the largest long.
        return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)

    return rows.withColumn("v", F.transform("v", scaled))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float | None = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", group_rows: int = GROUP_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each query's k rows of highest inner product. `is_query` is a condition on vec_id."""
    rows = usable(vectors, id_col, vector_col, scale)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).orderBy(F.desc("n"), "d").first()
    d, n, q = (sizes.d, sizes.n, sizes.q) if sizes else (1, 0, 0)
    fit = max(256, GROUP_BYTES // (8 * d))
    groups, blocks = max(1, -(-n // min(group_rows, fit))), max(1, -(-q // min(block_rows, fit)))
    rows = rows.where(F.size("v") == d)
    # The tile of a row follows from its hash alone, so that a lost task finds the same rows again.
    spread = F.pmod(F.xxhash64("vec_id", "v"), F.lit(groups)).cast("int")
    candidates = rows.select("vec_id", "v", F.lit(None).cast("double").alias("least"), spread.alias("g"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.lit(False).alias("is_query"))
    # A vec_id that repeats asks once; min() needs one row per query at most, made before the shuffle where it can be.
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))

    def tile(table: pa.Table) -> pa.Table:
        asking = table.column("is_query").to_numpy()
        ids = table.column("vec_id").to_numpy()
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        least = table.column("least").fill_null(-np.inf).to_numpy()
        queries = ids[asking]
        at, vec, score = search(v[asking], queries, v[~asking], ids[~asking], k, least[asking])
        return pa.table({"query_id": pa.array(queries[at], pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.int64())})

    def tops_of(asked: DataFrame, least: Column, low: int, high: int) -> DataFrame:
        """Each query's best k of each group from `low` to `high`."""
        asked = asked.select("vec_id", "v", least.cast("double").alias("least"), F.explode(F.sequence(F.lit(low), F.lit(high))).alias("g"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("b"), F.lit(True).alias("is_query"))
        tiles = candidates.where(F.col("g").between(low, high)).unionByName(asked)
        return tiles.groupBy("g", "b").applyInArrow(tile, "query_id long, vec_id long, score long")

    tops = tops_of(asked, F.lit(None), 0, 0)
    if groups > 1:
        tops = materialize(tops, "first-group")
        seeds = tops.groupBy("query_id").agg(F.count("*").alias("c"), F.min("score").alias("least")).where(F.col("c") >= k).select(F.col("query_id").alias("vec_id"), "least")
        tops = tops.unionByName(tops_of(asked.join(seeds, "vec_id", "left"), F.col("least"), 1, groups - 1))
    ordered = F.sort_array(F.collect_list(F.struct(F.bitwise_not("score").alias("s"), "vec_id")))
    # At most k rows for each query and group; halves of the groups are merged first where there are many.
    merged = tops
    if groups > 64:
        merged = tops.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(32))).groupBy("query_id", "part").agg(F.slice(ordered, 1, k).alias("t")).select("query_id", F.inline("t")).select("query_id", "vec_id", F.bitwise_not("s").alias("score"))
    return merged.groupBy("query_id").agg(F.slice(ordered, 1, k).alias("t")).select("query_id", F.posexplode("t").alias("rank", "t")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), F.bitwise_not("t.s").alias("score"))
