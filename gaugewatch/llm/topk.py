"""Exact top-k inner products with a table of pivot distances.

Vectors become integers, so scores are exact. Every candidate block holds the distances of its
rows to a fixed set of pivots. For a query q and a candidate x the triangle inequality gives
d(q, x) >= max over pivots of |d(q, p) - d(x, p)|, hence
q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2 <= (|q|^2 + |x|^2 - bound^2) / 2.
Candidates are scored in the order of this bound, until it falls below the k-th best score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugewatch.llm.common import stage

#: Pivots, rows of a candidate block, rows of a query block, candidates scored at a time.
PIVOTS, CANDIDATE_ROWS, QUERY_ROWS, STEP = 64, 8192, 1024, 256
#: Doubles hold integers exactly up to here.
EXACT = 2**53
LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


def usable(vector: str) -> Column:
    """Not null, and every component a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad


def _matrix(values: pa.Array, scale: int, width: int) -> np.ndarray:
    """Scaled integer components as doubles; shorter vectors end in zeros."""
    lists = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    out = np.zeros((len(lists), width))
    lengths = np.asarray(lists.value_lengths())
    flat = np.floor(np.asarray(lists.flatten(), dtype=np.float64) * scale)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products (queries x rows), held within the range of a long."""
    largest = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(1, rows.shape[1])
    if largest < EXACT:
        return (queries @ rows.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    found = whole(queries).dot(whole(rows).T) if queries.size and rows.size else np.zeros((len(queries), len(rows)))
    return np.vectorize(lambda x: min(max(int(x), LONG_MIN), LONG_MAX), otypes=[np.int64])(found)


def search_block(
    ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(query, best ids, their scores, candidates scored) for each query against one block."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    norms, query_norms = (rows**2).sum(1), (queries**2).sum(1)
    far = lambda x, n: np.sqrt(np.maximum(n[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T, 0))
    table = far(rows, norms)
    for query_id, query, norm, seen_from in zip(query_ids, queries, query_norms, far(queries, query_norms)):
        nearest = np.zeros(len(rows))
        for column, distance in zip(table.T, seen_from):
            np.maximum(nearest, np.abs(column - distance), out=nearest)
        # The slack covers the rounding of distances and norms.
        slack = 1 + 1e-9 * (norm + norms.max(initial=0))
        bound = (norm + norms - nearest**2) / 2 + slack
        turn = np.argsort(-bound, kind="stable")
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        scored = 0
        while scored < len(turn):
            if len(best) == k and bound[turn[scored]] < float(best[-1]):
                break
            chosen = turn[scored : scored + STEP]
            scored += len(chosen)
            scores = _exact(query[None, :], rows[chosen])[0]
            others = ids[chosen] != query_id
            best = np.concatenate([best, scores[others]])
            best_ids = np.concatenate([best_ids, ids[chosen][others]])
            # lexsort: the last key counts first; ~score falls as the score grows, without overflow.
            kept = np.lexsort((best_ids, ~best))[:k]
            best, best_ids = best[kept], best_ids[kept]
        yield query_id, best_ids, best, scored


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    scale: int = 1024,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """The ``k`` candidates of highest integer inner product for every query row.

    Returns query_id, rank from 1, vec_id, score. Every row but the query's own id is a
    candidate; ties go to the smaller id. Rows with a null id, a null vector, or null or
    non-finite components take no part; a shorter vector counts as filled up with zeros;
    repeated rows count as often as they stand there, and each of several query rows that share
    an id gets its own ``k``. Scores outside a long are held at its limits. No queries or no
    candidates give no rows.

    Query blocks of bounded size meet candidate blocks of bounded size, one task for each
    pair, and each pair passes on k rows a query. The driver gets counts and ``PIVOTS`` vectors.
    """
    # Only these columns, under own names; a marker tells queries from the rest.
    usual = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.col(vector).cast("array<double>").alias("embedding"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).where(F.col("vec_id").isNotNull() & usable("embedding"))
    # A number tells query rows of one id apart; it is written, so it stays the same.
    usual = stage(usual.withColumn("row", F.monotonically_increasing_id()))
    total = usual.agg(
        F.count("*"), F.count(F.when(F.col("asks"), 1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))
    ).first()
    rows, asking, width = total
    sides = (max(1, math.ceil(rows / CANDIDATE_ROWS)), max(1, math.ceil(asking / QUERY_ROWS)))
    chosen = usual.orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(PIVOTS).toArrow()["embedding"]
    pivots = _matrix(chosen, scale, width)

    def search(key: tuple, block: pa.Table) -> pa.Table:
        queries = block.filter(block["asks"])
        candidates = block.filter(pa.compute.invert(block["asks"]))
        found = search_block(
            candidates["vec_id"].to_numpy(),
            _matrix(candidates["embedding"], scale, width),
            queries["vec_id"].to_numpy(),
            _matrix(queries["embedding"], scale, width),
            pivots,
            k,
        )
        out = [
            (np.full(len(ids), row), np.full(len(ids), q), ids, scores)
            for row, (q, ids, scores, _) in zip(queries["row"].to_pylist(), found)
        ]
        columns = [np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(4)]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["query_row", "query_id", "vec_id", "score"])

    candidate_side, query_side = (F.pmod(F.xxhash64("vec_id", F.lit(i)), F.lit(n)) for i, n in enumerate(sides))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    as_candidates = usual.select(
        "vec_id", "embedding", F.lit(False).alias("asks"), "row", candidate_side.cast("int").alias("c"), all_of(sides[1]).alias("q")
    )
    as_queries = usual.where("asks").select(
        F.col("vec_id"), "embedding", "asks", "row", all_of(sides[0]).alias("c"), query_side.cast("int").alias("q")
    )
    pairs = as_candidates.unionByName(as_queries).groupBy("c", "q")
    found = pairs.applyInArrow(search, "query_row long, query_id long, vec_id long, score long").where(F.col("query_id").isNotNull())
    best_first = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.select("query_id", F.row_number().over(best_first).alias("rank"), "vec_id", "score")
    return ranked.where(F.col("rank") <= k)
