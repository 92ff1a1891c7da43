"""Exact top-k search by inner product: tiled matrix products and a tree of merges.

Queries are dealt to blocks and candidates to shards of bounded size. A tile is one block against one shard: one matrix
product, from which each query keeps its k best. Lists of the same query meet in groups of ``FAN`` shards, then in groups
of those, so no task ever sees more than ``FAN * k`` entries of a query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, SHARD, FAN = 1024, 8192, 16
EXACT = 2**53
LONG = 2**63 - 1


def usable(vec: str):
    """Not null, and every component a finite number."""
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vec).isNotNull() & F.coalesce(ok, F.lit(False))


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    values = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(len(column), dim)


def tile_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of integer-valued vectors. Doubles are exact below 2^53; beyond, Python integers are."""
    if not q.size or not c.size or np.abs(q).max() * np.abs(c).max() * q.shape[1] < EXACT:
        return q @ c.T
    whole = np.frompyfunc(int, 1, 1)
    return whole(q).astype(object) @ whole(c).astype(object).T


def best_of_row(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k best scores of ``ids`` (ascending), ties to the smaller id, the query's own id left out."""
    at = np.flatnonzero(ids != own)
    scores = scores[at]
    if len(at) > k:
        if scores.dtype == object:
            least = sorted(scores, reverse=True)[k - 1]
        else:
            least = np.partition(scores, len(at) - k)[len(at) - k]
        above = np.flatnonzero(scores > least)
        ties = np.flatnonzero(scores == least)[: k - len(above)]  # ids ascend, so these are the smallest
        pick = np.concatenate([above, ties])
        at, scores = at[pick], scores[pick]
    return at


def exact_top_k(queries: DataFrame, rows: DataFrame, k: int, id_col: str, vec_col: str) -> DataFrame:
    """The ``k`` rows with the highest inner product for each query: query_id, rank (from 1), ``id_col``, score (long).

    Vectors hold whole numbers (as doubles); only vectors of the same length meet. Rows with a null id or a vector that is
    null or has null or non-finite components take no part. Rows equal in id and vector count once; a query does not meet
    rows of its own id; ties go to the smaller id. A score beyond a long is returned as the nearest long, after ranking
    by its exact value within a tile. Other columns are not read. Empty tables give an empty result.
    """
    def clean(df: DataFrame) -> DataFrame:
        df = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
        return df.where(F.col("id").isNotNull() & usable("v")).distinct()

    queries, rows = clean(queries), clean(rows)
    blocks = max(1, math.ceil(queries.count() / BLOCK))
    shards = max(1, math.ceil(rows.count() / SHARD))
    left = queries.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).alias("block"),
                          F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    right = rows.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(shards)).alias("shard"),
                        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def tile(q: pa.Table, c: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if q.num_rows and c.num_rows:
            dim = q["dim"][0].as_py()
            c = c.sort_by("id")
            ids, own = c["id"].to_numpy(), q["id"].to_numpy()
            scores = tile_scores(matrix(q["v"], dim), matrix(c["v"], dim))
            for i, me in enumerate(own):
                at = best_of_row(scores[i], ids, me, k)
                out.append((np.full(len(at), me), ids[at], np.array([int(np.clip(s, -LONG - 1, LONG)) if scores.dtype == object else int(s) for s in scores[i][at]], dtype=np.int64)))
        shard = c["shard"][0].as_py() if c.num_rows else 0
        cols = [np.concatenate(x).astype(np.int64) if out else np.empty(0, np.int64) for x in (zip(*out) if out else ((), (), ()))]
        return pa.table({"query_id": cols[0], "id": cols[1], "score": cols[2], "shard": np.full(len(cols[0]), shard, np.int64)})

    best = (left.groupBy("dim", "block", "shard").cogroup(right.groupBy("dim", "block", "shard"))
            .applyInArrow(tile, "query_id long, id long, score long, shard long"))
    while True:
        shards = math.ceil(shards / FAN)
        best = best.withColumn("shard", F.floor(F.col("shard") / FAN))
        order = Window.partitionBy("query_id", "shard").orderBy(F.col("score").desc(), "id")
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if shards == 1:
            return best.select("query_id", "rank", F.col("id").alias(id_col), "score")
        best = best.drop("rank")
