"""Exact top-k search by inner product: matrix products tile by tile, partial selection, and a merge tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demoflux.llm.common import store

QUERY_BLOCK = 32_768  # queries that are sent to the tasks at once
TILE_QUERIES, TILE_ROWS = 1024, 2048
FAN_IN = 64
EXACT = float(1 << 53)
LEAST = -(1 << 63)
FOUND = "query_id bigint, vec_id bigint, score bigint"


def quantized(vectors: pa.Array, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """floor(scale * x) by vector length: the places of the vectors in the array, and their rows as a matrix."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    return {
        int(d): (at := np.flatnonzero(sizes == d), flat[(starts[at][:, None] + np.arange(d)).ravel()].reshape(len(at), d))
        for d in np.unique(sizes)}


def tile_scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as integers. Beyond what doubles hold exactly, Python's integers are used; what no long holds is clamped."""
    bound = max(1, rows.shape[1]) * float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0))
    if bound < EXACT:
        return (queries @ rows.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in queries], dtype=object) @ np.array([[int(x) for x in r] for r in rows], dtype=object).T
    return np.clip(exact, LEAST + 1, (1 << 63) - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k first of each row by falling score, then rising id."""
    order = np.lexsort((ids, ~scores))[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def partial_best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As `best`, by partial selection. The columns are sorted by id, so a column's place decides ties."""
    n = scores.shape[1]
    if n <= k or np.abs(scores).max(initial=0) >= (1 << 62) // n:
        return best(scores, np.broadcast_to(ids, scores.shape), k)
    merged = scores * n + (n - 1 - np.arange(n))
    at = np.argpartition(merged, n - k, axis=1)[:, n - k:]
    return np.take_along_axis(scores, at, 1), ids[at]


def _search(block: dict, k: int, scale: float):
    """Task: the k best rows of its own for each query of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = {d: (np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.int64)) for d, (q, _) in block.items()}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for d, (at, matrix) in quantized(batch.column(1), scale).items():
                if d not in block:
                    continue
                queries, query_ids = block[d]
                order = np.argsort(ids[at], kind="stable")
                own, matrix = ids[at][order], matrix[order]
                for i in range(0, len(own), TILE_ROWS):
                    tile, tile_ids = matrix[i:i + TILE_ROWS], own[i:i + TILE_ROWS]
                    scores, found = top[d]
                    width = min(k, scores.shape[1] + len(tile_ids))
                    merged = np.empty((len(queries), width), np.int64), np.empty((len(queries), width), np.int64)
                    for j in range(0, len(queries), TILE_QUERIES):
                        part = slice(j, j + TILE_QUERIES)
                        products = tile_scores(queries[part], tile)
                        own_row = query_ids[part][:, None] == tile_ids[None, :]
                        products[own_row] = products.min(initial=0, where=~own_row) - 1  # behind every other row of the tile
                        some = partial_best(products, tile_ids, k)
                        some[0][some[1] == query_ids[part][:, None]] = LEAST  # and of all tiles
                        merged[0][part], merged[1][part] = best(
                            np.hstack([scores[part], some[0]]), np.hstack([found[part], some[1]]), width)
                    top[d] = merged
        for d, (scores, found) in top.items():
            query_ids = np.broadcast_to(block[d][1][:, None], scores.shape)
            real = query_ids != found
            yield pa.RecordBatch.from_arrays(
                [pa.array(query_ids[real]), pa.array(found[real]), pa.array(scores[real])], names=["query_id", "vec_id", "score"])

    return run


def usable(vector: str) -> Column:
    """Whether the vector is there and all its components are finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True))


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: float = 1024.0,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """For each query row its k best other rows by the inner product of floor(scale * x), ties to the smaller key.

    Returns (query_id, rank, vec_id, score). Queries are sent to the tasks in blocks of about
    `query_block` vectors, whose size is therefore bounded; the table is read once per block and its
    vectors are never shuffled. A task keeps one list of k per query, so what is shuffled is k rows per
    query and task, merged in two levels. Rows without key, without vector or with a missing or
    non-finite component take no part. Only vectors of equal length are compared. Rows that
    repeat a key are rows of their own as candidates, except to the query of that key; as queries they
    are one, with the smallest vector. Equal vectors tie. An empty table gives an empty result; columns of
    other names are ignored. Scores beyond a long are clamped to it.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(F.col(key).isNotNull() & usable(vector)).select(
        F.col(key).cast("bigint").alias("vec_id"), F.col(vector).alias("vector"), is_query.alias("is_query"))
    queries = rows.filter("is_query").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    blocks = max(1, -(-queries.count() // query_block))
    found = None
    for number in range(blocks):
        mine = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).toArrow().combine_chunks()
        block = {}
        for part in mine.to_batches():
            ids = part.column(0).to_numpy()
            block |= {d: (matrix, ids[at]) for d, (at, matrix) in quantized(part.column(1), scale).items()}
        lists = rows.select("vec_id", "vector").mapInArrow(_search(block, k, scale), FOUND)
        branch = Window.partitionBy("query_id", "branch").orderBy(F.desc("score"), "vec_id")
        merged = (
            lists.withColumn("branch", F.floor(F.spark_partition_id() / FAN_IN))
            .withColumn("place", F.row_number().over(branch)).filter(F.col("place") <= k).drop("branch", "place"))
        root = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = merged.withColumn("rank", F.row_number().over(root)).filter(F.col("rank") <= k)
        ranked = ranked.select("query_id", "rank", "vec_id", "score")
        if blocks > 1:
            ranked = store(ranked, "top")
        found = ranked if found is None else found.unionAll(ranked)
    return found


def topk_query(vectors: DataFrame) -> DataFrame:
    return top_k(vectors, F.col("vec_id") % 100 == 0)


TOPK_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as q from embeddings
  where embedding is not null and vec_id is not null
    and not coalesce(list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x))), false)
), s as (
  select a.vec_id as query_id, b.vec_id, list_dot_product(a.q, b.q)::bigint as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), r as (
  select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 10
"""
