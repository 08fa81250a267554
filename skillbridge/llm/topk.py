"""Exact top-k by inner product of a set of queries against all vectors.

Vectors are dealt into shards by a hash, every query goes to every shard. A task multiplies
blocks of queries with tiles of its shard and keeps the best ``k`` of each tile; a tree of
small groupings merges the lists of the shards, ``FAN_IN`` at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillbridge.llm.store import written

SHARD_ROWS = 1 << 15  # rows of a shard, about
TILE_ROWS = 4096
BLOCK_ROWS = 512  # queries multiplied at once
FAN_IN = 8
_EXACT = float(1 << 53)  # integers that doubles hold exactly


def quantised(vector: Column, scale: int = 64) -> Column:
    """``floor(scale * x)`` of every component, or NULL if one is NULL or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


class Best:
    """The best ``k`` of a shard for a block of queries, tile by tile."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int) -> None:
        self.ids, self.rows, self.k = ids, rows, k

    def of(self, query_ids: np.ndarray, queries: np.ndarray) -> list[list[tuple[int, int]]]:
        """Per query its best ``(-score, id)``, in order."""
        ids, scores, owner = [], [], []
        for lo in range(0, len(self.ids), TILE_ROWS):
            tile_ids, tile = self.ids[lo : lo + TILE_ROWS], self.rows[lo : lo + TILE_ROWS]
            at, score = self._tile(query_ids, queries, tile_ids, tile)
            row, col = np.nonzero(at >= 0)
            owner.append(row)
            ids.append(tile_ids[at[row, col]])
            scores.append(score[row, col])
        owner, ids, scores = (np.concatenate([np.empty(0, np.int64), *x]) for x in (owner, ids, scores))
        order = np.lexsort((ids, -scores, owner))
        owner, ids, scores = owner[order], ids[order], scores[order]
        cuts = np.searchsorted(owner, np.arange(len(query_ids) + 1))
        return [
            list(zip((-scores[a : min(b, a + self.k)]).tolist(), ids[a : min(b, a + self.k)].tolist(), strict=True))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True)
        ]

    def _tile(self, query_ids, queries, tile_ids, tile) -> tuple[np.ndarray, np.ndarray]:
        """Places in the tile of its best ``k`` for each query (-1: none), and their scores.

        The tile is in the order of ids. Scores and places together make one number, so that
        ties go to the smaller id and the partial selection is unique.
        """
        bound = float(np.abs(queries).max(initial=0)) * float(np.abs(tile).max(initial=0)) * max(1, queries.shape[1])
        own = query_ids[:, None] == tile_ids[None, :]
        k, size = min(self.k, len(tile_ids)), len(tile_ids)
        if (bound + 1) * size < _EXACT:
            score = queries.astype(np.float64) @ tile.astype(np.float64).T
            key = score * size - np.arange(size)
            key[own] = -np.inf
            at = np.argpartition(-key, k - 1, axis=1)[:, :k]
            score = score.astype(np.int64)
        else:  # numbers too large for doubles
            score = queries @ tile.T
            at = np.argsort(np.where(own, np.iinfo(np.int64).max, -score), axis=1, kind="stable")[:, :k]
        found = np.take_along_axis(score, at, axis=1)
        at[np.take_along_axis(own, at, axis=1)] = -1
        return at, found


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(column[0]))


def _shard_tops(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows ``cell, side, shard, id, hash, v`` in order of cell and side to lists per query."""
    cell, ids, rows, best = None, [], [], None
    kind = pa.list_(pa.struct([("neg", pa.int64()), ("id", pa.int64())]))
    for batch in batches:
        cells, sides = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        change = np.append(True, (cells[1:] != cells[:-1]) | (sides[1:] != sides[:-1])) if len(cells) else []
        starts = np.flatnonzero(change)
        for lo, hi in zip(starts, np.append(starts[1:], len(cells)), strict=True):
            if cells[lo] != cell:
                cell, ids, rows, best = cells[lo], [], [], None
            part = batch.slice(lo, hi - lo)
            matrix = _matrix(part.column(5))
            own = part.column(3).to_numpy(zero_copy_only=False)
            if sides[lo] == 0:
                ids.append(own)
                rows.append(matrix)
                continue
            if best is None and ids:
                every = np.concatenate(ids)
                order = np.argsort(every, kind="stable")
                best = Best(every[order], np.concatenate(rows)[order], k)
                ids, rows = [], []
            if best is None:
                continue
            for at in range(0, len(own), BLOCK_ROWS):
                block = part.slice(at, BLOCK_ROWS)
                tops = best.of(own[at : at + BLOCK_ROWS], matrix[at : at + BLOCK_ROWS])
                yield pa.RecordBatch.from_arrays(
                    [block.column(3), block.column(4), block.column(2), pa.array(tops_rows(tops), kind)],
                    ["query_id", "query_hash", "node", "top"],
                )


def tops_rows(tops: list[list[tuple[int, int]]]) -> list[list[dict[str, int]]]:
    return [[{"neg": s, "id": i} for s, i in top] for top in tops]


def search(vectors: DataFrame, every: int, k: int, vector: str = "embedding", vec_id: str = "vec_id", scale: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's best ``k``, over all other vectors.

    Queries are the rows whose id is divisible by ``every``; candidates all rows but those
    with the query's own id. Scores are inner products of :func:`quantised` vectors, ties go
    to the smaller id. Rows whose id or vector is NULL or whose vector has a NULL or
    non-finite component take no part. Only vectors of one length are compared. Rows equal in
    id and vector count once; rows that share an id with another vector are candidates (and
    queries) each. A query without candidates has no rows, nor has an empty table. Products
    beyond 64 bits wrap around. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(f"`{vec_id}`").cast("bigint").alias("id"), quantised(F.col(f"`{vector}`"), scale).alias("v")
    ).filter("id IS NOT NULL AND v IS NOT NULL")
    rows = rows.dropDuplicates().withColumns({"dim": F.size("v"), "hash": F.xxhash64("id", "v")})
    rows = written(rows, "vectors")
    count = rows.count()
    cores = spark.sparkContext.defaultParallelism
    shards = max(-(-count // SHARD_ROWS), min(cores, -(-count // 1024)), 1)
    cell = F.xxhash64("dim", "shard")
    corpus = rows.withColumn("shard", F.pmod("hash", F.lit(shards)).cast("int"))
    queries = rows.filter(F.col("id") % every == 0).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    both = corpus.select(cell.alias("cell"), F.lit(0).alias("side"), "shard", "id", "hash", "v").unionAll(
        queries.select(cell, F.lit(1), "shard", "id", "hash", "v")
    )
    tops = both.repartition(shards, "cell").sortWithinPartitions("cell", "side").mapInArrow(
        lambda b: _shard_tops(b, k),
        "query_id long, query_hash long, node int, top array<struct<neg: bigint, id: bigint>>",
    )
    nodes = shards
    while True:
        nodes = -(-nodes // FAN_IN)
        best = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k)
        parent = F.floor(F.col("node") / FAN_IN).cast("int").alias("node")
        tops = tops.groupBy("query_id", "query_hash", parent).agg(best.alias("top"))
        if nodes <= 1:
            break
    return tops.select("query_id", F.posexplode("top").alias("at", "best")).select(
        "query_id",
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("best.id").alias("vec_id"),
        (-F.col("best.neg")).alias("score"),
    )


def oracle(every: int, k: int) -> str:
    """DuckDB SQL for the query over ``embeddings``."""
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {every} = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {k}"""
