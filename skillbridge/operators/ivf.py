"""A stored index for approximate search: an inverted file of cells.

Vectors are dealt to the cell of their nearest centre. A cell is a folder, so a query that visits some
cells reads only these. Beside the vector itself a row holds its difference to the centre in one byte per
component; the first pass of a search reads these alone, the second one measures the few candidates by
their vectors. Neither pass shuffles a vector: queries go to the rows, in tiles of a fixed size.

How many cells a query must visit depends on the data: few where vectors lie in clusters, most where they
are spread evenly. So it is measured when the index is written, and stored with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillbridge.functions.nearest import _true_cells, vectors
from skillbridge.operators.knn import best_hits, knn, prepared, query_tiles, usual_length
from skillbridge.session import scratch_path

SAMPLE = 20_000  # vectors that the centres are fitted on, at most
MOST_CELLS = 4096
TILE_BYTES = 8 << 20  # of queries searched at once
TILE_PAIRS = 1 << 20  # and their candidates, which go to all tasks by way of the driver
CANDIDATES = 20  # rows measured exactly for each hit asked for
BOUND_ROWS = 8192  # of the index, for a first bound of each query's distances
HELD = 2_000_000  # candidates that a task holds before it thins them
BLOCK_CELLS = 1 << 18  # rough distances held at once, which stay in a core's cache
TRIALS, NEAREST = 256, 10  # rows asked for their nearest ones, to see how many cells must be visited
TARGET = 0.98  # share of those that the visited cells must hold


def _squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    own, theirs = (np.einsum("ij,ij->i", x, x) for x in (points, centres))
    return own[:, None] + theirs[None, :] - 2.0 * points @ centres.T


def _centres(rows: DataFrame, cells: int, id_col: str) -> np.ndarray:
    sample = rows.orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE)
    sample = sample.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")).persist()
    try:
        model = KMeans(k=cells, seed=7, maxIter=10, initMode="random").fit(sample)
        return np.unique(np.array(model.clusterCenters()), axis=0)
    finally:
        sample.unpersist()


def write_ivf(index: DataFrame, folder: str, id_col: str = "vec_id", cells: int | None = None) -> str:
    """Store ``index`` (an id, ``embedding`` and further columns) as an inverted file.

    ``cells`` defaults to the square root of the rows, 4,096 at most. Centres are fitted on a sample;
    every row is stored. A cell with very many rows, such as copies of one vector, is dealt
    to several files by id. Rows without a finite vector, or with one of another length than most,
    are left out; queries of another length find nothing.
    """
    rows = prepared(index)
    length = usual_length(rows) or 0
    rows = rows.filter(F.size("embedding") == length)
    n = rows.count()
    cells = min(MOST_CELLS, max(1, int(np.ceil(np.sqrt(n))))) if cells is None else cells
    centres = _centres(rows, cells, id_col) if n else np.zeros((0, 0))
    spark = index.sparkSession
    table = [(i, c.tolist()) for i, c in enumerate(centres)]
    spark.createDataFrame(table, "cell int, centre array<double>").coalesce(1).write.parquet(f"{folder}/centres")
    sent = spark.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = vectors(batch.column("embedding"))
                cell = _squares(points, sent.value).argmin(axis=1)
                rest = points - sent.value[cell]
                scale = np.maximum(np.abs(rest).max(axis=1), 1e-30) / 127.0
                codes = np.rint(rest / scale[:, None]).astype(np.int8)
                coded = pa.array([c.tobytes() for c in codes], pa.binary())
                columns = [*batch.columns, coded, pa.array(scale), pa.array(cell.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "code", "scale", "cell"])

    added = [T.StructField("code", T.BinaryType()), T.StructField("scale", T.DoubleType()), T.StructField("cell", T.IntegerType())]
    placed = rows.mapInArrow(place, T.StructType([*rows.schema, *added]))
    dealt = placed.repartitionByRange("cell", id_col).sortWithinPartitions("cell", id_col)
    dealt.write.partitionBy("cell").parquet(f"{folder}/rows")
    probes = _needed(spark.read.parquet(f"{folder}/rows"), centres, id_col) if n else 0
    spark.createDataFrame([(probes,)], "probes int").coalesce(1).write.parquet(f"{folder}/settings")
    return folder


def _needed(stored: DataFrame, centres: np.ndarray, id_col: str) -> int:
    """Cells to visit for :data:`TARGET` of the true neighbours, by a few rows in the place of queries."""
    rows = stored.select(F.col(id_col).alias("qid"), "embedding")
    trials = rows.orderBy(F.xxhash64("qid"), "qid").limit(TRIALS).toArrow()
    asked = stored.sparkSession.createDataFrame(trials)
    near = knn(asked, stored.select(id_col, "cell", "embedding"), NEAREST, id_col=id_col, exclude_self=True)
    at = {q: k for k, q in enumerate(trials["qid"].to_pylist())}
    ranks = _squares(vectors(trials["embedding"].combine_chunks()), centres).argsort(axis=1).argsort(axis=1)
    found = [ranks[at[r["qid"]], r["cell"]] for r in near.select("qid", "cell").collect()]
    return int(np.quantile(found, TARGET, method="higher")) + 1 if found else len(centres)


def _bounded(queries: DataFrame, stored: DataFrame, centres: np.ndarray, k: int, probes: int, id_col: str) -> DataFrame:
    """Queries with ``_limit``, which the ``k``-th distance among the rows of their cells can't exceed.

    It is the ``k``-th distance to those rows of a sample that lie in the cells the query visits.
    """
    sample = stored.select(id_col, "cell", "embedding").orderBy(F.xxhash64(id_col), id_col).limit(BOUND_ROWS).toArrow()
    known, cells = vectors(sample["embedding"].combine_chunks()), sample["cell"].to_numpy()
    sent = stored.sparkSession.sparkContext.broadcast((known, cells, centres))

    def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cells, centres = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            points, far = vectors(batch.column("embedding")), np.full(batch.num_rows, np.inf)
            for lo in range(0, len(points) if len(known) >= k else 0, 256):
                some = points[lo : lo + 256]
                square = np.maximum(_squares(some, known), 0.0)
                square[~_visited(some, centres, probes)[:, cells]] = np.inf
                far[lo : lo + 256] = np.partition(square, k - 1, axis=1)[:, k - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far)], ["qid", "embedding", "_limit"])

    queries = queries.select("qid", "embedding")
    return queries.mapInArrow(limits, T.StructType([*queries.schema, T.StructField("_limit", T.DoubleType())]))


def _visited(points: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """Which cells each query visits."""
    if probes >= len(centres):
        return np.ones((len(points), len(centres)), dtype=bool)
    out = np.zeros((len(points), len(centres)), dtype=bool)
    step = max(1, BLOCK_CELLS // len(centres))
    for lo in range(0, len(points), step):
        near = np.argpartition(_squares(points[lo : lo + step], centres), probes - 1, axis=1)[:, :probes]
        np.put_along_axis(out[lo : lo + step], near, True, axis=1)
    return out


def _short(points: np.ndarray, last: np.ndarray | float) -> np.ndarray:
    """Points and a ``last`` column in short numbers, as long as these hold the values."""
    kind = np.float32 if len(points) and max(np.abs(points).max(), np.abs(last).max()) < 1e15 else np.float64
    out = np.empty((len(points), points.shape[1] + 1), dtype=kind)
    out[:, :-1], out[:, -1] = points, last
    return out


def _maybe_within(short: np.ndarray, norms: np.ndarray, side: np.ndarray, theirs: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of queries and points that may be within the queries' limits, with room for rounding.

    A distance is within the limit if the product q p less p p / 2 reaches (q q - limit) / 2: one product
    of ``short`` (queries and a 1) and ``side`` (points and - p p / 2), and one comparison for a pair.
    """
    product = short @ side.T
    kind = product.dtype.type
    coarse = max(float(np.finfo(x.dtype).eps) for x in (short, side))
    least = (norms - limit) / 2 - 4 * (short.shape[1] + 8) * coarse * (norms + theirs.max())
    cell = _true_cells(product >= np.nextafter(least.astype(kind), kind(-np.inf))[:, None])
    return np.divmod(cell, len(side))


def _tile_hits(
    table: pa.Table, stored: DataFrame, centres: np.ndarray, k: int, probes: int, candidates: int, id_col: str, schema: T.StructType
) -> tuple[DataFrame, Broadcast]:
    """Measured candidates of a tile of queries, and what was sent for them, of no use once they are read."""
    spark = stored.sparkSession
    matrix = vectors(table["embedding"].combine_chunks())
    visited = _visited(matrix, centres, probes).T
    wanted = [int(c) for c in np.flatnonzero(visited.any(axis=1))]
    roots = np.sqrt(table["_limit"].to_numpy())
    sent = spark.sparkContext.broadcast((matrix, centres, np.packbits(visited, axis=1), roots, table["qid"].combine_chunks()))
    id_field = stored.schema[id_col]

    def rough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, centres, packed, roots, _ = sent.value
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []
        best, many = np.full(len(matrix), np.inf), 0
        norms, short = np.einsum("ij,ij->i", matrix, matrix), _short(matrix, 1.0)
        longest = np.sqrt(norms.max())

        def compact() -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
            """The best candidates of each query so far; farther rows are no longer looked at."""
            query, dist, error = (np.concatenate([h[i] for h in held]) for i in (0, 1, 2))
            ids = pa.concat_arrays([h[3] for h in held])
            order = np.lexsort((dist, query))
            first = np.flatnonzero(np.r_[True, np.diff(query[order]) != 0])
            rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
            order, rank = order[rank < candidates], rank[rank < candidates]
            full = order[rank == candidates - 1]
            best[query[full]] = dist[full]
            return query[order], dist[order], error[order], ids.take(pa.array(order))

        room = max(HELD, 2 * candidates * len(matrix))
        for batch in batches:
            cells = batch.column("cell").to_numpy(zero_copy_only=False)
            for cell in np.unique(cells):
                at = np.flatnonzero(cells == cell)
                asking = np.flatnonzero(np.unpackbits(packed[cell], count=len(matrix)))
                raw = b"".join(batch.column("code").take(pa.array(at)).to_pylist())
                codes = np.frombuffer(raw, np.int8).reshape(len(at), -1)
                scale = batch.column("scale").to_numpy(zero_copy_only=False)[at]
                points = centres[cell] + codes * scale[:, None]
                # a code is off by half a step per component at the most
                errors = 0.51 * scale * np.sqrt(points.shape[1])
                off = errors.max()
                errors += 4e-7 * (longest + np.linalg.norm(points, axis=1).max())  # the root of what squares are rounded by
                step = max(1, BLOCK_CELLS // len(at))
                theirs = np.einsum("ij,ij->i", points, points)
                side = _short(points, -theirs / 2)
                for lo in range(0, len(asking), step):
                    some = asking[lo : lo + step]
                    limit = np.minimum(best[some], (roots[some] + off) ** 2 * (1 + 1e-9) + 1e-9)
                    row, point = _maybe_within(short[some], norms[some], side, theirs, limit)
                    if 8 * len(row) > len(some) * len(at):
                        square = _squares(matrix[some], points)
                        row, point = np.nonzero(square <= limit[:, None])
                        if len(row) > 4 * candidates * len(some) and len(at) > candidates:
                            point = np.argpartition(square, candidates - 1, axis=1)[:, :candidates].ravel()
                            row = np.repeat(np.arange(len(some)), candidates)
                        dist = square[row, point]
                    else:
                        dist = norms[some[row]] + theirs[point] - 2.0 * np.einsum("ij,ij->i", matrix[some[row]], points[point])
                        keep = dist <= limit[row]
                        row, point, dist = row[keep], point[keep], dist[keep]
                    if len(row):
                        held.append((some[row], dist, errors[point], batch.column(id_col).take(pa.array(at[point]))))
                        many += len(row)
                    if many > room:
                        held = [compact()]
                        many = len(held[0][0])
        if held:
            query, dist, error, ids = compact()
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(dist), pa.array(error), ids], ["_query", "_rough", "_off", id_col])

    # an IN list of cells prunes folders; vectors are not read here
    here = stored.filter(F.col("cell").isin(wanted))
    measures = [T.StructField(name, T.DoubleType()) for name in ("_rough", "_off")]
    first = here.select("cell", id_col, "code", "scale").mapInArrow(
        rough, T.StructType([T.StructField("_query", T.LongType()), *measures, id_field])
    )
    whole = Window.partitionBy("_query")
    chosen = first.withColumn("_n", F.row_number().over(whole.orderBy("_rough", id_col))).filter(F.col("_n") <= candidates)
    # a row that is farther by the least its distance can be than k others by the most is no hit
    root = F.sqrt(F.greatest("_rough", F.lit(0.0)))
    most = F.when(F.col(id_col).isNotNull(), root + F.col("_off"))
    kth = F.get(F.array_sort(F.collect_list(most).over(whole)), F.lit(k - 1))
    near = F.coalesce(root - F.col("_off") <= kth, F.lit(True))
    chosen = chosen.withColumn("_near", near).withColumn("_near", F.max("_near").over(Window.partitionBy("_query", id_col)))
    chosen = chosen.filter("_near")
    # at most as many rows as the tile has queries, times candidates
    chosen = chosen.select("_query", id_col)
    carried = [f.name for f in schema][2:]
    met = here.select("embedding", *carried).join(F.broadcast(chosen), id_col)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, *_, qids = sent.value
        for batch in batches:
            if batch.num_rows:
                query = batch.column("_query").to_numpy(zero_copy_only=False)
                diff = matrix[query] - vectors(batch.column("embedding"))
                dist = np.cumsum(np.square(diff), axis=1)[:, -1]
                columns = [qids.take(pa.array(query)), pa.array(dist), *[batch.column(c) for c in carried]]
                yield pa.RecordBatch.from_arrays(columns, ["qid", "dist", *carried])

    return met.select("_query", "embedding", *carried).mapInArrow(exact, schema), sent


def search_ivf(
    spark: SparkSession,
    folder: str,
    queries: DataFrame,
    k: int = 3,
    id_col: str = "vec_id",
    exclude_self: bool = False,
    probes: int | None = None,
    candidates: int = CANDIDATES,
) -> DataFrame:
    """Approximately the ``k`` nearest rows of a stored index for each query ``(qid, embedding)``.

    A query visits the ``probes`` cells with the nearest centres; by default so many as the index was found
    to need. (If it visits all, only what the rough pass misjudges may be lost.) Distances are exact. Columns as of :func:`~skillbridge.operators.knn.knn`.

    If there is more than one tile of queries, tiles are searched here, and their hits stored.
    """
    stored = spark.read.parquet(f"{folder}/rows") if _has_rows(spark, folder) else None
    queries = prepared(queries)
    if stored is None:
        return spark.createDataFrame([], T.StructType([queries.schema["qid"]])).select("qid", F.lit(0).alias("rk")).limit(0)
    kept = [f for f in stored.schema if f.name not in ("embedding", "code", "scale", "cell")]
    schema = T.StructType([queries.schema["qid"], T.StructField("dist", T.DoubleType()), *kept])
    table = spark.read.parquet(f"{folder}/centres").orderBy("cell").toArrow()
    centres = vectors(table["centre"].combine_chunks())
    wanted = k + 1 if exclude_self else k
    needed = spark.read.parquet(f"{folder}/settings").first()["probes"] if probes is None else probes
    visits = max(1, min(len(centres), needed))
    queries = queries.filter(F.size("embedding") == centres.shape[1])
    queries = _bounded(queries, stored, centres, wanted, visits, id_col)
    candidates *= wanted
    most = max(1, TILE_PAIRS // candidates) * (8 * centres.shape[1] + 64)

    def best(tile: pa.Table) -> tuple[DataFrame, Broadcast]:
        met, sent = _tile_hits(tile, stored, centres, wanted, visits, candidates, id_col, schema)
        return best_hits(met, wanted, id_col).select(schema.names), sent

    tiles = query_tiles(queries, min(TILE_BYTES, most))
    first, second = next(tiles, None), next(tiles, None)
    if first is None:
        hits = spark.createDataFrame([], schema)
    elif second is None:
        hits, _ = best(first)
    else:  # one after another, so that the driver has the candidates of one tile only
        path = scratch_path(spark, "ivf-hits")
        for tile in chain((first, second), tiles):
            found, sent = best(tile)
            found.write.mode("append").parquet(path)
            sent.destroy()
        hits = spark.read.schema(schema).parquet(path)
    return best_hits(hits, k, id_col, exclude_self=exclude_self)


def _has_rows(spark: SparkSession, folder: str) -> bool:
    return not spark.read.parquet(f"{folder}/centres").isEmpty()
