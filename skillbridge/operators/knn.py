"""Nearest chunks per query: exact, exact within an owner's scope, and approximate.

Queries have columns ``qid`` and ``embedding`` (and ``owner`` for the scoped form); corpus
rows have an id column, ``embedding`` and further columns, which hits carry along. Hits are
``qid, rk, <id>, dist`` and the carried columns, ordered by distance and then id.

No pair of query and row is ever emitted: tasks keep the best ``k`` per query of what they
see, and only these are shuffled to find the best ``k`` overall.

* A batch of queries that is measured to be small goes to every task, and the corpus is
  read where it lies. Of more queries, tiles of a fixed size in bytes go there in rounds, as many
  at once as are sent at most; or a corpus that is measured to be small goes to the queries.
* Private rows and hash buckets of the approximate join are matched by their key. A key with many
  rows on either side is split into a grid of blocks, so no task has to take a whole hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillbridge.functions.nearest import TopK, limits_of, vectors
from skillbridge.operators.keys import matching
from skillbridge.operators.numbering import numbered
from skillbridge.session import scratch_path

# The default of ``small_queries``: rows of queries that may be sent to every task. It changes
# the plan and not the result; the bench runs both plans.
SMALL_QUERIES = 2048
SMALL_BYTES = 16 << 20  # and their size
TILE_BYTES = 64 << 20  # of queries, or of a corpus, sent to all tasks at once
QUERY_BLOCK = 1 << 18  # queries of a key handled by one task, within TILE_BYTES
CORPUS_BLOCK = 200_000  # rows of a key handled by one task, which streams them
SAMPLE_ROWS = 2048  # of the corpus, for a first bound of the distances of many queries

METRICS = ("l2sq", "cosine")


def prepared(df: DataFrame, metric: str = "l2sq") -> DataFrame:
    """Drop rows without a vector, or with a component that is NULL, NaN or infinite.

    For ``cosine`` vectors are scaled to unit length, and zeros dropped.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    finite = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    df = df.filter(F.col("embedding").isNotNull() & finite)
    if metric == "l2sq":
        return df
    as_double = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate(as_double, F.lit(0.0), lambda s, x: s + x * x))
    # the outer lambda binds the norm, as the optimizer would put it into the inner one, once per component
    unit = F.transform(F.array(norm), lambda s: F.transform(as_double, lambda x: x / s))[0]
    return df.filter(norm > 0).withColumn("embedding", unit)


def _hit_schema(queries: DataFrame, corpus: DataFrame) -> T.StructType:
    carried = [f for f in corpus.schema if f.name != "embedding"]
    return T.StructType(
        [queries.schema["qid"], T.StructField("dist", T.DoubleType()), *carried]
    )


def best_hits(
    hits: DataFrame, k: int, id_col: str, metric: str = "l2sq", exclude_self: bool = False
) -> DataFrame:
    """Rank partial hits per query; the planner limits each group before the shuffle.

    Squared distances of unit vectors are twice the cosine distance.
    """
    if exclude_self:
        hits = hits.filter(F.col("qid") != F.col(id_col))
    if metric == "cosine":
        hits = hits.withColumn("dist", F.col("dist") / 2)
    order = Window.partitionBy("qid").orderBy("dist", id_col)
    rest = [c for c in hits.columns if c not in ("qid", "dist", id_col)]
    return (
        hits.withColumn("rk", F.row_number().over(order))
        .filter(F.col("rk") <= k)
        .select("qid", "rk", id_col, "dist", *rest)
    )


def _small(queries: DataFrame, max_rows: int) -> pa.Table | None:
    """The queries as a table if they are few and small, measured before they are sent."""
    if max_rows <= 0:
        return None
    table = queries.select("qid", "embedding").limit(max_rows + 1).toArrow()
    return None if table.num_rows > max_rows or table.nbytes > SMALL_BYTES else table


def _of_length(rows: DataFrame, length: int) -> DataFrame:
    return rows.filter(F.size("embedding") == length)


def usual_length(rows: DataFrame) -> int | None:
    """The number of components that most vectors have (the smaller one, if as many have another)."""
    counts = rows.groupBy(F.size("embedding").alias("length")).agg(F.count("*").alias("n"))
    most = counts.orderBy(F.desc("n"), "length").first()
    return None if most is None else most["length"]


def _scan(queries: pa.Table, corpus: DataFrame, k: int, id_col: str, schema: T.StructType) -> DataFrame:
    """Every task keeps the best ``k`` rows of its partition for each query."""
    if not queries.num_rows:
        return corpus.sparkSession.createDataFrame([], schema)
    qids = queries["qid"].combine_chunks()
    matrix = vectors(queries["embedding"].combine_chunks())
    carried = [f.name for f in schema][2:]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = TopK(matrix, k)
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            top.offer(vectors(batch.column("embedding")), rows.select(carried), id_col)
        yield from _result(top, qids, carried)

    return corpus.mapInArrow(task, schema)


def _result(top: TopK, qids: pa.Array, carried: list[str]) -> Iterator[pa.RecordBatch]:
    if top.rows is None:
        return
    columns = [qids.take(pa.array(top.query)), pa.array(top.dist)]
    table = pa.table([*columns, *top.rows.columns], names=["qid", "dist", *carried])
    yield from table.combine_chunks().to_batches()


def _splits(queries: DataFrame, corpus: DataFrame, key: str, length: int) -> DataFrame:
    """The keys that need more than one block, with the number of blocks per side.

    A block's queries fill a tile, as the rows of the key are copied for every block of them.

    Counting has a map-side part, so a hot key costs nothing here. The table is small: a row for
    every full block of rows at most.
    """
    c = corpus.groupBy(key).agg(F.count("*").alias("c"))
    q = queries.groupBy(key).agg(F.count("*").alias("q"))
    most = min(QUERY_BLOCK, rows_of(TILE_BYTES, length))
    return (
        c.join(q, key)
        .select(
            key,
            F.ceil(F.col("c") / CORPUS_BLOCK).cast("int").alias("_nc"),
            F.ceil(F.col("q") / most).cast("int").alias("_nq"),
        )
        .filter((F.col("_nc") > 1) | (F.col("_nq") > 1))
    )


def _join_by_key(
    queries: DataFrame,
    corpus: DataFrame,
    key: str,
    k: int,
    id_col: str,
    schema: T.StructType,
    length: int,
) -> DataFrame:
    """The best ``k`` rows per query among the rows of the same key, block by block.

    Vectors have ``length`` components.

    Rows are shuffled by key and block and sorted so that a block's queries come before
    its corpus rows; a task then holds one block's queries and streams the rows past them.
    """
    table = _splits(queries, corpus, key, length)

    def spread(df: DataFrame, own: str, other: str, id_: str, n_own: str, n_other: str) -> DataFrame:
        df = df.join(F.broadcast(table), key, "left")  # else the vectors would be shuffled for it
        mine = F.pmod(F.xxhash64(id_), F.coalesce(n_own, F.lit(1))).cast("int")
        others = F.sequence(F.lit(0), F.coalesce(n_other, F.lit(1)) - 1)
        return df.withColumns({own: mine, other: F.explode(others)}).drop("_nc", "_nq")

    q = spread(queries, "_qb", "_cb", "qid", "_nq", "_nc")
    c = spread(corpus, "_cb", "_qb", id_col, "_nc", "_nq")
    block = F.concat_ws("|", F.col("_cb"), F.col("_qb"), F.col(key).cast("string"))
    vector = F.col("embedding")
    if queries.schema["embedding"].dataType != corpus.schema["embedding"].dataType:
        vector = vector.cast("array<double>")
    carried = [f.name for f in schema][2:]
    both = q.select(
        block.alias("_block"), F.lit(0).alias("_side"), "qid", vector.alias("_vec")
    ).unionByName(
        c.select(block.alias("_block"), F.lit(1).alias("_side"), vector.alias("_vec"), *carried),
        allowMissingColumns=True,
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, top, qids = None, [], None, None
        for batch in batches:
            blocks = batch.column("_block")
            codes = blocks.dictionary_encode().indices.to_numpy()
            sides = batch.column("_side").to_numpy()
            cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(sides) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(codes)]):
                part = pa.Table.from_batches([batch.slice(lo, hi - lo)])
                name = blocks[int(lo)].as_py()
                if name != current:
                    if top is not None:
                        yield from _result(top, qids, carried)
                    current, held, top = name, [], None
                if sides[lo] == 0:
                    held.append(part.select(["qid", "_vec"]))
                    continue
                if not held:
                    continue
                if top is None:
                    table_ = pa.concat_tables(held).combine_chunks()
                    qids = table_["qid"].combine_chunks()
                    top = TopK(vectors(table_["_vec"].combine_chunks()), k)
                points = vectors(part["_vec"].combine_chunks())
                top.offer(points, part.select(carried), id_col)
        if top is not None:
            yield from _result(top, qids, carried)

    arranged = both.repartition("_block").sortWithinPartitions("_block", "_side")
    return arranged.mapInArrow(task, schema)


def _broadcastable(corpus: DataFrame, limit: int) -> pa.Table | None:
    """The corpus as a table if its size, measured before, is within ``limit`` bytes."""
    sizes = [F.size("embedding") * 8]
    for f in corpus.schema:
        if f.name != "embedding":
            text = isinstance(f.dataType, (T.StringType, T.BinaryType))
            sizes.append(F.coalesce(F.octet_length(f.name), F.lit(0)) + 16 if text else F.lit(16))
            if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
                return None
    total = corpus.agg(F.sum(sum(sizes[1:], sizes[0])).alias("b")).first()["b"]
    return None if total is not None and total > limit else corpus.toArrow()


def _scan_queries(
    queries: DataFrame, corpus: pa.Table, k: int, id_col: str, schema: T.StructType
) -> DataFrame:
    """Every task has the whole corpus and finds the hits of its own queries: nothing is shuffled."""
    if not corpus.num_rows:
        return queries.sparkSession.createDataFrame([], schema)
    carried = [f.name for f in schema][2:]
    corpus = corpus.combine_chunks()
    sent = queries.sparkSession.sparkContext.broadcast(
        (vectors(corpus["embedding"].combine_chunks()), corpus.select(carried))
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, rows = sent.value
        for batch in batches:
            if batch.num_rows:
                top = TopK(vectors(batch.column("embedding")), k)
                top.offer(points, rows, id_col)
                yield from _result(top, batch.column("qid"), carried)

    return queries.select("qid", "embedding").mapInArrow(task, schema)


def rows_of(tile_bytes: int, length: int) -> int:
    """Queries of a tile."""
    return max(1, tile_bytes // (8 * length + 64))


def query_tiles(queries: DataFrame, tile_bytes: int, tiles: int = 1) -> Iterator[pa.Table]:
    """The queries in tables of ``tiles`` tiles of about ``tile_bytes``: ``qid``, ``embedding`` and others.

    Rows are in the order of their numbers, so that a tile is a slice.
    """
    spark = queries.sparkSession
    first = queries.select("embedding").first()
    if first is None:
        return
    tile_rows = tiles * rows_of(tile_bytes, len(first["embedding"]))
    rows, n = numbered(queries, "_number")
    folder = scratch_path(spark, "query-tiles")
    rows.withColumn("_tile", F.expr(f"_number div {tile_rows}")).write.partitionBy("_tile").parquet(folder)
    for number in range(-(-n // tile_rows)):
        tile = spark.read.schema(rows.schema).parquet(f"{folder}/_tile={number}")
        yield tile.toArrow().sort_by("_number").drop(["_number"])


def _rounds(
    queries: DataFrame, corpus: DataFrame, k: int, id_col: str, schema: T.StructType, tile_bytes: int
) -> DataFrame:
    """Tiles of queries are sent to the corpus one after another, which is read where it lies.

    Before a tile is sent, its queries are compared with a small sample of the corpus: what is farther
    than the ``k``-th of those is no hit, so tasks return little more than hits. A round stores its
    own; driver and tasks hold one tile of queries at a time.
    """
    spark, hits = queries.sparkSession, scratch_path(queries.sparkSession, "tile-hits")
    sample = corpus.select("embedding", id_col).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE_ROWS)
    sample = sample.select(F.col("embedding").cast("array<double>").alias("v")).toArrow()
    known = vectors(sample["v"].combine_chunks()) if sample.num_rows >= k else None
    near = spark.sparkContext.broadcast(known)
    bounded = queries.select("qid", "embedding", F.lit(0.0).alias("_limit")).schema

    def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = limits_of(vectors(batch.column("embedding")), near.value, k)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far)], ["qid", "embedding", "_limit"])

    carried = [f.name for f in schema][2:]
    spark.createDataFrame([], schema).write.parquet(hits)
    bounded_queries = queries.select("qid", "embedding").mapInArrow(limits, bounded)
    for table in query_tiles(bounded_queries, tile_bytes, max(1, TILE_BYTES // tile_bytes)):
        matrix = vectors(table["embedding"].combine_chunks())
        sent = spark.sparkContext.broadcast((table["qid"].combine_chunks(), matrix, table["_limit"].to_numpy()))
        step = rows_of(tile_bytes, matrix.shape[1])

        def task(batches: Iterator[pa.RecordBatch], sent=sent, step=step) -> Iterator[pa.RecordBatch]:
            qids, matrix, limit = sent.value
            tiles = range(0, len(matrix), step)
            tops = [TopK(matrix[lo : lo + step], k, limit[lo : lo + step]) for lo in tiles]
            for batch in batches:
                points, rows = vectors(batch.column("embedding")), pa.Table.from_batches([batch]).select(carried)
                for top in tops:
                    top.offer(points, rows, id_col)
            for lo, top in zip(tiles, tops):
                for hits_ in _result(top, qids.slice(lo, step), carried):
                    yield hits_.append_column("_tile", pa.array(np.full(hits_.num_rows, lo)))

        # by tile, as a query may come twice
        order = Window.partitionBy("_tile", "qid").orderBy("dist", id_col)
        found = corpus.mapInArrow(task, T.StructType([*schema, T.StructField("_tile", T.LongType())]))
        found = found.withColumn("_rk", F.row_number().over(order)).filter(F.col("_rk") <= k)
        found.select([f.name for f in schema]).write.mode("append").parquet(hits)
        sent.destroy()
    return spark.read.schema(schema).parquet(hits)


def knn(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 3,
    metric: str = "l2sq",
    id_col: str = "vec_id",
    exclude_self: bool = False,
    small_queries: int = SMALL_QUERIES,
    tile_bytes: int = TILE_BYTES,
) -> DataFrame:
    """The exact ``k`` nearest corpus rows of each query.

    With ``exclude_self`` a row is not its own neighbour (``qid`` and id are equal). Up to
    ``small_queries`` queries are sent to every task at once. For more, a corpus within
    ``tile_bytes`` is sent to the queries; else tiles of queries, so large, are sent to the corpus
    in rounds of one tile or some, which run here. No vector of the corpus is shuffled; the result is the same.

    Vectors that are NULL, or hold NULL, NaN or an infinite component, take no part; nor do those of
    another length than most queries have.
    """
    queries = prepared(queries, metric)
    corpus = prepared(corpus, metric)
    wanted = k + 1 if exclude_self else k
    schema = _hit_schema(queries, corpus)
    small = _small(queries, small_queries)
    if small is not None:
        sizes = np.sort(pc.list_value_length(small["embedding"]).to_numpy())
        length = int(np.bincount(sizes).argmax()) if len(sizes) else 0
        small = small.filter(pc.equal(pc.list_value_length(small["embedding"]), length))
        hits = _scan(small, _of_length(corpus, length), wanted, id_col, schema)
        return best_hits(hits, k, id_col, metric, exclude_self)
    length = usual_length(queries) or 0
    queries, corpus = _of_length(queries, length), _of_length(corpus, length)
    table = _broadcastable(corpus, tile_bytes)
    if table is not None:
        hits = _scan_queries(queries, table, wanted, id_col, schema)
    else:
        hits = _rounds(queries, corpus, wanted, id_col, schema, tile_bytes)
    return best_hits(hits, k, id_col, metric, exclude_self)


def knn_private(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 3,
    metric: str = "l2sq",
    id_col: str = "vec_id",
    exclude_self: bool = False,
) -> DataFrame:
    """The exact ``k`` nearest rows that have the query's owner; a NULL owner has none."""
    queries = prepared(queries, metric).filter(F.col("owner").isNotNull())
    corpus = prepared(corpus, metric).filter(F.col("owner").isNotNull())
    wanted = k + 1 if exclude_self else k
    length = usual_length(queries) or 0
    queries, corpus = _of_length(queries, length), _of_length(corpus, length)
    asking = matching(corpus, queries, "owner")
    hits = _join_by_key(queries, asking, "owner", wanted, id_col, _hit_schema(queries, corpus), length)
    return best_hits(hits, k, id_col, metric, exclude_self)


def knn_scoped(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 3,
    metric: str = "l2sq",
    id_col: str = "vec_id",
    exclude_self: bool = False,
) -> DataFrame:
    """The ``k`` nearest among shared rows (``owner`` NULL) and the query owner's own rows.

    Two plans instead of an OR on the owner: the private part is an equi-join, so rows of
    another owner never meet the query at all.
    """
    shared = knn(
        queries, corpus.filter(F.col("owner").isNull()), k, metric, id_col, exclude_self
    )
    private = knn_private(queries, corpus, k, metric, id_col, exclude_self)
    return best_hits(shared.unionByName(private).drop("rk"), k, id_col)


def knn_lsh(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 3,
    radius: float = 0.25,
    tables: int = 16,
    hashes: int = 3,
    id_col: str = "vec_id",
    exclude_self: bool = False,
    seed: int = 42,
) -> DataFrame:
    """Approximately the ``k`` nearest rows: only rows sharing a hash bucket are compared.

    A bucket of a table is given by ``hashes`` random projections, cut to steps of
    ``radius``. All rows of a shared bucket are compared, however full it is. A query that
    shares no bucket with ``k`` rows has fewer hits.
    """
    queries, corpus = prepared(queries), prepared(corpus)
    length = usual_length(queries) or 0
    queries, corpus = _of_length(queries, length), _of_length(corpus, length)
    wanted = k + 1 if exclude_self else k
    lsh = BucketedRandomProjectionLSH(
        inputCol="_v",
        outputCol="_h",
        bucketLength=radius,
        numHashTables=tables * hashes,
        seed=seed,
    )
    # fitting draws the directions and needs the dimension only
    one = _as_vector(corpus).limit(1)
    if one.isEmpty():
        return best_hits(corpus.sparkSession.createDataFrame([], _hit_schema(queries, corpus)), k, id_col)
    model = lsh.fit(one)

    def buckets(df: DataFrame) -> DataFrame:
        hashed = model.transform(_as_vector(df))
        steps = F.transform("_h", lambda v: vector_to_array(v)[0].cast("bigint").cast("string"))
        keys = F.transform(
            F.sequence(F.lit(0), F.lit(tables - 1)),
            lambda t: F.concat_ws(",", t, F.slice(F.col("_steps"), t * hashes + 1, hashes)),
        )
        return hashed.withColumn("_steps", steps).select(*df.columns, F.explode(keys).alias("_key"))

    hits = _join_by_key(
        buckets(queries), buckets(corpus), "_key", wanted, id_col, _hit_schema(queries, corpus), length
    )
    # a row may be met in several buckets
    distinct = hits.dropDuplicates(["qid", id_col])
    return best_hits(distinct, k, id_col, exclude_self=exclude_self)


def _as_vector(df: DataFrame) -> DataFrame:
    return df.withColumn("_v", array_to_vector(F.col("embedding").cast("array<double>")))


def distance_to(vector: list[float], column: str = "embedding") -> Column:
    """Squared distance of a vector column to one fixed vector, as a built-in expression."""
    fixed = F.array(*[F.lit(float(x)) for x in vector])
    squares = F.zip_with(F.col(column), fixed, lambda a, b: (a - b) * (a - b))
    return F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)
