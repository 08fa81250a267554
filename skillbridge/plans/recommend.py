"""Requests to recommendations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from skillbridge.functions.text import (
    ANSWER_SUBJECT,
    CONTEXT_SEPARATOR,
    PROMPT_TEMPLATE,
    STANDING_QUESTION,
)
from skillbridge.operators.context import answer_inputs, build_prompts
from skillbridge.operators.corpus import (
    Embedder,
    chunk_text,
    course_documents,
    embed,
    request_documents,
    with_chunk_id,
)
from skillbridge.operators.knn import best_hits, distance_to, knn, knn_scoped
from skillbridge.operators.numbering import dealt


Chunker = Callable[[DataFrame], DataFrame]


def index_documents(
    docs: DataFrame, embedder: Embedder | None = None, chunker: Chunker = chunk_text
) -> DataFrame:
    """Chunk and embed documents: ``chunk_id, doc_id, owner, kind, meta, chunk_idx, chunk, embedding``."""
    chunks = with_chunk_id(chunker(docs))
    return embed(chunks, "chunk", embedder).select(
        "chunk_id", "doc_id", "owner", "kind", "meta", "chunk_idx", "chunk", "embedding"
    )


def index_courses(
    courses: DataFrame, embedder: Embedder | None = None, chunker: Chunker = chunk_text
) -> DataFrame:
    """The shared part of the index. Build it once, store it, and use it for all requests.

    Courses have no key, so a document is named by the course's id and a hash of its text.
    Loads append and may hold a course several times; it is indexed once.
    """
    name = F.concat_ws("-", F.col("id").cast("string"), F.md5(F.concat("title", "headline")))
    documents = course_documents(courses, name).dropDuplicates(["doc_id"])
    return index_documents(documents, embedder, chunker)


def answer_queries(
    queries: DataFrame,
    index: DataFrame,
    k: int = 3,
    id_col: str = "vec_id",
    text: str = "text",
    question: str | Column = STANDING_QUESTION,
    template: str = PROMPT_TEMPLATE,
    exclude_self: bool = False,
) -> DataFrame:
    """``qid, context, sources, prompt`` for queries that each have a vector of their own.

    A query sees the shared rows of the index and the rows of its owner. The search goes by
    ids, which must be unique; texts are joined to the hits alone.
    """
    rows = index.select(id_col, "owner", "embedding")
    found = knn_scoped(queries, rows, k, id_col=id_col, exclude_self=exclude_self)
    hits = found.join(index.select(id_col, text), id_col)
    return build_prompts(answer_inputs(hits, id_col, text), question, template)


def nearest_courses(
    index: DataFrame,
    k: int = 3,
    question: str = STANDING_QUESTION,
    embedder: Embedder | None = None,
) -> tuple[list[float], list[Row]]:
    """The question's vector and its ``k`` nearest chunks of the shared index."""
    spark = index.sparkSession
    asked = spark.createDataFrame([(question,)], "question string")
    row = embed(asked, "question", embedder).select("embedding").first()
    if row is None:
        raise ValueError("the question has no word to search by")
    vector = list(row["embedding"])
    query = spark.createDataFrame([("q", vector)], "qid string, embedding array<float>")
    hits = knn(query, _shared(index), k, id_col="chunk_id")
    return vector, hits.orderBy("rk").collect()


def _shared(index: DataFrame) -> DataFrame:
    """What everybody may see of an index, with the title of each chunk's document."""
    title = F.col("meta")["title"] if "meta" in index.columns else F.lit(None).cast("string")
    return index.filter(F.col("owner").isNull()).select("chunk_id", "chunk", title.alias("title"), "embedding")


def _listed(courses: list[Row], titles: bool) -> str:
    if not titles:
        return "\n".join(c["chunk"] for c in courses)
    return "\n".join(dict.fromkeys(c["title"] for c in courses if c["title"] is not None))


def stored_requests(requests: DataFrame, *more: str) -> DataFrame:
    """Id, sender, texts and ``more`` of ``requests``, with ``_row``, which tells whose documents are whose.

    No two rows share it, even if ids or senders are missing or come twice. Stored once, so that
    requests are parsed once, and their texts are read where they lie and not shuffled.
    """
    columns = dict.fromkeys(["request_id", "email", "resume", "job_desc", *more])
    rows = requests.withColumn("request_id", F.col("request_id").cast("string")).select(*columns)
    return dealt(rows).withColumnRenamed("_dealt_at", "_row")


def recommend(
    requests: DataFrame,
    index: DataFrame,
    k: int = 3,
    question: str = STANDING_QUESTION,
    embedder: Embedder | None = None,
    chunker: Chunker = chunk_text,
    template: str = PROMPT_TEMPLATE,
    nearest: tuple[list[float], list[Row]] | None = None,
    query: str | None = None,
    titles: bool = False,
) -> DataFrame:
    """Recommendations for requests ``(request_id, email, resume, job_desc)``.

    With ``query`` that column is what each request asks (see :func:`recommend_each`).

    ``index`` is the stored index of the courses. Every request asks the same question, so
    the ``k`` nearest courses are found once for all of them (a stream passes them in as
    ``nearest``). A request's own documents are chunked and embedded here and ranked
    against that question by a built-in expression. A request sees its own documents only
    (see :func:`stored_requests`), so nobody's text can reach somebody else's context.

    With ``titles`` the message lists the titles of the courses, each once, instead of chunks.

    Returns ``request_id, address, subject, message, context, sources, prompt``. The
    message is the ranked list of nearest courses; the context may also hold the
    request's own text.
    """
    if query is not None:
        return recommend_each(requests, index, query, k, embedder, chunker, template, titles)
    vector, courses = nearest or nearest_courses(index, k, question, embedder)
    hit = "array<struct<dist:double,chunk_id:string,chunk:string>>"
    shared = F.array(
        *[
            F.struct(F.lit(c["dist"]), F.lit(c["chunk_id"]), F.lit(c["chunk"])) for c in courses
        ]
    ).cast(hit)

    requests = stored_requests(requests)
    private = index_documents(request_documents(requests, "_row"), embedder, chunker).select(
        F.col("owner").alias("qid"), "chunk_id", distance_to(vector).alias("dist"), "chunk"
    )
    own = (
        best_hits(private, k, "chunk_id")
        .groupBy(F.col("qid").alias("_row"))
        .agg(F.collect_list(F.struct("dist", "chunk_id", "chunk")).alias("_own"))
    )
    both = F.concat(shared, F.coalesce("_own", F.array().cast(hit)))
    answered = requests.drop("resume", "job_desc").join(own, "_row", "left").withColumn(
        "_hits", F.slice(F.array_sort(both), 1, k)
    )
    contexts = answered.select(
        "request_id",
        F.col("email").alias("address"),
        F.lit(ANSWER_SUBJECT).alias("subject"),
        F.lit(_listed(courses, titles)).alias("message"),
        F.array_join(F.transform("_hits", lambda h: h["chunk"]), CONTEXT_SEPARATOR).alias("context"),
        F.transform("_hits", lambda h: h["chunk_id"]).alias("sources"),
    )
    return build_prompts(contexts, question, template)


def recommend_each(
    requests: DataFrame,
    index: DataFrame,
    query: str,
    k: int = 3,
    embedder: Embedder | None = None,
    chunker: Chunker = chunk_text,
    template: str = PROMPT_TEMPLATE,
    titles: bool = False,
) -> DataFrame:
    """As :func:`recommend`, with a question of its own for every request.

    Every distinct question is searched once, for all requests that ask it, and the lists of hits are
    joined to the requests. The message ranks the nearest courses of the request's question; its
    own documents are compared with that question only. A request whose question has no word gets
    an empty message and context.
    """
    requests = stored_requests(requests, query).withColumn("_ask", F.sha2(F.col(query), 256))
    asked = requests.select("_ask", F.col(query).alias("_text")).dropDuplicates(["_ask"])
    asked = embed(asked.filter(F.col("_text").isNotNull()), "_text", embedder)
    asked = asked.select(F.col("_ask").alias("qid"), "embedding")

    # as many rows as there are distinct questions, each with k hits
    shared = knn(asked, _shared(index), k, id_col="chunk_id")
    hit = F.struct("dist", "chunk_id", "chunk", "title")
    listed = shared.groupBy(F.col("qid").alias("_ask")).agg(F.array_sort(F.collect_list(hit)).alias("_courses"))

    private = index_documents(request_documents(requests, "_row"), embedder, chunker)
    private = private.select(F.col("owner").alias("_row"), "chunk_id", "chunk", F.col("embedding").alias("_own"))
    # a question goes to the chunks of its requests; a request has one question, so no pairs arise
    whose = requests.select("_row", "_ask").join(asked.withColumnRenamed("qid", "_ask"), "_ask")
    squares = F.zip_with("_own", "embedding", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    near = private.join(whose.select("_row", "embedding"), "_row").select(
        F.col("_row").alias("qid"),
        "chunk_id",
        F.aggregate(squares, F.lit(0.0), lambda s, x: s + x).alias("dist"),
        "chunk",
    )
    own = best_hits(near, k, "chunk_id").withColumn("title", F.lit(None).cast("string"))
    own = own.groupBy(F.col("qid").alias("_row")).agg(F.collect_list(hit).alias("_own"))

    nothing = F.array().cast(listed.schema["_courses"].dataType)
    answered = (
        requests.select(*dict.fromkeys(["request_id", "email", query, "_row", "_ask"]))
        .join(listed, "_ask", "left")
        .join(own, "_row", "left")
        .withColumn("_courses", F.coalesce("_courses", nothing))
        .withColumn("_hits", F.slice(F.array_sort(F.concat("_courses", F.coalesce("_own", nothing))), 1, k))
    )
    lines = F.transform("_courses", lambda h: h["title" if titles else "chunk"])
    contexts = answered.select(
        "request_id",
        F.col("email").alias("address"),
        F.lit(ANSWER_SUBJECT).alias("subject"),
        F.array_join(F.array_distinct(lines) if titles else lines, "\n").alias("message"),
        F.array_join(F.transform("_hits", lambda h: h["chunk"]), CONTEXT_SEPARATOR).alias("context"),
        F.transform("_hits", lambda h: h["chunk_id"]).alias("sources"),
        F.coalesce(F.col(query), F.lit("")).alias("_question"),
    )
    return build_prompts(contexts, F.col("_question"), template).drop("_question")
