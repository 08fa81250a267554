"""Named queries over the shared test tables, one or more per operator.

Each takes ``(spark, sf_dir)`` and reads its tables whole. ``oracles.py`` states the same
results in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillbridge.functions import text as X
from skillbridge.operators import accounts, context, corpus, ivf, knn, numbering, quality
from skillbridge.plans import inputs as I
from skillbridge.plans.ingest import all_courses, ingest, typed_listing
from skillbridge.plans.outbound import answer_landed
from skillbridge.plans.recommend import answer_queries, index_courses, recommend
from skillbridge.plans.uploads import publish_uploads
from skillbridge.schemas import COURSES
from skillbridge.session import scratch_path
from skillbridge.sources import listings, requests, sinks
from skillbridge.sources.listings import PROVIDER_A, PROVIDER_B
from skillbridge.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


# Listings -----------------------------------------------------------------------------


def _landed(spark: SparkSession, pages: DataFrame, name: str) -> DataFrame:
    path = scratch_path(spark, name)
    listings.write_pages(pages, path)
    return listings.read_pages(spark, path)


@query
def listing_a(spark: SparkSession, sf: str) -> DataFrame:
    pages = _landed(spark, I.pages_a(spark, sf), "pages-a")
    return typed_listing(pages, PROVIDER_A).select(COURSES.names)


@query
def listing_b(spark: SparkSession, sf: str) -> DataFrame:
    pages = _landed(spark, I.pages_b(spark, sf), "pages-b")
    return typed_listing(pages, PROVIDER_B).select(COURSES.names)


@query
def listing_bad_envelope(spark: SparkSession, sf: str) -> DataFrame:
    rejects = listings.bad_pages(I.pages_of_talk(spark, sf), PROVIDER_B)
    return rejects.select("_page", "raw", F.array_join("errors", ",").alias("errors"))


@query
def courses_conform(spark: SparkSession, sf: str) -> DataFrame:
    return ingest(I.pages_b(spark, sf), PROVIDER_B)[0]


@query
def courses_rejects(spark: SparkSession, sf: str) -> DataFrame:
    rejects = ingest(I.pages_b(spark, sf), PROVIDER_B)[1]
    return rejects.select(
        "_source",
        "_page",
        F.get_json_object("raw", "$.id").alias("raw_id"),
        F.get_json_object("raw", "$.name").alias("raw_title"),
        F.array_join("errors", ",").alias("errors"),
    )


def _both_providers(spark: SparkSession, sf: str) -> DataFrame:
    return all_courses(
        ingest(I.pages_a(spark, sf), PROVIDER_A)[0], ingest(I.pages_b(spark, sf), PROVIDER_B)[0]
    )


@query
def courses_union(spark: SparkSession, sf: str) -> DataFrame:
    return _both_providers(spark, sf)


@query
def courses_append(spark: SparkSession, sf: str) -> DataFrame:
    """Two loads of one provider: the table keeps both copies."""
    path = scratch_path(spark, "courses")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    courses = ingest(I.pages_a(spark, sf), PROVIDER_A)[0]
    sinks.append_courses(courses, name, path)
    sinks.append_courses(courses, name, path)
    return spark.table(name)


@query
def page_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Documents are the pages wanted, labelled ones have landed."""
    last = I.table(spark, sf, "documents").agg(F.max("doc_id")).first()[0]
    landed = I.table(spark, sf, "labels").select(F.col("doc_id").alias("page"))
    return listings.page_gaps(landed, 0, last)


@query
def page_gap_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The turns of conversations as pages that have landed; what is missing up to the last one."""
    pages = _landed(spark, I.pages_of_talk(spark, sf), "pages-talk")
    last = pages.agg(F.max("page")).first()[0]
    return listings.gap_runs(pages, 0, last)


@query
def course_text(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "courses")
    sinks.append_rows(ingest(I.pages_a(spark, sf), PROVIDER_A)[0], path)
    rows = listings.scan_course_text(spark, path)
    text = X.course_text(F.col("title"), F.col("headline"))
    return rows.select(text.alias("text")).filter(F.col("text").isNotNull())


# Accounts -----------------------------------------------------------------------------


@query
def row_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = I.wide_table(spark, sf, "documents")
    checked = quality.check(docs, quality.account_rules("text", "text"))
    return checked.select("doc_id", F.array_join("errors", ",").alias("errors"))


@query
def upload_admit(spark: SparkSession, sf: str) -> DataFrame:
    ok, _ = quality.split_valid(I.upload_forms(spark, sf), quality.upload_rules())
    return ok.select("id")


@query
def upload_rejects(spark: SparkSession, sf: str) -> DataFrame:
    _, rejects = quality.split_valid(I.upload_forms(spark, sf), quality.upload_rules())
    return rejects.select("id", F.array_join("errors", ",").alias("errors"))


@query
def user_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return accounts.lookup(I.users(spark, sf), I.active_users(spark, sf), unique=True)


@query
def user_credential(spark: SparkSession, sf: str) -> DataFrame:
    return accounts.lookup(I.users(spark, sf), I.active_users(spark, sf), columns=["password"])


@query
def user_uploads(spark: SparkSession, sf: str) -> DataFrame:
    found = accounts.user_uploads(
        I.uploads(spark, sf), I.users(spark, sf), I.active_users(spark, sf)
    )
    return accounts.project_upload(found, "id")


@query
def upload_page(spark: SparkSession, sf: str) -> DataFrame:
    return accounts.page_rows(I.uploads(spark, sf), skip=20, limit=10).select("id")


@query
def upload_page_after(spark: SparkSession, sf: str) -> DataFrame:
    """The page that follows the first twenty uploads, from the last key of those."""
    rows = I.uploads(spark, sf).select("id")
    last = accounts.page_after(rows, None, 20).agg(F.max("id")).first()[0]
    return accounts.page_after(rows, last, 10)


@query
def upload_listing(spark: SparkSession, sf: str) -> DataFrame:
    return accounts.page_rows(I.uploads(spark, sf)).select("id", "email")


@query
def fk_ok(spark: SparkSession, sf: str) -> DataFrame:
    return accounts.fk_split(I.uploads(spark, sf), I.active_users(spark, sf))[0].select("id")


@query
def fk_orphan(spark: SparkSession, sf: str) -> DataFrame:
    return accounts.fk_split(I.uploads(spark, sf), I.active_users(spark, sf))[1].select("id")


def _erased(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return accounts.erase(I.users(spark, sf), I.uploads(spark, sf), I.active_users(spark, sf))


@query
def erase_users(spark: SparkSession, sf: str) -> DataFrame:
    return _erased(spark, sf)[0].select("id", "email")


@query
def erase_uploads(spark: SparkSession, sf: str) -> DataFrame:
    return _erased(spark, sf)[1].select("id", "email")


@query
def erase_report(spark: SparkSession, sf: str) -> DataFrame:
    return _erased(spark, sf)[2]


def _signups(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    batch = I.uploads(spark, sf).select("id", "email")
    return accounts.admit_unique(batch, I.active_users(spark, sf), "email", "id")


@query
def user_admit(spark: SparkSession, sf: str) -> DataFrame:
    return _signups(spark, sf)[0]


@query
def user_admit_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return _signups(spark, sf)[1]


@query
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    """A customer takes over the price of the last order."""
    base = I.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("v")
    )
    changes = I.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("seq")
    )
    return accounts.upsert(base, changes, "key", "seq")


@query
def update_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of all customers as changes to the nations; unknown keys change nothing."""
    base = I.table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("key"), F.lit(0.0).alias("v")
    )
    changes = I.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("seq")
    )
    return accounts.upsert(base, changes, "key", "seq", insert_missing=False)


@query
def surrogate_ids(spark: SparkSession, sf: str) -> DataFrame:
    return accounts.assign_ids(I.table(spark, sf, "customer"), start=1000)


@query
def surrogate_summary(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the ids, whatever they are."""
    return surrogate_ids(spark, sf).agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("id").alias("n_ids"),
        (F.min("id") > 1000).alias("above_start"),
    )


@query
def ids_two_loads(spark: SparkSession, sf: str) -> DataFrame:
    """Customers, then suppliers, then the customers again, as after a failure."""
    path = scratch_path(spark, "accounts-table")
    customers = I.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    suppliers = I.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    for load, rows in (("customers", customers), ("suppliers", suppliers), ("customers", customers)):
        numbering.append_numbered(rows, path, load, order=["key"])
    return numbering.read_numbered(spark, path)


# Messages -----------------------------------------------------------------------------


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "requests")
    requests.write_requests(requests.encode_requests(I.resume_uploads(spark, sf)), path)
    parsed = requests.parse_requests(requests.route(requests.read_requests(spark, path)))
    return requests.split_requests(parsed)[0].withColumnRenamed("message_id", "request_id")


@query
def request_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return _requests(spark, sf).select("request_id", "email", "resume", "job_desc")


@query
def upload_publish(spark: SparkSession, sf: str) -> DataFrame:
    """The messages that the upload job sends for all orders as forms."""
    table, queue = scratch_path(spark, "uploads-table"), scratch_path(spark, "uploads-queue")
    publish_uploads(I.full_forms(spark, sf), I.active_users(spark, sf), table, queue)
    sent = requests.parse_requests(requests.route(requests.read_requests(spark, queue)))
    stored = spark.read.parquet(table).select(F.col("id").cast("string").alias("message_id"))
    return sent.join(stored, "message_id").select("message_id", "email", "resume", "job_desc", "error")


@query
def upload_publish_rejects(spark: SparkSession, sf: str) -> DataFrame:
    table, queue = scratch_path(spark, "uploads-table"), scratch_path(spark, "uploads-queue")
    rejects = publish_uploads(I.full_forms(spark, sf), I.active_users(spark, sf), table, queue)
    return rejects.select("id", F.array_join("errors", ",").alias("errors"))


@query
def answer_trim(spark: SparkSession, sf: str) -> DataFrame:
    padded = F.concat(F.lit("\n\t  "), F.col("text"), F.lit("  \r\n"))
    return I.table(spark, sf, "conversations").select(
        "conv_id", "turn", X.strip_space(padded).alias("answer")
    )


@query
def notify_rows(spark: SparkSession, sf: str) -> DataFrame:
    turns = I.table(spark, sf, "conversations")
    rows = sinks.notifications(
        turns, I.email("conv_id"), F.lit(X.ANSWER_SUBJECT), X.strip_space(F.col("text"))
    )
    path = scratch_path(spark, "notifications")
    sinks.write_notifications(rows, path)
    return sinks.read_notifications(spark, path)


# Corpus -------------------------------------------------------------------------------


@query
def atomic_meta(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.atomic_columns(I.table(spark, sf, "embeddings"))


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return I.wide_table(spark, sf, "documents").select("doc_id", "text")


@query
def doc_union(spark: SparkSession, sf: str) -> DataFrame:
    courses = I.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("headline")
    )
    # metadata as it comes: some of its values are nested, and are to be left out
    about = F.to_variant_object(F.struct("lang", "source", "n_chars", F.array("lang").alias("tags"), F.struct("source").alias("more")))
    resumes = corpus.owned_documents(
        I.table(spark, sf, "documents"), "resume", F.col("doc_id"), I.email("doc_id"), F.col("text"), about
    )
    turn_id = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    jobs_ = corpus.owned_documents(
        I.table(spark, sf, "conversations"), "job", turn_id, I.email("conv_id"), F.col("text"),
        F.to_variant_object(F.struct("role", "turn")),
    )
    docs = corpus.corpus_docs(corpus.course_documents(courses), resumes, jobs_)
    return docs.withColumn("meta", F.to_json("meta"))


@query
def chunk_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.chunk_fixed(_documents(spark, sf))


@query
def chunk_text(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.chunk_text(_documents(spark, sf))


@query
def embed_hash(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.embed(_documents(spark, sf), "text").drop("text")


@query
def embed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What the vectors of ``embed_hash`` are made of: the words of each text by the component they hash to.

    ``as_embedded`` says that the vector is these counts, brought to length 1.
    """
    embedder = corpus.HashingEmbedder()
    docs = embedder.counts(embedder.embed(_documents(spark, sf), "text"), "text", "counts")
    docs = docs.withColumn("n", vector_to_array("counts"))
    norm = F.sqrt(F.aggregate("n", F.lit(0.0), lambda s, x: s + x * x))
    pairs = F.arrays_zip("n", "embedding")
    # the outer lambda binds the norm, as the optimizer would put it into the inner one, once per component
    off = F.transform(F.array(norm), lambda s: F.exists(pairs, lambda p: F.abs(p["n"] / s - p["embedding"]) > 1e-6))
    docs = docs.withColumn("as_embedded", ~off[0])
    cells = docs.select("doc_id", "as_embedded", F.posexplode("n").alias("component", "n")).filter("n > 0")
    return cells.select("doc_id", "component", F.col("n").cast("bigint").alias("n_words"), "as_embedded")


@query
def embed_model(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of all documents through a model that is loaded in the workers."""
    chunks = corpus.chunk_fixed(_documents(spark, sf))
    made = corpus.embed(chunks, "chunk", corpus.ModelEmbedder(I.load_counter, "counter"))
    vector = [F.col("embedding")[k].cast("int") for k in (0, 1)]
    return made.select("doc_id", "chunk_idx", vector[0].alias("n_chars"), vector[1].alias("n_spaces"))


@query
def index_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed chunks of all documents, stored as an index by kind and read back."""
    docs = doc_union(spark, sf)
    chunks = corpus.with_chunk_id(corpus.chunk_fixed(docs))
    folder = sinks.write_index(chunks, scratch_path(spark, "index"), "v1")
    return sinks.read_index(spark, folder)


# Retrieval ----------------------------------------------------------------------------


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return (
        I.vector_queries(spark, sf).select("qid", "embedding"),
        I.wide_table(spark, sf, "embeddings").select("vec_id", "embedding"),
    )


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.select("qid", "rk", "vec_id", F.round("dist", 6).alias("d"))


@query
def knn_top3(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(knn.knn(*_vectors(spark, sf), exclude_self=True))


@query
def knn_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(knn.knn(*_vectors(spark, sf), metric="cosine", exclude_self=True))


@query
def knn_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The exact join in the form for more queries than a task may be sent: tiles in rounds."""
    return _rounded(knn.knn(*_vectors(spark, sf), exclude_self=True, small_queries=0, tile_bytes=1 << 16))


@query
def knn_sent_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The exact join in the form for many queries and a corpus that fits into a tile."""
    return _rounded(knn.knn(*_vectors(spark, sf), exclude_self=True, small_queries=0))


@query
def knn_scoped(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(
        knn.knn_scoped(I.vector_queries(spark, sf), I.scoped_vectors(spark, sf), exclude_self=True)
    )


@query
def knn_lsh(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(knn.knn_lsh(*_vectors(spark, sf), exclude_self=True))


def _recall(near: DataFrame, exact: DataFrame, least: float) -> DataFrame:
    """How approximate hits compare with the exact ones."""
    found = exact.select("qid", "vec_id", F.col("d").alias("true_d")).join(near, ["qid", "vec_id"], "left")
    return found.agg(
        F.countDistinct("qid").alias("n_queries"),
        F.bool_and(F.coalesce(F.col("d") == F.col("true_d"), F.lit(True))).alias("distances_exact"),
        (F.count("d") >= least * F.count("*")).alias("recall_reached"),
    )


@query
def knn_lsh_recall(spark: SparkSession, sf: str) -> DataFrame:
    return _recall(knn_lsh(spark, sf), knn_top3(spark, sf), 0.9)


@query
def knn_ivf(spark: SparkSession, sf: str) -> DataFrame:
    """Hits from the stored inverted file."""
    queries, vectors = _vectors(spark, sf)
    folder = ivf.write_ivf(vectors, scratch_path(spark, "inverted-file"))
    return _rounded(ivf.search_ivf(spark, folder, queries, exclude_self=True))


@query
def knn_ivf_recall(spark: SparkSession, sf: str) -> DataFrame:
    return _recall(knn_ivf(spark, sf), knn_top3(spark, sf), 0.95)


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    queries, index = I.vector_queries(spark, sf), I.vector_index(spark, sf)
    hits = knn.knn_scoped(queries, index.drop("text"), exclude_self=True)
    return hits.join(index.select("vec_id", "text"), "vec_id")


@query
def context_(spark: SparkSession, sf: str) -> DataFrame:
    return context.stuff_context(_hits(spark, sf))


@query
def source_docs(spark: SparkSession, sf: str) -> DataFrame:
    found = context.source_docs(_hits(spark, sf))
    return found.select("qid", F.array_join("sources", ",").alias("sources"))


@query
def prompt(spark: SparkSession, sf: str) -> DataFrame:
    contexts = context.stuff_context(_hits(spark, sf))
    return context.build_prompts(contexts).select("qid", "prompt")


def _answers(queries: DataFrame, index: DataFrame) -> DataFrame:
    answers = answer_queries(queries, index, exclude_self=True)
    return answers.select(
        "qid",
        I.email("qid").alias("address"),
        F.lit(X.ANSWER_SUBJECT).alias("subject"),
        "context",
        F.array_join("sources", ",").alias("sources"),
        "prompt",
    )


@query
def recommend_(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(I.vector_queries(spark, sf), I.vector_index(spark, sf))


def _course_index(spark: SparkSession, sf: str) -> DataFrame:
    index = index_courses(_both_providers(spark, sf))
    folder = sinks.write_index(index, scratch_path(spark, "course-index"), "v1")
    return sinks.read_index(spark, folder)


@query
def recommend_text(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a resume, answered from the courses of both providers."""
    answers = recommend(_requests(spark, sf), _course_index(spark, sf))
    return answers.withColumn("sources", F.array_join("sources", ","))


def _window_index(spark: SparkSession, sf: str) -> DataFrame:
    index = index_courses(_both_providers(spark, sf), I.LetterEmbedder(), corpus.chunk_fixed)
    folder = sinks.write_index(index, scratch_path(spark, "window-index"), "v1")
    return sinks.read_index(spark, folder)


def _windows(spark: SparkSession, sf: str, asked: DataFrame, **options: object) -> DataFrame:
    """The text job with fixed windows and letter counts, which SQL can check."""
    answers = recommend(
        asked, _window_index(spark, sf), embedder=I.LetterEmbedder(), chunker=corpus.chunk_fixed, **options
    )
    return answers.withColumn("sources", F.array_join("sources", ","))


@query
def recommend_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _windows(spark, sf, _requests(spark, sf))


@query
def recommend_isolated(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of different senders under one id: each is answered from its own texts."""
    return _windows(spark, sf, I.turn_requests(spark, sf))


@query
def recommend_per_request(spark: SparkSession, sf: str) -> DataFrame:
    """Every request asks its own question: its job description."""
    return _windows(spark, sf, _requests(spark, sf), query="job_desc")


@query
def recommend_titles(spark: SparkSession, sf: str) -> DataFrame:
    """The message names the courses: their titles come from the metadata of the chunks."""
    return _windows(spark, sf, _requests(spark, sf), titles=True)


@query
def recommend_titles_each(spark: SparkSession, sf: str) -> DataFrame:
    return _windows(spark, sf, _requests(spark, sf), query="job_desc", titles=True)


@query
def outbound_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as requests, and events as further messages, from the queue to the outbound sink."""
    landed, out = scratch_path(spark, "batch-requests"), scratch_path(spark, "batch-outbound")
    own = requests.encode_requests(I.resume_uploads(spark, sf))
    others = I.event_messages(I.table(spark, sf, "events")).filter("body NOT LIKE '%file_content%'")
    requests.write_requests(own.unionByName(others), landed)
    options = {"embedder": I.LetterEmbedder(), "chunker": corpus.chunk_fixed, "titles": True}
    return answer_landed(spark, landed, _window_index(spark, sf), I.OPERATOR_ADDRESS, out, **options)


# Streams ------------------------------------------------------------------------------


def _table_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table of one file or of a folder of files; a stream takes both by a pattern, but no plain file."""
    schema = I.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}[.]parquet")


def _run(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Drain a stream into a parquet sink and read it back."""
    out = scratch_path(spark, name)
    done = (
        stream.writeStream.format("parquet")
        .option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    done.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query
def stream_route(spark: SparkSession, sf: str) -> DataFrame:
    messages = I.event_messages(_table_stream(spark, sf, "events"))
    routed = requests.route(messages).select(F.col("message_id").cast("bigint").alias("event_id"), "body")
    return _run(spark, routed, "stream-route")


@query
def stream_admit(spark: SparkSession, sf: str) -> DataFrame:
    orders = _table_stream(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), I.email("o_custkey").alias("email")
    )
    joined = jobs.enrich_requests(orders, I.active_users(spark, sf), "email", "left_semi")
    return _run(spark, joined.select("id"), "stream-admit")


@query
def stream_deadletter(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch_path(spark, "stream-dead")
    routed = requests.route(I.event_messages(_table_stream(spark, sf, "events")))

    def echo(usable: DataFrame) -> DataFrame:
        subject = F.lit(X.ANSWER_SUBJECT)
        return usable.select(
            F.col("message_id").alias("request_id"),
            F.col("email").alias("address"),
            subject.alias("subject"),
            F.col("job_desc").alias("message"),
        )

    parsed = requests.parse_requests(routed)
    done = jobs.recommend_stream(parsed, echo, I.OPERATOR_ADDRESS, out, f"{out}-checkpoint")
    done.awaitTermination()
    return spark.read.parquet(f"{out}/dead").select(
        F.col("message_id").cast("bigint").alias("event_id"), "address", "subject", "message", "body"
    )


@query
def stream_poison(spark: SparkSession, sf: str) -> DataFrame:
    """Texts too long for the model make their batch raise: they become letters, the rest is answered."""
    landed, out = scratch_path(spark, "poison-requests"), scratch_path(spark, "poison-answers")
    requests.write_requests(requests.encode_requests(I.resume_uploads(spark, sf)), landed)
    model = corpus.ModelEmbedder(I.load_counter, "counter")

    def answer(usable: DataFrame) -> DataFrame:
        return model.embed(usable, "resume").select(
            F.col("message_id").alias("request_id"),
            F.col("email").alias("address"),
            F.lit(X.ANSWER_SUBJECT).alias("subject"),
            F.concat_ws(" ", F.transform("embedding", lambda x: x.cast("int").cast("string"))).alias("message"),
        )

    parsed = jobs.request_stream(spark, landed)
    long = lambda rows: model.raising(rows, "resume")
    done = jobs.recommend_stream(parsed, answer, I.OPERATOR_ADDRESS, out, f"{out}/checkpoint", suspects=long)
    done.awaitTermination()
    columns = ["address", "subject", "message"]
    answers = spark.read.parquet(f"{out}/answers").select(F.col("request_id").cast("bigint").alias("doc_id"), *columns)
    letters = spark.read.parquet(f"{out}/dead").select(F.col("message_id").cast("bigint").alias("doc_id"), *columns)
    return answers.unionByName(letters)


@query
def stream_courses_table(spark: SparkSession, sf: str) -> DataFrame:
    """Pages streamed into the course table, and all of their batches replayed."""
    landed, out = scratch_path(spark, "table-pages"), scratch_path(spark, "table-courses")
    name = out.rsplit("/", 1)[1].replace("-", "_")
    listings.write_pages(I.pages_a(spark, sf), landed)
    for attempt in ("first", "again"):
        done = jobs.ingest_stream(spark, landed, PROVIDER_A, out, f"{out}/{attempt}", table=name)
        done.awaitTermination()
    return sinks.read_courses(spark, name)


@query
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    landed, out = scratch_path(spark, "stream-pages"), scratch_path(spark, "stream-courses")
    listings.write_pages(I.pages_a(spark, sf), landed)
    done = jobs.ingest_stream(spark, landed, PROVIDER_A, out, f"{out}/checkpoint")
    done.awaitTermination()
    return spark.read.schema(COURSES).parquet(f"{out}/courses").select(COURSES.names)


@query
def stream_recommend(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch_path(spark, "stream-answers")
    index = I.vector_index(spark, sf)
    asked = _table_stream(spark, sf, "embeddings").select(
        F.col("vec_id").alias("qid"),
        F.concat(F.lit("owner"), F.col("label").cast("string")).alias("owner"),
        "embedding",
    )
    done = jobs.answer_stream(asked, lambda b: _answers(b, index), out, f"{out}-checkpoint")
    done.awaitTermination()
    return spark.read.parquet(out).drop("batch_id")


@query
def stream_recommend_text(spark: SparkSession, sf: str) -> DataFrame:
    """Landed requests answered per micro-batch by the same job as ``recommend_text``."""
    landed, out = scratch_path(spark, "stream-requests"), scratch_path(spark, "stream-texts")
    requests.write_requests(requests.encode_requests(I.resume_uploads(spark, sf)), landed)
    answer = jobs.course_answers(_course_index(spark, sf))
    parsed = jobs.request_stream(spark, landed)
    done = jobs.recommend_stream(parsed, answer, I.OPERATOR_ADDRESS, out, f"{out}/checkpoint")
    done.awaitTermination()
    answers = spark.read.parquet(f"{out}/answers").drop("batch_id")
    return answers.withColumn("sources", F.array_join("sources", ","))
