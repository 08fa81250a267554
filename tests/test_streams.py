import base64
import json
from pathlib import Path

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from skillbridge.functions.text import ERROR_PREFIX
from skillbridge.operators import corpus
from skillbridge.plans import inputs, registry
from skillbridge.plans.ingest import ingest
from skillbridge.plans.recommend import index_courses, recommend
from skillbridge.session import shared_dir
from skillbridge.sources import listings, requests, sinks
from skillbridge.sources.listings import PROVIDER_B
from skillbridge.streaming import jobs, poison


def body(email="u@x", content=b"text", job="job", **changes):
    message = {"email": email, "file_content": base64.b64encode(content).decode(), "job_desc": job}
    return json.dumps({**message, **changes})


def messages(spark, *rows, first=0):
    return spark.createDataFrame(
        [(str(i), key, text) for i, (key, text) in enumerate(rows, first)],
        "message_id string, routing_key string, body string",
    )


def test_parse_keeps_every_row(spark):
    long = bytes(range(32, 127)) * 5
    rows = [
        body(content=long), "{", None, "[]", "7", body(email=None), body(job=None), "{}",
        body(file_content="%%%"), body(content=b"\xff\xfe"), body(content="é\n".encode()), body(content=b""),
    ]
    df = requests.parse_requests(messages(spark, *[("resume_pdf", r) for r in rows]))
    got = {int(r.message_id): r for r in df.collect()}
    assert len(got) == len(rows)
    assert got[0].error is None and got[0].resume == long.decode()
    assert [got[i].error for i in (1, 2)] == ["body is not JSON"] * 2
    assert all(got[i].error for i in (3, 4))
    assert got[5].error == "email is missing" and got[6].error == "job_desc is missing"
    assert got[7].error == "email is missing"
    assert got[8].error == got[9].error == "file_content cannot be decoded"
    assert got[10].error is None and got[10].resume == "é\n"
    assert got[11].error is None and got[11].resume == ""
    usable, failed = requests.split_requests(df)
    assert usable.count() + failed.count() == len(rows)


def test_encoded_base64_has_no_line_breaks(spark):
    uploads = spark.createDataFrame(
        [(1, "u@x", b"x" * 300, "j")], "id int, email string, pdf_resume binary, job_description string"
    )
    message = requests.encode_requests(uploads).first()
    assert message.routing_key == "resume_pdf" and message.message_id == "1"
    assert json.loads(message.body)["file_content"] == base64.b64encode(b"x" * 300).decode()


def test_shared_folder_is_required_on_a_cluster(tmp_path):
    from types import SimpleNamespace

    def session(**conf):
        values = {k.replace("_", "."): v for k, v in conf.items()}
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: values.get(k, d)))

    assert shared_dir(session(spark_checkpoint_dir="hdfs:///x/", spark_master="yarn")) == "hdfs:///x"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session(spark_master="yarn"))
    local = session(spark_master="local[2]")
    assert shared_dir(local) == shared_dir(local)


def test_routing(spark):
    df = messages(spark, ("resume_pdf", "a"), ("other", "b"), (None, "c"))
    assert [r.body for r in requests.route(df).collect()] == ["a"]


def land_pages(spark, path, numbers):
    rows = [(n, json.dumps({"results": [{"id": n, "name": "a"}, {"id": n}]})) for n in numbers]
    spark.createDataFrame(rows, "page bigint, body string").repartitionByRange(
        len(rows), "page"
    ).write.mode("append").json(path)


def test_ingest_in_batches_of_five_files(spark, folder):
    landed, out, checkpoint = f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint"
    land_pages(spark, landed, range(12))

    def run():
        stream = jobs.ingest_stream(spark, landed, PROVIDER_B, out, checkpoint)
        stream.awaitTermination()
        return [p["numInputRows"] for p in stream.recentProgress if p["numInputRows"]]

    run()
    courses = spark.read.parquet(f"{out}/courses")
    counts = sorted(r["count"] for r in courses.groupBy("batch_id").count().collect())
    assert counts == [2, 5, 5]
    assert spark.read.parquet(f"{out}/rejects").count() == 12
    batch = ingest(listings.read_pages(spark, landed), PROVIDER_B)[0]
    assert sorted(r.id for r in courses.collect()) == sorted(r.id for r in batch.collect())
    run()  # a restart finds nothing new
    assert spark.read.parquet(f"{out}/courses").count() == 12
    land_pages(spark, landed, [50])
    run()
    assert spark.read.parquet(f"{out}/courses").count() == 13


def test_replayed_batch_replaces_its_rows(spark, folder):
    for rows in ([1, 2], [1, 2]):
        sinks.write_batch(spark.createDataFrame([(r,) for r in rows], "x int"), folder, 7)
    assert spark.read.parquet(folder).count() == 2


def test_recommend_stream_goes_on_after_bad_requests(spark, folder):
    courses = spark.createDataFrame(
        [(i, f"course {w}", " recommend") for i, w in enumerate("abcd")], "id int, title string, headline string"
    )
    index = index_courses(courses).cache()
    landed = f"{folder}/in"
    files = [("resume_pdf", "{"), ("resume_pdf", body())], [("other", body()), ("resume_pdf", body(job="z"))]
    for n, rows in enumerate(files):
        messages(spark, *rows, first=10 * n).coalesce(1).write.mode("append").json(landed)

    def answer(batch):
        return recommend(batch.withColumnRenamed("message_id", "request_id"), index)

    parsed = jobs.request_stream(spark, landed, files_per_batch=1)
    jobs.recommend_stream(
        parsed, answer, "op@example.com", f"{folder}/out", f"{folder}/checkpoint"
    ).awaitTermination()
    answers = spark.read.parquet(f"{folder}/out/answers")
    assert answers.count() == 2 and answers.select("batch_id").distinct().count() == 2
    (dead,) = spark.read.parquet(f"{folder}/out/dead").collect()
    assert (dead.address, dead.subject) == ("op@example.com", "Service Error")
    assert dead.message == ERROR_PREFIX + "body is not JSON"
    assert (dead.message_id, dead.body) == ("0", "{")
    sent = sinks.read_notifications(spark, f"{folder}/out/outbound")
    assert sent.count() == 3 and sent.filter("subject = 'Service Error'").count() == 1
    usable = requests.parse_requests(requests.route(requests.read_requests(spark, landed)))
    batch = answer(requests.split_requests(usable)[0])
    key = ["address", "context", "message"]
    assert sorted(answers.select(key).collect()) == sorted(batch.select(key).collect())


def test_requests_without_an_answer_become_letters(spark, folder):
    rows = [("resume_pdf", body(email=f"u{n}@x")) for n in range(4)]
    messages(spark, *rows).write.json(f"{folder}/in")

    def answer(batch):
        found = batch.filter("message_id < 2").withColumnRenamed("message_id", "request_id")
        return found.selectExpr("request_id", "email AS address", "'Courses' AS subject", "job_desc AS message")

    parsed = jobs.request_stream(spark, f"{folder}/in")
    trigger = {"processingTime": "1 second"}  # a standing stream
    stream = jobs.recommend_stream(parsed, answer, "op@x", f"{folder}/out", f"{folder}/checkpoint", trigger)
    stream.processAllAvailable()
    assert stream.isActive
    stream.stop()
    dead = spark.read.parquet(f"{folder}/out/dead").collect()
    assert sorted(r.message_id for r in dead) == ["2", "3"]
    assert {r.message for r in dead} == {ERROR_PREFIX + "there is no answer"}


def test_text_stream_equals_batch(spark):
    columns = ["request_id", "address", "message", "context", "sources", "prompt"]
    batch = registry.recommend_text(spark, SF).select(columns)
    stream = registry.stream_recommend_text(spark, SF).select(columns)
    assert batch.count() == 200
    assert sorted(stream.collect()) == sorted(batch.collect())


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
def test_stream_static_join(spark, how):
    orders = registry._table_stream(spark, SF, "orders").select(
        F.col("o_orderkey").alias("id"), inputs.email("o_custkey").alias("email")
    )
    users = inputs.users(spark, SF).filter("id < 100").select("email")
    got = registry._run(spark, jobs.enrich_requests(orders, users, "email", how), f"join-{how}")
    static = inputs.uploads(spark, SF).select("id", "email").join(users, "email", how)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in static.collect())


def test_notifications_round_trip(spark, folder):
    df = spark.createDataFrame([("a@x", 'quote " and\nline')], "a string, m string")
    rows = sinks.notifications(df, F.col("a"), F.lit("Courses"), F.col("m"))
    sinks.write_notifications(rows, folder)
    assert sinks.read_notifications(spark, folder).collect() == [("a@x", "Courses", 'quote " and\nline')]
    line = spark.read.text(folder).first().value
    assert list(json.loads(line)) == ["address", "subject", "message"]


def raising_answer(bad, log=None):
    """Echoes the job, and raises where it is one of ``bad``."""

    def answer(batch):
        job = F.when(F.col("job_desc").isin(bad), F.raise_error(F.concat(F.lit("no use for "), "job_desc")))
        return batch.select(
            F.col("message_id").alias("request_id"), F.col("email").alias("address"),
            F.lit("Courses").alias("subject"), F.coalesce(job, F.col("job_desc")).alias("message"),
        )

    return answer


@pytest.mark.parametrize("bad", [[], [0], [19], [3, 4, 11], list(range(20))])
def test_raising_requests_become_letters(spark, folder, bad):
    rows = [("resume_pdf", body(email=f"u{n}@x", job=f"job {n}")) for n in range(20)] + [("resume_pdf", "{")]
    messages(spark, *rows).repartition(3).write.json(f"{folder}/in")
    answer = raising_answer([f"job {n}" for n in bad])
    for checkpoint in ("one", "two"):  # the second run replays the batch
        jobs.recommend_stream(
            jobs.request_stream(spark, f"{folder}/in"), answer, "op@x", f"{folder}/out", f"{folder}/{checkpoint}"
        ).awaitTermination()
        answers = spark.read.parquet(f"{folder}/out/answers")
        assert sorted(int(r.request_id) for r in answers.collect()) == [n for n in range(20) if n not in bad]
        dead = {r.message_id: r for r in spark.read.parquet(f"{folder}/out/dead").collect()}
        assert set(dead) == {str(n) for n in bad} | {"20"}
        assert all(f"no use for job {n}" in dead[str(n)].message for n in bad)
        sent = sinks.read_notifications(spark, f"{folder}/out/outbound")
        assert sent.count() == 21 and sent.filter("address = 'op@x'").count() == len(bad) + 1


def test_an_outage_stops_the_stream(spark, folder):
    rows = [("resume_pdf", body(job=f"job {n}")) for n in range(8)]
    messages(spark, *rows).write.json(f"{folder}/in")
    stream = jobs.recommend_stream(
        jobs.request_stream(spark, f"{folder}/in"), raising_answer([f"job {n}" for n in range(8)]),
        "op@x", f"{folder}/out", f"{folder}/checkpoint", most_raising=3,
    )
    with pytest.raises(Exception, match="messages of a batch raise"):
        stream.awaitTermination()


def test_reasons():
    trace = "x\nTraceback (most recent call last):\n  File y\nKeyError: 'a'\n\nTraceback (most recent call last):\n  z\npkg.OwnError: it is so\n\n\tat java"
    assert poison.reason_of(Exception(trace)) == "it is so"
    assert poison.reason_of(Exception("first line\nat java")) == "first line"
    assert poison.reason_of(RuntimeError()) == "RuntimeError"


def test_batches_in_the_course_table(spark, folder):
    landed = f"{folder}/in"
    name = "courses_" + folder.rsplit("-", 1)[1]
    land_pages(spark, landed, range(7))

    def run(checkpoint, files=3):
        jobs.ingest_stream(spark, landed, PROVIDER_B, f"{folder}/out", f"{folder}/{checkpoint}", files, table=name).awaitTermination()
        return sorted(r.id for r in sinks.read_courses(spark, name).collect())

    assert run("one") == list(range(7))
    assert run("two") == list(range(7))  # all batches again
    loads = {r["_load"] for r in spark.table(name).select("_load").distinct().collect()}
    assert loads == {f"{PROVIDER_B.name}-{n}" for n in range(3)}
    # a load of the same name takes the place of its own rows only
    some = sinks.read_courses(spark, name)
    one = spark.createDataFrame(some.take(1), some.schema)
    sinks.put_load(one.filter("id < 0"), name, f"{PROVIDER_B.name}-0")
    left = sinks.read_courses(spark, name).count()
    assert 0 < left < 7
    # a session that doesn't know the table finds its files
    kept = sinks.read_courses(spark, name).columns
    spark.sql(f"DROP TABLE {name}")
    sinks.put_load(one.selectExpr("99 AS id", "'it''s' AS title", *kept[2:]), name, "by hand's", f"{folder}/out/courses")
    again = sinks.read_courses(spark, name)
    assert again.columns == kept and again.count() == left + 1
    with pytest.raises(Exception, match="title is NULL"):
        sinks.put_load(one.selectExpr("1 AS id", "cast(NULL AS string) AS title", *kept[2:]), name, "x")


@pytest.mark.parametrize("files", [1, 3])
def test_table_streams_of_a_file_and_of_a_folder(spark, folder, files):
    rows = spark.range(10)
    if files == 1:
        Path(folder).mkdir(parents=True)
        rows.toPandas().to_parquet(f"{folder}/events.parquet")
    else:
        rows.repartition(files).write.parquet(f"{folder}/events.parquet")
    spark.range(5).write.parquet(f"{folder}/late_events.parquet")
    got = registry._run(spark, registry._table_stream(spark, folder, "events"), "stream-table")
    assert sorted(r.id for r in got.collect()) == list(range(10))


def short_model():
    def too_long(model_name, device):  # here, as workers don't have the tests
        def model(texts):
            for text in texts:
                if len(text) > 20:
                    raise ValueError(f"{len(text)} characters are too many")
            return np.array([[len(t)] for t in texts], dtype=np.float32).reshape(-1, 1)

        return model

    return corpus.ModelEmbedder(too_long, "m")


@pytest.mark.parametrize("bad, other", [(150, []), (0, []), (3, ["job 200"])])
def test_many_raising_texts_are_named_by_the_model(spark, folder, bad, other):
    """More raising rows than halving may find, in a few jobs; what raises for another reason is halved."""
    rows = [("resume_pdf", body(content=b"x" * (30 if n < bad else 5), job=f"job {n}")) for n in range(400)]
    messages(spark, *rows).repartition(3).write.json(f"{folder}/in")
    model = short_model()

    def answer(batch):
        return raising_answer(other)(model.embed(batch, "resume").filter("embedding[0] > 0"))

    jobs.recommend_stream(
        jobs.request_stream(spark, f"{folder}/in"), answer, "op@x", f"{folder}/out", f"{folder}/checkpoint",
        suspects=lambda batch: model.raising(batch, "resume"),
    ).awaitTermination()
    dead = {r.message_id: r.message for r in spark.read.parquet(f"{folder}/out/dead").collect()}
    assert set(dead) == {str(n) for n in range(bad)} | {j.split()[1] for j in other}
    assert all(dead[str(n)] == ERROR_PREFIX + "30 characters are too many" for n in range(bad))
    answers = spark.read.parquet(f"{folder}/out/answers")
    assert sorted(int(r.request_id) for r in answers.collect()) == [n for n in range(400) if str(n) not in dead]


def test_the_model_names_an_outage(spark, folder):
    messages(spark, *[("resume_pdf", body(content=b"x" * 30)) for n in range(8)]).write.json(f"{folder}/in")
    model = short_model()
    stream = jobs.recommend_stream(
        jobs.request_stream(spark, f"{folder}/in"), lambda b: raising_answer([])(model.embed(b, "resume").filter("embedding[0] > 0")),
        "op@x", f"{folder}/out", f"{folder}/checkpoint", most_raising=3, suspects=lambda b: model.raising(b, "resume"),
    )
    with pytest.raises(Exception, match="messages of a batch raise"):
        stream.awaitTermination()


@pytest.fixture
def no_small_tables(spark):
    """Nothing is broadcast for its size alone, as where tables are large."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def test_batches_are_not_held_in_memory(spark, folder, plan_of):
    messages(spark, *[("resume_pdf", body(job=f"job {n}")) for n in range(8)], ("resume_pdf", "{")).write.json(f"{folder}/in")
    plans = []

    def answer(batch):
        plans.append(plan_of(batch))
        return raising_answer([])(batch)

    jobs.recommend_stream(
        jobs.request_stream(spark, f"{folder}/in"), answer, "op@x", f"{folder}/out", f"{folder}/checkpoint"
    ).awaitTermination()
    assert plans and not any("InMemoryTableScan" in plan for plan in plans)
    assert spark.read.parquet(f"{folder}/out/answers").count() == 8
    assert spark.read.parquet(f"{folder}/out/dead").count() == 1


def test_bodies_stay_where_they_lie(spark, no_small_tables, plan_of):
    """Only ids are shuffled to see what has no answer; missing ids are like each other, and ids may come twice."""
    ids = [None, "a", "a", "b", "b", "c"]
    usable = spark.createDataFrame([(i, f"body {n}") for n, i in enumerate(ids)], "message_id string, body string")
    for got, want in ((["a"], [0, 3, 4, 5]), ([None, "b"], [1, 2, 5]), ([], range(6)), ([None, "a", "b", "c"], [])):
        found = jobs._unanswered(usable, spark.createDataFrame([(g,) for g in got], "request_id string"))
        assert "Exchange hashpartitioning" not in plan_of(found) and "SortMergeJoin" not in plan_of(found)
        assert sorted(r.body for r in found.collect()) == [f"body {n}" for n in want]
        assert found.columns == usable.columns


def test_raising_rows_are_told_apart_where_they_lie(spark, no_small_tables, plan_of):
    batch = spark.range(200).selectExpr("id", "repeat('x', cast(id as int)) AS text").repartition(5)
    tried = []

    def work(rows):
        tried.append(plan_of(rows))
        rows.select(F.when(F.col("id") >= 190, F.raise_error(F.lit("no"))).otherwise(F.col("id"))).collect()

    fine, raising = poison.isolate(
        batch, work, lambda: None, suspects=lambda rows: rows.filter("id >= 190").withColumn("error", F.lit("long"))
    )
    assert sorted(r.id for r in fine.collect()) == list(range(190))
    assert sorted((r.id, r.text, r.error) for r in raising.collect()) == [(n, "x" * n, "long") for n in range(190, 200)]
    for plan in (tried[-1], plan_of(fine), plan_of(raising)):
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
