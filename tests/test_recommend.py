import numpy as np
from pyspark.sql import functions as F

from skillbridge.functions.text import PROMPT_TEMPLATE, STANDING_QUESTION, fill_template
from skillbridge.operators import context
from skillbridge.operators.corpus import embed, split_text
from skillbridge.plans.recommend import index_courses, nearest_courses, recommend

TEXTS = ["recommend exact courses", "Based on $1 \\0 {context}", "resume interests", "cooking", "job description"]


def courses(spark):
    rows = [(i, t, " for all") for i, t in enumerate(TEXTS)] + [(9, "no headline", None)]
    return spark.createDataFrame(rows, "id int, title string, headline string")


def requests(spark, n=6):
    """Request ``n`` says its own number; every second one asks nearly the question itself."""
    rows = [
        (str(i), f"user{i}@x", f"resume of number{i}. " * 20,
         f"{STANDING_QUESTION} number{i}" if i % 2 else f"job of number{i}")
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "request_id string, email string, resume string, job_desc string")


def test_context_and_sources(spark):
    rows = [(1, 2, "b", 20), (1, 1, "a", 30), (1, 3, "c", 10), (2, 1, "x$1\\", 5)]
    hits = spark.createDataFrame(rows, "qid int, rk int, text string, vec_id int").repartition(4)
    assert sorted(context.stuff_context(hits).collect()) == [(1, "a\n\nb\n\nc"), (2, "x$1\\")]
    assert sorted(context.source_docs(hits).collect()) == [(1, [30, 20, 10]), (2, [5])]
    both = context.answer_inputs(hits).collect()
    assert sorted(both) == [(1, "a\n\nb\n\nc", [30, 20, 10]), (2, "x$1\\", [5])]


def test_prompt_takes_values_literally(spark):
    value = "$1 \\0 {question} {context} %s"
    df = spark.createDataFrame([(1, value)], "qid int, context string")
    got = context.build_prompts(df, "why {context}?").first().prompt
    before, after = PROMPT_TEMPLATE.split("{context}")
    assert got == before + value + after.replace("{question}", "why {context}?")
    filled = df.select(fill_template("{context}-{context}", context=F.col("context")).alias("t"))
    assert filled.first().t == f"{value}-{value}"


def test_recommend_against_brute_force(spark):
    index = index_courses(courses(spark)).cache()
    asked = requests(spark)
    answers = {r.request_id: r for r in recommend(asked, index).collect()}
    assert set(answers) == {r.request_id for r in asked.collect()}

    def vector(texts):
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        return {r.t: np.array(r.embedding, float) for r in embed(df, "t").collect()}

    question = vector([STANDING_QUESTION])[STANDING_QUESTION]
    shared = {t + " for all": None for t in TEXTS}
    measured = {t: np.square(v - question).sum() for t, v in vector(shared).items()}
    top = sorted(measured, key=measured.get)[:3]
    for r in asked.collect():
        own = {t for text in (r.resume, r.job_desc) for t in split_text(text)}
        mine = {**measured, **{t: np.square(v - question).sum() for t, v in vector(own).items()}}
        got = answers[r.request_id]
        best = sorted(mine.values())[:3]
        assert np.allclose([mine[t] for t in got.context.split("\n\n")], best)
        assert got.message == "\n".join(top)
        assert got.address == r.email and got.subject == "Courses"
        assert got.context in got.prompt and STANDING_QUESTION in got.prompt
        assert len(got.sources) == 3


def test_nobody_sees_the_text_of_others(spark):
    index = index_courses(courses(spark)).cache()
    rows = recommend(requests(spark, 20), index).collect()
    seen = [r for r in rows if f"number{r.request_id}" in r.context]
    assert seen
    for r in rows:
        others = [i for i in range(20) if str(i) != r.request_id]
        words = set(r.context.replace(".", " ").split())
        assert not any(f"number{i}" in words for i in others)


def test_private_rows_of_an_index_are_not_recommended(spark):
    index = index_courses(courses(spark))
    mine = index.limit(1).withColumns(
        {"owner": F.lit("1"), "chunk": F.lit("secret"), "chunk_id": F.lit("p"), "kind": F.lit("resume")}
    )
    rows = recommend(requests(spark), index.unionByName(mine).cache()).collect()
    assert not any("secret" in r.context + r.message for r in rows)


def test_requests_without_text_are_answered_from_courses(spark):
    index = index_courses(courses(spark)).cache()
    df = spark.createDataFrame(
        [("1", "u@x", None, "..."), ("2", "u@x", "", "")],
        "request_id string, email string, resume string, job_desc string",
    )
    nearest = nearest_courses(index)
    for r in recommend(df, index, nearest=nearest).collect():
        assert r.context == "\n\n".join(h["chunk"] for h in nearest[1])


def test_course_without_headline_is_not_indexed(spark):
    assert index_courses(courses(spark)).filter(F.col("chunk").contains("no headline")).count() == 0


def test_requests_that_share_an_id_see_their_own_text_only(spark):
    index = index_courses(courses(spark)).cache()
    rows = [(i, f"u{n}@x", f"{STANDING_QUESTION} secret{n}", "job") for n, i in enumerate(["1", "1", "1", None, None])]
    asked = spark.createDataFrame(rows, "request_id string, email string, resume string, job_desc string")
    for answers in (recommend(asked, index), recommend(asked, index, query="resume")):
        got = answers.collect()
        assert sorted(r.address for r in got) == [f"u{n}@x" for n in range(5)]
        for r in got:
            mine = "secret" + r.address[1]
            assert mine in r.context
            assert not any(f"secret{n}" in r.context + r.message for n in range(5) if f"secret{n}" != mine)


def test_courses_loaded_twice_are_found_once(spark):
    twice = courses(spark).union(courses(spark))
    index = index_courses(twice)
    assert index.count() == index.select("chunk_id").distinct().count() == index_courses(courses(spark)).count()
    _, found = nearest_courses(index.cache())
    assert len({c["chunk_id"] for c in found}) == 3


def test_every_request_may_ask_its_own_question(spark):
    index = index_courses(courses(spark)).cache()
    rows = [("1", "a@x", "resume", "cooking"), ("2", "b@x", "resume", "recommend exact courses"),
            ("3", "c@x", "resume", "..."), ("4", "d@x", "resume", None), ("2", "b@x", "resume", "recommend exact courses")]
    asked = spark.createDataFrame(rows, "request_id string, email string, resume string, job_desc string")
    got = recommend(asked, index, query="job_desc").collect()
    first = {r.request_id: r.message.split("\n")[0] for r in got}
    assert len(got) == 5 and first == {"1": "cooking for all", "2": "recommend exact courses for all", "3": "", "4": ""}
    for r in got:
        if r.request_id in "12":
            question = "cooking" if r.request_id == "1" else "recommend exact courses"
            assert f"Question: {question}" in r.prompt and r.context in r.prompt and len(r.sources) == 3


def test_requests_without_id_and_sender_share_nothing(spark):
    index = index_courses(courses(spark)).cache()
    rows = [(None, None, f"{STANDING_QUESTION} secret{n}", "cooking") for n in range(3)]
    asked = spark.createDataFrame(rows, "request_id string, email string, resume string, job_desc string")
    for answers in (recommend(asked, index), recommend(asked, index, query="resume")):
        seen = [{n for n in range(3) if f"secret{n}" in r.context} for r in answers.collect()]
        assert sorted(map(sorted, seen)) == [[0], [1], [2]]


def test_messages_list_titles(spark):
    index = index_courses(courses(spark)).cache()
    plain = recommend(requests(spark), index).first().message.split("\n")
    titles = recommend(requests(spark), index, titles=True).first().message.split("\n")
    assert [t + " for all" for t in titles] == plain
    each = recommend(requests(spark), index, query="job_desc", titles=True).collect()
    assert all(set(r.message.split("\n")) <= set(TEXTS) for r in each)
    # an index without metadata has no titles
    assert recommend(requests(spark), index.drop("meta"), titles=True).first().message == ""


def test_requests_are_read_once_and_their_texts_are_not_sorted(spark, plan_of):
    """A task would hold the whole texts of its part to sort them, and parse them again to answer."""
    index = index_courses(spark.createDataFrame([(1, "spark course", "learn")], "id int, title string, headline string"))
    row = ("1", "a@b", "a resume about spark", "a job")
    asked = [row, row, ("1", "c@d", None, "another job")]  # copies, and another request under their id
    asked = spark.createDataFrame(asked, "request_id string, email string, resume string, job_desc string")
    answers = recommend(asked, index)
    plan = plan_of(answers)
    assert "LocalTableScan" not in plan and "ExistingRDD" not in plan and "SortAggregate" not in plan
    for found in (answers, recommend(asked, index, query="job_desc")):
        first, second, other = sorted((r.address, r.sources, r.context) for r in found.collect())
        assert first == second and first[1].count("resume-1#000000000") == 1 and "a resume about spark" in first[2]
        assert other[0] == "c@d" and not any(s.startswith("resume") for s in other[1]) and "another job" in other[2]
