import json

import pytest
from pyspark.sql import functions as F

from skillbridge.functions import text as X
from skillbridge.plans.ingest import all_courses, ingest
from skillbridge.schemas import COURSES
from skillbridge.sources import listings, sinks
from skillbridge.sources.listings import PROVIDER_A, PROVIDER_B, SourceSpec


def pages(spark, *bodies):
    return spark.createDataFrame(list(enumerate(bodies, 1)), "page bigint, body string")


def page_b(*items):
    return json.dumps({"results": list(items)})


def courses_b(spark, *items):
    valid, rejects = ingest(pages(spark, page_b(*items)), PROVIDER_B)
    return valid.collect(), rejects.collect()


def test_missing_keys_are_null_and_unknown_keys_dropped(spark):
    (row,), rejects = courses_b(spark, {"name": "x", "colour": "red"})
    assert row.asDict() == {**dict.fromkeys(COURSES.names), "title": "x"}
    assert rejects == []


def test_numbers_as_text_and_text_as_numbers(spark):
    items = [
        {"name": "ok", "id": "12", "rating": "4.60", "students": 7, "price": 0, "lectures": 3.5},
        {"name": "no", "id": 4.6},
        {"name": "no", "rating": "good"},
        {"name": "no", "rating": "1.5f"},
        {"name": "ok", "rating": "1e3"},
    ]
    valid, rejects = courses_b(spark, *items)
    assert [(r.id, r.rating, r.enrolled, r.price, r.duration) for r in valid] == [
        (12, 4.6, 7, "0", "3.5"),
        (None, 1000.0, None, None, None),
    ]
    assert sorted(r.errors[0] for r in rejects) == ["id_cast", "rating_cast", "rating_cast"]
    assert {json.loads(r.raw).get("id") for r in rejects} == {4.6, None}


def test_lengths(spark):
    items = [
        {"name": "t" * 255},
        {"name": "t" * 256},
        {"name": "t" * 255 + "   "},
        {"name": "x", "price": "p" * 21, "category": "c" * 51, "lectures": "d" * 11},
        {"short_description": "no title"},
    ]
    valid, rejects = courses_b(spark, *items)
    assert [len(r.title) for r in valid] == [255, 255]
    assert sorted(r.errors for r in rejects) == [
        ["duration_length", "section_length", "price_length"],
        ["title_length"],
        ["title_null"],
    ]


def test_bad_pages_are_rejected_and_the_others_kept(spark):
    df = pages(spark, "not json", "{}", '{"results": {}}', '{"results": []}', None, page_b({"name": "a"}))
    valid, rejects = ingest(df, PROVIDER_B)
    assert [r.title for r in valid.collect()] == ["a"]
    bad = rejects.collect()
    assert sorted(r._page for r in bad) == [1, 2, 3, 5]
    assert {tuple(r.errors) for r in bad} == {("bad_envelope",)}
    assert {r.raw for r in bad if r._page == 1} == {"not json"}


def test_a_bad_item_spoils_no_other(spark, plan_of):
    bad = [5, "text", [1], True]
    valid, rejects = courses_b(spark, {"name": "a"}, *bad, {"name": "b", "id": {"x": 1}, "extra": 1}, {"name": "c"})
    assert sorted(r.title for r in valid) == ["a", "c"]
    assert sorted((r.raw, r.errors[0]) for r in rejects) == [
        ("5", "bad_item"), ("[1]", "bad_item"), ("text", "bad_item"), ("true", "bad_item"),
        ('{"name":"b","id":{"x":1},"extra":1}', "id_cast"),
    ]


def test_pages_are_read_and_parsed_once(spark, folder, plan_of):
    listings.write_pages(pages(spark, page_b({"name": "a"}, {"id": 1})), folder)
    for df in ingest(listings.read_pages(spark, folder), PROVIDER_B):
        plan = plan_of(df)
        assert plan.count("FileScan") == 1
        # once for the page's envelope, once for an item
        assert plan.count("from_json(") + plan.count("jsontostructs(") == 2


def test_null_item_is_a_reject(spark):
    valid, rejects = courses_b(spark, None, {"name": "a"})
    assert len(valid) == 1 and rejects[0].errors == ["title_null"]


def test_nested_envelope_and_new_provider(spark):
    body = json.dumps({"data": {"courseData": [{"productId": 1, "title": "a", "avgRating": 4}]}})
    (row,) = ingest(pages(spark, body), PROVIDER_A)[0].collect()
    assert (row.id, row.title, row.rating) == (1, "a", 4.0)
    other = SourceSpec("c", ("x", "y", "z"), {"k": "id", "t": "title"})
    body = json.dumps({"x": {"y": {"z": [{"k": 2, "t": "b"}]}}})
    (row,) = ingest(pages(spark, body), other)[0].collect()
    assert (row.id, row.title, row.price) == (2, "b", None)


def test_union_is_a_bag(spark):
    one = ingest(pages(spark, page_b({"id": 1, "name": "a"})), PROVIDER_B)[0]
    assert all_courses(one, one, one).count() == 3


def test_one_file_per_page(spark, tmp_path):
    for n in (1, 2, 10):
        (tmp_path / f"provider2-page-{n}.json").write_text(page_b({"id": n, "name": "a"}))
    df = listings.read_pages(spark, str(tmp_path), layout="files")
    assert sorted(r.page for r in df.collect()) == [1, 2, 10]
    assert sorted(r.id for r in ingest(df, PROVIDER_B)[0].collect()) == [1, 2, 10]
    gaps = listings.page_gaps(df, 1, 11)
    assert sorted(r.page for r in gaps.collect()) == [3, 4, 5, 6, 7, 8, 9, 11]


def test_course_text_reads_two_columns(spark, folder, plan_of):
    valid, _ = ingest(pages(spark, page_b({"name": "a", "short_description": "b"}, {"name": "c"})), PROVIDER_B)
    sinks.append_rows(valid, folder)
    df = listings.scan_course_text(spark, folder)
    assert "ReadSchema: struct<title:string,headline:string>" in plan_of(df)
    texts = df.select(X.course_text(F.col("title"), F.col("headline")).alias("t"))
    assert sorted(r.t or "" for r in texts.collect()) == ["", "ab"]


def test_append_creates_once_and_keeps_duplicates(spark, folder):
    valid, _ = ingest(pages(spark, page_b({"id": 1, "name": "a"})), PROVIDER_B)
    name = "courses_" + folder[-8:]
    sinks.append_courses(valid, name, folder)
    sinks.append_courses(valid, name, folder)
    assert spark.table(name).count() == 2
    assert spark.table(name).columns == COURSES.names


def test_append_goes_by_name_and_keeps_the_constraints(spark, folder):
    name, path = "courses_" + folder[-8:], folder + "'s"
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reversed(COURSES.fields))
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet")
    valid, _ = ingest(pages(spark, page_b({"id": 1, "name": "a", "price": "5", "rating": 2})), PROVIDER_B)
    sinks.append_courses(valid, name)
    (row,) = spark.table(name).collect()
    assert (row.id, row.title, row.price, row.rating) == (1, "a", "5", 2.0)
    for title in ("t" * 256, None):
        with pytest.raises(Exception, match="(?i)exceed|NULL"):
            sinks.append_courses(valid.withColumn("title", F.lit(title).cast("string")), name + "_new", path)
    sinks.append_courses(valid, name + "_new")
    assert spark.table(name + "_new").count() == 1


@pytest.mark.parametrize("value", ["a\n ", "\t a\r\n", " a　", "a"])
def test_strip_space(spark, value):
    df = spark.createDataFrame([(value,)], "v string").select(X.strip_space(F.col("v")).alias("v"))
    assert df.first().v == value.strip()
