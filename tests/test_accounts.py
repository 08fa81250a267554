import pytest
from pyspark.sql import functions as F

from skillbridge.operators import accounts, keys, quality
from skillbridge.sources import sinks


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_account_rules(spark):
    rows = [("a@b", "Abc!"), ("ab", "Abc!"), ("a@b", "abc!"), ("a@b", "ABC"), ("a@b", "éabc"), ("a@b", "Éa")]
    checked = quality.check(frame(spark, rows, "email string, password string"), quality.account_rules())
    got = {(r.email, r.password): r.errors for r in checked.collect()}
    assert got[("a@b", "Abc!")] == []
    assert got[("ab", "Abc!")] == ["email_format"]
    assert got[("a@b", "abc!")] == ["password_uppercase"]
    assert got[("a@b", "ABC")] == []  # the range in the class holds capitals
    assert got[("a@b", "éabc")] == ["password_uppercase", "password_special"]
    assert got[("a@b", "Éa")] == ["password_special"]


def test_reset_is_checked_and_applied_to_known_users(spark):
    rows = [("a", "Ab!", "Ab!", 1), ("a", "Cd!", "Cd!", 2), ("a", "Ef!", "other", 3), ("a", "Gh!", None, 4),
            ("a", "weak", "weak", 5), ("z", "Ij!", "Ij!", 6)]
    asked = frame(spark, rows, "email string, new_password string, confirm_password string, seq int")
    ok, bad = quality.split_valid(asked, quality.reset_rules())
    assert {r.seq: r.errors for r in bad.collect()} == {
        3: ["password_mismatch"], 4: ["password_mismatch"], 5: ["password_uppercase", "password_special"]
    }
    users = frame(spark, [("a", "old"), ("b", "old")], "email string, password string")
    changes = ok.withColumnRenamed("new_password", "password")
    updated = accounts.upsert(users, changes, "email", "seq", insert_missing=False)
    assert sorted(updated.collect()) == [("a", "Cd!"), ("b", "old")]


def test_special_class_is_the_fixed_one(spark):
    import re

    chars = [chr(c) for c in range(32, 127)]
    df = frame(spark, [(c,) for c in chars], "c string")
    got = {r.c for r in df.filter(F.col("c").rlike(quality.SPECIAL_CHARACTER)).collect()}
    assert got == {c for c in chars if re.search(quality.SPECIAL_CHARACTER, c)}


def test_upload_rules(spark):
    rows = [(1, b"x", "application/pdf"), (2, b"x", None), (3, b"x", "text/plain"), (4, None, "application/pdf"),
            (5, b"", "application/pdf; v=1")]
    ok, bad = quality.split_valid(
        frame(spark, rows, "id int, pdf_resume binary, content_type string"), quality.upload_rules()
    )
    assert [r.id for r in ok.collect()] == [1]
    assert {r.id: r.errors for r in bad.collect()} == {
        2: ["not_pdf"], 3: ["not_pdf"], 4: ["no_file"], 5: ["no_file"]
    }


def test_lookup(spark):
    users = frame(spark, [(1, "a", "p"), (2, "b", "q"), (3, "b", "r")], "id int, email string, password string")
    keys = frame(spark, [("a",), ("a",), ("z",), (None,)], "email string")
    assert accounts.lookup(users, keys, unique=True).collect() == [(1, "a", "p")]
    assert accounts.lookup(users, keys, columns=["password"]).collect() == [("p",)]
    with pytest.raises(Exception, match="several rows"):
        accounts.lookup(users, frame(spark, [("b",)], "email string"), unique=True).collect()


def test_foreign_key(spark):
    uploads = frame(spark, [(1, "a"), (2, "b"), (3, None)], "id int, email string")
    users = frame(spark, [("a",), ("a",), (None,)], "email string")
    ok, orphan = accounts.fk_split(uploads, users)
    assert [r.id for r in ok.collect()] == [1]
    assert sorted(r.id for r in orphan.collect()) == [2, 3]
    assert [r.id for r in accounts.user_uploads(uploads, users).collect()] == [1]


def test_key_joins_with_hot_keys_on_both_sides(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 5 == 0, F.lit("warm"))
    rows = spark.range(3000).select("id", key.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("k"))
    wanted = spark.range(900).select(
        F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 11 > 0, F.col("id").cast("string")).alias("k")
    )
    known = {r.k for r in wanted.collect()} - {None}
    every = rows.collect()
    assert sorted(keys.matching(rows, wanted, "k").collect()) == sorted(r for r in every if r.k in known)
    by_id = lambda found: sorted(r.id for r in found)
    assert by_id(keys.missing(rows, wanted, "k").collect()) == by_id(r for r in every if r.k not in known)


def test_sets_are_broadcast_by_their_size_only(spark, plan_of, folder):
    spark.range(10**5).select(F.col("id").cast("string").alias("k")).write.parquet(f"{folder}/table")
    spark.createDataFrame([("1",)], "k string").write.parquet(f"{folder}/few")
    table, few = spark.read.parquet(f"{folder}/table"), spark.read.parquet(f"{folder}/few")
    assert "BroadcastHashJoin" in plan_of(keys.matching(table, few, "k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        assert "SortMergeJoin" in plan_of(keys.matching(table, table, "k"))
        plan = plan_of(accounts.user_uploads(table, table, few, "k"))
        assert plan.count("FileScan") == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_erase_cascades_and_ignores_unknown_keys(spark, folder):
    users = frame(spark, [("a",), ("b",)], "email string")
    uploads = frame(spark, [(1, "a"), (2, "a"), (3, "b")], "id int, email string")
    uploads = spark.read.parquet(sinks.write_version(uploads, folder, "v1"))
    left, kept, report = accounts.erase(users, uploads, frame(spark, [("a",), ("zz",)], "email string"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_version(kept, folder, "v1")
    written = spark.read.parquet(sinks.write_version(kept, folder, "v2"))
    assert [r.email for r in left.collect()] == ["b"]
    assert [r.id for r in written.collect()] == [3]
    assert report.collect() == [(1, 2)]
    _, kept, report = accounts.erase(users, uploads, frame(spark, [("zz",)], "email string"))
    assert kept.count() == 3 and report.collect() == [(0, 0)]


def test_admit_unique(spark):
    new = frame(spark, [(3, "a"), (1, "b"), (2, "b"), (4, "c"), (5, None), (6, "c")], "id int, email string")
    ok, bad = accounts.admit_unique(new, frame(spark, [("a",), (None,)], "email string"), "email", "id")
    assert sorted(ok.collect()) == [(1, "b"), (4, "c")]
    assert sorted((r.id, r.reason) for r in bad.collect()) == [
        (2, "key_repeated"), (3, "key_taken"), (5, "key_null"), (6, "key_repeated")
    ]


def test_admit_unique_has_one_winner(spark):
    rows = [(1, "a", "x"), (1, "a", "y"), (1, "a", "y"), (2, "b", "x"), (2, "b", "x"), (None, "c", "x"),
            (None, "c", "x"), (None, "d", "x"), (3, "d", "x"), (None, "e", "z"), (7, "t", "x"), (7, "t", "x")]
    new = frame(spark, rows, "id int, email string, password string")
    ok, bad = accounts.admit_unique(new, frame(spark, [("t",)], "email string"), "email", "id")
    admitted, refused = ok.collect(), bad.collect()
    assert sorted(r.email for r in admitted) == ["a", "b", "c", "d", "e"]
    assert {r.id for r in admitted if r.email == "d"} == {3}
    assert len(admitted) + len(refused) == len(rows)
    assert sorted(r.reason for r in refused) == ["key_repeated"] * 6 + ["key_taken"]
    assert {r.reason for r in refused if r.email in "abcde"} == {"key_repeated"}


def test_admit_unique_with_a_hot_key(spark):
    """A third of the batch has one key; it is reduced before the join on the key."""
    new = spark.range(30000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("email")
    )
    ok, bad = accounts.admit_unique(new, spark.createDataFrame([("1",)], "email string"), "email", "id")
    assert ok.count() == 20000 and bad.count() == 10000
    assert ok.filter("email = 'hot'").collect() == [(0, "hot")]


def test_upsert(spark):
    base = frame(spark, [("a", "1", 1), ("b", "1", 1)], "k string, v string, w int")
    changes = frame(
        spark,
        [("a", "2", 2, 10), ("a", None, 3, 30), ("a", "4", 4, 20), ("c", "5", 5, 1)],
        "k string, v string, w int, seq int",
    )
    assert sorted(accounts.upsert(base, changes, "k", "seq").collect()) == [
        ("a", None, 3), ("b", "1", 1), ("c", "5", 5)
    ]
    updated = accounts.upsert(base, changes, "k", "seq", insert_missing=False)
    assert sorted(r.k for r in updated.collect()) == ["a", "b"]


def test_ids_and_pages(spark):
    ids = [r.id for r in accounts.assign_ids(spark.range(0, 1000, 1, 7).toDF("x"), 50).collect()]
    assert len(set(ids)) == 1000 and min(ids) > 50
    df = spark.range(0, 100, 1, 7)
    assert accounts.page_rows(df).count() == 100
    assert [r.id for r in accounts.page_rows(df, skip=20, limit=3).collect()] == [20, 21, 22]
    assert accounts.page_rows(df, skip=95).count() == 5
