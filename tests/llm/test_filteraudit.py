import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F
from rows import DOCS

from skillbridge.llm import filteraudit as audit

LABELS = "doc_id long, quality int, toxic int"


def test_merges_of_sorted_lists():
    rng = random.Random(2)
    for _ in range(300):
        a, b = (np.array(sorted(rng.sample(range(60), rng.randrange(0, rng.choice([3, 60])))), dtype=np.int64) for _ in "ab")
        assert audit.union(a, b).tolist() == sorted({*a.tolist()} | {*b.tolist()})
        assert audit.minus(a, b).tolist() == sorted({*a.tolist()} - {*b.tolist()})
    lists = [np.array(x, dtype=np.int64) for x in ([1, 5], [], [2, 5, 9], [0])]
    for members, got in enumerate(audit.unions(lists)):
        assert got.tolist() == sorted({n for k, x in enumerate(lists) if members >> k & 1 for n in x.tolist()})


def fails(row, rows):
    text = row[1] or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = {"A"} if len(words) < 200 else set()
    out |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
    out |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text) else set()
    out |= {"D"} if re.search(r"[#$%&*|]", text) else set()
    out |= {"E"} if row[0] is not None and any((t or "") == text and i is not None and i < row[0] for i, t, _ in rows) else set()
    return out


def brute(rows, labels):
    """By removing documents step by step."""
    out = []
    for part in {lang or "" for _, _, lang in rows}:
        mine = [(r[0], fails(r, rows)) for r in rows if (r[2] or "") == part]
        good, toxic = ({i for i, *m in labels if m[k] == 1 and i is not None} for k in (0, 1))
        made = []
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                redundant = sum(f in x[1] for x in mine) - len(gone)
                only = sum(x[1] == {f} for x in mine)
                lost = [sum(i in m for i, _ in gone) for m in (good, toxic)]
                made.append((part, "".join(order), step, len(left), len(gone), redundant, only, *lost))
        total = {f: sum(m[4] for m in made if m[1][m[2] - 1] == f) for f in "ABCDE"}
        out += [(*m, total[m[1][m[2] - 1]]) for m in made]
    return sorted(out)


NAMES = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def check(spark, rows, labels, **kw):
    docs = spark.createDataFrame([(i, t, lang, "s", None) for i, t, lang in rows], DOCS).repartition(4)
    for name in ("words", "same", "number", "salt", "first", "part", "A", "E", "good"):
        docs = docs.withColumn(name, F.lit("x"))
    got = audit.audit_documents(docs, spark.createDataFrame(labels, LABELS).withColumn("first", F.lit(1)), **kw)
    assert got.columns == NAMES
    assert sorted(map(tuple, got.collect())) == brute(rows, labels)


def texts(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(90):
        words = [rng.choice(["a", "A", "Bb", "é", "ÄÖ", "x1"]) + str(rng.randrange(rng.choice([5, 400]))) for _ in range(rng.choice([0, 3, 199, 200, 260]))]
        out.append(rng.choice([" ", "\n", "\x0b\t", "\x0c "]).join(words) + rng.choice(["", "", " #", " *", " \x85", " $", "\r"]))
    return out


def test_as_by_brute_force(spark):
    every = texts(3)
    rng = random.Random(4)
    rows = [(k, rng.choice(every), rng.choice(["en", "en", "de", "", None])) for k in range(200)]
    rows += [(k, "same text", "en") for k in range(1000, 1120)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 1100, 2)]
    check(spark, rows, labels, size=16)


def test_odd_rows(spark):
    rows = [(None, None, None), (None, "", "en"), (5, "", "en"), (5, "", "en"), (5, None, "fr"), (4, "one", "en"), (6, "one", "fr")]
    rows += [(9, "Word " * 70_000, "fr"), (10, "WORD " * 200, "fr"), (11, " ".join(map(str, range(300))), "de")]
    check(spark, rows, [(5, 0, 1), (5, 1, 0), (6, None, None), (None, 1, 1), (77, 1, 1), (11, 1, 0)])
    check(spark, rows, [])


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert audit.audit_documents(docs, spark.createDataFrame([(1, 1, 1)], LABELS)).count() == 0


def test_other_filters(spark):
    """Any flags, parts and ids; lists are sorted, and hold what fails."""
    rows = [(f"p{k % 2}", k, k % 2 == 0, k % 3 == 0, None if k % 5 else True) for k in range(60)]
    table = spark.createDataFrame(rows, "grp string, key int, X boolean, Y boolean, mark boolean")
    lists = audit.posting_lists(table, ["X", "Y"], ["mark"], "grp", "key", size=7)
    got = lists.collect()
    assert sum(r.docs for r in got) == 60 and all(x == sorted(x) for r in got for x in [*r.fails, *r.marked])
    assert [sum(len(r.fails[k]) for r in got) for k in (0, 1)] == [30, 20] and sum(len(r.marked[0]) for r in got) == 12
    out = {(r.part, r.filter_order, r.step): r for r in audit.audit(lists, ["X", "Y"], ["mark"]).collect()}
    first, second = out["p0", "XY", 1], out["p0", "XY", 2]
    assert (first.removed, first.kept, second.removed, second.redundant) == (30, 0, 0, 10)
    assert out["p1", "YX", 1].removed == 10 and out["p1", "YX", 1].mark_lost == 2 and out["p0", "YX", 2].shapley == 50
    with pytest.raises(ValueError, match="orders"):
        audit.audit(lists, list("ABCDEFGHI"), [])
