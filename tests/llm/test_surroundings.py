"""What operators must not depend on: names of the user's columns, and packages on executors."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from rows import docs_of

from skillbridge.llm import decontam, jaccard, linededup, sharding, toxicity
from skillbridge.llm.store import unused

NAMES = ["_slot", "_shard", "_doc", "_th", "_mask", "_n", "_p_toxic", "_p_poor", "p_toxic", "__p_x", "doc", "th", "node", "id", "comp", "item"]
ITEM = "nine words that belong to one question of a benchmark and to nothing else here at all"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, f"text {k} of its own " + " ".join(f"w{k}x{j}" for j in range(60))) for k in range(12)]
    rows += [(20, rows[3][1]), (21, ITEM), (21, ITEM), (None, None)]
    table = docs_of(spark, rows)
    for name in NAMES:
        table = table.withColumn(name, F.concat(F.lit(f"own {name} "), F.coalesce("doc_id", F.lit(-1))))
    return table.persist()


def test_unused_names():
    assert unused(["A", "_b"], "a", "b", "_B", "c") == ["_a", "b", "__B", "c"]


def operations(spark):
    labels = spark.createDataFrame([(k, 1, 0) for k in range(8)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    return {
        "place": (lambda d: sharding.place(d, "doc_id", ["a", "b"]), 16),
        "lines": (lambda d: linededup.dedup_lines(d), 16),
        "copies": (lambda d: jaccard.one_of_each(d), 14),
        "contaminated": (lambda d: decontam.remove_contaminated(d, bench), 14),
        "toxic": (lambda d: toxicity.remove_toxic(d, labels), 16),
    }


@pytest.mark.parametrize("name", ["place", "lines", "copies", "contaminated", "toxic"])
def test_columns_of_the_user_stay(spark, docs, name):
    work, left = operations(spark)[name]
    out = work(docs)
    assert [c for c in out.columns if c in docs.columns] == docs.columns
    rows = out.collect()
    assert len(rows) == left
    assert all(r[n] == f"own {n} {-1 if r.doc_id is None else r.doc_id}" for r in rows for n in NAMES)


SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from skillbridge.session import local_session
from skillbridge.llm import langid, toxicity
from pyspark.sql import functions as F
spark = local_session("2")
def missing(_):
    try:
        import skillbridge
    except ImportError:
        return 1
    return 0
assert spark.sparkContext.parallelize([1]).map(missing).collect() == [1]
docs = spark.createDataFrame([(k, "nice words " * 9 if k % 3 else "vile slur " * 9, "en" if k % 3 else "de") for k in range(120)], "doc_id long, text string, lang string")
labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
assert langid.predict(docs, langid.fit(docs)).filter("lang_pred = 'de'").count() == 40
assert toxicity.remove_toxic(docs, labels).count() == 80
print("fine")
"""


def test_executors_need_not_have_the_package(tmp_path):
    repo = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]
