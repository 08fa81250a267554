import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skillbridge.functions.text import ERROR_PREFIX
from skillbridge.plans import inputs
from skillbridge.plans.outbound import answer_landed
from skillbridge.plans.recommend import index_courses
from skillbridge.plans.registry import QUERIES
from skillbridge.sources import requests

REPO = str(Path(__file__).resolve().parent.parent)


@pytest.mark.parametrize("missing", ["tiktoken", "public_tokenizers", "zstandard"])
def test_entry_point_without_a_library_of_the_text_operators(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) == len(QUERIES)


def test_entry_point_does_not_hide_errors_of_its_own_package():
    code = "import sys; sys.modules['skillbridge.operators.knn'] = None; import __spark_entry__"
    done = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert done.returncode != 0 and "knn" in done.stderr


def test_keys_with_gaps_are_refused(spark):
    rows = spark.range(10).withColumnRenamed("id", "k")
    assert inputs.dense_count(rows, "k") == 10 and inputs.dense_count(rows.filter("k < 0"), "k") == 0
    for bad in (rows.filter("k <> 4"), rows.filter("k > 0"), rows.union(rows.filter("k = 3"))):
        with pytest.raises(ValueError, match="without gaps"):
            inputs.dense_count(bad, "k")


class Fussy(inputs.LetterEmbedder):
    def embed(self, df, text):
        bad = F.raise_error(F.lit("no vector for this")).cast("string")
        return super().embed(df.withColumn(text, F.when(F.col(text).contains("#!"), bad).otherwise(F.col(text))), text)


def test_batch_from_queue_to_outbound(spark, folder):
    courses = spark.createDataFrame([(i, f"course {w}", " recommend") for i, w in enumerate("abcd")], "id int, title string, headline string")
    index = index_courses(courses, inputs.LetterEmbedder()).cache()
    uploads = spark.createDataFrame(
        [(k, f"u{k}@x", b"resume" if k != 3 else b"#! resume", "job") for k in range(9)],
        "id int, email string, pdf_resume binary, job_description string",
    )
    landed = requests.encode_requests(uploads).union(
        spark.createDataFrame([("50", "resume_pdf", "{"), ("51", "other", "{")], "message_id string, routing_key string, body string")
    )
    requests.write_requests(landed, f"{folder}/in")
    sent = answer_landed(spark, f"{folder}/in", index, "op@x", f"{folder}/out", embedder=Fussy(), titles=True).collect()
    assert sorted(r.address for r in sent) == ["op@x"] * 2 + [f"u{k}@x" for k in range(9) if k != 3]
    letters = sorted(r.message for r in sent if r.address == "op@x")
    assert letters[1] == ERROR_PREFIX + "body is not JSON" and "no vector for this" in letters[0]
    assert all(r.message.startswith("course ") and len(r.message.split("\n")) == 3 for r in sent if r.subject == "Courses")
