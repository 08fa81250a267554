import math

import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillbridge.operators import corpus
from skillbridge.plans import registry
from skillbridge.sources import sinks


def split_by_lists(text, separators=("\n\n", "\n", " ", ""), size=256, overlap=64):
    """The same rules on lists of strings, with none of the offsets of the real one."""
    sep = next(s for s in separators if not s or s in text)
    finer = separators[separators.index(sep) + 1 :]
    if sep:
        head, *tail = text.split(sep)
        pieces = [p for p in [head, *[sep + t for t in tail]] if p]
    else:
        pieces = list(text)
    out, group = [], []

    def close():
        window = []
        for piece in group:
            if window and len("".join(window)) + len(piece) > size:
                out.append("".join(window))
                while window and (
                    len("".join(window)) > overlap or len("".join(window)) + len(piece) > size
                ):
                    window.pop(0)
            window.append(piece)
        if window:
            out.append("".join(window))
        group.clear()

    for piece in pieces:
        if len(piece) < size or not finer:
            group.append(piece)
        else:
            close()
            out.extend(split_by_lists(piece, finer, size, overlap))
    close()
    return out


TEXTS = st.text(alphabet="ab é\n.", max_size=200)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(4, 30), st.integers(0, 3))
def test_chunks_agree_with_lists(text, size, overlap):
    want = [c.strip() for c in split_by_lists(text, size=size, overlap=overlap)] if text else []
    assert corpus.split_text(text, size, overlap) == [c for c in want if c]


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(4, 30), st.integers(0, 3))
def test_chunks_cover_the_text(text, size, overlap):
    # letters made distinct, so that the place of a chunk in the text is certain
    text = "".join(c if c in " \n" else chr(0x4E00 + i) for i, c in enumerate(text))
    end = 0
    for chunk in corpus.split_text(text, size, overlap):
        assert 0 < len(chunk) <= size
        start = text.find(chunk)
        assert start >= end - overlap and not text[end:start].strip()
        end = start + len(chunk)
    assert not text[end:].strip()


def test_chunk_text_on_the_documents(spark):
    rows = registry.chunk_text(spark, SF).collect()
    texts = {r.doc_id: r.text for r in registry._documents(spark, SF).collect()}
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.chunk_idx)):
        got.setdefault(r.doc_id, []).append(r.chunk)
    for doc_id, text in texts.items():
        want = [c.strip() for c in split_by_lists(text)]
        assert got.get(doc_id, []) == [c for c in want if c]


@pytest.mark.parametrize("length", [0, 1, 63, 64, 65, 256, 257, 448, 449, 5000])
def test_chunk_fixed(spark, length):
    text = "".join(chr(97 + i % 26) for i in range(length))
    rows = corpus.chunk_fixed(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert len(rows) == max(1, math.ceil((length - 64) / 192))
    assert [r.chunk for r in rows] == [text[i * 192 : i * 192 + 256] for i in range(len(rows))]


def test_embedding(spark):
    rows = [(1, "One two two"), (2, "one, two; TWO"), (3, "éclair"), (4, "clair"), (5, "..."), (6, None)]
    df = corpus.embed(spark.createDataFrame(rows, "id int, t string"), "t")
    assert df.columns == ["id", "t", "embedding"]
    vectors = {r.id: np.array(r.embedding) for r in df.collect()}
    assert set(vectors) == {1, 2, 3, 4}
    assert all(abs(np.linalg.norm(v) - 1) < 1e-6 for v in vectors.values())
    assert (vectors[1] == vectors[2]).all()
    assert (vectors[3] != vectors[4]).any()


def test_embed_documents_are_unit_vectors(spark):
    rows = registry.embed_hash(spark, SF).collect()
    assert len(rows) == 200
    assert all(abs(np.linalg.norm(r.embedding) - 1) < 1e-6 for r in rows)


def test_own_embedder(spark):
    class Length:
        def embed(self, df, text):
            return df.withColumn("embedding", F.array(F.length(text).cast("float")))

    df = corpus.embed(spark.createDataFrame([("abc",)], "chunk string"), embedder=Length())
    assert df.first().embedding == [3.0]


def test_model_embedder_loads_by_name_and_device(spark):
    def load(name, device):
        scale = {"small/cpu": 1.0, "large/gpu": 10.0}[f"{name}/{device}"]
        return lambda texts: np.array([[len(t) * scale, scale] for t in texts], dtype=np.float32)

    df = spark.createDataFrame([("abc",), ("de",), (None,)], "chunk string")
    small = corpus.embed(df, embedder=corpus.ModelEmbedder(load, "small", batch_size=1))
    assert sorted(r.embedding for r in small.collect()) == [[2.0, 1.0], [3.0, 1.0]]
    large = corpus.embed(df, embedder=corpus.ModelEmbedder(load, "large", "gpu"))
    assert sorted(r.embedding for r in large.collect()) == [[20.0, 10.0], [30.0, 10.0]]


def test_atomic_columns(spark):
    df = spark.range(1).select(
        "id", F.array("id").alias("a"), F.struct("id").alias("s"), F.create_map("id", "id").alias("m"),
        F.lit("x").alias("t"),
    )
    assert corpus.atomic_columns(df).columns == ["id", "t"]


def test_union_of_kinds(spark):
    courses = corpus.course_documents(
        spark.createDataFrame([(1, "a", "b"), (2, "c", None)], "id int, title string, headline string")
    )
    own = corpus.owned_documents(
        spark.createDataFrame([(7, "u", "text")], "id int, email string, t string"),
        "resume", F.col("id"), F.col("email"), F.col("t"),
    ).withColumn("extra", F.lit(1))
    rows = corpus.corpus_docs(courses, own, own.drop("extra")).collect()
    assert sorted((r.doc_id, r.owner, r.kind, r.text, r.extra) for r in rows if r.kind == "course") == [
        ("1", None, "course", "ab", None)
    ]
    assert len(rows) == 3


def test_index_is_stored_by_kind(spark, folder):
    docs = corpus.course_documents(
        spark.createDataFrame([(1, "a", "b")], "id int, title string, headline string")
    )
    written = sinks.write_index(corpus.chunk_fixed(docs), folder, "v1")
    assert written == f"{folder}/v1"
    df = sinks.read_index(spark, written).filter("kind = 'course'")
    assert df.count() == 1 and df.inputFiles()[0].split("/")[-2] == "kind=course"
    assert df.schema["kind"].dataType == T.StringType()


def test_worker_functions_need_no_installed_package(tmp_path):
    import pickle
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "f").write_bytes(cloudpickle.dumps(corpus.split_text))
    code = "import pickle; print(pickle.load(open('f', 'rb'))('a b\\nc', 3, 0))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.stdout.strip() == "['a b', 'c']", done.stderr
    assert pickle.loads(cloudpickle.dumps(corpus.split_text))("a") == ["a"]


def test_metadata_keeps_plain_values_row_by_row(spark):
    rows = [('{"a": 1, "b": [1], "c": {"d": 2}, "e": "x", "f": true, "g": null, "h": 1.5}',), ('{"a": [1], "b": 7}',), ("{}",), (None,)]
    df = spark.createDataFrame(rows, "j string").select(corpus.plain_meta(F.try_parse_json("j")).alias("m"))
    assert [r.m for r in df.collect()] == [{"a": "1", "e": "x", "f": "true", "h": "1.5"}, {"b": "7"}, {}, None]


def test_metadata_goes_from_documents_to_chunks(spark):
    courses = spark.createDataFrame([(1, "title", " headline")], "id int, title string, headline string")
    chunks = corpus.chunk_text(corpus.course_documents(courses)).collect()
    assert [c.meta for c in chunks] == [{"title": "title", "headline": " headline"}]
    owned = corpus.owned_documents(courses, "resume", F.col("id"), F.lit("o"), F.col("title"))
    assert owned.first().meta == {}


def test_short_texts_stay_in_the_jvm(spark, plan_of):
    texts = ["", " ", "a", "\n\n", "  a b\x1c\n", "x" * 256, "x " * 128, "a\n\n" * 85, "y" * 257, "é " * 200, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in corpus.chunk_text(docs).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_idx, r.chunk))
    for i, text in enumerate(texts):
        want = list(enumerate(corpus.split_text(text))) if text is not None else []
        assert sorted(got.get(i, [])) == want
    short = corpus.chunk_text(docs.filter(F.length("text") <= 256))
    # the branch that has a Python node reads no row
    assert short.count() == len([t for t in texts if t is not None and len(t) <= 256 and t.strip()])
    plan = plan_of(corpus.chunk_text(docs))
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Union") == 1


def test_windows_of_a_long_text(spark):
    """Windows come from runs of them; borders of runs and characters of several bytes make no difference."""
    lengths = [0, 1, 256, 257, 32 * 192 + 64, 32 * 192 + 65, 20_000]
    texts = [(n, "".join("aé€😀"[(i * i) % 4] for i in range(n))) for n in lengths]
    got = {}
    for r in corpus.chunk_fixed(spark.createDataFrame(texts, "doc_id int, text string")).collect():
        got.setdefault(r.doc_id, {})[r.chunk_idx] = r.chunk
    for n, text in texts:
        count = max(1, -(-(n - 64) // 192))
        assert got[n] == {k: text[k * 192 : k * 192 + 256] for k in range(count)}


def test_letters_of_texts(spark, monkeypatch):
    from skillbridge.plans import inputs

    monkeypatch.setattr(inputs, "TEXT_BYTES", 10)
    texts = ["abc", "", None, "ÄÖ 12", "zebra zz" * 9, "é{`aé", "A", "q"]
    made = inputs.LetterEmbedder().embed(spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1), "t")
    assert "_counts" not in made.columns
    got = {r.t: r.embedding for r in made.collect()}
    want = {t: [t.count(c) for c in inputs.LetterEmbedder.letters] for t in texts if t and any("a" <= c <= "z" for c in t)}
    assert set(got) == set(want)
    for t, counts in want.items():
        norm = sum(n * n for n in counts) ** 0.5
        assert got[t] == pytest.approx([n / norm for n in counts], abs=1e-6)


def test_shared_rows_of_an_index_are_dealt_to_several_tasks(spark, folder):
    rows = spark.range(4000).selectExpr("concat('c', id) AS chunk_id", "CAST(NULL AS STRING) AS owner", "'course' AS kind")
    stored = sinks.read_index(spark, sinks.write_index(rows, folder, "v1"))
    assert stored.count() == 4000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stored = sinks.read_index(spark, sinks.write_index(rows, folder, "v2"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = stored.groupBy(F.input_file_name()).count().collect()
    assert len(files) > 4 and max(r["count"] for r in files) < 2000


def test_norms_are_not_computed_for_every_component(spark):
    """A lambda over components holds no sum over components."""
    from skillbridge.operators import knn
    from skillbridge.plans import inputs

    vectors = spark.createDataFrame([(1, [3.0, 4.0])], "vec_id int, embedding array<float>")
    letters = inputs.LetterEmbedder().embed(spark.createDataFrame([("ab",)], "t string"), "t")
    for made, inner in (
        (registry.embed_counts(spark, SF), "exists("), (knn.prepared(vectors, "cosine"), " / "), (letters, " / ")
    ):
        lines = made._jdf.queryExecution().optimizedPlan().toString().splitlines()
        line = next(x for x in lines if inner in x)
        assert "aggregate(" not in line.split(inner, 1)[1], line
