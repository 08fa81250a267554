import hashlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import SF
from plain import cut_lines
from pyspark.sql import functions as F
from rows import DOCS
from test_jaccard import brute as components

import corpus_pipeline
from skillbridge.llm import bpe, decontam, toxicity
from skillbridge.llm.store import written


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage reads and makes."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        made = written(stage(spark, docs, SF), name)
        out[name] = (docs, made)
        docs = made
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns_stay(steps):
    for name, (before, after) in steps.items():
        if name != "encoding":
            assert after.columns == before.columns
            assert all(r.n_chars == len(r.text) for r in after.collect())


def test_toxicity(spark, steps):
    before, after = steps["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    chain = toxicity.fit_chain(before, toxicity.label_categories(labels), toxicity.CATEGORIES)
    p = {r.doc_id: r.p_toxic for r in toxicity.score(before, chain).collect()}
    assert {i for i, _ in rows(after)} == {i for i, x in p.items() if x < toxicity.THRESHOLD}
    toxic = {r.doc_id for r in labels.collect() if r.toxic}
    left = {i for i, _ in rows(after)}
    assert len(toxic & left) < 0.5 * len(toxic) and len(left) > 0.9 * (before.count() - len(toxic))


def test_lines(steps):
    before, after = (rows(x) for x in steps["line_dedup"])
    want = cut_lines(before)
    assert sorted(after) == sorted((i, want[i, t][0]) for i, t in before)
    assert after != before


def test_near_copies(steps):
    before, after = (rows(x) for x in steps["near_duplicates"])
    comps = {(i, c) for i, n, c in components(before) if n}
    none = {i for i, n, _ in components(before) if not n}
    assert {i for i, _ in after} == {c for _, c in comps} | none
    assert set(after) <= set(before) and len(after) < len(before)


def test_contaminated(spark, steps):
    before, after = (rows(x) for x in steps["decontamination"])
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {i for i, _ in after}
    assert all(not any(item in text for item in items) for _, text in after)
    # whoever went shares a window of words with an item
    def grams(text):
        words = text.lower().replace(".", " ").replace(",", " ").split()
        return {tuple(words[k : k + decontam.WINDOW]) for k in range(len(words) - decontam.WINDOW + 1)}

    known = set().union(*map(grams, items))
    gone = [text for i, text in before if i not in left]
    assert gone and all(grams(text) & known for text in gone)
    assert all(not grams(text) & known for _, text in after)


def test_encoding(steps):
    before, after = steps["encoding"]
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, text in rows(before):
        raw = np.array(library.encode_ordinary(text), dtype="<u4").tobytes()
        want.append((i, len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(tuple(r) for r in after.collect()) == sorted(want)


NAMES = ["_doc", "_th", "_mask", "_n", "_p_toxic", "doc", "node", "id"]


def odd_folder(spark, folder, rows, labels, items):
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
    for name in NAMES:
        docs = docs.withColumn(name, F.lit(name))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_odd_rows_and_clashing_names(spark, folder):
    item = "a question of the benchmark that is long enough to be found by its thirteen and more words"
    own = [(k, f"text {k} " + " ".join(f"w{k}x{j}" for j in range(70))) for k in range(8)]
    rows = [*own, (3, own[3][1]), (20, own[5][1]), (21, None), (22, ""), (None, "no id " + item), (None, None), (23, item.upper())]
    labels = [(1, 1, 0), (2, None, None), (None, 0, 1), (99, 0, 1)]
    path = odd_folder(spark, folder, rows, labels, [(1, item), (2, None), (None, "")])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, path), name)
        assert docs.columns == [*DOCS.names, *NAMES]
        assert all(r[n] == n for r in docs.collect() for n in NAMES)
    left = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    # the only line of row 20 repeats an earlier one
    assert left == sorted([*own, (20, ""), (21, None), (22, ""), (None, None)], key=str)


def test_empty_tables(spark, folder):
    rows = [(k, f"text {k} of its own " * 30) for k in range(5)]
    path = odd_folder(spark, f"{folder}/a", rows, [], [])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, path).collect()) == list(range(5))
    path = odd_folder(spark, f"{folder}/b", [], [(1, 1, 0)], [(1, "some words of an item")])
    assert corpus_pipeline.run(spark, path).count() == 0


def test_rest_works_without_the_folder():
    """No module outside imports the operators, but for the guarded entry point."""
    top = Path(corpus_pipeline.__file__).parent
    for file in [*top.glob("*.py"), *top.glob("skillbridge/**/*.py"), *top.glob("tools/*.py"), *top.glob("tests/*.py")]:
        if "llm" not in file.parts and file.name not in ("corpus_pipeline.py", "__spark_entry__.py"):
            assert ".llm" not in file.read_text() and "corpus_pipeline" not in file.read_text()
