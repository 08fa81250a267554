import random

import numpy as np
import pyarrow as pa
import pytest
from rows import docs_of

from skillbridge.llm import linear, toxicity
from skillbridge.llm.spans import chunks

RUDE = ["grumblix", "snarfle", "blargwort"]


def corpus(count=600, seed=2):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfgl" for b in "aeiou" for c in ("ran", "tel", "mos", "pir")]
    rows, labels = [], []
    for k in range(count):
        toxic, poor = k % 9 == 0, k % 4 == 1
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(8, 60))]
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(RUDE))
        if poor:
            words += ["%%%junk"] * 5
        rows.append((k, " ".join(words)))
        labels.append((k, int(poor), int(toxic)))
    return rows, labels


def label_frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, poor int, toxic int")


def probabilities(spark, chain, rows):
    out = toxicity.score(docs_of(spark, rows), chain).collect()
    return {r.doc_id: (r.p_poor, r.p_toxic) for r in out}


def test_held_out_documents(spark):
    rows, labels = corpus()
    chain = toxicity.fit_chain(docs_of(spark, rows), label_frame(spark, labels[:400]), ["poor", "toxic"])
    p = probabilities(spark, chain, rows)
    for k, poor, toxic in labels[400:]:
        assert (p[k][0] >= 0.5) == bool(poor)
        assert (p[k][1] >= toxicity.THRESHOLD) == bool(toxic)


def brute(chain, text):
    """Features of one text, counted word by word."""
    counts = {}
    part = next(chunks(pa.array([text])))
    hashes, _ = toxicity.terms(part)
    for h in hashes.tolist():
        counts[h] = counts.get(h, 0) + 1
    known = {int(h): k for k, h in enumerate(chain.known)}
    p = []
    for k in range(len(chain.categories)):
        z = chain.bias[k] + sum(x * u for x, u in zip(p, chain.earlier[k], strict=False))
        for h, n in counts.items():
            for level, least in enumerate(toxicity.LEVELS):
                if n >= least and (h | level) in known:
                    z += chain.weights[known[h | level], k]
        p.append(1 / (1 + np.exp(-z)))
    return p


def test_scores_as_by_brute_force(spark):
    rows, labels = corpus(200)
    chain = toxicity.fit_chain(docs_of(spark, rows), label_frame(spark, labels), ["poor", "toxic"])
    more = rows[:40] + [(900, None), (901, ""), (902, "grumblix " * 3000), (903, "!!"), (None, "snarfle there")]
    p = probabilities(spark, chain, more)
    for k, text in more:
        assert p[k] == pytest.approx(brute(chain, text or ""), abs=1e-9)


def test_odd_tables(spark):
    rows, labels = corpus(60)
    docs = docs_of(spark, [*rows, rows[0], (None, None)]).withColumnsRenamed({"lang": "p_toxic", "source": "features"})
    odd = [*labels, (0, None, 1), (1, 7, 0), (None, 1, 1), (9999, 0, 0), labels[2], (3, 1, None)]
    for some in (odd, [], [(1, 0, 0), (2, 0, 0)], [(1, 1, 1)]):
        chain = toxicity.fit_chain(docs, label_frame(spark, some), ["poor", "toxic"])
        out = toxicity.score(docs, chain)
        assert sorted(out.columns) == sorted([*docs.columns, "p_poor"])
        assert out.count() == 62
    assert toxicity.score(docs_of(spark, []), chain).count() == 0


def test_filter_keeps_whole_rows(spark):
    rows, labels = corpus(400)
    table = label_frame(spark, labels).selectExpr("doc_id", "1 - poor AS quality", "toxic")
    docs = docs_of(spark, rows)
    kept = toxicity.remove_toxic(docs, table)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, _, toxic in labels if not toxic}


def test_sample_is_bounded_and_one_row_an_id(spark):
    rows, labels = corpus(90)
    docs = docs_of(spark, rows + rows[:30])
    sample = toxicity.sample_of(docs, label_frame(spark, labels), ["poor", "toxic"], "text", "doc_id", 25)
    ids = [r.id for r in sample.collect()]
    assert len(ids) == len(set(ids)) == 25


def test_logistic_regression_finds_the_optimum():
    rng = np.random.default_rng(0)
    lists = [np.flatnonzero(rng.random(8) < 0.4) for _ in range(300)]
    rows = linear.Rows.of(lists, 8)
    extra = rng.random((300, 2))
    y = (rng.random(300) < 0.3 + 0.4 * np.array([0 in x for x in lists])).astype(float)
    w, u, b = linear.fit_logistic(rows, extra, y, l2=1.0)
    dense = np.zeros((300, 8))
    for k, x in enumerate(lists):
        dense[k, x] = 1
    p = linear.sigmoid(dense @ w + extra @ u + b)
    assert np.abs(dense.T @ (p - y) + w).max() < 1e-3 and np.abs(extra.T @ (p - y) + u).max() < 1e-3
    part = rows.take(np.arange(300) % 3 == 0)
    assert [part.cols[a:b].tolist() for a, b in zip([0, *part.ends[:-1]], part.ends, strict=True)] == [x.tolist() for x in lists[::3]]
