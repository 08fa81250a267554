import math
import random

import numpy as np
import pyarrow as pa
import pytest
from rows import docs_of

from skillbridge.llm import importance
from skillbridge.llm.spans import chunks


def corpus(count=300, seed=1):
    rng = random.Random(seed)
    good = [a + b for a in "bcdfg" for b in ("an", "el", "im", "or")]
    bad = ["%%%", "$$$", "!!", "xx"]
    rows = []
    for k in range(count):
        words = [rng.choice(good) for _ in range(rng.randrange(3, 30))]
        if k % 3 == 0:
            words = [rng.choice(good[:3]) + rng.choice(bad) for _ in words]
        rows.append((k, " ".join(words)))
    return rows


def targets(spark, rows):
    return spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in rows if i is not None and i < 150], "doc_id long, quality int, toxic int")


def buckets_of(text, buckets):
    if not text:
        return []
    return importance.gram_buckets(next(chunks(pa.array([text]))), buckets)[0].tolist()


def test_weights_as_by_brute_force(spark):
    rows = [*corpus(), (900, None), (901, ""), (902, " \n"), (903, "ban " * 20_000), (1, "ban can"), (None, "ban can")]
    docs = docs_of(spark, rows).withColumnsRenamed({"lang": "key", "source": "target"})
    ids = importance.target_ids(targets(spark, rows))
    chosen = {r.id for r in ids.collect()}
    raw, target = np.ones(500), np.ones(500)
    for i, text in rows:
        for b in buckets_of(text, 500):
            raw[b] += 1
            target[b] += i in chosen
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    out = importance.resample(docs, ids, share=0.5, buckets=500).collect()
    assert len(out) == len(rows)
    want = {(i, len(b := buckets_of(t, 500)), round(float(ratio[b].sum()), 6) if b else None) for i, t in rows}
    assert {(r.doc_id, r.n_grams, None if r.log_weight is None else round(r.log_weight, 6)) for r in out} == want
    keys = sorted((r.key for r in out if r.key is not None), reverse=True)
    least = keys[math.ceil(0.5 * len(keys)) - 1]
    assert all(r.kept == (r.key is not None and r.key >= least) for r in out)
    kept = [r.doc_id for r in out if r.kept and r.doc_id is not None and r.doc_id < 300]
    assert sum(i % 3 > 0 for i in kept) > 0.9 * len(kept)


def test_all_good_labels_make_the_target(spark):
    count = 20_500
    labels = spark.range(count).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    ids = importance.target_ids(labels)
    assert ids.count() == count
    docs = spark.range(count).selectExpr("id AS doc_id", "concat('w', id) AS text")
    # all documents are the target, so no bucket is more likely in it
    assert not importance.log_ratios(docs, ids).any()


def test_noise_is_gumbel(spark):
    noise = np.array([r[0] for r in spark.range(20_000).select(importance.gumbel(3, "id")).collect()])
    assert abs(noise.mean() - 0.5772) < 0.05 and abs(noise.var() - math.pi**2 / 6) < 0.1


@pytest.mark.parametrize("bins", [2, 1024])
def test_kth_largest(spark, monkeypatch, bins):
    monkeypatch.setattr(importance, "BINS", bins)
    rng = random.Random(4)
    for values in ([rng.gauss(0, 1e6) for _ in range(99)], [1.0] * 9 + [2.0] * 9, [0.0, 5e-324, 1e300], [3.5], [1.0, np.nextafter(1.0, 2)] * 3):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
        for k in {1, 2, len(values) // 2, len(values)} - {0}:
            if k <= len(values):
                assert importance.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]
        assert importance.kth_largest(df, "x", len(values) + 1) is None


def test_odd_tables(spark):
    rows = corpus(20)
    none = importance.target_ids(targets(spark, []))
    out = importance.resample(docs_of(spark, rows), none, share=0.25).collect()
    assert {r.log_weight for r in out} == {0.0} and sum(r.kept for r in out) == 5
    assert importance.resample(docs_of(spark, []), none).count() == 0
    twice = importance.resample(docs_of(spark, rows + rows), none, share=0.25).collect()
    assert sorted(r.doc_id for r in twice if r.kept) == sorted(2 * [r.doc_id for r in out if r.kept])
