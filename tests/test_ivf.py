import numpy as np
import pytest
from pyspark.sql import functions as F
from test_knn import brute, frames, grouped, rows, rubbish

from skillbridge.functions.nearest import limits_of
from skillbridge.operators import ivf


def clustered(seed, n, d=8, groups=12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(scale=10.0, size=(groups, d))
    return [(i, None, (middle[i % groups] + rng.normal(size=d)).tolist()) for i in range(n)]


def test_all_cells_give_the_exact_hits(spark, folder):
    queries, corpus = clustered(1, 50), clustered(2, 600)
    q, c = frames(spark, queries + rubbish(3, 500), corpus + rubbish(4, 9000))
    ivf.write_ivf(c.withColumn("text", F.concat(F.lit("t"), "vec_id")), folder)
    hits = ivf.search_ivf(spark, folder, q, probes=10**6)
    assert grouped(hits) == brute(queries, corpus, 3)
    assert all(r.text == f"t{r.vec_id}" for r in hits.collect())


def test_few_cells_are_read(spark, folder, plan_of):
    queries, corpus = clustered(1, 40), clustered(1, 800)
    q, c = frames(spark, queries, corpus)
    ivf.write_ivf(c, folder, cells=12)
    needed = spark.read.parquet(f"{folder}/settings").first()["probes"]
    assert needed <= 6
    got, want = grouped(ivf.search_ivf(spark, folder, q, exclude_self=True)), {}
    for qid, _, v in queries:
        near = sorted((round(float(np.square(np.array(v) - np.array(x)).sum()), 6), i) for i, _, x in corpus if i != qid)
        want[qid] = [i for _, i in near[:3]]
    found = sum(len(set(got[k]) & set(want[k])) for k in want)
    assert found >= 0.95 * 120
    one = q.filter("qid = 0")
    plan = plan_of(ivf.search_ivf(spark, folder, one, probes=1))
    assert "PartitionFilters: [isnotnull(cell" in plan or "cell#" in plan.partition("PartitionFilters: [")[2][:80]
    # vectors are read in place: what is shuffled are numbers of queries, distances and ids
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and "SortMergeJoin" not in plan


def test_tiles_copies_and_empty_tables(spark, folder, monkeypatch):
    monkeypatch.setattr(ivf, "TILE_BYTES", 1000)
    queries, corpus = rows(5, 60), rows(6, 300, copies=200)
    q, c = frames(spark, queries, corpus)
    ivf.write_ivf(c, f"{folder}/a", cells=5)
    hits = ivf.search_ivf(spark, f"{folder}/a", q, probes=5, candidates=100)
    got, want = grouped(hits), brute(queries, corpus, 3)
    vector = {i: np.array(v) for i, _, v in corpus}
    for qid, _, v in queries:  # ties may fall among copies; distances may not differ
        far = [sorted(np.square(np.array(v) - vector[i]).sum() for i in ids[qid]) for ids in (got, want)]
        assert np.allclose(*far)
    assert ivf.search_ivf(spark, f"{folder}/a", q.filter("false")).count() == 0
    ivf.write_ivf(c.filter("false"), f"{folder}/b")
    assert ivf.search_ivf(spark, f"{folder}/b", q).count() == 0


def test_bounds_from_a_sample():
    rng = np.random.default_rng(0)
    queries, known = rng.normal(size=(30, 4)), rng.normal(size=(100, 4))
    far = limits_of(queries, known, 3)
    exact = np.sort(np.square(queries[:, None] - known[None]).sum(-1), axis=1)[:, 2]
    assert (far >= exact).all() and np.allclose(far, exact, atol=1e-6)
    assert np.isinf(limits_of(queries, None, 3)).all()


@pytest.mark.parametrize("column", ["embedding"])
def test_stored_rows_hold_their_cell(spark, folder, column):
    _, c = frames(spark, rows(1, 2), clustered(7, 200))
    ivf.write_ivf(c, folder)
    centres = {r.cell: np.array(r.centre) for r in spark.read.parquet(f"{folder}/centres").collect()}
    stored = spark.read.parquet(f"{folder}/rows").collect()
    assert len(stored) == 200
    for r in stored:
        v = np.array(r[column])
        assert np.square(v - centres[r.cell]).sum() <= min(np.square(v - x).sum() for x in centres.values()) + 1e-6
        back = centres[r.cell] + np.frombuffer(r.code, np.int8) * r.scale
        assert np.abs(back - v).max() <= 0.51 * r.scale


def test_candidates_are_thinned_as_they_come(spark, folder, monkeypatch):
    """Far rows are left out by a bound, and what is held is cut to the best; hits stay those of all cells."""
    queries, corpus = clustered(1, 50), clustered(2, 900)
    q, c = frames(spark, queries, corpus)
    ivf.write_ivf(c, folder, cells=20)
    bounded = ivf._bounded(q, spark.read.parquet(f"{folder}/rows"), np.array([r.centre for r in spark.read.parquet(f"{folder}/centres").orderBy("cell").collect()]), 3, 10**6, "vec_id")
    want, limits = brute(queries, corpus, 3), {r.qid: r._limit for r in bounded.collect()}
    vector = {i: np.array(v) for i, _, v in corpus}
    off = [np.square(np.array(v) - vector[want[i][-1]]).sum() - limits[i] for i, _, v in queries]
    assert max(off) <= 1e-3, off  # vectors are kept as floats
    monkeypatch.setattr(ivf, "HELD", 100)
    monkeypatch.setattr(ivf, "BOUND_ROWS", 2)  # no bound
    assert grouped(ivf.search_ivf(spark, folder, q, probes=10**6, candidates=10)) == want


def test_tiles_are_searched_one_after_another(spark, folder, monkeypatch, plan_of):
    """Candidates of many tiles must not be broadcast at once: hits of a tile are stored, and few pairs are sent."""
    queries, corpus = clustered(1, 90), clustered(2, 900)
    q, c = frames(spark, queries, corpus)
    ivf.write_ivf(c, folder, cells=20)
    want, sent, tile_hits = brute(queries, corpus, 3), [], ivf._tile_hits

    def counted(*args):
        met, other = tile_hits(*args)
        sent.append((args[0].num_rows, met.count()))
        return met, other

    monkeypatch.setattr(ivf, "_tile_hits", counted)
    monkeypatch.setattr(ivf, "TILE_PAIRS", 30 * 60)
    hits = ivf.search_ivf(spark, folder, q, probes=10**6)
    assert "Broadcast" not in plan_of(hits)
    assert [rows for rows, _ in sent] == [30, 30, 30]
    assert sum(pairs for _, pairs in sent) < 90 * 12  # of 60 candidates
    assert grouped(hits) == want


def test_ids_that_repeat_or_are_missing(spark, folder, monkeypatch):
    """A pair is kept for every row of its id; rows without an id don't count as hits."""
    near = [(i, None, [float(i), 0.0]) for i in range(40)]
    c = frames(spark, near, near)[1].drop("owner")
    far = c.filter("vec_id < 3").selectExpr("vec_id", "transform(embedding, x -> x + 30) AS embedding")
    lost = c.filter("vec_id < 20").selectExpr("cast(NULL AS bigint) AS vec_id", "embedding")
    q = c.selectExpr("vec_id AS qid", "embedding").filter("qid < 3")
    ivf.write_ivf(c.unionByName(far).unionByName(far).unionByName(lost.select(*c.columns)), folder, cells=3)
    monkeypatch.setattr(ivf, "TILE_PAIRS", 1)
    got = ivf.search_ivf(spark, folder, q, probes=3, k=1, candidates=200)
    assert sorted((r.qid, r.vec_id, r.dist) for r in got.collect()) == [(i, i, 0.0) for i in range(3)]
