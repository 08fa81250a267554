import math

import numpy as np
import pytest

from skillbridge.llm import topk


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id int").repartition(3)


def brute(rows, every, k, scale=64):
    good = {(i, tuple(math.floor(scale * float(np.float32(x))) for x in v))
            for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, q in good:
        if i % every == 0:
            near = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in good if j != i and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near[:k])]
    return sorted(out)


def vectors(count, dim, seed):
    rng = np.random.default_rng(seed)
    rows = [(k, rng.normal(size=dim).tolist(), 0) for k in range(count)]
    return [(k, rows[k // 7][1] if k % 3 else v, x) for k, v, x in rows]  # many equal vectors


@pytest.mark.parametrize("tile", [16, 4096])
def test_as_by_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "TILE_ROWS", tile)
    monkeypatch.setattr(topk, "FAN_IN", 3)
    rows = vectors(400, 9, 1)
    rows += [(500, None, 0), (520, [1.0, None] + [0.0] * 7, 0), (540, [float("nan")] + [0.0] * 8, 0), (560, [float("inf")] + [0.0] * 8, 0)]
    rows += [(None, rows[0][1], 0), rows[20], rows[20], (600, [0.5, 0.5], 0), (601, [1.0, 0.0], 0), (620, [], 0), (640, [], 0), (20, [0.1] * 9, 0)]
    got = sorted(tuple(r) for r in topk.search(frame(spark, rows), 20, 5).collect())
    assert got == brute(rows, 20, 5)


def test_few_rows_and_large_numbers(spark):
    rows = [(0, [3e7, -2.0], 0), (1, [2e7, 5.0], 0), (2, [1.0, 1.0], 0)]
    assert sorted(tuple(r) for r in topk.search(frame(spark, rows), 20, 20).collect()) == brute(rows, 20, 20)
    assert topk.search(frame(spark, rows[:1]), 20, 20).count() == 0
    assert topk.search(frame(spark, []), 20, 20).count() == 0
