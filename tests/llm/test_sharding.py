import hashlib

import numpy as np
import pytest
from rows import docs_of

from skillbridge.llm import sharding

NAMES = [f"s{k}" for k in range(7)]


def turn_by_turn(shards, slots):
    orders = []
    for name in shards:
        digest = hashlib.md5(name.encode()).digest()
        at, step = int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:], "big") % (slots - 1) + 1
        orders.append([(at + k * step) % slots for k in range(slots)])
    table, turn = {}, 0
    while len(table) < slots:
        shard = turn % len(shards)
        table[next(s for s in orders[shard] if s not in table)] = shard
        turn += 1
    return [table[s] for s in range(slots)]


@pytest.mark.parametrize(("shards", "slots"), [(NAMES, 251), (NAMES[:1], 13), (NAMES, 7), (NAMES[:3], 2 + 1)])
def test_table_as_turn_by_turn(shards, slots):
    table = sharding.fill_table(shards, slots)
    assert table.tolist() == turn_by_turn(shards, slots)
    shares = np.bincount(table, minlength=len(shards))
    assert shares.max() - shares.min() <= 1


def test_a_lost_shard_moves_few_others():
    names = [f"shard-{k}" for k in range(20)]
    before, after = sharding.fill_table(names), sharding.fill_table(names[:-1])
    stays = before != 19
    assert (before[stays] != after[stays]).mean() < 0.1


def test_wrong_arguments():
    for shards, slots in ((NAMES, 250), ([], 13), (NAMES, 5), (["a", "a"], 13)):
        with pytest.raises(ValueError):
            sharding.fill_table(shards, slots)


def test_rows(spark, tmp_path, plan_of):
    rows = [(k, "t") for k in range(500)] + [(3, "again"), (3, "again"), (None, None), (None, "x")]
    docs = docs_of(spark, rows).withColumnsRenamed({"lang": "shard", "source": "_slots"})
    out = sharding.place(docs, "doc_id", NAMES)
    assert out.columns == ["doc_id", "text", "_slots", "n_chars", "shard"]
    table = sharding.fill_table(NAMES).tolist()
    for r in out.collect():
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.shard == NAMES[table[int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 65_537]]
    assert out.count() == len(rows)
    sharding.write_shards(out, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows)
    plan = plan_of(sharding.place(spark.range(10).withColumnRenamed("id", "doc_id"), "doc_id", NAMES))
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert sharding.place(docs_of(spark, []), "doc_id", NAMES).count() == 0
