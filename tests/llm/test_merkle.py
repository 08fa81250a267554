import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F
from rows import DOCS

from skillbridge.llm import merkle

LOWER = {c: c + 32 for c in range(65, 91)}


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests, fanout=8):
    """The top, and for each leaf its steps ``(left, right)``."""
    steps, owners, nodes = [[] for _ in digests], [[k] for k in range(len(digests))], list(digests)
    while len(nodes) > 1:
        runs = [range(k, min(k + fanout, len(nodes))) for k in range(0, len(nodes), fanout)]
        for run in runs:
            for k in run:
                step = ("".join(nodes[j] for j in run if j < k), "".join(nodes[j] for j in run if j > k))
                for o in owners[k]:
                    steps[o].append(step)
        owners = [[o for k in run for o in owners[k]] for run in runs]
        nodes = [h("".join(nodes[k] for k in run)) for run in runs]
    return nodes[0], steps


def brute(rows, fanout=8):
    """``(doc_id, leaf, subroot, root, proof, folded, verified)`` of rows ``id, source, lang, n, text``."""
    order = {}
    for r in rows:
        order.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    langs = sorted(order, key=lambda x: (x is not None, (x or "").encode()))
    made = []
    for lang in langs:
        mine = sorted(order[lang], key=lambda x: x[:3])
        made.append((mine, *tree([x[2] for x in mine], fanout)))
    root, upper = tree([m[1] for m in made], fanout)
    out = []
    for (mine, subroot, steps), more in zip(made, upper, strict=True):
        for (_, _, leaf, r), own in zip(mine, steps, strict=True):
            path = own + more
            chosen = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            folded = leaf_of((*r[:4], r[4].translate(LOWER))) if chosen else leaf
            for left, right in path:
                folded = h(left + folded + right)
            proof = h("".join(left + right for left, right in path))
            out.append((r[0], leaf, subroot, root, proof, folded, folded == root))
    return sorted(out, key=str)


def docs_of(spark, rows):
    full = [(i, text, lang, source, n) for i, source, lang, n, text in rows]
    return spark.createDataFrame(full, DOCS).repartition(5)


def got(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()), key=str)


def corpus(sizes, seed=1):
    rng = random.Random(seed)
    langs = ["en", None, "", "zu", "é", "😀", "de", "aa", "ab", "ac", "ad"]
    rows = []
    for lang, size in zip(langs, sizes, strict=False):
        rows += [(rng.randrange(10**6), rng.choice(["a", None, ""]), lang, rng.choice([None, 5]), f"Text {k}") for k in range(size)]
    return rows


@pytest.mark.parametrize("sizes", [[1], [2], [8], [9], [64, 1], [65, 7, 1, 1], [130, 1, 3, 1, 1, 1, 1, 1, 20], [3, 0, 600, 513]])
def test_as_by_brute_force(spark, sizes):
    rows = corpus(sizes)
    out = got(merkle.tamper_test(docs_of(spark, rows)))
    assert out == brute(rows)
    assert len(out) == len(rows)


def test_odd_rows(spark):
    long = "Word ÄÖ " * 60_000
    rows = [(None, None, None, None, None), (None, "s", None, 3, "Text"), (7, "", "", 0, ""), (3, None, "en", 1, long)]
    rows += [(9, "s", "en", 4, "Same")] * 40 + [(9, "s", "en", 5, "other")] * 3 + [(12, "1:x", "en", None, "-"), (12, "-", "en", None, None)]
    out = got(merkle.tamper_test(docs_of(spark, rows)))
    assert out == brute(rows)
    assert {r[6] for r in out} == {True, False}


def test_empty_table(spark):
    assert merkle.tamper_test(docs_of(spark, [])).count() == 0


def test_proofs_of_any_table(spark):
    """Other fanout, fields and group; columns named like those of the module."""
    names = ["tree", "place", "total", "digest", "item", "steps", "_at", "_salt", "_tree", "handed", "c0", "i0", "leaf", "rank"]
    rows = [(k, k % 3, f"v{k}") for k in range(50)]
    table = spark.createDataFrame(rows, ["place", "tree", "c0"])
    for name in names:
        if name not in table.columns:
            table = table.withColumn(name, F.lit(name))
    out = merkle.manifest(table, ["c0", "_at"], group="tree", order="place", carry=["place", "c0", "steps", "leaf", "_salt"], fanout=3)
    assert out.columns == ["place", "c0", "_salt", "leaf", "subroot", "root", "steps"]
    ok = out.withColumn("ok", merkle.fold(F.col("leaf"), F.col("steps")) == F.col("root")).collect()
    assert len(ok) == 50 and all(r.ok for r in ok) and len({r.root for r in ok}) == 1 and len({r.subroot for r in ok}) == 3
    want, _ = tree([h("".join(f"{len(v)}:{v}" for v in (f"v{k}", "_at"))) for k in range(50) if k % 3 == 1], 3)
    assert {r.subroot for r in ok if int(r.place) % 3 == 1} == {want}
    other = merkle.manifest(table.withColumn("c0", F.when(F.col("place") == 49, "x").otherwise(F.col("c0"))), ["c0", "_at"], "tree", "place", fanout=3)
    assert not {r.root for r in other.select("root").collect()} & {r.root for r in ok}
