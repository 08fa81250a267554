import hashlib
import random

import pytest
from pyspark.sql import functions as F

from skillbridge.llm import chat

KINDS = "tree string, node long, parent long, role string, text string, score double"
BITS = ["<s>", "</s>", "[INST]", "[/INST]", " [/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "\\", "\\\\", "<", "[", "/", "\n", "é", "😀", "a", " ", "$0", "<\\s>"]


def odd_text(rng):
    return "".join(rng.choice(BITS) for _ in range(rng.randrange(0, 12)))


def forest(seed, trees=25):
    rng = random.Random(seed)
    rows = []
    for t in range(trees):
        name = None if t == 0 else f"t{t}"
        for n in range(rng.choice([1, 2, 5, 40])):
            parent = None if n == 0 or rng.random() < 0.05 else rng.randrange(max(0, n - rng.choice([1, 1, 9])), n)
            role = rng.choice(["user", "assistant", "assistant", "system", "tool", None, "[ROLE]x\\"])
            rows.append((name, n, parent, role, rng.choice([None, odd_text(rng), odd_text(rng)]), rng.choice([None, 0.5, 1.0, 2.0, -1.0])))
    return rows


def brute(rows, keep):
    """``{(tree, leaf): (rank, score, [(role, text)])}``, path by path."""
    known = {(r[0], r[1]): r for r in rows}
    parents = {(r[0], r[2]) for r in rows if (r[0], r[2]) in known}
    found = {}
    for tree, node in known:
        if (tree, node) in parents:
            continue
        path, at = [], (tree, node)
        while at in known and len(path) <= len(rows):
            path.append(known[at])
            at = (tree, known[at][2])
        if len(path) <= len(rows):
            found.setdefault(tree, []).append((-sum(r[5] or 0 for r in path), node, path[::-1]))
    out = {}
    for tree, branches in found.items():
        for rank, (score, node, path) in enumerate(sorted(branches, key=lambda b: b[:2]), 1):
            if keep is None or rank <= keep:
                out[tree, node] = (rank, -score, [(r[3] or "", r[4] or "") for r in path])
    return out


def check(spark, rows, keep):
    table = spark.createDataFrame(rows, KINDS).repartition(4)
    for name in ("place", "leaf", "rank", "piece", "_node", "formatted"):
        table = table.withColumn(name, F.lit("x"))
    made = chat.conversations(table, keep)
    rank = {(r.tree, r.leaf): (r["rank"], r.score, r.n_turns, r.formatted) for r in made.collect()}
    want = brute(rows, keep)
    assert {k: (v[0], v[1], v[2]) for k, v in rank.items()} == {k: (v[0], v[1], len(v[2])) for k, v in want.items()}
    for r in chat.read_back(made).collect():
        turns = want[r.tree, r.leaf][2]
        assert [tuple(t) for t in r.turns] == turns
        assert r.learned == [t for role, t in turns if role == "assistant"]
        text = rank[r.tree, r.leaf][3]
        assert r.formatted_chars == len(text) and text.startswith("<s>")
        # no control string but those of the template: one begins and one ends each turn
        kinds = [role if role in ("user", "system", "assistant") else "other" for role, _ in turns]
        marks = {"user": 2, "system": 2, "assistant": 1, "other": 3}
        controls = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]"]
        assert sum(text.count(c) for c in controls) == 1 + sum(marks[k] for k in kinds)
    return want


@pytest.mark.parametrize(("seed", "keep"), [(1, 1), (2, 2), (3, None)])
def test_as_by_brute_force(spark, seed, keep):
    assert len(check(spark, forest(seed), keep)) >= 25


def test_odd_rows(spark):
    rows = [("c", 1, 2, "user", "on a cycle", 1.0), ("c", 2, 1, "user", "too", 1.0), ("c", 3, 2, "user", "below it", 9.0)]
    rows += [("c", 7, 7, "user", "own parent", 1.0), ("d", 5, 99, "user", "no parent", float("nan"))]
    rows += [("e", 1, None, "user", "long Ä" * 100_000, 1.0), ("e", 2, 1, "assistant", "<s>" * 50_000, 1.0)]
    want = brute([r if r[5] == r[5] else (*r[:5], 0.0) for r in rows], 1)
    assert set(want) == {("d", 5), ("e", 2)}
    made = chat.conversations(spark.createDataFrame(rows, KINDS))
    got = {(r.tree, r.leaf): [tuple(t) for t in r.turns] for r in chat.read_back(made).collect()}
    assert got == {k: v[2] for k, v in want.items()}
    twice = [("a", 1, None, "user", "b", 1.0), ("a", 1, None, "user", "a", 1.0), ("a", 1, None, "user", "a", 1.0)]
    assert [r.formatted for r in chat.conversations(spark.createDataFrame(twice, KINDS)).collect()] == ["<s>[INST] a [/INST]"]


def test_one_root_with_many_answers(spark):
    rows = [("t", 0, None, "user", "ask", 0.0)] + [("t", k, 0, "assistant", f"answer {k}", float(k % 7)) for k in range(1, 500)]
    assert len(check(spark, rows, 3)) == 3
    assert len(check(spark, rows, None)) == 499


def test_conversations_in_turn(spark):
    """Rows of one turn, NULLs everywhere, a conversation of hundreds of turns."""
    kinds = "conv_id long, turn long, role string, text string, node string"
    rows = [(1, k, "user" if k % 2 else "assistant", f"[INST] {k} \\", "x") for k in range(333)]
    rows += [(None, 0, "user", "a", "x"), (2, None, None, None, "x"), (2, 1, "user", "b", "x"), (2, 1, "user", None, "x"), (2, 1, "user", "b", "x")]
    out = {r.conv_id: r for r in chat.formatted_digests(spark.createDataFrame(rows, kinds)).collect()}
    assert {k: r.n_turns for k, r in out.items()} == {-1: 2, None: 1, 1: 333, 2: 4}
    flat = "".join(f"{r[2]}\n{r[3]}\n" for r in rows[:333])
    assert out[1].turns_sha256 == hashlib.sha256(flat.encode()).hexdigest()
    learned = "".join(r[3] for r in rows[:333] if r[2] == "assistant")
    assert (out[1].loss_chars, out[1].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert out[2].turns_sha256 == hashlib.sha256(b"\n\nuser\n\nuser\nb\nuser\nb\n").hexdigest()
    assert out[2].loss_sha256 == hashlib.sha256(b"").hexdigest() and out[2].loss_chars == 0
    odd = chat.ODD_TEXT
    assert out[-1].loss_sha256 == hashlib.sha256(odd.encode()).hexdigest()
    assert out[-1].formatted_chars == 3 + 15 + 4 + 2 * (len(odd) + 3)


def test_empty_table(spark):
    assert chat.conversations(spark.createDataFrame([], KINDS)).count() == 0
