import random

import pytest
from plain import cut_lines
from rows import docs_of

from skillbridge.llm import linededup


def corpus(seed, count=40):
    rng = random.Random(seed)
    lines = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice([1, 2, 3, 5, 8, 13]))) for _ in range(25)]
    blocks = [[rng.choice(lines) for _ in range(rng.randrange(1, 7))] for _ in range(6)]
    rows = []
    for k in range(count):
        parts = []
        for _ in range(rng.randrange(0, 6)):
            kind = rng.random()
            parts += rng.choice(blocks) if kind < 0.5 else [rng.choice(lines)] if kind < 0.8 else ["", " \t"]
        if rng.random() < 0.3:
            parts = [" " + p + "\r" for p in parts]
        rows.append((k, "\n".join(parts)))
    rows += [(k, rows[k - 100][1]) for k in range(100, 106)]
    return rows


def check(spark, rows, min_words):
    docs = docs_of(spark, rows).withColumnsRenamed({"lang": "pos", "source": "lines_removed"})
    out = linededup.dedup_lines(docs, min_words=min_words)
    assert out.columns == ["doc_id", "text", "pos", "n_chars", "lines_removed"]
    want = cut_lines(rows, min_words)
    expected = [(i, *want[i, t]) for i, t in rows]
    got = [(r.doc_id, r.text, r.lines_removed) for r in out.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    return sum(n > 0 for _, _, n in expected)


@pytest.mark.parametrize(("seed", "min_words"), [(1, 1), (2, 6), (3, 10), (4, 25)])
def test_as_by_brute_force(spark, seed, min_words):
    rows = corpus(seed)
    rows += [(None, rows[3][1]), (900, None), (901, ""), (902, "\n\n"), (5, rows[5][1]), (5, rows[5][1])]
    assert check(spark, rows, min_words) > 2


def test_long_documents_and_hot_runs(spark):
    long_line = " ".join(f"x{k}" for k in range(60))
    rows = [(k, f"own line {k}\n{long_line}\nend {k}") for k in range(300)]
    rows += [(400, "\n".join(f"line {k % 700} of many with some more words" for k in range(1500)))]
    docs = docs_of(spark, rows)
    out = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    assert out[0].lines_removed == 0 and all(out[k].text == f"own line {k}\nend {k}" for k in range(1, 300))
    assert out[400].lines_removed == 800


def test_empty_table(spark):
    assert linededup.dedup_lines(docs_of(spark, [])).count() == 0
