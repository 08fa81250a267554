import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from rows import docs_of

from skillbridge.llm import bpe, tokencounts


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def encoding(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def spans_of(text, encoding):
    """Character span of each token, byte by byte."""
    owner = [k for k, c in enumerate(text) for _ in c.encode()]
    at, out = 0, []
    for t in encoding.encode_ordinary(text):
        size = len(encoding.decode_single_token_bytes(t))
        out.append((owner[at], owner[at + size - 1] + 1))
        at += size
    return out


def brute(text, sections, rule, encoding):
    counts = [0] * len(sections)
    for a, b in spans_of(text, encoding):
        points = {"first": [a], "last": [b - 1], "largest": range(a, b)}[rule]
        shared = [sum(lo <= p < hi for p in points) for lo, hi in sections]
        if any(shared):
            counts[shared.index(max(shared))] += 1
    return counts


def lines(text):
    ends, out = 0, []
    for line in text.split("\n"):
        out.append((ends, ends + len(line) + 1))
        ends += len(line) + 1
    out[-1] = (out[-1][0], len(text))
    return out if len(out) == 1 or out[-1][0] < out[-1][1] else out[:-1]


def texts(seed=2):
    rng = random.Random(seed)
    bits = ["\n", "\n\n", " ", "  ", "word", "don't", "é", "漢字", "😀", "42", ".", "\t", "\r\n", "aaaa "]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(120)]


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_lines_as_by_brute_force(spark, ranks, encoding, rule):
    rows = [*enumerate(texts()), (900, None), (901, ""), (902, "\n"), (903, "x" * 20_000 + "\n y"), (None, "a\nb"), (904, "a"), (904, "a")]
    docs = docs_of(spark, rows).withColumnsRenamed({"lang": "section", "source": "id"})
    out = tokencounts.section_counts(docs, ranks, public_tokenizers.PATTERN, rule=rule).collect()
    want = []
    for i, text in rows:
        spans = lines(text or "")
        want += [(i, k, a, b, n) for k, ((a, b), n) in enumerate(zip(spans, brute(text or "", spans, rule, encoding), strict=True))]
    assert sorted([tuple(r) for r in out], key=str) == sorted(want, key=str)
    total = {}
    for r in out:
        total[r[0]] = total.get(r[0], 0) + r[4]
    assert all(total[i] == len(encoding.encode_ordinary(t or "")) for i, t in rows if i not in (None, 904))


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_given_sections(spark, ranks, encoding, rule):
    rng = random.Random(5)
    rows = []
    for k, text in enumerate(texts(9)):
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, rng.randrange(0, 9))))
        rows.append((k, text, [(a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=False) if a < b]))
    rows += [(900, None, [(0, 3)]), (901, "text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, parts array<struct<a: int, b: int>>")
    out = tokencounts.section_counts(docs, ranks, public_tokenizers.PATTERN, sections="parts", rule=rule).collect()
    got = {(r.doc_id, r.section): r.n_tokens for r in out}
    want = {(i, k): n for i, t, s in rows for k, n in enumerate(brute(t or "", s or [], rule, encoding))}
    assert got == want


def test_empty_table_and_wrong_rule(spark, ranks):
    assert tokencounts.section_counts(docs_of(spark, []), ranks, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        tokencounts.section_counts(docs_of(spark, []), ranks, public_tokenizers.PATTERN, rule="half")
    assert tokencounts.line_sections("").tolist() == [[0, 0]]
    assert np.array_equal(tokencounts.line_sections("a\n\nb"), [[0, 2], [2, 3], [3, 4]])
