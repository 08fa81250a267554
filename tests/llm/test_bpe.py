import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from rows import docs_of, mirrored

from skillbridge.llm import bpe
from skillbridge.llm.spans import chunks

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(PATH)


@pytest.fixture(scope="module")
def encoding(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(count=400, seed=3):
    rng = random.Random(seed)
    bits = ["'", "'s", "'re", "'l", "'ll", "'v", " ", "  ", "\n", "\t", " ", "　", "a", "é", "ß", "漢", "1",
            "²", "٣", "!", "-", "😀", "́", "s", "t", "re", "\x1c", "\x85", "<|endoftext|>", "ſ", "\r\n", "don't"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 30))) for _ in range(count)]


def test_pretokens_are_those_of_the_pattern():
    classes = bpe.character_classes()
    texts = [None, "", *odd_texts()]
    for limit in (1, 50, 1 << 20):
        for part in chunks(pa.array(texts), limit):
            chars = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])
            codes = np.frombuffer(part.data.tobytes().decode().encode("utf-32-le"), dtype="<u4")
            begin, end = chars[part.begin], chars[part.end]
            start = bpe.pretoken_starts(codes, begin, end, classes)
            for n, (a, b) in enumerate(zip(begin, end, strict=True)):
                mine = [s for s in start if a <= s < b]
                text = texts[part.first + n] or ""
                want = [a + m.start() for m in regex.finditer(public_tokenizers.PATTERN, text)]
                assert mine == want, text


def run(docs, ranks, **kw):
    out = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN, **kw), ranks)
    return out, bpe.digests(out).collect()


def expected(texts, encoding):
    want = []
    for i, t in texts:
        ids = encoding.encode_ordinary(t or "")
        raw = np.array(ids, dtype="<u4").tobytes()
        want.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(want, key=str)


@pytest.mark.parametrize("block_chars", [200, 16_000_000])
def test_same_as_the_library_and_back(spark, ranks, encoding, block_chars):
    texts = list(enumerate(odd_texts()))
    texts += [(None, "no id"), (5000, None), (5001, ""), (5002, "x" * 30_000), (5003, "ab c " * 20_000), (7, "again"), (7, "again")]
    _, got = run(docs_of(spark, texts), ranks, block_chars=block_chars)
    assert sorted([tuple(r) for r in got], key=str) == expected(texts, encoding)


def test_empty_table_and_clashing_columns(spark, ranks):
    out, got = run(docs_of(spark, []), ranks)
    assert got == [] and out.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    clash = docs_of(spark, [(1, "some words")]).withColumnsRenamed({"lang": "id", "source": "ids", "n_chars": "block"})
    assert len(run(clash, ranks)[1]) == 1


def test_another_pattern_is_refused(spark):
    with pytest.raises(ValueError, match="split by"):
        bpe.encode(docs_of(spark, [(1, "a b")]), {}, r"\p{L}+|\s+")


def test_words_that_hashes_may_confuse(spark, ranks, encoding, monkeypatch):
    texts = [(2 * k + n, word) for k, length in enumerate((1024, 4096)) for n, word in enumerate(mirrored(length))]
    texts += [(10, " ".join(mirrored(1024))), (11, "some other words")]
    _, got = run(docs_of(spark, texts).coalesce(1), ranks)
    assert sorted(map(tuple, got)) == expected(texts, encoding)
    # all words share the first hash: the second one tells them apart
    own = bpe.span_hashes

    def blunt(codes, start, stop, *base):
        return own(codes, start, stop, *base) if base else np.zeros(len(start), dtype=np.uint64)

    monkeypatch.setattr(bpe, "span_hashes", blunt)
    texts += list(enumerate(odd_texts(100), 20))
    _, got = run(docs_of(spark, texts).coalesce(1), ranks)
    assert sorted(map(tuple, got)) == expected(texts, encoding)


def test_words_are_encoded_again_when_the_cache_is_full(spark, ranks, encoding, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 500)
    texts = list(enumerate(odd_texts(200, seed=9)))
    _, got = run(docs_of(spark, texts), ranks, block_chars=300)
    assert sorted(map(tuple, got)) == expected(texts, encoding)
