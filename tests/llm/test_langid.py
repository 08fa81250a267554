import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F
from rows import docs_of

from skillbridge.llm import langid, queries
from skillbridge.llm.spans import chunks


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    out = queries.op7_language_id(spark, sf).join(docs, "doc_id").toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]).all()
    held = out[out.held_out]
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() > 0.97
    assert out.score.between(0, 1).all()


def gram_sets(texts):
    """4-grams of each text, letter by letter."""
    out = []
    for text in texts:
        raw = (text or "").encode()
        plain = bytes(b if b >= 0x80 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in raw)
        plain = b" " + plain + b" "
        out.append({plain[k : k + 4] for k in range(len(plain) - 3) if 32 not in plain[k + 1 : k + 3]})
    return out


def test_grams_and_filters_lose_nothing():
    texts = ["Der die", None, "", "a", "ab", "été 12 x-y", "..", "the the THE"]
    for limit in (1, 1 << 20):
        for part in chunks(pa.array(texts), limit):
            gram, text = langid.grams(part)
            for n in range(len(part)):
                got = {int(g).to_bytes(4, "big") for g in gram[text == n]}
                assert got == gram_sets([texts[part.first + n]])[0]


def test_no_false_negatives_and_corrected_counts(spark):
    rows = [(k, f"{'ba be bi bo bu'.split()[k % 5]}{k:03d} nana lolo", "one" if k % 2 else "two") for k in range(60)]
    rows = [(i, t.replace("lolo", "mimi") if lang == "two" else t, lang) for i, t, lang in rows]
    docs = spark.createDataFrame([*rows, (90, None, "one"), (91, "text", None)], "doc_id long, text string, lang string")
    filters = langid.fit(docs)
    assert filters.languages == ["one", "two"]
    counts = {}
    for _, text, lang in rows:
        for g in gram_sets([text])[0]:
            counts[lang, g] = counts.get((lang, g), 0) + 1
    for (lang, g), n in counts.items():
        if n >= langid.MIN_DOCS:
            mask = int(filters.containing(np.array([int.from_bytes(g, "big")], dtype=np.uint64))[0])
            assert mask >> filters.languages.index(lang) & 1
    out = {r.doc_id: r.lang_pred for r in langid.predict(docs, filters).collect()}
    assert all(out[i] == lang for i, _, lang in rows) and out[90] == langid.UNKNOWN


def test_odd_tables(spark):
    docs = docs_of(spark, [(1, None), (2, ""), (3, "12 !?"), (4, "zz"), (4, "zz"), (None, "些 x"), (5, "y " * 50_000)])
    docs = docs.withColumnsRenamed({"source": "id", "n_chars": "score"})
    nothing = langid.fit(docs.filter("doc_id = 99"))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {langid.UNKNOWN}
    some = langid.fit(docs.withColumn("lang", F.lit("only")))
    out = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(docs, some).collect()]
    assert len(out) == 7 and {i for i, lang, _ in out if lang == langid.UNKNOWN} == {1, 2, 3}
    assert langid.predict(docs_of(spark, []), some).count() == 0
    with pytest.raises(ValueError):
        langid.fit(spark.range(70).selectExpr("'a text' AS text", "cast(id AS string) AS lang"))
