"""Toxicity by classifier chains.

A chain predicts its categories one after the other with linear models over words and word
beginnings. The model of a category also sees the probabilities of the categories before it.
While fitting, those come from models that have not seen the document (out of fold), as they
will when the chain meets new documents.

The fit uses a bounded sample of labelled documents (``SAMPLE``), for which Spark counts and
selects features; scoring covers every document and is done where its text lies.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillbridge.llm.linear import Rows, fit_logistic, sigmoid
from skillbridge.llm.spans import Texts, chunks, span_hashes, spans
from skillbridge.llm.store import small_batches

SAMPLE = 20_000  # labelled documents that the fit uses at most
FEATURES = 20_000  # features that a chain uses at most
MIN_DOCS = 5  # documents of the sample that a feature must occur in
FOLDS = 5
BEGINNINGS = (4, 5, 6, 7, 8)  # bytes of a longer word that are a feature by themselves
LEVELS = (1, 2, 4)  # a word or beginning that occurs so often in a text is a feature each
ASSOCIATED = 30.0  # least chi-square of a feature with a category
THRESHOLD = 0.4
NOTHING_KNOWN = -14.0  # intercept of a model without rows

_WORDLIKE = np.zeros(256, dtype=bool)
_WORDLIKE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEED = np.uint64(0xC2B2AE3D27D4EB4F)


def terms(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and beginning, its low two bits 0, and the number of its text."""
    found = spans(texts, _WORDLIKE)
    data = _LOWER[texts.data]
    hashes, text = [span_hashes(data, found.start, found.stop)], [found.text]
    for size in BEGINNINGS:
        longer = found.stop - found.start > size
        a = found.start[longer]
        hashes.append(span_hashes(data, a, a + size, _SEED))
        text.append(found.text[longer])
    return np.concatenate(hashes) & ~np.uint64(3), np.concatenate(text)


def counted(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of each text, with how often they occur; in order of text."""
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return hashes[first], text[first], np.diff(np.append(first, len(text)))


def features(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A feature for each level that a term's count reaches: its number is in the low bits."""
    hashes, text, count = counted(hashes, text)
    some = [(hashes[count >= n] | np.uint64(k), text[count >= n]) for k, n in enumerate(LEVELS)]
    return np.concatenate([s[0] for s in some]), np.concatenate([s[1] for s in some])


@dataclass
class Chain:
    """Fitted models: column ``k`` of ``weights`` and row ``k`` of ``earlier`` are category ``k``'s."""

    categories: tuple[str, ...]
    known: np.ndarray  # hashes of the features, in order
    weights: np.ndarray
    earlier: np.ndarray
    bias: np.ndarray

    def __post_init__(self) -> None:
        # by term: the weights of its levels added up, so that a count selects one row
        self.terms, term = np.unique(self.known & ~np.uint64(3), return_inverse=True)
        by_level = np.zeros((len(self.terms), len(LEVELS), len(self.categories)))
        by_level[term, (self.known & np.uint64(3)).astype(np.int64)] = self.weights
        self.by_level = np.cumsum(by_level, axis=1)

    def probabilities(self, texts: Texts) -> np.ndarray:
        hashes, text = terms(texts)
        score = np.zeros((len(texts), len(self.categories)))
        if len(self.terms) and len(hashes):
            at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
            hit = self.terms[at] == hashes
            cell, count = np.unique(text[hit] * len(self.terms) + at[hit], return_counts=True)
            text, at = cell // len(self.terms), cell % len(self.terms)
            level = np.searchsorted(LEVELS, count, side="right") - 1
            for k in range(score.shape[1]):
                score[:, k] = np.bincount(text, weights=self.by_level[at, level, k], minlength=len(texts))
        out = np.zeros_like(score)
        for k in range(score.shape[1]):
            out[:, k] = sigmoid(score[:, k] + out[:, :k] @ self.earlier[k, :k] + self.bias[k])
        return out


def sample_of(
    docs: DataFrame, labels: DataFrame, categories: Sequence[str], text: str, doc_id: str, size: int
) -> DataFrame:
    """``id, fold, text`` and the categories of at most ``size`` labelled documents.

    Ids are taken in the order of a hash. Labels that are NULL or not 0 or 1 count as
    missing, documents that lack one are left out; a repeated id has its greatest label.
    """
    ids = labels.select(
        F.col(f"`{doc_id}`").alias("id"),
        *[F.when(F.col(f"`{c}`").isin(0, 1), F.col(f"`{c}`")).cast("int").alias(c) for c in categories],
    )
    ids = ids.groupBy("id").agg(*[F.max(c).alias(c) for c in categories]).dropna()
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(size)
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    # at most `size` ids, so they may be sent to all tasks
    sample = texts.join(F.broadcast(ids), "id").groupBy("id", *categories).agg(F.min("text").alias("text"))
    return sample.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))


def _feature_rows(batches: Iterator[pa.RecordBatch], known=None) -> Iterator[pa.RecordBatch]:
    """Distinct features of each row, as an array; only known ones, if given."""
    for batch in batches:
        names = batch.schema.names
        for texts in chunks(batch.column(names.index("text"))):
            hashes, text = features(*terms(texts))
            if known is not None:
                at = np.minimum(np.searchsorted(known.value, hashes), len(known.value) - 1)
                hit = known.value[at] == hashes
                hashes, text = hashes[hit], text[hit]
            order = np.lexsort((hashes, text))
            hashes, text = hashes[order], text[order]
            ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(texts)))])
            part = batch.slice(texts.first, len(texts))
            columns = [part.column(i) for i, n in enumerate(names) if n != "text"]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*columns, lists], [*[n for n in names if n != "text"], "features"])


def fit_chain(
    docs: DataFrame,
    labels: DataFrame,
    categories: Sequence[str],
    text: str = "text",
    doc_id: str = "doc_id",
    sample: int = SAMPLE,
) -> Chain:
    """A chain for the 0/1 columns ``categories`` of ``labels``, in that order.

    Features are chosen by chi-square against any of the categories. With one class only, a category's
    probability is its smoothed share; without labelled documents nothing is predicted, and it is 0
    (to a millionth).
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = sample_of(docs, labels, categories, text, doc_id, sample)
    head = "id {}, {}, fold int".format(
        rows.schema["id"].dataType.simpleString(), ", ".join(f"`{c}` int" for c in categories)
    )
    rows = rows.select("id", *categories, "fold", "text").persist()
    try:
        total = rows.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in categories]).first()
        n = total["n"]
        each = rows.mapInArrow(_feature_rows, f"{head}, features array<long>")
        counts = (
            each.select(F.explode("features").alias("feature"), *categories)
            .groupBy("feature")
            .agg(F.count("*").alias("df"), *[F.sum(c).alias(c) for c in categories])
            .filter(F.col("df") >= MIN_DOCS)
        )
        chi = [F.lit(0.0)]
        for c in categories:
            share = (total[c] or 0) / n if n else 0.0
            if 0.0 < share < 1.0:
                want = F.col("df") * share
                other = F.col("df") * (1 - share)
                chi.append(F.pow(F.col(c) - want, 2) * (1 / want + 1 / other))
        score = F.greatest(*chi, F.lit(0.0))
        chosen = counts.select("feature", score.alias("score")).filter(F.col("score") > ASSOCIATED)
        chosen = chosen.orderBy(F.desc("score"), "feature").limit(FEATURES).toPandas()
        known = np.sort(chosen["feature"].to_numpy(np.int64).view(np.uint64))
        if not len(known):
            known = np.zeros(1, dtype=np.uint64)
        sent = spark.sparkContext.broadcast(known)
        fitted = rows.mapInArrow(lambda b: _feature_rows(b, sent), f"{head}, features array<long>")
        found = fitted.orderBy(F.xxhash64("id"), "id").toArrow()
    finally:
        rows.unpersist()
    lists = found["features"].combine_chunks()
    hashes = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    matrix = Rows(np.searchsorted(known, hashes).astype(np.int32), np.cumsum(sizes, dtype=np.int64), len(known))
    del lists, hashes
    fold = found["fold"].to_numpy()
    truth = np.array([found[c].to_numpy() for c in categories], dtype=float).T.reshape(n, len(categories))
    return _fit(tuple(categories), known, matrix, truth, fold)


def _fit(categories: tuple[str, ...], known: np.ndarray, matrix: Rows, truth: np.ndarray, fold: np.ndarray) -> Chain:
    width = len(categories)
    weights, earlier, bias = np.zeros((len(known), width)), np.zeros((width, width)), np.full(width, NOTHING_KNOWN)
    if not len(truth):
        return Chain(categories, known, weights, earlier, bias)
    unseen = np.zeros_like(truth)  # out-of-fold probabilities
    row = matrix.row_of()
    for k in range(width):
        y = truth[:, k]
        weights[:, k], earlier[k, :k], bias[k] = fit_logistic(matrix, unseen[:, :k], y)
        if k + 1 == width:
            break
        for f in range(FOLDS):
            out = fold == f
            w, u, b = fit_logistic(matrix.take(~out), unseen[~out, :k], y[~out])
            score = np.bincount(row, weights=w[matrix.cols], minlength=len(y)) + unseen[:, :k] @ u + b
            unseen[out, k] = sigmoid(score[out])
    return Chain(categories, known, weights, earlier, bias)


def score(docs: DataFrame, chain: Chain, text: str = "text", prefix: str = "p_") -> DataFrame:
    """``docs`` with a probability for each category, where the rows lie.

    A NULL or empty text has no features and gets the probabilities that the intercepts
    give; repeated rows get equal ones. Texts of any length are scored whole. Columns that bear a new
    column's name are replaced; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    # plain arrays, as executors need not have the package to read a broadcast
    sent = spark.sparkContext.broadcast((chain.categories, chain.known, chain.weights, chain.earlier, chain.bias))
    new = [prefix + c for c in chain.categories]
    names = [c for c in docs.columns if c not in new]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names]

    def run(batches):
        model = Chain(*sent.value)
        for batch in batches:
            at = batch.schema.names.index(text)
            for texts in chunks(batch.column(at)):
                p = model.probabilities(texts)
                part = batch.slice(texts.first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *[pa.array(p[:, k].copy()) for k in range(p.shape[1])]], [*names, *new]
                )

    schema = ", ".join([*fields, *[f"`{c}` double" for c in new]])
    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


def label_categories(labels: DataFrame) -> DataFrame:
    """The table ``labels`` as categories of a chain: ``poor`` (quality 0) and ``toxic``."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("poor"), "toxic")


CATEGORIES = ("poor", "toxic")


def remove_toxic(
    docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """``docs`` without those whose probability of ``toxic`` reaches ``threshold``.

    All columns are kept, whatever their names; NULL and empty texts are as toxic as the intercepts say.
    """
    chain = fit_chain(docs, label_categories(labels), CATEGORIES, text)
    prefix = "_p_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    scored = score(docs, chain, text, prefix=prefix).filter(F.col(f"{prefix}toxic") < threshold)
    return scored.select(*[F.col(f"`{c}`") for c in docs.columns])
