"""From ranked hits to the context, the sources and the prompt of an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillbridge.functions.text import (
    CONTEXT_SEPARATOR,
    PROMPT_TEMPLATE,
    STANDING_QUESTION,
    fill_template,
)


def _ranked(*columns: str) -> Column:
    # a query has k hits at most, so the list is short whatever the corpus holds
    return F.array_sort(F.collect_list(F.struct("rk", *columns)))


def stuff_context(hits: DataFrame, text: str = "text") -> DataFrame:
    """``(qid, context)``: the hit texts in rank order, joined by a blank line."""
    texts = F.transform(_ranked(text), lambda h: h[text])
    return hits.groupBy("qid").agg(F.array_join(texts, CONTEXT_SEPARATOR).alias("context"))


def source_docs(hits: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """``(qid, sources)``: the ids behind an answer in rank order."""
    ids = F.transform(_ranked(id_col), lambda h: h[id_col])
    return hits.groupBy("qid").agg(ids.alias("sources"))


def answer_inputs(hits: DataFrame, id_col: str = "vec_id", text: str = "text") -> DataFrame:
    """Context and sources of each query in one pass over its hits."""
    return (
        hits.groupBy("qid")
        .agg(_ranked(id_col, text).alias("h"))
        .select(
            "qid",
            F.array_join(F.transform("h", lambda h: h[text]), CONTEXT_SEPARATOR).alias("context"),
            F.transform("h", lambda h: h[id_col]).alias("sources"),
        )
    )


def build_prompts(
    contexts: DataFrame,
    question: str | Column = STANDING_QUESTION,
    template: str = PROMPT_TEMPLATE,
) -> DataFrame:
    """Add ``prompt``: the template with context and question filled in."""
    asked = F.lit(question) if isinstance(question, str) else question
    return contexts.withColumn(
        "prompt", fill_template(template, context=F.col("context"), question=asked)
    )
