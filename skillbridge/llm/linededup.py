"""Deletion of repeated runs of lines, found by winnowing.

A line counts without blanks at its ends; blank lines count for nothing and stay. A *run* is
a sequence of consecutive counting lines of one document. A line goes if it lies in a run of at least ``min_words`` words that also occurs earlier, in an earlier document or further
up; documents are ordered by id (NULL first) and then by a hash of their text.

Some facts make this linear and free of pairs. If a line lies in such a run, it lies in one
that cannot be shortened without losing the line or falling below ``min_words``; and a run
that cannot be shortened is either the shortest one *from* its first line or the shortest
one *up to* its last line. Only these two runs per line need to be looked at.

1. Every line is hashed. Of each shortest run the line with the least hash is selected: the
   *fingerprints*. Equal runs select equal lines, so a repeat always shares a fingerprint.
2. Runs whose fingerprint occurs once are dropped. The others are joined with the first position of
   their content, which is unique. (The first position of the fingerprint itself would not do: a line may
   first occur in another surrounding than the passage that is repeated.)
3. The lines of later runs go. Runs of one passage overlap, so their union is the match, extended both
   ways for as long as some earlier text holds it; there is no comparison line by line.

Only built-in functions. A content that fills a third of the table is no hot spot: classes
are counted by partial aggregates and joined back, where Spark can split a skewed key. Of a
document's lines only hashes are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillbridge.llm.store import same, unused, written

MIN_WORDS = 50
BLANKS = " \t\r"  # what separates words and is cut off at the ends of a line


def _row_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def counting_lines(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``doc, th, pos, h1, h2, words`` of every line that is not blank."""
    lines = docs.select(
        F.col(f"`{doc_id}`").alias("doc"),
        _row_hash(F.col(f"`{text}`")).alias("th"),
        F.posexplode(F.split(F.col(f"`{text}`"), "\n")).alias("pos", "line"),
    )
    line = F.btrim("line", F.lit(BLANKS))
    return (
        lines.withColumn("line", line)
        .filter(F.col("line") != "")
        .select(
            "doc",
            "th",
            "pos",
            F.xxhash64("line").alias("h1"),
            F.xxhash64(F.lit(7), F.col("line")).alias("h2"),
            F.regexp_count("line", F.lit(f"[^{BLANKS}]+")).cast("bigint").alias("words"),
        )
    )


def shortest_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """The shortest run from and up to each line: its ends, fingerprint and content."""
    doc = Window.partitionBy("doc", "th")
    # words up to and without the line: grows with the position, as every line has a word
    upto = F.sum("words").over(doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    ahead = doc.orderBy("before").rangeBetween(0, min_words - 1)
    behind = doc.orderBy("upto").rangeBetween(-(min_words - 1), 0)
    runs = []
    for frame in (ahead, behind):
        hashes = F.collect_list(F.struct("h1", "h2")).over(frame)
        runs.append(
            F.struct(
                F.min("pos").over(frame).alias("lo"),
                F.max("pos").over(frame).alias("hi"),
                F.sum("words").over(frame).alias("words"),
                F.min("h1").over(frame).alias("print"),
                F.xxhash64(hashes).alias("k1"),
                F.xxhash64(F.lit(7), hashes).alias("k2"),
            )
        )
    return (
        # identical rows share a key: count their lines once
        lines.dropDuplicates(["doc", "th", "pos"])
        .withColumn("upto", upto)
        .withColumn("before", F.col("upto") - F.col("words"))
        .select("doc", "th", *[r.alias(n) for r, n in zip(runs, ("ahead", "behind"), strict=True)])
        .select("doc", "th", F.explode(F.array_distinct(F.array("ahead", "behind"))).alias("run"))
        .select("doc", "th", "run.*")
        .filter(F.col("words") >= min_words)
    )


def repeated_runs(runs: DataFrame) -> DataFrame:
    """``doc, th, lo, hi`` of the runs that occur earlier."""
    prints = runs.groupBy("print").agg(F.count("*").alias("n"))
    recurring = prints.filter(F.col("n") > 1).select("print")
    matched = runs.join(recurring, "print", "left_semi")
    place = F.struct("doc", "th", "lo")
    first = matched.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    again = first.filter(F.col("n") > 1).select("k1", "k2", "first")
    later = matched.join(again, ["k1", "k2"]).filter(place > F.col("first"))
    return later.select("doc", "th", "lo", "hi")


def cut_masks(repeats: DataFrame) -> DataFrame:
    """Per document, up to its last line that goes, whether each line goes."""
    lines = repeats.select("doc", "th", F.explode(F.sequence("lo", "hi")).alias("pos")).distinct()
    last = F.lag("pos", 1, -1).over(Window.partitionBy("doc", "th").orderBy("pos"))
    steps = lines.withColumn("gap", F.col("pos") - last - 1)
    mask = F.flatten(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "gap"))),
            lambda s: F.concat(F.array_repeat(F.lit(False), s["gap"]), F.array(F.lit(True))),
        )
    )
    return steps.groupBy("doc", "th").agg(mask.alias("mask"))


def dedup_lines(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS
) -> DataFrame:
    """``docs`` with later repeated runs cut from ``text``, and ``lines_removed``.

    Rows equal in id and text are one document: they are cut alike and all stay. A NULL or
    empty text stays as it is, as do documents without repeats; an empty table gives an
    empty one. Texts of any length are read whole. Other columns are kept, whatever their names, but
    one named ``lines_removed`` is replaced.
    """
    columns = [c for c in docs.columns if c != "lines_removed"]
    runs = written(shortest_runs(counting_lines(docs, text, doc_id), min_words), "line-runs")
    doc, th, mask = unused(columns, "_doc", "_th", "_mask")
    gone = cut_masks(repeated_runs(runs)).toDF(doc, th, mask).hint("shuffle_hash")
    here = same(F.col(f"`{doc_id}`"), F.col(doc)) & (_row_hash(F.col(f"`{text}`")) == F.col(th))
    joined = docs.select(*[F.col(f"`{c}`") for c in columns]).join(gone, here, "left")
    parts = F.split(F.col(f"`{text}`"), "\n")
    blank = lambda line: F.btrim(line, F.lit(BLANKS)) == ""
    rest = F.filter(parts, lambda line, i: ~F.coalesce(F.get(mask, i), F.lit(False)) | blank(line))
    cut = F.col(mask).isNotNull()
    return joined.select(
        *[
            F.when(cut, F.array_join(rest, "\n")).otherwise(F.col(f"`{c}`")).alias(c)
            if c == text
            else F.col(f"`{c}`")
            for c in columns
        ],
        F.when(cut, F.size(parts) - F.size(rest)).otherwise(0).cast("bigint").alias("lines_removed"),
    )


def oracle(min_words: int = MIN_WORDS) -> str:
    """DuckDB SQL for the query over ``documents``: all repeats by direct comparison of runs."""
    blanks = "' ' || chr(9) || chr(13)"
    return f"""
WITH parts AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), trimmed AS (
  SELECT doc_id, pos, line, trim(line, {blanks}) AS t FROM parts
), counted AS (
  SELECT doc_id, pos, t, len(regexp_extract_all(t, '[^ \\t\\r]+')) AS words
  FROM trimmed WHERE t <> ''
), summed AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM counted
), placed AS (
  SELECT *, upto - words AS before FROM summed
), runs AS (
  SELECT doc_id, min(pos) OVER a AS lo, max(pos) OVER a AS hi, sum(words) OVER a AS w,
         list(t) OVER a AS content
  FROM placed WINDOW a AS (PARTITION BY doc_id ORDER BY before
                           RANGE BETWEEN CURRENT ROW AND {min_words - 1} FOLLOWING)
  UNION
  SELECT doc_id, min(pos) OVER b, max(pos) OVER b, sum(words) OVER b, list(t) OVER b
  FROM placed WINDOW b AS (PARTITION BY doc_id ORDER BY upto
                           RANGE BETWEEN {min_words - 1} PRECEDING AND CURRENT ROW)
), ranked AS (
  SELECT doc_id, lo, hi, row_number() OVER (PARTITION BY content ORDER BY doc_id, lo) AS nth
  FROM runs WHERE w >= {min_words}
), gone AS (
  SELECT DISTINCT p.doc_id, p.pos FROM placed p JOIN ranked r
    ON p.doc_id = r.doc_id AND p.pos BETWEEN r.lo AND r.hi WHERE r.nth > 1
), rest AS (
  SELECT q.doc_id, count(g.pos) AS lines_removed,
         string_agg(q.line, chr(10) ORDER BY q.pos) FILTER (WHERE g.pos IS NULL) AS kept
  FROM parts q LEFT JOIN gone g ON q.doc_id = g.doc_id AND q.pos = g.pos GROUP BY q.doc_id
)
SELECT d.doc_id, CASE WHEN r.lines_removed > 0 THEN coalesce(r.kept, '') ELSE d.text END AS text,
       coalesce(r.lines_removed, 0)::BIGINT AS lines_removed
FROM documents d LEFT JOIN rest r ON d.doc_id = r.doc_id"""
