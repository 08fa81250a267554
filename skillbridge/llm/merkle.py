"""Merkle manifest of a table: a tree of digests per group, a tree over groups, proofs of rows.

A row is a leaf: the SHA-256 of its fields. Leaves of a group stand in one order; every
``fanout`` consecutive nodes have a parent, the digest of their digests, until one node is left,
the *subroot*. Subroots, in the order of the groups, have a tree of the same kind, whose top is
the *root*: it commits to all rows and their order.

1. **Places.** Rows are dealt by ranges of group and order and sorted there. A row's place in its
   group is its place in the range and the number of rows of the group in ranges before, so no
   group is ever in one task. Only counts per range and group are summed up.
2. **Slot pivot.** A parent's children have the same ``place div fanout``. Conditional aggregates
   spread them into ``fanout`` columns by ``place mod fanout``; the columns one after another are
   hashed. A parent has ``fanout`` children at most, so no key is hot.
3. **Proofs.** The same columns without the one of the child are its siblings. They go down the
   tree: a parent hands every child its own steps behind the child's. Level by level this is a
   join of unique keys on both sides, and leaves get theirs from their parent's columns.

Levels are written, an eighth of the rows each; the highest place tells how many there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillbridge.llm.store import same, written

FANOUT = 8
_ROW_BITS = 33  # of monotonically_increasing_id: rows within a partition


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after another; digests enter as hex text."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """Length in bytes, ``:`` and the value as text; ``-`` for NULL. No two rows look alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Digest of a row's fields. Texts are taken whole, however long."""
    return digest(*[field(v) for v in values])


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``place`` (from 0) and ``total`` within ``tree``, in the order of ``order``.

    Rows that the order leaves equal stand in any order among themselves.
    """
    salt = F.monotonically_increasing_id()
    dealt = rows.withColumn("_salt", salt).repartitionByRange("tree", *order, "_salt")
    dealt = dealt.sortWithinPartitions("tree", *order).drop("_salt")
    dealt = written(dealt.withColumn("_at", F.monotonically_increasing_id()), "merkle-order")
    at_range = F.shiftright("_at", _ROW_BITS)
    counts = dealt.groupBy(F.col("tree").alias("_tree"), at_range.alias("_range")).agg(
        F.min("_at").alias("_first"), F.count("*").alias("_n")
    )
    # a row for each range and group: as many as there are partitions and groups
    group = Window.partitionBy("_tree")
    before = F.sum("_n").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("total", F.sum("_n").over(group))
    here = same(F.col("tree"), F.col("_tree")) & (at_range == F.col("_range"))
    place = F.col("_at") - F.col("_first") + F.col("_before")
    return dealt.join(counts, here).select(*rows.columns, place.alias("place"), "total")


def _pivot(nodes: DataFrame, fanout: int, with_items: bool) -> DataFrame:
    """Parents of ``tree, total, place, digest``: children in columns, and their digest."""
    slot = F.pmod("place", F.lit(fanout))
    spread = [F.max(F.when(slot == s, F.col("digest"))).alias(f"c{s}") for s in range(fanout)]
    if with_items:
        spread += [
            F.any_value(F.when(slot == s, F.col("item")), ignoreNulls=True).alias(f"i{s}") for s in range(fanout)
        ]
    above = nodes.groupBy("tree", "total", F.expr(f"place div {fanout}").alias("place")).agg(*spread)
    return above.withColumn("digest", digest(*_or_empty(range(fanout))))


def _or_empty(slots) -> list[Column]:
    return [F.coalesce(F.col(f"c{s}"), F.lit("")) for s in slots]


def climb(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """Parents, level by level, and ``tree, digest, height`` of the tops."""
    most = nodes.agg(F.max("total")).first()[0] or 0
    levels: list[DataFrame] = []
    tops = [nodes.filter("total = 1").select("tree", "digest", F.lit(0).alias("height"))]
    below, width = nodes, 1
    while width < most:
        open_trees = below.filter(F.col("total") > width)
        made = written(_pivot(open_trees, fanout, with_items=not levels), f"merkle-level-{len(levels) + 1}")
        levels.append(made)
        width *= fanout
        done = made.filter(F.col("total") <= width)
        tops.append(done.select("tree", "digest", F.lit(len(levels)).alias("height")))
        below = made.select("tree", "total", "place", "digest")
    return levels, reduce(DataFrame.unionByName, tops)


def descend(nodes: DataFrame, levels: list[DataFrame], start: DataFrame, fanout: int) -> DataFrame:
    """``item, digest, steps`` and ``handed`` of all leaves of the trees in ``start``.

    ``start``: ``tree, height, steps, handed``. ``steps`` leads from a tree's top on,
    ``handed`` is given to every leaf as it is.
    """
    known = None
    for height in range(len(levels), 0, -1):
        tops = start.filter(F.col("height") == height).select("tree", F.lit(0).cast("bigint").alias("place"), "steps", "handed")
        known = tops if known is None else known.unionByName(tops)
        known = known.withColumnsRenamed({"tree": "_tree", "place": "_place"})
        level = levels[height - 1].drop("digest", "total")
        here = same(F.col("tree"), F.col("_tree")) & (F.col("place") == F.col("_place"))
        children = []
        for s in range(fanout):
            left = F.concat(F.lit(""), *_or_empty(range(s)))
            right = F.concat(F.lit(""), *_or_empty(range(s + 1, fanout)))
            child = [
                (F.col("place") * fanout + s).alias("place"),
                F.col(f"c{s}").alias("digest"),
                F.struct(left.alias("left"), right.alias("right")).alias("step"),
            ]
            child += [F.col(f"i{s}").alias("item")] if height == 1 else []
            children.append(F.when(F.col(f"c{s}").isNotNull(), F.struct(*child)))
        below = level.join(known, here).select("tree", "steps", "handed", F.inline(F.array_compact(F.array(*children))))
        steps = F.concat(F.array("step"), F.col("steps")).alias("steps")
        known = below.select("tree", "place", steps, "handed", *(["item", "digest"] if height == 1 else []))
    single = start.filter("height = 0").select(F.col("tree").alias("_tree"), "steps", "handed")
    alone = nodes.filter("total = 1").join(single, same(F.col("tree"), F.col("_tree")))
    alone = alone.select("item", "digest", "steps", "handed")
    return alone if known is None else known.select(*alone.columns).unionByName(alone)


def manifest(
    docs: DataFrame,
    fields: list[str],
    group: str = "lang",
    order: str = "doc_id",
    carry: list[str] | None = None,
    fanout: int = FANOUT,
) -> DataFrame:
    """One row for each row of ``docs``: ``carry`` (or ``order``), and its proof.

    ``leaf``, ``subroot`` and ``root`` are digests; ``steps`` is the proof: from the leaf's run
    to the root, what stands ``left`` and ``right`` of the own node among its siblings, as hex
    digests one after another. A run of one node is a step without siblings; a group of one row
    has its leaf as subroot, a table of one group its subroot as root, and a table of one row
    has no steps.

    NULLs are values of their own: in a field ``-``, as a group the first one, in the order
    first. Rows equal in the order stand by their leaves; repeated rows are leaves each. Empty
    texts are ``0:``, texts of any length are hashed whole. An empty table has no rows. Columns
    that are neither named in ``fields``, ``group`` nor ``order`` take no part, whatever their
    names; of carried ones, those named like an output are replaced by it.
    """
    outputs = ["leaf", "subroot", "root", "steps"]
    kept = [c for c in (carry or [order]) if c not in outputs]
    q = {c: F.col(f"`{c}`") for c in {*fields, group, order, *kept}}
    leaves = docs.select(
        q[group].alias("tree"),
        q[order].alias("rank"),
        leaf(*[q[c] for c in fields]).alias("digest"),
        F.struct(*[q[c].alias(f"f{n}") for n, c in enumerate(kept)]).alias("item"),
    )
    # written: dealing by ranges reads its input twice, and texts are to be hashed once
    nodes = written(placed(written(leaves, "merkle-leaves"), ["rank", "digest"]).drop("rank"), "merkle-leaves")
    levels, subroots = climb(nodes, fanout)
    upper = subroots.select(
        F.lit("").alias("tree"), F.struct("tree", "height").alias("item"), "digest", F.col("tree").alias("rank")
    )
    upper = written(placed(upper, ["rank"]).drop("rank"), "merkle-subroots")
    upper_levels, root = climb(upper, fanout)
    no_steps = F.array().cast("array<struct<left:string,right:string>>")
    top = root.select("tree", "height", no_steps.alias("steps"), F.struct(F.col("digest").alias("root")).alias("handed"))
    tops = descend(upper, upper_levels, top, fanout)
    start = tops.select(
        "item.tree", "item.height", "steps", F.struct(F.col("digest").alias("subroot"), "handed.root").alias("handed")
    )
    proofs = descend(nodes, levels, written(start, "merkle-starts"), fanout)
    return proofs.select(
        *[F.col(f"item.f{n}").alias(c) for n, c in enumerate(kept)],
        F.col("digest").alias("leaf"),
        "handed.subroot",
        "handed.root",
        "steps",
    )


def fold(leaf_digest: Column, steps: Column) -> Column:
    """The root that a leaf and the steps of a proof lead to."""
    return F.aggregate(steps, leaf_digest, lambda own, s: digest(s["left"], own, s["right"]))


def proof_digest(steps: Column) -> Column:
    """Digest of all siblings of a proof, from the leaf's run up, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def tamper_test(docs: DataFrame, every: int = 3) -> DataFrame:
    """Proofs of ``docs`` held against rows of which some were tampered with.

    Where ``every`` divides the CRC-32 of the id, the capitals A-Z of the text are lowered; a
    text without capitals (or NULL), and a NULL id, stay as they are and must verify.
    """
    chosen = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(every)) == 0, F.lit(False))
    lowered = leaf(*[F.col(c) for c in FIELDS[:-1]], F.translate("text", UPPER, LOWER))
    docs = docs.select(*FIELDS).withColumn("tampered", F.when(chosen, lowered))
    proofs = manifest(docs, FIELDS, carry=["doc_id", "tampered"])
    folded = fold(F.coalesce("tampered", "leaf"), F.col("steps"))
    out = proofs.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), folded.alias("folded_root")
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(every: int = 3, fanout: int = FANOUT) -> str:
    """DuckDB SQL for :func:`tamper_test` over ``documents``."""

    def text_of(column: str) -> str:
        value = f"CAST({column} AS VARCHAR)"
        return f"coalesce(CAST(strlen({value}) AS VARCHAR) || ':' || {value}, '-')"

    def leaf_of(text: str) -> str:
        return "sha256(" + " || ".join([*map(text_of, FIELDS[:-1]), text_of(text)]) + ")"

    bits = ", ".join(["-1"] * 8)
    crc = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
      string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, {bits}]))),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295::BIGINT)"""
    parents = f"""SELECT tree, k + 1, idx // {fanout}, (n + {fanout - 1}) // {fanout},
      sha256(string_agg(digest, '' ORDER BY idx))"""
    group = f"GROUP BY tree, k, n, idx // {fanout}"

    def runs(nodes: str) -> str:
        return f"""SELECT tree, k, idx // {fanout} AS parent, list(digest ORDER BY idx) AS digests
      FROM {nodes} WHERE n > 1 GROUP BY ALL"""

    def walk(walks: str, run: str, extra: str) -> str:
        own = f"CAST(w.idx % {fanout} AS INTEGER)"
        left, right = f"r.digests[:{own}]", f"r.digests[{own} + 2:]"
        return f"""SELECT {extra}, w.tree, w.k + 1, w.idx // {fanout}, (w.n + {fanout - 1}) // {fanout},
      sha256(array_to_string({left} || [w.folded] || {right}, '')), w.proof || array_to_string({left} || {right}, '')
      FROM {walks} w JOIN {run} r ON r.tree IS NOT DISTINCT FROM w.tree AND r.k = w.k AND r.parent = w.idx // {fanout}
      WHERE w.n > 1"""

    return f"""
WITH RECURSIVE hashed AS (
  SELECT *, {leaf_of("text")} AS leaf, {crc} % {every} = 0 AS chosen FROM documents
), tampered AS (
  SELECT *, CASE WHEN chosen THEN {leaf_of(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE leaf END AS bad FROM hashed
), placed AS (
  SELECT row_number() OVER () AS id, doc_id, lang, leaf, bad,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY lang) AS n
  FROM tampered
), nodes(tree, k, idx, n, digest) AS (
  SELECT lang, 0, idx, n, leaf FROM placed UNION ALL {parents} FROM nodes WHERE n > 1 {group}
), subroots AS (
  SELECT tree AS lang, digest, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS idx, count(*) OVER () AS n
  FROM nodes WHERE n = 1
), upper(tree, k, idx, n, digest) AS (
  SELECT 0, 0, idx, n, digest FROM subroots UNION ALL {parents} FROM upper WHERE n > 1 {group}
), runs AS ({runs("nodes")}), upper_runs AS ({runs("upper")}),
walks(id, tree, k, idx, n, folded, proof) AS (
  SELECT id, lang, 0, idx, n, bad, '' FROM placed UNION ALL {walk("walks", "runs", "w.id")}
), upper_walks(id, tree, k, idx, n, folded, proof) AS (
  SELECT w.id, 0, 0, s.idx, s.n, w.folded, w.proof
  FROM walks w JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.tree WHERE w.n = 1
  UNION ALL {walk("upper_walks", "upper_runs", "w.id")}
)
SELECT p.doc_id, p.leaf, s.digest AS subroot, u.digest AS root, sha256(w.proof) AS proof_sha256,
  w.folded AS folded_root, w.folded = u.digest AS verified
FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang
JOIN (SELECT * FROM upper_walks WHERE n = 1) w ON w.id = p.id, (SELECT digest FROM upper WHERE n = 1) u"""
