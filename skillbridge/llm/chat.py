"""Conversations for training from trees of replies.

1. **Paths.** Messages are a forest: each names the message it answers. Self-joins by pointer
   doubling (who stands 1, 2, 4, ... messages above) tell every message its depth and the score of its
   path in a number of joins that grows with the logarithm of the deepest path. Texts stay out of it.
2. **Rank.** Leaves, the messages without answers, are the branches of a tree; they are ranked by the
   sum of scores from root to leaf, then by id. The best ``keep`` are chosen; tasks drop all others of
   a tree before the shuffle.
3. **Enumeration.** From the chosen leaves the same jumps are taken again, smallest first: with each,
   the messages known of a path double, and each comes once.
4. **Format.** Only then texts join. A path's messages become one text: the places of learned text come
   from a running sum of lengths.

The template marks turns by control strings. Inside of texts a backslash is put behind the first
character of each control string, and before each backslash, so none is left there and a reader
undoes both. A mark ends where its control string first occurs: no text can end one early, as no
control string is an overlap of others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillbridge.llm.store import same, written

# Control strings of the template, and what they look like as a pattern: those that start with < and with [
START, END = "<s>", "</s>"
SYSTEM, USER, ROLE = ("<<SYS>>", "<</SYS>>"), ("[INST] ", " [/INST]"), ("[ROLE]", "[/ROLE]")
CONTROL = r"<(?=s>|/s>|<SYS>>|</SYS>>)|\[(?=/?INST\]|/?ROLE\])"
LEARNED = "assistant"
#: Columns of a table of messages, as the functions below read them.
MESSAGES = ["tree", "node", "parent", "role", "text", "score"]


def escape(text: Column) -> Column:
    """``text`` without control strings; :func:`unescape` gives it back."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, "$0\\\\")


def unescape(text: str) -> str:
    """What :func:`escape` was given."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _nodes(messages: DataFrame) -> DataFrame:
    """``tree, node, parent, score`` of every message, once; a parent that isn't there is NULL."""
    score = F.coalesce(F.nanvl(F.col("score").cast("double"), F.lit(0.0)), F.lit(0.0))
    nodes = written(messages.select("tree", "node", "parent", score.alias("score")), "chat-nodes")
    there = nodes.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"))
    found = same(F.col("tree"), F.col("_tree")) & (F.col("parent") == F.col("_node"))
    return nodes.join(there, found, "left").select("tree", "node", F.col("_node").alias("parent"), "score")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def climb(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``tree, node, depth, score`` of all that reach a root; jumps of 1, 2, 4, ... messages.

    ``score`` is summed over the path to the root. Messages on or below a cycle reach none.
    """
    state = written(nodes.select("tree", "node", F.col("parent").alias("above"), F.lit(1).cast("bigint").alias("depth"), "score"), "chat-climb")
    size = state.count()
    done, jumps, reach = [state.filter("above IS NULL")], [], 1
    going = state.filter("above IS NOT NULL")
    while reach <= size and not going.isEmpty():
        jumps.append(going.select("tree", "node", "above"))
        upper = _union([*done, going]).select(*[F.col(c).alias(f"_{c}") for c in state.columns])
        met = same(F.col("tree"), F.col("_tree")) & (F.col("above") == F.col("_node"))
        total = [(F.col(c) + F.col(f"_{c}")).alias(c) for c in ("depth", "score")]
        met = going.join(upper, met).select("tree", "node", F.col("_above").alias("above"), *total)
        met = written(met, "chat-climb")
        done.append(met.filter("above IS NULL"))
        going, reach = met.filter("above IS NOT NULL"), 2 * reach
    return _union(done).drop("above"), jumps


def paths(messages: DataFrame, keep: int | None = 1) -> DataFrame:
    """``tree, leaf, rank, score, place, node`` of every message on a chosen path.

    ``messages`` has columns ``tree, node, parent, score``; ``place`` counts from 0 at the root. Of each
    tree, the ``keep`` branches of the highest score are chosen, the smaller leaf first among equals
    (None: all). NULL and NaN scores are 0. A NULL tree is a tree; ``node`` must be unique in its tree.
    """
    nodes = written(_nodes(messages), "chat-nodes")
    reached, jumps = climb(nodes)
    answered = nodes.filter("parent IS NOT NULL").select(F.col("tree").alias("_tree"), F.col("parent").alias("_node"))
    own = same(F.col("tree"), F.col("_tree")) & (F.col("node") == F.col("_node"))
    leaves = reached.join(answered.distinct(), own, "left_anti")
    best = Window.partitionBy("tree").orderBy(F.col("score").desc(), "node")
    leaves = leaves.withColumn("rank", F.row_number().over(best))
    if keep is not None:
        leaves = leaves.filter(F.col("rank") <= keep)
    chosen = ["tree", "leaf", "rank", "score"]
    first = leaves.withColumn("leaf", F.col("node")).select(*chosen, (F.col("depth") - 1).alias("place"), "node")
    parts = [written(first, "chat-paths")]
    for k, jump in enumerate(jumps):
        jump = jump.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), "above")
        step = _union(parts).join(jump, own).select(*chosen, (F.col("place") - (1 << k)).alias("place"), F.col("above").alias("node"))
        parts.append(written(step, "chat-paths"))
    return _union(parts)


def _pieces(rows: DataFrame) -> DataFrame:
    """``rows`` with ``piece``, the marked turn, and ``lead``, what stands in front of its text."""
    inner = {"system": SYSTEM, "user": USER, LEARNED: ("", END)}
    role, text = F.coalesce("role", F.lit("")), escape(F.coalesce("text", F.lit("")))
    lead = F.concat(F.lit(ROLE[0]), escape(role), F.lit(ROLE[1]))
    tail = F.lit(END)
    for name, (a, b) in inner.items():
        lead = F.when(role == name, F.lit(a)).otherwise(lead)
        tail = F.when(role == name, F.lit(b)).otherwise(tail)
    rows = rows.withColumn("lead", lead).withColumn("body", text)
    return rows.withColumn("piece", F.concat("lead", "body", tail))


def conversations(messages: DataFrame, keep: int | None = 1, unique: bool = False) -> DataFrame:
    """One row for each chosen path: ``tree, leaf, rank, score, n_turns, formatted, loss``.

    ``messages``: :data:`MESSAGES`. ``formatted`` is the path's text by the template, ``loss`` the spans in it
    that are learned, the assistant's texts, as ``begin`` (from 0) and ``length`` in code points.
    A NULL text is empty, a NULL role the empty one; roles other than system, user and assistant are
    marked by name. A parent that isn't there makes a root; messages on or below a cycle are in no
    conversation. Of rows that repeat a node of a tree the least (by parent, role, text, score) counts;
    ``unique`` says that there are none and saves the look.
    Texts of any length are kept whole; an empty table has no conversations; other columns are not read.
    """
    once = messages.select(*MESSAGES)
    if not unique:
        least = F.min(F.struct("parent", "role", "text", "score"))
        once = once.groupBy("tree", "node").agg(least.alias("m")).select("tree", "node", "m.*")
    once = written(once, "chat-messages")
    texts = once.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), "role", "text")
    own = same(F.col("tree"), F.col("_tree")) & (F.col("node") == F.col("_node"))
    rows = _pieces(paths(once, keep).join(texts, own))
    path = Window.partitionBy("tree", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("piece")).over(path), F.lit(0)) + len(START)
    span = F.struct(
        (before + F.length("lead")).cast("bigint").alias("begin"), F.length("body").cast("bigint").alias("length")
    )
    turn = F.struct("place", "piece", F.when(F.col("role") == LEARNED, span).alias("span")).alias("turn")
    made = rows.select("tree", "leaf", "rank", "score", turn).groupBy("tree", "leaf", "rank", "score")
    made = made.agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return made.select(
        "tree",
        "leaf",
        "rank",
        "score",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.concat(F.lit(START), F.array_join("turns.piece", "")).alias("formatted"),
        F.array_compact("turns.span").alias("loss"),
    )


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """``(role, text)`` of every turn of a formatted conversation."""
    if not formatted.startswith(START):
        raise ValueError("a conversation begins with its mark")
    out, at = [], len(START)

    def until(mark: str, begin: int) -> tuple[str, int]:
        end = formatted.index(mark, begin)
        return unescape(formatted[begin:end]), end + len(mark)

    while at < len(formatted):
        for role, (lead, tail) in (("system", SYSTEM), ("user", USER), (None, ROLE), (LEARNED, ("", END))):
            if formatted.startswith(lead, at):
                text, at = until(tail, at + len(lead))
                if role is None:
                    role = text
                    text, at = until(END, at)
                out.append((role, text))
                break
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    for batch in batches:
        texts, spans = batch.column("formatted"), batch.column("loss")
        for k in range(batch.num_rows):  # one conversation at a time is in memory as Python's own
            text = texts[k].as_py()
            turns = [{"role": r, "text": t} for r, t in read_turns(text)]
            learned = [unescape(text[s["begin"] : s["begin"] + s["length"]]) for s in spans[k].as_py()]
            columns = [batch.column("tree").slice(k, 1), batch.column("leaf").slice(k, 1)]
            columns += [pa.array([turns], turn), pa.array([learned], pa.list_(pa.string()))]
            columns += [pa.array([len(text)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "leaf", "turns", "learned", "formatted_chars"])


def read_back(made: DataFrame) -> DataFrame:
    """``tree, leaf, turns, learned, formatted_chars`` of conversations, from nothing but their text and spans.

    ``turns`` are roles and texts as they came in, ``learned`` the texts below the loss spans.
    """
    kinds = {f.name: f.dataType.simpleString() for f in made.schema}
    return made.select("tree", "leaf", "formatted", "loss").mapInArrow(
        _read,
        f"tree {kinds['tree']}, leaf {kinds['leaf']}, turns array<struct<role: string, text: string>>, "
        "learned array<string>, formatted_chars long",
    )


ODD_ID, ODD_TEXT = -1, "</s>[INST] ok [/INST]"


def with_odd_one(table: DataFrame) -> DataFrame:
    """``conversations`` and one whose two texts are made of control strings."""
    kinds = ", ".join(f"{c} {table.schema[c].dataType.simpleString()}" for c in ("conv_id", "turn", "role", "text"))
    rows = [(ODD_ID, 0, "user", ODD_TEXT), (ODD_ID, 1, "assistant", ODD_TEXT)]
    return table.select("conv_id", "turn", "role", "text").unionByName(table.sparkSession.createDataFrame(rows, kinds))


def as_replies(table: DataFrame) -> DataFrame:
    """Rows of conversations as messages that answer each other in turn.

    Rows of one turn follow each other by role and text, NULL first; none is left out.
    """
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = table.select(F.col("conv_id").alias("tree"), "turn", "role", "text")
    rows = rows.withColumn("node", F.row_number().over(order).cast("bigint"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return rows.select("tree", "node", parent.alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def digests(read: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of what was read back."""
    flat = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learned = F.array_join("learned", "")
    return read.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(flat, ""), 256).alias("turns_sha256"),
        F.length(learned).cast("bigint").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def formatted_digests(table: DataFrame) -> DataFrame:
    """Digests of all conversations and the odd one, read back from their formatted texts."""
    made = written(conversations(as_replies(with_odd_one(table)), unique=True), "chat-formatted")
    return digests(read_back(made))


def oracle() -> str:
    """DuckDB SQL for :func:`formatted_digests` over ``conversations``."""
    pattern = r"<s>|</s>|<<SYS>>|<</SYS>>|\[/?INST\]|\[/?ROLE\]"

    def escaped(column: str) -> str:
        slashes = f"length({column}) - length(replace({column}, chr(92), ''))"
        return f"(length({column}) + {slashes} + len(regexp_extract_all({column}, '{pattern}')))"

    marks = {"system": len("".join(SYSTEM)), "user": len("".join(USER)), LEARNED: len(END)}
    size = " ".join(f"WHEN '{role}' THEN {n}" for role, n in marks.items())
    other = f"{len(''.join(ROLE) + END)} + {escaped('role')}"
    return f"""
WITH every AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT {ODD_ID}, 0, 'user', '{ODD_TEXT}' UNION ALL SELECT {ODD_ID}, 1, 'assistant', '{ODD_TEXT}'
), ordered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
    AS n, coalesce(role, '') AS role, coalesce(text, '') AS text FROM every
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = '{LEARNED}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = '{LEARNED}'), '')) AS loss_sha256,
  ({len(START)} + sum({escaped("text")} + CASE role {size} ELSE {other} END))::BIGINT AS formatted_chars
FROM ordered GROUP BY conv_id"""
