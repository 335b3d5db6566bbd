"""Chat formatting by multi-party perspective rotation (operator 4), built-in functions only.

Every participant of a dialogue is in turn the assistant: their turns are rendered as assistant turns and are the training
targets, all others appear as named users. System turns frame the dialogue in every perspective and are no participant.

A rendering comes in parts of PART_TURNS turns, counted in the order of the conversation, so that a conversation of any length
never meets in one row. A part carries its place in the whole rendering (start) and its target spans as [begin, end) pairs in
code points of the part; the parts of a perspective concatenate to the whole rendering.

The turns of a part are gathered once, with running lengths that no perspective changes; a perspective differs from them by a
constant for each of its own turns, so places and spans follow without walking the part again. Only slim tables of parts and
participants meet per conversation; texts are shuffled by conversation and part.

Headers cannot be forged: in texts a marker `<|` gets a backslash after its `<` (one more if there are some), and in names
backslashes, bars and line breaks are written as escapes.

`perspectives` starts jobs when it is called, and the table that it stages is deleted as `plans.staging` says.

Defined edge cases: a null role is a participant without a name (perspective null, header `<|user|>`), told from any name; a
null text renders as empty; null turns come first; turns with equal numbers follow each other by role (null first), then
text; repeated rows are repeated turns; texts of any length are rendered whole; a conversation with only system turns has no
participant and gives no row; null conv_ids are one conversation; other columns never enter; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import staged

PART_TURNS = 256
SYSTEM = "system"
ASSISTANT_HEAD = "<|assistant|>\n"


def escaped_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*\|)", r"<\\$1")


def escaped_name(name: Column) -> Column:
    out = F.replace(name, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("|"), F.lit("\\p")), F.lit("\n"), F.lit("\\n"))


def _user_head(role: Column) -> Column:
    return F.when(role.isNull(), "<|user|>\n").otherwise(F.concat(F.lit("<|user name="), escaped_name(role), F.lit("|>\n")))


def _on(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def in_parts(df: DataFrame) -> DataFrame:
    """conv_id, part, ts (its turns in order: pos, role, head, body, at), length. Staged.

    Rows are counted per block of turn numbers first, then inside the blocks.
    """
    turns = df.select("conv_id", "turn", "role", escaped_text(F.coalesce("text", F.lit(""))).alias("body"))
    turns = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / PART_TURNS).cast("long"), F.lit(-(1 << 62))))
    sizes = turns.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "body")
    rows = turns.withColumn("k", F.row_number().over(inside)).join(shift, _on("conv_id", "_c") & (F.col("block") == F.col("_b")))
    head = F.when(F.col("role") == SYSTEM, "<|system|>\n").otherwise(_user_head(F.col("role")))
    pos = F.col("ahead") + F.col("k") - 1
    rows = rows.select("conv_id", F.floor(pos / PART_TURNS).cast("long").alias("part"), pos.alias("pos"), "role", head.alias("head"), "body")
    size = F.length("head") + F.length("body") + 1
    upto = Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(size).over(upto), F.lit(0)).cast("int")).withColumn("size", size)
    turn = F.struct("pos", "role", "head", "body", "at")
    return staged(rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(turn)).alias("ts"), F.sum("size").alias("length")), "chat-parts")


def perspectives(df: DataFrame) -> DataFrame:
    """conv_id, perspective, part, n_turns, start, text, spans (array of struct begin, end)."""
    parts = in_parts(df)
    own = parts.select("conv_id", "part", F.explode("ts.role").alias("perspective")).filter(~F.col("perspective").eqNullSafe(F.lit(SYSTEM)))
    own = own.groupBy("conv_id", "part", "perspective").agg(F.count(F.lit(1)).alias("n_own"))
    people = own.select(F.col("conv_id").alias("_c"), "perspective").distinct()
    less = F.lit(len(ASSISTANT_HEAD)) - F.length(_user_head(F.col("perspective")))
    frame = parts.select("conv_id", "part", "length").join(people, _on("conv_id", "_c")).drop("_c").withColumn("less", less)
    own = own.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), F.col("perspective").alias("_r"), "n_own")
    frame = frame.join(own, _on("conv_id", "_c") & (F.col("part") == F.col("_p")) & _on("perspective", "_r"), "left")
    chars = F.col("length") + F.col("less") * F.coalesce("n_own", F.lit(0))
    ahead = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    frame = frame.withColumn("start", F.coalesce(F.sum(chars).over(ahead), F.lit(0)).cast("long"))
    frame = frame.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), "perspective", "less", "start")
    seen = parts.join(frame, _on("conv_id", "_c") & (F.col("part") == F.col("_p")))
    mine = lambda t: t["role"].eqNullSafe(F.col("perspective"))
    begin = lambda t, k: t["at"] + k * F.col("less") + len(ASSISTANT_HEAD)
    spans = F.transform(F.filter("ts", mine), lambda t, k: F.struct(begin(t, k).alias("begin"), (begin(t, k) + F.length(t["body"]) + 1).alias("end")))
    text = F.array_join(F.transform("ts", lambda t: F.concat(F.when(mine(t), ASSISTANT_HEAD).otherwise(t["head"]), t["body"], F.lit("\n"))), "")
    return seen.select("conv_id", "perspective", "part", F.size("ts").cast("long").alias("n_turns"), text.alias("text"), spans.alias("spans"), "start")


def perspective_report(df: DataFrame) -> DataFrame:
    """Digest of every part: sizes, md5 of the rendering, and the target spans written as `begin-end` pairs."""
    p = perspectives(df)
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["begin"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    target = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return p.select("conv_id", "perspective", "part", "n_turns", "start", F.length("text").cast("long").alias("n_chars"), target.alias("target_chars"), F.md5("text").alias("text_md5"), spans.alias("spans"))


SQL = rf"""
WITH t AS (SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '<(\\*\|)', '<\\\1', 'g') AS text,
  (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text) - 1) // {PART_TURNS} AS part FROM conversations),
p AS (SELECT DISTINCT conv_id AS c, role AS perspective FROM t WHERE role IS DISTINCT FROM '{SYSTEM}'),
s AS (SELECT t.*, perspective, role IS NOT DISTINCT FROM perspective AS mine, CASE WHEN role = '{SYSTEM}' THEN '<|system|>'
  WHEN role IS NOT DISTINCT FROM perspective THEN '<|assistant|>' WHEN role IS NULL THEN '<|user|>'
  ELSE '<|user name=' || replace(replace(replace(role, '\', '\\'), '|', '\p'), chr(10), '\n') || '|>' END || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.c),
w AS (SELECT *, row_number() OVER g AS k, coalesce(sum(length(head) + length(text) + 1) OVER (g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM s WINDOW g AS (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, role NULLS FIRST, text)),
r AS (SELECT conv_id, perspective, part, count(*) AS n_turns, string_agg(head || text || chr(10), '' ORDER BY k) AS body,
  coalesce(sum(length(text) + 1) FILTER (mine), 0)::BIGINT AS target_chars,
  coalesce(string_agg((a + length(head))::BIGINT || '-' || (a + length(head) + length(text) + 1)::BIGINT, ',' ORDER BY k) FILTER (mine), '') AS spans
  FROM w GROUP BY conv_id, perspective, part)
SELECT conv_id, perspective, part, n_turns::BIGINT AS n_turns,
  coalesce(sum(length(body)) OVER (PARTITION BY conv_id, perspective ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
  length(body)::BIGINT AS n_chars, target_chars, md5(body) AS text_md5, spans FROM r"""
