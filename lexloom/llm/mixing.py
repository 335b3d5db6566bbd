"""Mixing sources to target weights (operator 2), built-in functions only.

Sources get word targets by capped proportional sharing. Every source is cut into hash blocks; a permutation of the blocks
is consumed until the source's target is met (a second pass over the permutation serves targets above the source's size).
The consumed blocks form exact per-source quotas; a splitting tree halves the pool level by level, each half a uniform
draw without replacement (so the per-source counts of a node are multivariate hypergeometric), and every output shard then
takes its quota as a run of a fresh permutation of the source's blocks. Rows are shuffled inside their shard only.

Decisions reach the rows through a table of (source, block): which copies of a block are taken, and, for the one block that
straddles the target, the largest row hash whose rows are all taken and how many rows of the next hash. That table is
broadcast after its size has been counted; beyond PLAN_ROWS rows it is joined on source and block together, a key that cuts
the largest source into thousands of parts. Windows span blocks or sources, as many as these are, never documents.

The functions here start jobs when they are called; the tables that they stage are deleted as `plans.staging` says.

Defined edge cases: a null text has size 0; null source is a source of its own, ordered last; a row is hashed by its doc_id
and text, and of rows equal in both, in a source, as many are taken as the target asks for; sources of size 0 have target 0;
texts of any length count by their words; ties between hashes fall together, as equal rows do; other columns pass through
`mixed_documents` in one struct and never clash; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import hash60, numbered, packed, staged, text_of, unpacked, unstage, words_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
LEVELS = 3
MIN_BLOCKS, MAX_BLOCKS, DOCS_PER_BLOCK = 256, 8192, 65536
#: the block plan is broadcast up to this many rows (about 20 MB) and shuffle-joined beyond
PLAN_ROWS = 200_000


def source_targets(slim: DataFrame) -> DataFrame:
    """One row per source: source_size, target. Windows here span sources, not documents."""
    s = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    position = (F.row_number().over(order) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), position + 1)
    s = s.withColumn("weight", weight).withColumn("cap", CAP * F.col("source_size")).withColumn("total", SHARE * F.sum("source_size").over(everything))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("capped", F.col("cap") * rest <= (F.col("total") - before) * F.col("weight"))
    free = F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything)
    weights = F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0)).over(everything)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(free * F.col("weight") / weights)
    return s.select("source", "source_size", target.alias("target"))


def hashed(seed: int) -> Column:
    """Hash of a row's doc_id and text."""
    return hash60(F.lit(f"{seed}:d:"), text_of("doc_id"), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit(""))))


def _sized(df: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size, h of every row, staged."""
    return staged(df.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), hashed(seed).alias("h")), "mix-sizes")


def _same(a: str, b: str, *more: Column) -> Column:
    on = F.col(a).eqNullSafe(F.col(b))
    for c in more:
        on = on & c
    return on


def block_plan(slim: DataFrame, seed: int = 7) -> tuple[DataFrame, int]:
    """The number of blocks of a source, and one row per (source, block): source_size, target, whole copies taken, cut (largest
    row hash wholly inside the partial copy), edge and edge_rows (the next hash and how many of its rows are taken), shards."""
    src = source_targets(slim)
    n_blocks = min(max(-(-slim.count() // DOCS_PER_BLOCK), MIN_BLOCKS), MAX_BLOCKS)
    rows = slim.select("source", "size", "h", (F.col("h") % n_blocks).alias("block"))
    blocks = rows.groupBy("source", "block").agg(F.sum("size").alias("words"))
    blocks = staged(blocks.join(src.withColumnRenamed("source", "s2"), _same("source", "s2")).drop("s2"), "mix-blocks")
    name = lambda tag: hash60(F.lit(f"{seed}:{tag}:"), text_of("source"), F.lit(":"), F.col("block").cast("string"))
    permuted = Window.partitionBy("source").orderBy(name("b"), "block").rowsBetween(Window.unboundedPreceding, -1)
    units = blocks.withColumn("ahead", F.coalesce(F.sum("words").over(permuted), F.lit(0)))
    units = units.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(CAP - 1))))
    units = units.withColumn("start", F.col("ahead") + F.col("copy") * F.col("source_size")).filter("start < target")
    # The splitting tree: at every level each node's units fall into two halves of exact size.
    unit = lambda tag: hash60(F.lit(f"{seed}:{tag}:"), text_of("source"), F.lit(":"), F.col("block").cast("string"), F.lit(":"), F.col("copy").cast("string"))
    units = units.withColumn("node", F.lit(0))
    for level in range(LEVELS):
        n = F.count(F.lit(1)).over(Window.partitionBy("node"))
        at = F.row_number().over(Window.partitionBy("node").orderBy(unit(f"t{level}"), F.col("source").asc_nulls_last(), "block", "copy"))
        units = units.withColumn("node", 2 * F.col("node") + F.when(2 * at <= n, 0).otherwise(1))
    units = staged(units.select("source", "block", "words", "target", "copy", "start", "node"), "mix-units")
    quotas = units.groupBy("source", "node").agg(F.count(F.lit(1)).alias("quota"))
    upto = Window.partitionBy("source").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    quotas = quotas.select(F.col("source").alias("s2"), F.col("node").alias("shard"), F.sum("quota").over(upto).alias("last"), "quota")
    drawn = units.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(unit("p"), "block", "copy")))
    drawn = drawn.drop("node").join(quotas, _same("source", "s2", F.col("rank") <= F.col("last"), F.col("rank") > F.col("last") - F.col("quota")))
    drawn = drawn.withColumn("whole", F.col("start") + F.col("words") <= F.col("target"))
    # The straddling copy of a block takes rows in hash order while their middles lie before the target.
    part = drawn.filter("not whole").select(F.col("source").alias("s3"), F.col("block").alias("b3"), F.col("start").alias("begin"), F.col("target").alias("aim"))
    edge = rows.join(part, _same("source", "s3", F.col("block") == F.col("b3")))
    edge = edge.groupBy("source", "block", "h", "begin", "aim").agg(F.sum("size").alias("words"), F.max("size").alias("size"), F.count(F.lit(1)).alias("m"))
    sofar = F.sum("words").over(Window.partitionBy("source", "block").orderBy("h").rowsBetween(Window.unboundedPreceding, -1))
    left = F.col("aim") - F.col("begin") - F.coalesce(sofar, F.lit(0))
    fits = F.when(F.col("size") > 0, F.floor(left / F.col("size") + 0.5)).otherwise(F.when(left >= 0, F.col("m")).otherwise(0))
    edge = edge.withColumn("taken", F.greatest(F.least(fits, F.col("m")), F.lit(0)).cast("long")).filter("taken > 0")
    split = F.when(F.col("taken") < F.col("m"), F.struct("h", "taken"))
    cuts = edge.groupBy(F.col("source").alias("s3"), F.col("block").alias("b3")).agg(F.max(F.when(F.col("taken") == F.col("m"), F.col("h"))).alias("cut"), F.max(split).alias("edge"))
    plan = drawn.groupBy("source", "block").agg(
        F.count_if("whole").cast("int").alias("copies"),
        F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("shards"),
    )
    plan = plan.join(cuts, _same("source", "s3", F.col("block") == F.col("b3")), "left").select(F.col("source").alias("s2"), F.col("block").alias("b2"), "copies", "shards", "cut", F.col("edge.h").alias("edge"), F.col("edge.taken").alias("edge_rows"))
    every = blocks.select("source", "block", "source_size", "target").join(plan, _same("source", "s2", F.col("block") == F.col("b2")), "left").drop("s2", "b2")
    out = staged(every, "mix-plan")
    unstage(blocks, units)
    return out, n_blocks


def _decided(df: DataFrame, plan: DataFrame, n_blocks: int) -> DataFrame:
    """df (source, h and others) with one struct column `_m`: source_size, target, shards (one entry for each copy taken)."""
    fit = F.broadcast if plan.count() <= PLAN_ROWS else (lambda x: x)
    per = plan.select(F.col("source").alias("_s"), F.col("block").alias("_k"), F.struct("source_size", "target", "copies", "cut", "edge", "edge_rows", "shards").alias("_p"))
    got = df.join(fit(per), _same("source", "_s", F.col("h") % n_blocks == F.col("_k"))).drop("_s", "_k")
    # Of equal rows that straddle a target some are taken: only they are numbered.
    straddling = F.col("h") == F.col("_p.edge")
    sure = got.filter(~F.coalesce(straddling, F.lit(False))).withColumn("_at", F.lit(None).cast("long"))
    if plan.filter("edge is not null").limit(1).count():
        sure = sure.unionByName(numbered(got.filter(straddling), "h", "mix-edge"))
    more = (F.col("h") <= F.col("_p.cut")) | (F.col("_at") <= F.col("_p.edge_rows"))
    n = F.coalesce(F.col("_p.copies"), F.lit(0)) + F.when(more, 1).otherwise(0)
    shards = F.transform(F.slice(F.coalesce(F.col("_p.shards"), F.array().cast("array<struct<copy:int,shard:int>>")), F.lit(1), n), lambda x: x["shard"])
    return sure.withColumn("_m", F.struct(F.col("_p.source_size"), F.col("_p.target"), shards.alias("shards"))).drop("_p", "_at")


def mix_report(df: DataFrame, seed: int = 7) -> DataFrame:
    """One row per document: size, source_size, target, taken (words), shards (comma-separated, one for each copy)."""
    slim = _sized(df, seed)
    out = _decided(slim, *block_plan(slim, seed))
    return out.select("doc_id", "size", F.col("_m.source_size").alias("source_size"), F.col("_m.target").alias("target"), (F.col("size") * F.size("_m.shards")).cast("long").alias("taken"), F.array_join(F.col("_m.shards").cast("array<string>"), ",").alias("shards"))


def mixed_documents(df: DataFrame, seed: int = 7, shards: str | None = None) -> DataFrame:
    """The mix itself: every document as often as it is taken, dealt to its shard (added under the name `shards`) and shuffled inside it."""
    cols = df.columns
    slim = _sized(df, seed)
    plan, n_blocks = block_plan(slim, seed)
    unstage(slim)
    out = _decided(packed(df, "source", hashed(seed).alias("h")), plan, n_blocks).withColumn("_shard", F.explode("_m.shards"))
    out = out.withColumn("_key", F.xxhash64(F.lit(seed), F.col("h"), F.col("_shard"))).select("_row", "_shard", "_key")
    out = out.repartitionByRange(F.col("_shard"), F.col("_key")).sortWithinPartitions("_shard", "_key")
    return out.select("_row.*", F.col("_shard").alias(shards)) if shards else unpacked(out, cols)


def sql(seed: int = 7) -> str:
    """DuckDB SQL of mix_report over `documents`."""
    num = lambda x: f"('0x' || substr(md5({x}), 1, 15))::BIGINT"
    src = "coalesce(source, 'null')"
    unit = lambda tag: num(f"'{seed}:{tag}:' || {src} || ':' || block || ':' || copy")
    levels, node = "", "u0"
    for k in range(LEVELS):
        levels += f"""
u{k + 1} AS (SELECT * EXCLUDE (pos, n) REPLACE (2 * node + CASE WHEN 2 * pos <= n THEN 0 ELSE 1 END AS node) FROM (
  SELECT *, count(*) OVER (PARTITION BY node) AS n, row_number() OVER (PARTITION BY node ORDER BY {unit(f"t{k}")}, source NULLS LAST, block, copy) AS pos FROM u{k})),"""
        node = f"u{k + 1}"
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
  {num(f"'{seed}:d:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))")} AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT] AS weight,
  {CAP} * source_size AS cap, {SHARE}::DOUBLE * sum(source_size) OVER () AS total FROM s0),
s2 AS (SELECT *, cap * sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  <= (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS capped FROM s1),
s AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) * weight
  / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () END AS target FROM s2),
n AS (SELECT least(greatest(ceil(count(*) / {DOCS_PER_BLOCK}), {MIN_BLOCKS}), {MAX_BLOCKS})::BIGINT AS n_blocks FROM d),
r AS (SELECT d.*, source_size, target, h % n_blocks AS block FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, n),
b AS (SELECT source, block, any_value(source_size) AS source_size, any_value(target) AS target, sum(size)::BIGINT AS words FROM r GROUP BY source, block),
b2 AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY {num(f"'{seed}:b:' || {src} || ':' || block")}, block
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead FROM b),
u0 AS (SELECT *, ahead + copy * source_size AS start, 0 AS node FROM b2, range({CAP}) AS c(copy) WHERE ahead + copy * source_size < target),{levels}
q AS (SELECT source, node AS shard, count(*) AS quota, sum(count(*)) OVER (PARTITION BY source ORDER BY node) AS last FROM {node} GROUP BY source, node),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {unit("p")}, block, copy) AS rank FROM {node}),
g AS (SELECT p.source, block, copy, start, words, target, shard, start + words <= target AS whole FROM p JOIN q
  ON p.source IS NOT DISTINCT FROM q.source AND rank <= last AND rank > last - quota),
e AS (SELECT r.source, r.block, h, start, any_value(g.target) AS aim, sum(size) AS w, max(size) AS size, count(*) AS m FROM r JOIN g
  ON r.source IS NOT DISTINCT FROM g.source AND r.block = g.block AND NOT whole GROUP BY r.source, r.block, h, start),
f AS (SELECT *, aim - start - coalesce(sum(w) OVER (PARTITION BY source, block ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS rest FROM e),
x AS (SELECT source, block, h, greatest(least(CASE WHEN size > 0 THEN floor(rest / size + 0.5::DOUBLE) WHEN rest >= 0 THEN m ELSE 0 END, m), 0)::BIGINT AS j FROM f),
w AS (SELECT source, block, count(*) FILTER (whole) AS copies, list(shard ORDER BY copy) AS shards FROM g GROUP BY source, block),
k AS (SELECT r.*, row_number() OVER (PARTITION BY r.source, h) AS nth FROM r),
o AS (SELECT k.*, coalesce(copies, 0) + CASE WHEN nth <= coalesce(j, 0) THEN 1 ELSE 0 END AS n, coalesce(shards, []) AS shards FROM k
  LEFT JOIN w ON k.source IS NOT DISTINCT FROM w.source AND k.block = w.block LEFT JOIN x ON k.source IS NOT DISTINCT FROM x.source AND k.block = x.block AND k.h = x.h)
SELECT doc_id, size, source_size, target, (size * n)::BIGINT AS taken, array_to_string(list_slice(shards, 1, n), ',') AS shards FROM o"""
