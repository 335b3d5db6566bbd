"""Minimum-cost-flow resharding (operator 10).

From the byte sizes of the old shards and equal new capacities, a minimum-cost flow (successive shortest paths on a graph of
old and new shards) gives the bytes that every old shard passes to every new one, moving as few bytes as possible. An old
shard is an ordered sequence of hash blocks; the flow cuts that sequence into runs. A cut inside a document moves to one of its
ends, chosen so that what the new shards gain and lose cancels out, and the few documents that are large against a new shard
come first, where they stay. Prefix sums are taken first over blocks, then inside
blocks, so no task orders a whole shard of documents. Only the sums per old shard and the documents under a cut (as many rows
as shards and cuts) reach the driver.

Law `bytes`: shard sizes differ only by the documents that straddle a cut. `rewrite` writes the files that lose rows anew.

The functions here start jobs when they are called; the tables that they stage are deleted as `plans.staging` says.

Defined edge cases: a null text has size 1 and the checksum of the empty text; rows with equal doc_id are separate rows with
slots of their own; rows equal in doc_id, size and checksum are counted, not compared, and a cut may part them; texts of any
length count by their bytes; an empty table gives an empty result; further columns of the input never reach the plan (rewrite
carries them in one struct, and adds `shard`, which the input must not have).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import hash60, numbered, staged, text_of, unstage

N_OLD, N_NEW = 6, 8
ROWS_PER_BLOCK, MIN_BLOCKS = 16384, 64
#: rows larger than this part of a new shard (fewer than N_NEW times as many) come first in their old shard, away from the cuts
HEAVY_PART = 50
#: rows that one generator row of a run of equal rows writes out
CHUNK = 4096


def min_cost_flow(supply: list[int], demand: list[int], cost) -> list[list[int]]:
    """Flow[i][j] that ships all supplies within the demands at the least total cost(i, j) per unit.

    Successive shortest paths over the residual graph; each augmentation exhausts a supply, a demand or a reverse flow.
    """
    a, b = len(supply), len(demand)
    flow = [[0] * b for _ in range(a)]
    left, room = list(supply), list(demand)
    while any(left):
        # Bellman-Ford from all old shards with bytes left; node i < a is old, a + j is new
        far = [0 if i < a and left[i] else float("inf") for i in range(a + b)]
        via = [-1] * (a + b)
        for _ in range(a + b):
            changed = False
            for i in range(a):
                for j in range(b):
                    c = cost(i, j)
                    if far[i] + c < far[a + j]:
                        far[a + j], via[a + j], changed = far[i] + c, i, True
                    if flow[i][j] and far[a + j] - c < far[i]:
                        far[i], via[i], changed = far[a + j] - c, a + j, True
            if not changed:
                break
        end = min((a + j for j in range(b) if room[j]), key=far.__getitem__, default=None)
        if end is None or far[end] == float("inf"):
            raise ValueError("the new capacities do not hold all bytes")
        path = [end]
        while via[path[-1]] >= 0:
            path.append(via[path[-1]])
        path.reverse()
        steps = list(zip(path, path[1:]))
        amount = min(left[path[0]], room[end - a], *(flow[v][u - a] for u, v in steps if u >= a))
        for u, v in steps:
            if u < a:
                flow[u][v - a] += amount
            else:
                flow[v][u - a] -= amount
        left[path[0]] -= amount
        room[end - a] -= amount
    return flow


def capacities(total: int, n: int) -> list[int]:
    return [total // n + (i < total % n) for i in range(n)]


def keyed(df: DataFrame, n_old: int = N_OLD) -> DataFrame:
    """df with size, text_crc32, old_shard (the hash layout that is being resharded) and h, the digest of doc_id, size and checksum."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    out = df.withColumns({"size": (F.octet_length(raw) + 1).cast("long"), "text_crc32": F.crc32(raw)})
    out = out.withColumn("old_shard", (hash60(F.lit("old:"), text_of("doc_id")) % n_old).cast("int"))
    return out.withColumn("h", F.md5(F.concat(F.lit("row:"), text_of("doc_id"), F.lit(":"), F.col("size").cast("string"), F.lit(":"), F.col("text_crc32").cast("string"))))


def old_and_new(supply: list[int], n_new: int) -> list[tuple[int, int, int]]:
    """Runs (old shard, bytes up to which, new shard) of the cheapest flow: an old shard keeps its own run first, then hands out runs in order of the receiving shards."""
    flow = min_cost_flow(supply, capacities(sum(supply), n_new), lambda i, j: int(i != j))
    runs = []
    for i in range(len(supply)):
        at = 0
        for j in sorted(range(n_new), key=lambda j: (j != i, j)):
            if flow[i][j]:
                at += flow[i][j]
                runs.append((i, at, j))
    return runs


def rounded(runs: list[tuple[int, int, int]], cut_rows: list[tuple[int, int, int, int]], n_new: int) -> list[tuple[int, int, int]]:
    """The runs with every cut inside a row moved to an end of that row. cut_rows: old shard, begin, size and count of the equal rows under a cut.

    Cuts are settled one by one, those in the largest rows first, so that the squared deviations of the new shards grow least.
    """
    off = [0] * n_new
    ends: dict[int, tuple[int, int]] = {}
    for at, ((i, cut, _), (k, _, _)) in enumerate(zip(runs, runs[1:])):
        for old, begin, size, m in cut_rows if i == k else []:
            if old == i and begin < cut < begin + size * m and (cut - begin) % size:
                low = cut - (cut - begin) % size
                ends[at] = (low, low + size)
    out = [list(r) for r in runs]
    for at, (low, high) in sorted(ends.items(), key=lambda x: (x[1][0] - x[1][1], x[0])):
        cut, a, b = runs[at][1], runs[at][2], runs[at + 1][2]
        worse = lambda end: (off[a] + end - cut) ** 2 + (off[b] - end + cut) ** 2
        end = min(low, high, key=worse)
        off[a] += end - cut
        off[b] -= end - cut
        out[at][1] = end
    return [tuple(r) for r in out]


def planned(df: DataFrame, n_old: int = N_OLD, n_new: int = N_NEW) -> DataFrame:
    """One row per run of equal rows: doc_id, size, text_crc32, old_shard, h, block, shard, first (from 1: its first row among the equal ones), n, slot (of its first row).

    Equal rows (in doc_id, size and checksum) are one entry with a count throughout; a cut may part them.
    """
    slim = keyed(df.select("doc_id", "text"), n_old).drop("text")
    equal = groups = staged(slim.groupBy("doc_id", "size", "text_crc32", "old_shard", "h").agg(F.count(F.lit(1)).alias("m")), "reshard-groups")
    by_shard = {r["old_shard"]: (r["bytes"], r["n"]) for r in groups.groupBy("old_shard").agg(F.sum(F.col("size") * F.col("m")).alias("bytes"), F.sum("m").alias("n")).collect()}
    runs = old_and_new([by_shard.get(i, (0, 0))[0] for i in range(n_old)], n_new)
    n_blocks = max(MIN_BLOCKS, -(-sum(n for _, n in by_shard.values()) // ROWS_PER_BLOCK))
    heavy = F.col("size") * n_new * HEAVY_PART > sum(b for b, _ in by_shard.values())
    groups = groups.withColumn("block", F.when(heavy, 0).otherwise(1 + F.conv(F.substring("h", 1, 12), 16, 10).cast("long") % n_blocks).cast("int"))
    blocks = groups.groupBy("old_shard", "block").agg(F.sum(F.col("size") * F.col("m")).alias("bytes"))
    ahead = F.coalesce(F.sum("bytes").over(Window.partitionBy("old_shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("old_shard", "block", ahead.alias("ahead"))
    order = ["h", F.col("doc_id").asc_nulls_first(), "size", "text_crc32"]
    inside = Window.partitionBy("old_shard", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.join(blocks, ["old_shard", "block"]).withColumn("begin", F.col("ahead") + F.coalesce(F.sum(F.col("size") * F.col("m")).over(inside), F.lit(0)))
    laid = groups = staged(groups, "reshard-laid")
    inner = [(i, at) for (i, at, _), (k, _, _) in zip(runs, runs[1:]) if i == k]
    under = F.lit(False)
    for i, at in inner:
        under = under | ((F.col("old_shard") == i) & (F.col("begin") < at) & (F.col("begin") + F.col("size") * F.col("m") > at))
    cut_rows = [(r["old_shard"], r["begin"], r["size"], r["m"]) for r in groups.filter(under).collect()]
    runs = rounded(runs, cut_rows, n_new)
    upto = lambda c: F.greatest(F.least(F.floor((F.lit(c).cast("long") - F.col("begin")) / F.col("size")), F.col("m")), F.lit(0)).cast("long")
    cuts = F.lit(None).cast("array<struct<shard:int,upto:bigint>>")
    for i in sorted({i for i, _, _ in runs}):
        mine = [(at, j) for k, at, j in runs if k == i]
        ends = [F.struct(F.lit(j).alias("shard"), (F.col("m") if (at, j) == mine[-1] else upto(at)).alias("upto")) for at, j in mine]
        cuts = F.when(F.col("old_shard") == i, F.array(*ends)).otherwise(cuts)
    parts = groups.select("*", F.posexplode(F.transform(cuts, lambda x, i: F.struct(x["shard"].alias("shard"), F.when(i == 0, 0).otherwise(F.get(cuts, i - 1)["upto"]).alias("before"), x["upto"].alias("upto")))).alias("_i", "c"))
    parts = parts.filter("c.upto > c.before").select("doc_id", "size", "text_crc32", "old_shard", "h", "block", F.col("c.shard").alias("shard"), (F.col("c.before") + 1).alias("first"), (F.col("c.upto") - F.col("c.before")).alias("n"))
    parts = staged(parts, "reshard-parts")
    counts = parts.groupBy("shard", "old_shard", "block").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("old_shard", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("shard", "old_shard", "block", before.alias("_before"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("shard", "old_shard", "block").orderBy(*order, "first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = staged(parts.withColumn("_ahead", ahead).join(counts, ["shard", "old_shard", "block"]).withColumn("slot", F.col("_before") + F.col("_ahead")).drop("_before", "_ahead"), "reshard-plan")
    unstage(equal, laid, parts)
    return out


def reshard(df: DataFrame, n_old: int = N_OLD, n_new: int = N_NEW) -> DataFrame:
    """One row per document: size, text_crc32, old_shard, shard, slot, block, moved."""
    plan = planned(df, n_old, n_new)
    # A run of equal rows is written out in chunks, long runs dealt to many tasks.
    chunks = plan.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))))
    large = chunks.filter(F.col("n") > CHUNK).repartition("h", "_c")
    rows = chunks.filter(F.col("n") <= CHUNK).unionByName(large)
    each = F.sequence(F.col("slot") + F.col("_c") * CHUNK, F.col("slot") + F.least((F.col("_c") + 1) * CHUNK, F.col("n")) - 1)
    return rows.select("doc_id", "size", "text_crc32", "old_shard", "shard", F.explode(each).alias("slot"), "block", (F.col("shard") != F.col("old_shard")).alias("moved"))


def affected(plan: DataFrame) -> DataFrame:
    """The files (old shard, block) that lose rows, with the rows and bytes that leave them."""
    moved = F.col("shard") != F.col("old_shard")
    files = plan.groupBy("old_shard", "block").agg(F.coalesce(F.sum(F.when(moved, F.col("n"))), F.lit(0)).alias("rows_moved"), F.coalesce(F.sum(F.when(moved, F.col("n") * F.col("size"))), F.lit(0)).alias("bytes_moved"))
    return files.filter("rows_moved > 0")


def rewrite(docs: DataFrame, path: str, n_old: int = N_OLD, n_new: int = N_NEW) -> DataFrame:
    """Write all rows of affected files to path/shard=j/ in order of their slots; files without a moved row stay as they are.

    Every row finds its place by the hash of doc_id, size and checksum and its number among equal rows, so repeated ids and
    rows are written as often as they come. Returns the affected files with the rows and bytes that left them.
    """
    plan = planned(docs, n_old, n_new)
    files = staged(affected(plan), "reshard-files")
    hit = plan.join(files.select("old_shard", "block"), ["old_shard", "block"], "left_semi")
    where = hit.select(F.col("h").alias("_h"), F.col("shard").alias("_shard"), "first", "n", "slot")
    alone = where.groupBy("_h").agg(F.sum("n").alias("_all"), F.first("_shard").alias("_shard"), F.first("slot").alias("_slot"))
    rows = keyed(docs.select(F.struct("*").alias("_row"), "doc_id", "text"), n_old).select("_row", "h")
    one = rows.join(alone.filter("_all = 1").drop("_all"), F.col("h") == F.col("_h")).select("_row", "_shard", "_slot")
    many = rows.join(alone.filter("_all > 1").select("_h"), F.col("h") == F.col("_h"), "left_semi")
    at = F.col("_at") - F.col("first")
    many = numbered(many, "h", "reshard-equal").join(where, (F.col("h") == F.col("_h")) & (at >= 0) & (at < F.col("n"))).select("_row", "_shard", (F.col("slot") + at).alias("_slot"))
    out = one.unionByName(many).repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot")
    out.select("_row.*", F.col("_shard").alias("shard")).write.partitionBy("shard").parquet(path)
    return files


def reshard_report(df: DataFrame) -> DataFrame:
    return reshard(df).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved")
