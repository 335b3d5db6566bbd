"""SimHash near-duplicates through pivot distance tables (operator 3).

Every distinct fingerprint gets its Hamming distances to a fixed table of reference fingerprints (pivots). The pivots are one
base value, the base with one 2-bit block flipped (32 of them) and a few unrelated values. Two fingerprints within 2 bits
differ by at most 2 in every pivot coordinate, and the difference between the base coordinate and a block pivot's coordinate
moves only when that block holds a differing bit. So of 5 groups of block pivots at least 3 agree on a linked pair: rows meet
in a cell keyed by the coordinates of 3 groups (10 choices). Inside a cell pairs are discarded by the largest coordinate
difference over all pivots, survivors are verified by exact distance, and only a spanning forest of the links is emitted.

A cell with more than CELL_ROWS fingerprints is cut by the coordinates of LEVELS further pivots, one after the other: linked
fingerprints differ by at most 2 there, so a fingerprint goes to the band of its coordinate and, near the upper edge, to the
next one. That parts unrelated fingerprints but not those packed within a few bits of each other, which fall into one band of
every pivot and would only be copied by more cuts. Cells that stay crowded take an exact way without pairs, linear in their
fingerprints: these meet at all values within one bit of them, since two values within 2 bits share such a midpoint and any two
that share one are within 2 bits.

The functions here start jobs when they are called; tables that are staged on the way are deleted as soon as they are used up,
the others as `plans.staging` says. Joins on a fingerprint or a component broadcast the hot ones.

Defined edge cases: a null or wordless text has fingerprint 0 and links like any other; texts of any length are read whole, in
bounded pieces; equal fingerprints are one node, so copies are never paired; a null doc_id never names a component; ties go to
the least doc_id, then text hash; repeated rows are rows of one group; other columns pass through `deduplicated` in one
struct and never clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import packed, staged, unpacked, unstage
from lexloom.plans.components import components
from lexloom.plans.joins import join_counted

SEED = 42
MAX_BITS = 2
BLOCK_BITS = 2
GROUPS = 5
CELL_ROWS = 512
#: unrelated pivots, how many of them cut crowded cells, and the width of their bands
EXTRA, LEVELS, BAND = 8, 2, 4
BATCH, CELLS = 512, 64


def pivot_table(extra: int = EXTRA) -> list[int]:
    """Base, one pivot for each flipped block, and unrelated pivots, as signed 64-bit integers from a fixed generator."""
    draw = np.random.default_rng(20240229).integers(0, 2**64, extra + 1, dtype=np.uint64)
    base = draw[0]
    flips = [base ^ (np.uint64(2**BLOCK_BITS - 1) << np.uint64(BLOCK_BITS * i)) for i in range(64 // BLOCK_BITS)]
    return np.array([base, *flips, *draw[1:]], np.uint64).view(np.int64).tolist()


def fingerprint(raw: bytes) -> int:
    """Signed fingerprint of UTF-8 text: the majority of each bit over the hashes of its 3-word shingles."""
    import xxhash

    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < 3:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-3] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[2:].tolist())]
    h = np.array(hashes, "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), fp (signed 64-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                fps = [fingerprint(x.as_py() or b"") for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fps, pa.int64())], names=["doc_id", "h", "fp"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", F.xxhash64("text"), F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, h bigint, fp bigint")


def _cell_keys(fp: Column) -> tuple[list[Column], list[tuple[int, ...]]]:
    """One code for each group of block pivots (their coordinates less the base's), and the choices of GROUPS - MAX_BITS groups."""
    pivots = pivot_table()
    blocks = 64 // BLOCK_BITS
    far = lambda p: F.bit_count(fp.bitwiseXOR(F.lit(p)))
    base = far(pivots[0])
    group = []
    for g in range(GROUPS):
        code = F.lit(0).cast("long")
        for i in range(g, blocks, GROUPS):
            code = code * (2 * BLOCK_BITS + 1) + (base - far(pivots[1 + i]) + BLOCK_BITS).cast("long")
        group.append(code)
    return group, list(combinations(range(GROUPS), GROUPS - MAX_BITS))


def links_in_cell(fps: np.ndarray, pivots: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the links within one cell."""
    fps = np.sort(fps)
    bits = fps.view(np.uint64)
    coords = np.bitwise_count(bits[:, None] ^ pivots[None, :]).astype(np.int8)
    label = np.arange(len(fps))
    out = []
    for i in range(1, len(fps)):
        near = np.flatnonzero(np.abs(coords[:i] - coords[i]).max(axis=1) <= MAX_BITS)
        near = near[np.bitwise_count(bits[near] ^ bits[i]) <= MAX_BITS]
        joined, first = np.unique(label[near], return_index=True)
        if len(joined):
            out += [(int(fps[i]), int(fps[j])) for j in near[first]]
            label[i] = joined[0]
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
    return out


def _near_links(cells: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = np.array(pivot_table(), np.int64).view(np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, CELLS):
                links = [x for cell in batch.column(0).slice(at, CELLS) for x in links_in_cell(np.array(cell.values, np.int64), pivots)]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return cells.select("fps").mapInArrow(run, "u bigint, v bigint")


def _met(rows: DataFrame) -> DataFrame:
    """rows (fp, cell) of cells with two or more, and n, the size of their cell; staged."""
    counts = staged(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-counts")
    out = staged(join_counted(rows, counts, "cell", "n"), "simhash-cells")
    unstage(counts)
    return out


def links(nodes: DataFrame) -> DataFrame:
    """nodes: distinct fp. Returns edges u, v that connect exactly what links within MAX_BITS connect; staged.

    A cell is a hash of its key: cells that share a hash only hold more to verify.
    """
    group, choices = _cell_keys(F.col("fp"))
    coded = nodes.select("fp", *[g.alias(f"g{i}") for i, g in enumerate(group)])
    cells = F.array(*[F.xxhash64(F.lit(k), *[F.col(f"g{g}") for g in c]) for k, c in enumerate(choices)])
    met = _met(coded.select("fp", F.explode(cells).alias("cell")))
    tables, fine = [met], [met.filter(F.col("n") <= CELL_ROWS)]
    for level, pivot in enumerate(pivot_table()[-EXTRA:][:LEVELS]):
        crowded = met.filter(F.col("n") > CELL_ROWS)
        if not crowded.limit(1).count():
            break
        far = F.bit_count(F.col("fp").bitwiseXOR(F.lit(pivot)))
        bands = F.array_distinct(F.array(F.floor(far / BAND), F.floor((far + MAX_BITS) / BAND)))
        cut = crowded.select("fp", "cell", F.explode(bands).alias("band"))
        met = _met(cut.select("fp", F.xxhash64("cell", F.lit(level), "band").alias("cell")))
        tables.append(met)
        fine.append(met.filter(F.col("n") <= CELL_ROWS))
    small = reduce(DataFrame.unionByName, fine).groupBy("cell").agg(F.collect_list("fp").alias("fps"))
    packed_ = met.filter(F.col("n") > CELL_ROWS).select("fp").distinct()
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(b)) for b in np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64)).view(np.int64).tolist()])
    spread = packed_.select("fp", F.explode(near).alias("mid"))
    least = spread.groupBy("mid").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    far = spread.join(least, "mid").filter("fp != v").select(F.col("fp").alias("u"), "v")
    out = staged(_near_links(small).union(far.distinct()), "simhash-links")
    unstage(*tables)
    return out


def _grouped(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id, h, fp of every row; groups: fp, root, n_equal, first (struct of the group's first row: blank, doc_id, h). Both staged."""
    docs = staged(fingerprints(df), "simhash-fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("blank"), "doc_id", "h"))
    nodes = staged(docs.groupBy("fp").agg(first.alias("first"), F.count(F.lit(1)).alias("n_equal")), "simhash-nodes")
    found = links(nodes.select("fp"))
    roots = components(found)
    labelled = staged(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", "n_equal", F.coalesce("root", "fp").alias("root")), "simhash-labels")
    named = staged(labelled.groupBy("root").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n")), "simhash-names")
    groups = staged(join_counted(labelled.select("fp", "root", "n_equal"), named, "root", "n").drop("n"), "simhash-groups")
    unstage(nodes, found, labelled, named)
    return docs, groups


def near_duplicates(df: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable), n_equal (documents with this fingerprint)."""
    docs, groups = _grouped(df)
    labelled = groups.select("fp", F.col("first.doc_id").alias("component_id"), "n_equal")
    return join_counted(docs, labelled, "fp", "n_equal").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_equal")


def deduplicated(df: DataFrame) -> DataFrame:
    """One document of each group: the row with the least doc_id (nulls last), by text hash among rows that share it.

    Rows are found by doc_id and text hash together, so groups whose documents have no doc_id, or the same one, keep one each.
    """
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    _, groups = _grouped(df)
    keep = groups.select(key("first.doc_id").alias("_key"), F.col("first.h").alias("_hash")).distinct()
    rows = packed(df, key("doc_id").alias("_key"), F.xxhash64("text").alias("_hash")).join(keep, ["_key", "_hash"], "left_semi")
    one = F.row_number().over(Window.partitionBy("_key", "_hash").orderBy(F.xxhash64("_row")))
    return unpacked(rows.withColumn("_at", one).filter("_at = 1"), df.columns)
