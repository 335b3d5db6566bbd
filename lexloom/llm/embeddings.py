"""Embedding near-duplicates by a subspace pigeonhole join (operator 5).

Unit vectors with cosine >= c are within squared distance t = 2 - 2c. After a fixed rotation the coordinates are cut into
blocks; if every block's squared distance exceeded its share of t, proportional to its width, the sum would exceed t. So each
block is range-joined under its own budget and the union of candidates is verified exactly. Within a block a k-d tree fitted
on a bounded sample gives cells; a vector visits a cell only if the cell's box lies within the budget. Crowded cells are cut
into tiles, so a work item holds two tiles at most. A pair is counted only in the block where its distance is least, so no
pair list is ever built: work items return link counts and a spanning forest.

Only equal vectors collapse before the join (with their multiplicity), into nodes named by the digest of the vector; every
index parameter is fitted on at most SAMPLE vectors while all vectors are joined, without loss.

The functions here start jobs when they are called; the tables that they stage are deleted as `plans.staging` says.

Defined edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
each length are joined among themselves; vec_ids may be of any type that sorts, be missing or be shared by different vectors,
which link by their vectors alone; a null vec_id never names a component; repeated rows link with each other; of ties in a
block's distance the first block owns the pair; other columns never enter; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import staged
from lexloom.plans.components import components
from lexloom.plans.joins import join_counted

COSINE = 0.9
BLOCK_DIMS = 16
TILE = 8192
SAMPLE = 20_000
MAX_LEAVES = 256


def rotation(dim: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(raw: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision of raw ones, whose size tells single precision (kept as such in shuffles) from double."""
    width = len(raw[0]) // dim if raw else 8
    x = np.frombuffer(b"".join(raw), f"<f{width}").astype(float).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Boxes:
    """A k-d tree over one block: split planes, leaves as boxes, fitted on a sample."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.lo, self.hi, self.plane = [], [], {}
        width = sample.shape[1]
        self._cut(sample, 0, np.full(width, -np.inf), np.full(width, np.inf), leaves)
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def _cut(self, x, at, lo, hi, leaves):
        axis = int(x.var(axis=0).argmax()) if len(x) > 1 else 0
        mid = float(np.median(x[:, axis])) if len(x) else 0.0
        if leaves <= 1 or len(x) < 8 or not (x[:, axis] > mid).any():
            self.plane[at] = (-1, len(self.lo))
            self.lo.append(lo)
            self.hi.append(hi)
            return
        self.plane[at] = (axis, mid)
        left, right = hi.copy(), lo.copy()
        left[axis] = right[axis] = mid
        self._cut(x[x[:, axis] <= mid], 2 * at + 1, lo, left, leaves // 2)
        self._cut(x[x[:, axis] > mid], 2 * at + 2, right, hi, leaves // 2)

    def home(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            axis, value = self.plane[at]
            if axis < 0:
                out[rows] = value
            else:
                low = x[rows, axis] <= value
                todo += [(2 * at + 1, rows[low]), (2 * at + 2, rows[~low])]
        return out

    def reach(self, x: np.ndarray, budget: float) -> np.ndarray:
        """Row by leaf: whether the leaf's box lies within the squared budget."""
        out = np.empty((len(x), len(self.lo)), bool)
        for k, (lo, hi) in enumerate(zip(self.lo, self.hi)):
            gap = np.maximum(np.maximum(lo - x, x - hi), 0)
            out[:, k] = (gap * gap).sum(axis=1) <= budget
        return out


def block_slices(dim: int) -> list[slice]:
    return [slice(a, min(a + BLOCK_DIMS, dim)) for a in range(0, dim, BLOCK_DIMS)]


def item_links(a: np.ndarray, b: np.ndarray, same: bool, block: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Row indexes of a and b that link and are owned by this block. a, b: unit vectors; same: a is b."""
    dim = a.shape[1]
    rot, parts = rotation(dim), block_slices(dim)
    cut = parts[block]
    limit = 2 - 2 * cosine
    budget = limit * (cut.stop - cut.start) / dim
    ra, rb = (a @ rot[:, cut]).astype(np.float32), (b @ rot[:, cut]).astype(np.float32)
    nb = (rb * rb).sum(axis=1)
    left, right = [], []
    for at in range(0, len(a), 1024):
        part = ra[at : at + 1024]
        # |x - y|^2 <= budget, with room for single precision; survivors are verified in double precision
        near = part @ rb.T
        near -= (nb / 2)[None, :]
        i, j = np.nonzero(near >= ((part * part).sum(axis=1) - (budget + 1e-4))[:, None] / 2)
        if same:
            i, j = i[j > i + at], j[j > i + at]
        for s in range(0, len(i), 1 << 16):
            x, y = a[i[s : s + (1 << 16)] + at], b[j[s : s + (1 << 16)]]
            ok = (x * y).sum(axis=1) >= cosine
            d = (x[ok] - y[ok]) @ rot
            share = np.stack([(d[:, p] ** 2).sum(axis=1) / (p.stop - p.start) for p in parts])
            own = np.round(share, 13).argmin(axis=0) == block
            left.append(i[s : s + (1 << 16)][ok][own] + at)
            right.append(j[s : s + (1 << 16)][ok][own])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places the least place it reaches by the given links."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    vector = F.col(embedding).cast("array<double>")
    fine = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(vec_id).alias("vec_id"), F.when(fine, F.col(embedding)).alias("x"), F.when(fine, F.size(vector)).alias("dim"))
    single = df.schema[embedding].dataType.elementType.simpleString() == "float"
    rows = staged(_packed(rows, "<f4" if single else "<f8").withColumn("key", F.md5("raw")), "emb-rows")
    dims = [r["dim"] for r in rows.filter("dim is not null").select("dim").distinct().collect()]  # lengths, not vectors
    known = [_of_one_length(rows.filter(F.col("dim") == d), d, cosine) for d in sorted(dims)]
    out = rows.filter("key is null").select("vec_id", F.lit(0).alias("links"), F.col("vec_id").alias("component_id"))
    if known:
        every = staged(reduce(DataFrame.unionByName, known), "emb-known")
        out = out.unionByName(join_counted(rows.filter("key is not null").select("vec_id", "key"), every, "key", "mult").select("vec_id", "links", "component_id"))
    comp = F.when(F.col("component_id").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.col("vec_id").eqNullSafe(comp).alias("kept"))


def _packed(rows: DataFrame, kind: str) -> DataFrame:
    """The vectors as bytes of their own precision."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw = [None if v is None else np.array(v, kind).tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), batch.column(2)], names=["vec_id", "raw", "dim"])

    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, raw binary, dim int")


def _of_one_length(rows: DataFrame, dim: int, cosine: float) -> DataFrame:
    """key, links, component_id of every distinct vector of rows (vec_id, raw, key), all of length dim."""
    nodes = staged(rows.groupBy("key").agg(F.first("raw").alias("raw"), F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("mult")), "emb-nodes")
    n = nodes.count()
    parts = block_slices(dim)
    leaves = 1
    while leaves * TILE < n and leaves < MAX_LEAVES:
        leaves *= 2
    sample = [bytes(r["raw"]) for r in nodes.select("raw").orderBy("key").limit(SAMPLE if leaves > 1 else 1).collect()]
    turned = unit(sample, dim) @ rotation(dim)
    trees = [Boxes(turned[:, p], leaves) for p in parts]
    tile_of = lambda key, tiles: int(key[:8], 16) % tiles

    def homes(it):
        for pdf in it:
            x = unit(list(pdf.raw), dim) @ rotation(dim)
            for b, p in enumerate(parts):
                yield pd.DataFrame({"block": b, "leaf": trees[b].home(x[:, p])})

    # At most blocks x MAX_LEAVES sums reach the driver.
    sizes = nodes.select("raw").mapInPandas(homes, "block int, leaf long").groupBy("block", "leaf").count().collect() if leaves > 1 else []
    tiles = [np.ones(len(t.lo), np.int64) for t in trees]
    for r in sizes:
        tiles[r["block"]][r["leaf"]] = max(1, -(-r["count"] // TILE))
    starts = [np.concatenate(([0], np.cumsum(t))) for t in tiles]
    limit = 2 - 2 * cosine

    def visits(it):
        for pdf in it:
            for at in range(0, len(pdf), 2048):
                part = pdf.iloc[at : at + 2048]
                x = unit(list(part.raw), dim) @ rotation(dim)
                for b, p in enumerate(parts):
                    y = x[:, p]
                    leaf = trees[b].home(y)
                    own = np.array([starts[b][k] + tile_of(key, tiles[b][k]) for k, key in zip(leaf, part.key)], np.int64)
                    near = trees[b].reach(y, limit * (p.stop - p.start) / dim + 1e-4)
                    near[np.arange(len(y)), leaf] = True
                    row, unit_at = np.nonzero(np.repeat(near, tiles[b], axis=1))
                    mine = own[row]
                    out = part[["raw", "key", "mult"]].iloc[row]
                    yield out.assign(block=np.int32(b), u=np.minimum(mine, unit_at), v=np.maximum(mine, unit_at), own=mine)

    def item(key, pdf):
        block, u, v = key
        pdf = pdf.sort_values("key")
        x = unit(list(pdf.raw), dim)
        names, mult, own = pdf.key.to_numpy(), pdf.mult.to_numpy(), pdf.own.to_numpy()
        a, b = np.flatnonzero(own == u), np.flatnonzero(own == v)
        i, j = item_links(x[a], x[b], u == v, int(block), cosine)
        i, j = a[i], b[j]
        count = np.bincount(i, mult[j], len(names)) + np.bincount(j, mult[i], len(names))
        root = names[_forest(len(names), i, j)]
        has = count > 0
        return pd.DataFrame({"key": names[has], "links": count[has].astype(np.int64), "root": root[has]})

    visited = nodes.select("raw", "key", "mult").mapInPandas(visits, "raw binary, key string, mult long, block int, u long, v long, own long")
    found = staged(visited.groupBy("block", "u", "v").applyInPandas(item, "key string, links long, root string"), "emb-links")
    roots = components(found.filter("key != root").select(F.col("key").alias("u"), F.col("root").alias("v")))
    linked = found.groupBy("key").agg(F.sum("links").alias("links"))
    known = nodes.select("key", "first", "mult").join(linked, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left")
    known = staged(known.withColumn("root", F.coalesce("root", "key")), "emb-roots")
    names = staged(known.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n")), "emb-names")
    return join_counted(known, names, "root", "n").select("key", "mult", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"), "component_id")
