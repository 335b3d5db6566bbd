"""The canonical map: pool merge, candidate lists, integrity gate, exclusions and variant clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.kernels import phonetic_similarity, similar_pairs
from lexloom.functions.lexicon import CLOSE_PAIRS, VOWELS
from lexloom.plans.components import components
from lexloom.plans.staging import staged

#: tokens of a block in comparisons of all pairs, and how many tokens a probe is verified on where one link is enough
PROBE_BLOCK, TOKEN_BLOCK, MOST = 512, 4096, 8
#: rows of a group, of probes or tokens, that a task holds
GROUP_ROWS = 131_072


def merge_pool(pilot: DataFrame, override: DataFrame, vocab: DataFrame) -> DataFrame:
    """token, freq, source. pilot: token, freq; override: token, given a frequency by the vocabulary (0 if unknown)."""
    listed = override.select("token").distinct().join(vocab.select("token", F.col("freq").alias("_v")), "token", "left").withColumn("_o", F.lit(True))
    both = pilot.select("token", "freq").join(listed, "token", "full")
    source = F.when(F.col("_o") & F.col("freq").isNotNull(), "both").when(F.col("_o"), "override_list").otherwise("pilot_pool")
    return both.select("token", F.greatest(F.coalesce("freq", F.lit(0)), F.coalesce("_v", F.lit(0))).alias("freq"), source.alias("source"))


def padded(candidates: Column, n: int = 4, name: str = "candidate") -> list[Column]:
    """The first n non-empty candidates as columns, filled with empty text."""
    some = F.filter(candidates, lambda x: x.isNotNull() & (x != ""))
    return [F.coalesce(F.get(some, F.lit(i)), F.lit("")).alias(f"{name}_{i + 1}") for i in range(n)]


def chunks(flat: Column, n: int = 4) -> Column:
    """A flat array cut into arrays of n (an incomplete rest is dropped)."""
    return F.when(F.size(flat) >= n, F.transform(F.sequence(F.lit(0), F.floor(F.size(flat) / n).cast("int") - 1), lambda i: F.slice(flat, i * n + 1, n))).otherwise(F.array().cast("array<array<string>>"))


def candidates(tokens: DataFrame, engine: Callable[[str], list[str]] | None = None, top: int = 4) -> DataFrame:
    """token, candidates, error from a pluggable transliterator, called on the executors; by default the token itself."""

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            found, errors = [], []
            for t in pdf.token:
                try:
                    found.append(list((engine or (lambda x: [x]))(t))[:top])
                    errors.append(None)
                except Exception as e:  # the plug-in may raise anything; the row records it
                    found.append([])
                    errors.append(str(e))
            yield pdf[["token"]].assign(candidates=found, error=errors)

    return tokens.select("token").mapInPandas(run, "token string, candidates array<string>, error string")


def aligned(first: DataFrame, second: DataFrame, single: DataFrame) -> DataFrame:
    """pos, first_run, second_run, single: three candidate lists (each pos, candidates) side by side; a missing place is null."""
    out = first.select("pos", F.col("candidates").alias("first_run")).join(second.select("pos", F.col("candidates").alias("second_run")), "pos", "full")
    return out.join(single.select("pos", F.col("candidates").alias("single")), "pos", "full")


def batch_gate(rows: DataFrame) -> DataFrame:
    """One row: does batching agree with single calls? rows: pos, first_run, second_run, single (arrays of candidates)."""
    first, second, single = (F.get(c, F.lit(0)) for c in ("first_run", "second_run", "single"))
    out = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(F.col("first_run").isNotNull()).alias("complete"),
        F.bool_and(first.eqNullSafe(second)).alias("deterministic"),
        F.count_if(~first.eqNullSafe(single)).alias("mismatches"),
    )
    return out.withColumn("trusted", F.col("complete") & F.col("deterministic") & (F.col("mismatches") == 0))


def canonical_map(pool: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """token, form of pool rows (token, candidate_1) with a form; ambiguous tokens never enter."""
    return pool.join(ambiguous.select("token"), "token", "left_anti").filter(F.coalesce("candidate_1", F.lit("")) != "").select("token", F.col("candidate_1").alias("form"))


def leaked(pool: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """Ambiguous tokens that a pool holds (a map build should stop if there are any)."""
    return pool.select("token").intersect(ambiguous.select("token"))


def source_counts(pool: DataFrame) -> DataFrame:
    """source, n, mass of a merged pool."""
    return pool.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("freq").alias("mass"))


def against_baseline(vocab: DataFrame, tokens: int, mass: int) -> DataFrame:
    """measure, got, documented, warning: do a vocabulary's counts still agree with documented ones? A warning, never an error."""
    rows = vocab.agg(F.count("token").alias("t"), F.coalesce(F.sum("freq"), F.lit(0)).alias("m"))
    each = F.array(*[F.struct(F.lit(name).alias("measure"), F.col(c).alias("got"), F.lit(want).cast("long").alias("documented")) for name, c, want in (("tokens", "t", tokens), ("mass", "m", mass))])
    return rows.select(F.inline(each)).withColumn("warning", F.when(F.col("got") != F.col("documented"), "differs from the documented baseline"))


def as_json(mapping: DataFrame) -> DataFrame:
    """The map as one JSON object (small maps only: it is one value)."""
    return mapping.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "form"))))).alias("json"))


def skeleton(token: Column) -> Column:
    """Consonants of a token with close pairs merged; variants of one word often share it."""
    out = F.regexp_replace(token, f"[{VOWELS}]", "")
    for a, b in CLOSE_PAIRS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _pairs_of_blocks(probes: DataFrame, tokens: DataFrame, threshold: float, most: int | None, each: bool) -> DataFrame:
    """a, b, similarity of probes and tokens (both token, root) at or above threshold: every pair, or with each the first pair of a probe with each root.

    Groups of probes meet groups of tokens, so no key can miss a pair; a task cuts its two groups into blocks, so a row is sent
    once for each group of the other side, not once for each block. With most, a probe is verified on its most promising tokens
    of a block alone.
    """
    n_x, n_y = probes.count(), tokens.count()
    g_y = max(1, -(-n_y // GROUP_ROWS))
    g_x = max(-(-n_x // GROUP_ROWS), min(-(-n_x // PROBE_BLOCK), -(-4 * probes.sparkSession.sparkContext.defaultParallelism // g_y)), 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("token"), F.lit(n)).cast("int")
    x = probes.select("token", "root", own(g_x).alias("_x"), every(g_y).alias("_y"))
    y = tokens.select("token", "root", own(g_y).alias("_y"), every(g_x).alias("_x"))

    def run(xs: pd.DataFrame, ys: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"a": [], "b": [], "similarity": []}).astype({"a": object, "b": object, "similarity": float})]
        xt, xr, yt, yr = xs.token.to_numpy(object), xs.root.to_numpy(), ys.token.to_numpy(object), ys.root.to_numpy()
        for p in range(0, len(xt), PROBE_BLOCK):
            met = []
            for q in range(0, len(yt), TOKEN_BLOCK):
                i, j, s = similar_pairs(list(xt[p : p + PROBE_BLOCK]), list(yt[q : q + TOKEN_BLOCK]), threshold, most)
                met.append(pd.DataFrame({"a": xt[p + i], "b": yt[q + j], "similarity": s, "root": yr[q + j], "own": xr[p + i]}))
            out = pd.concat(met) if met else pd.DataFrame(columns=["a", "b", "similarity", "root", "own"])
            if each:
                out = out[out.root != out.own].drop_duplicates(["a", "root"])
            found.append(out[["a", "b", "similarity"]])
        return pd.concat(found)

    return x.groupBy("_x", "_y").cogroup(y.groupBy("_x", "_y")).applyInPandas(run, "a string, b string, similarity double")


def variant_pairs(vocab: DataFrame, threshold: float = 0.75) -> DataFrame:
    """All pairs (a < b) of tokens with similarity >= threshold."""
    rows = vocab.select("token", F.lit(0).cast("long").alias("root"))
    return _pairs_of_blocks(rows, rows, threshold, None, False).filter("a < b")


def _easy_links(vocab: DataFrame, threshold: float) -> DataFrame:
    """Some pairs of similar tokens, linear in the tokens: neighbours among those whose skeletons agree but for one consonant."""
    k = skeleton(F.col("token"))
    less = F.when(F.length(k) > 0, F.transform(F.sequence(F.lit(1), F.length(k)), lambda i: F.concat(F.substring(k, F.lit(1), i - 1), F.substring(k, i + 1, F.length(k))))).otherwise(F.array().cast("array<string>"))
    keys = vocab.select("token", F.explode(F.array_distinct(F.concat(F.array(k), less))).alias("k"))
    order = Window.partitionBy("k").orderBy(F.length("token"), "token")
    pairs = keys.select(F.col("token").alias("x"), F.lag("token").over(order).alias("y")).filter("y is not null")
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs.filter(phonetic_similarity(F.col("a"), F.col("b")) >= threshold)


def variant_links(vocab: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Edges (u, v: hashes of tokens) with the connected components of all similar pairs, without listing those pairs.

    Easy links leave one large component. A link between two components has an end outside the largest, so only tokens
    outside it are compared with all tokens; most of them first find a link to it in a part of it.
    """
    node = F.xxhash64("token")
    edges = [staged(components(_easy_links(vocab, threshold).select(F.xxhash64("a").alias("u"), F.xxhash64("b").alias("v"))).select(F.col("node").alias("u"), F.col("root").alias("v")), "easy-links")]
    tokens = staged(vocab.select("token", node.alias("u")).join(edges[0], "u", "left").select("token", F.coalesce("v", "u").alias("root")), "easy-roots")
    top = tokens.groupBy("root").count().orderBy(F.desc("count"), "root").first()
    if top is None:
        return edges[0]
    large, rest = tokens.filter(F.col("root") == top["root"]), tokens.filter(F.col("root") != top["root"])
    hashed = lambda df: df.select(F.xxhash64("a").alias("u"), F.xxhash64("b").alias("v"))
    for part in (1, 16):
        share = F.pmod(F.xxhash64("token", F.lit(part)), F.lit(max(1, top["count"] // (part * TOKEN_BLOCK)))) == 0
        found = staged(_pairs_of_blocks(rest, large.filter(share), threshold, MOST, True), "links")
        edges.append(hashed(found))
        rest = staged(rest.join(found.select(F.col("a").alias("token")).distinct(), "token", "left_anti"), "rest")
    edges.append(hashed(_pairs_of_blocks(rest, tokens, threshold, None, True)))
    return reduce(DataFrame.unionByName, edges).filter("u != v")


def clusters(vocab: DataFrame, threshold: float = 0.75) -> DataFrame:
    """cluster_id, canonical_roman (most frequent member, then first), members, freq; singletons are left out."""
    ids = vocab.select("token", F.xxhash64("token").alias("id"))
    roots = components(variant_links(vocab, threshold))
    named = roots.join(ids, F.col("node") == F.col("id")).join(vocab, "token")
    best = F.min_by("token", F.struct(-F.col("freq"), F.col("token")))
    out = named.groupBy("root").agg(best.alias("canonical_roman"), F.array_sort(F.collect_list("token")).alias("members"), F.sum("freq").alias("freq"))
    return out.select(F.get("members", F.lit(0)).alias("cluster_id"), "canonical_roman", "members", "freq")


def signature_clusters(chosen: DataFrame, threshold: float = 0.75) -> DataFrame:
    """cluster_id, canonical_roman, canonical_devanagari, members, freq. chosen: token, freq, form (the chosen Devanagari form).

    Tokens belong together if their forms do: equal forms, and components of similar ones. The most frequent member (then the
    first) gives both canonical forms; a token alone is a cluster too.
    """
    chosen = staged(chosen.filter(F.coalesce("form", F.lit("")) != ""), "chosen")
    forms = chosen.select("form").distinct()
    roots = components(variant_links(forms.select(F.col("form").alias("token"), F.lit(1).alias("freq")), threshold))
    known = forms.withColumn("id", F.xxhash64("form")).join(roots, F.col("id") == F.col("node"), "left").select("form", F.coalesce("root", "id").alias("root"))
    best = lambda c: F.min_by(c, F.struct(-F.col("freq"), F.col("token")))
    out = chosen.join(known, "form").groupBy("root").agg(best("token").alias("canonical_roman"), best("form").alias("canonical_devanagari"), F.array_sort(F.collect_list("token")).alias("members"), F.sum("freq").alias("freq"))
    return out.select(F.get("members", F.lit(0)).alias("cluster_id"), "canonical_roman", "canonical_devanagari", "members", "freq")


def match_signatures(tokens: DataFrame, clusters: DataFrame, threshold: float = 0.75) -> DataFrame:
    """token, form, cluster_id, normalized, similarity. tokens: token, form. The cluster whose Devanagari form is most similar
    at or above threshold (of equals the more frequent, then the first) gives its Roman form; other tokens pass unchanged."""
    signs = staged(clusters.groupBy(F.col("canonical_devanagari").alias("sign")).agg(F.min_by(F.struct("cluster_id", "canonical_roman", "freq"), F.struct(-F.col("freq"), F.col("cluster_id"))).alias("c")), "signatures")
    asked = tokens.filter(F.coalesce("form", F.lit("")) != "").select("form").distinct()
    root = F.lit(0).cast("long").alias("root")
    near = _pairs_of_blocks(asked.select(F.col("form").alias("token"), root), signs.select(F.col("sign").alias("token"), root), threshold, None, False)
    near = near.join(signs, F.col("b") == F.col("sign"))
    order = F.struct(-F.round("similarity", 9), -F.col("c.freq"), F.col("c.cluster_id"))
    best = near.groupBy(F.col("a").alias("form")).agg(F.min_by(F.struct("c", "similarity"), order).alias("m"))
    out = tokens.join(best, "form", "left")
    return out.select("token", "form", F.col("m.c.cluster_id").alias("cluster_id"), F.coalesce("m.c.canonical_roman", "token").alias("normalized"), F.col("m.similarity").alias("similarity"))


def provenance(routed: DataFrame, candidates_: DataFrame, picked: DataFrame, clusters_: DataFrame) -> DataFrame:
    """token, router_verdict, candidates, pick, reason, cluster_id: how every routed token came to its place in the map."""
    placed = clusters_.select("cluster_id", F.explode("members").alias("token"))
    out = routed.select("token", F.col("category").alias("router_verdict")).join(candidates_.select("token", "candidates"), "token", "left")
    return out.join(picked.select("token", F.col("form").alias("pick"), "reason"), "token", "left").join(placed, "token", "left")
