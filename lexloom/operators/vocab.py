"""Vocabularies: document frequencies, coverage in frequency order, cross-tabs, examples, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import SPACE, length_bucket, tokens
from lexloom.plans.running import running_total


def document_frequency(docs: DataFrame, text: str = "text") -> DataFrame:
    """token, freq: rows that hold the token, each counted once. Counts are combined before the shuffle."""
    return docs.filter(F.col(text).isNotNull()).select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))


def totals(vocab: DataFrame) -> DataFrame:
    return vocab.agg(F.count("token").alias("n_tokens"), F.coalesce(F.sum("freq"), F.lit(0)).alias("mass"))


def by_frequency() -> list[Column]:
    """The total order of a vocabulary."""
    return [F.desc("freq"), F.asc("token")]


def top(vocab: DataFrame, n: int) -> DataFrame:
    return vocab.orderBy(*by_frequency()).limit(n)


def coverage(vocab: DataFrame) -> DataFrame:
    """Add rank, running and cum_pct (rounded to 3 places) in frequency order."""
    out = running_total(vocab, by_frequency(), "freq", total="total")
    return out.withColumn("cum_pct", F.round(F.col("running") / F.col("total") * 100, 3))


def rank_at_share(covered: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the first rank whose running total reaches each share of the mass."""
    cols = [F.struct(F.lit(s).alias("share"), F.min(F.when(F.col("running") >= s * F.col("total"), F.col("rank"))).alias("n_tokens")) for s in shares]
    return covered.agg(F.array(*cols).alias("a")).select(F.inline("a"))


def ranks_at_percent(covered: DataFrame, percents: list[int]) -> DataFrame:
    """One row: for each percent the tokens below it, by rounded percentage, plus one."""
    return covered.agg(*[(F.count_if(F.col("cum_pct") < p) + 1).alias(f"n_{p}") for p in percents])


def share_at_rank(covered: DataFrame, ranks: list[int]) -> DataFrame:
    """rank, share: percent of the mass that the first `rank` tokens cover (all of it beyond the last token)."""
    at = [F.struct(F.lit(r).cast("long").alias("rank"), F.round(100 * F.max(F.when(F.col("rank") <= r, F.col("running"))) / F.max("total"), 4).alias("share")) for r in ranks]
    return covered.agg(F.array(*at).alias("a")).select(F.inline("a"))


def union_of(*vocabularies: DataFrame) -> DataFrame:
    """The distinct tokens of several vocabularies."""
    out = vocabularies[0].select("token")
    for v in vocabularies[1:]:
        out = out.unionByName(v.select("token"))
    return out.distinct()


def pilot_pool(covered: DataFrame, high: int = 80, low: int = 70, most: int = 2500) -> DataFrame:
    """Tokens up to the high percent if that takes at most `most` of them, else up to the low one."""
    ranks = ranks_at_percent(covered, [low, high])
    cut = F.when(F.col(f"n_{high}") <= most, F.col(f"n_{high}")).otherwise(F.col(f"n_{low}"))
    return covered.crossJoin(F.broadcast(ranks)).filter(F.col("rank") <= cut).select("token", "freq", "cum_pct")  # one row


def crosstab(labelled: DataFrame, label: str, values: list[str], share_of: str) -> DataFrame:
    """Length bucket by label counts with row total and the share of one label in percent."""
    out = labelled.groupBy(length_bucket(F.col("token")).alias("bucket")).agg(*[F.count_if(F.col(label) == v).alias(v.lower()) for v in values], F.count(F.lit(1)).alias("total"))
    share = F.when(F.col("total") > 0, F.round(100 * F.col(share_of.lower()) / F.col("total"), 4)).otherwise(0.0)
    return out.withColumn("share", share)


def histogram(labelled: DataFrame, label: str, values: tuple[str, ...]) -> DataFrame:
    """Counts and percents of labels, with rows for values that never occur."""
    spark = labelled.sparkSession
    counts = labelled.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    every = spark.createDataFrame([(v,) for v in values], "label string").join(counts, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy())  # as many rows as values
    return every.withColumn("percent", F.when(total > 0, F.round(100 * F.col("n") / total, 4)).otherwise(0.0))


def label_mass(labelled: DataFrame, bands: tuple[int, ...] = (1, 5, 10, 50)) -> DataFrame:
    """Tokens and row mass for each label and method, and tokens at or above each frequency."""
    return labelled.groupBy("label", "method").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum("freq").alias("mass"), *[F.count_if(F.col("freq") >= b).alias(f"at_least_{b}") for b in bands])


def sample(vocab: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n tokens drawn by a seeded hash, then in frequency order."""
    return vocab.orderBy(F.md5(F.concat(F.lit(str(seed)), "token")), "token").limit(n)


def examples(docs: DataFrame, wanted: DataFrame, key: str = "doc_id", text: str = "text", most: int = 3, case_sensitive: bool = False) -> DataFrame:
    """token, first (id of its first row), ids (first `most` rows that hold it). wanted: distinct tokens.

    The inverted index is cut to the wanted tokens before ranking; ranking keeps at most `most` rows of a token per task.
    """
    t = F.split(F.coalesce(F.col(text), F.lit("")), f"[{SPACE}]+") if case_sensitive else tokens(F.col(text))
    hits = docs.select(key, F.explode(F.array_distinct(t)).alias("token")).join(wanted.select("token"), "token", "left_semi")
    order = Window.partitionBy("token").orderBy(key)
    some = hits.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= most)
    return some.groupBy("token").agg(F.min(key).alias("first"), F.array_sort(F.collect_list(key)).alias("ids"))


def unmatched(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tokens of exactly one side."""
    left, right = a.select("token"), b.select("token")
    return left.join(right, "token", "left_anti").unionByName(right.join(left, "token", "left_anti")).distinct()
