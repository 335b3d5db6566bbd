"""Evaluation of predicted strings against references."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scored(pairs: DataFrame) -> DataFrame:
    """pairs: want, got. Adds exact, distance and character error rate."""
    d = F.levenshtein("want", "got")
    return pairs.withColumns({"exact": (F.col("want") == F.col("got")).cast("int"), "distance": d, "cer": d / F.greatest(F.length("want"), F.lit(1))})


def histogram(pairs: DataFrame) -> DataFrame:
    """distance, n, share of exact matches and mean error rate for each distance."""
    return scored(pairs).groupBy("distance").agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg("exact"), 6).alias("exact_pct"), F.round(100 * F.avg("cer"), 6).alias("cer_pct"))


def bars(counts: DataFrame, label: str, n: str, width: int = 40) -> DataFrame:
    """label, n, bar: the data of a bar plot, with bars of `#` scaled to the largest count. counts: an aggregate, never data."""
    top = F.max(n).over(Window.partitionBy())  # as many rows as bars
    length = F.when(top > 0, F.round(width * F.col(n) / top)).otherwise(0).cast("int")
    return counts.select(F.col(label).alias("label"), F.col(n).alias("n"), F.repeat(F.lit("#"), length).alias("bar"))


def progress(done: Column, total: Column, seconds: Column) -> Column:
    """Struct (ms_per_item, minutes_left) of a run that took `seconds` for `done` of `total` items; null before the first."""
    per = F.when(done > 0, seconds / done)
    return F.struct((per * 1000).alias("ms_per_item"), (per * (total - done) / 60).alias("minutes_left"))


def timed(spark: SparkSession, engine: Callable[[str], object], batch: Callable[[list[str]], object], words: list[str], runs: int = 10) -> DataFrame:
    """mode, runs, items, mean_ms, max_ms, per_item_ms of single calls and of one batch call of a plug-in, each after a warm-up."""

    def clock(call: Callable[[], object]) -> float:
        began = time.perf_counter()
        call()
        return (time.perf_counter() - began) * 1000

    clock(lambda: engine(words[0]))
    single = [clock(lambda: engine(words[0])) for _ in range(runs)]
    clock(lambda: batch(words[:5]))
    whole = clock(lambda: batch(words))
    rows = [("single", runs, 1, sum(single) / runs, max(single), sum(single) / runs), ("batch", 1, len(words), whole, whole, whole / len(words))]
    return spark.createDataFrame(rows, "mode string, runs int, items int, mean_ms double, max_ms double, per_item_ms double")
