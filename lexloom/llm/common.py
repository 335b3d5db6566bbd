"""Shared plumbing of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.plans.staging import shared_dir, staged, unstage

__all__ = ["WS", "hash60", "numbered", "packed", "shared_dir", "staged", "table", "text_of", "unpacked", "unstage", "words_of"]

#: White space that separates words everywhere in this subpackage, as a regex class body.
WS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text) -> F.Column:
    """The array of words of a text column (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{WS}]+"), "")


def packed(df: DataFrame, *names: str) -> DataFrame:
    """All columns in one struct `_row`, so that no working column can clash with them, beside the named ones."""
    return df.select(F.struct("*").alias("_row"), *names)


def unpacked(df: DataFrame, columns: list[str], **new) -> DataFrame:
    """The packed columns again, some of them replaced."""
    return df.select(*[(new[c] if c in new else F.col("_row").getField(c)).alias(c) for c in columns])


def hash60(*parts) -> Column:
    """A non-negative 60-bit hash of a text, the same in any SQL engine with md5."""
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 15), 16, 10).cast("long")


def text_of(c: str) -> Column:
    """A column as text, nulls as `null`."""
    return F.coalesce(F.col(c).cast("string"), F.lit("null"))


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """Add `_at`, the number (from 1) of a row among those with its key, which must not be null. Which of them gets which number is left open.

    Rows are numbered inside the partitions they come in, which writing them fixes, and shifted by the counts of the partitions
    before, so that no task meets all rows of a key.
    """
    rows = staged(df.withColumn("_pid", F.spark_partition_id()), name)
    per = rows.groupBy(key, "_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    shift = per.select(F.col(key).alias("_nkey"), F.col("_pid").alias("_npid"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(key, "_pid").orderBy(F.lit(0))
    rows = rows.withColumn("_in", F.row_number().over(inside))
    out = rows.join(shift, (F.col(key) == F.col("_nkey")) & (F.col("_pid") == F.col("_npid")))
    return out.withColumn("_at", (F.col("_shift") + F.col("_in")).cast("long")).drop("_pid", "_nkey", "_npid", "_in", "_shift")
