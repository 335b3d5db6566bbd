"""Bounded training samples: at most a stated number of labelled rows for each label value is drawn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def remainder(doc_id: str, by: int) -> Column:
    """crc32 of the id as text, modulo by."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % by


def labelled_ids(labels: DataFrame, label: str, per_label: int, where: Column) -> dict:
    """doc_id (of any type) -> label of up to per_label rows of each label, in hash order; of repeated ids the largest label counts."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & where)
    out: dict = {}
    for value in (0, 1):
        some = rows.filter(F.col(label) == value).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        out |= {r["doc_id"]: value for r in some.collect()}
    return out


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, per_label: int, where: Column) -> DataFrame | None:
    """doc_id, text, label of the sample, one row for each id that has a text (of several the least); None if nothing is labelled.

    Only the ids of the sample, at most 2 * per_label, reach the driver and are broadcast; the texts stay on the executors.
    """
    ids = labelled_ids(labels, label, per_label, where)
    if not ids:
        return None
    kind = StructType([StructField("doc_id", labels.schema["doc_id"].dataType), StructField("label", LongType())])
    wanted = docs.sparkSession.createDataFrame(list(ids.items()), kind)
    hits = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").filter(F.col("text").isNotNull())
    return hits.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
