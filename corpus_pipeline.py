"""Training-corpus pipeline: toxicity, quality rules, near-duplicates, source mixing, tokenization.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; what its operator states of
nulls, empty and very long texts, ties, repeated rows and clashing columns holds for the stage: null and empty texts are not
toxic, fail the quality rules, and so never reach the later stages; repeated rows fall together in near-dedup; other columns
are passed on untouched; an empty table passes through all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import mixing, pieces, quality_rules, simhash, toxicity
from lexloom.llm.common import staged, table, unstage
from lexloom.llm.queries import model_bytes
from lexloom.llm.sampling import remainder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the token chain doesn't call toxic. Fitted on labelled rows outside the held-out fold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return toxicity.tag(docs, model, keep=True)


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line rules, without their failing lines."""
    return quality_rules.clean_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The weighted mix; a document taken twice is two rows."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return pieces.encode_documents(docs, model_bytes())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", clean_lines),
    ("simhash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("sentencepiece", tokenize),
]

#: SQL can express neither the tagger, nor the fingerprints, nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read again."""
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, before, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if name != STAGES[0][0]:
            unstage(before)
        before = docs
    return docs
