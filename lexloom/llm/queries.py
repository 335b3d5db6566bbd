"""Queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from lexloom.llm import embeddings, language_id, mixing, perspectives, pieces, quality_model, quality_rules, resharding, simhash, toxicity
from lexloom.llm.common import table
from lexloom.llm.sampling import remainder


def model_bytes(path: str | None = None) -> bytes:
    """A SentencePiece model as bytes; they travel with the task, so executors need no file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return Path(path).read_bytes()


def op1_quality_rules(spark, sf_dir):
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


def op2_source_mixing(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op3_simhash_pivots(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_perspective_rotation(spark, sf_dir):
    return perspectives.perspective_report(table(spark, sf_dir, "conversations"))


def op5_subspace_join(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_language_network(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 3) == 1
    out = language_id.predict(docs, language_id.fit(docs, ~held_out))
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_quality_trees(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 3) == 1
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return quality_model.score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_sentencepiece(spark, sf_dir):
    return pieces.encode_documents(table(spark, sf_dir, "documents"), model_bytes())


def op9_toxicity_chain(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    out = toxicity.tag(docs, model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted", F.size("spans").cast("long").alias("n_spans"))


def op10_resharding(spark, sf_dir):
    return resharding.reshard_report(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_source_mixing": op2_source_mixing,
    "op3_simhash_pivots": op3_simhash_pivots,
    "op4_perspective_rotation": op4_perspective_rotation,
    "op5_subspace_join": op5_subspace_join,
    "op6_language_network": op6_language_network,
    "op7_quality_trees": op7_quality_trees,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_toxicity_chain": op9_toxicity_chain,
    "op10_resharding": op10_resharding,
}
ORACLES = {"op1_quality_rules": quality_rules.sql(), "op2_source_mixing": mixing.sql(), "op4_perspective_rotation": perspectives.SQL}
