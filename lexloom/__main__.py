"""Label a vocabulary file: python -m lexloom --vocab IN --out OUT [--english FILE] [--lemmas FILE] [--skip-self-test]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lexloom.functions import lexicon as L
from lexloom.operators import classify, vocab
from lexloom.plans.staging import staged
from lexloom.sources import text_tables


def label_file(spark: SparkSession, source: str, out: str, english: str | None = None, lemmas: str | None = None) -> None:
    """Write token, label, method of every line of a vocabulary file and show the histogram of labels."""
    words = lambda path: text_tables.optional_lexicon(spark, spark.read.text(path).withColumnRenamed("value", "word") if path else None)
    tokens = text_tables.read_vocabulary(spark, source)
    labelled = staged(classify.classify(tokens, words(english), words(lemmas) if lemmas else None, words(english) if english else None).select("token", "label", "method"), "labelled")
    text_tables.write_tsv(labelled, out)
    vocab.histogram(labelled, "label", L.LABELS).show(truncate=False)


def self_test(spark: SparkSession) -> float:
    """Accuracy of the rules on the known tokens; the English ones stand in for a dictionary."""
    want = [(t, "HINGLISH") for t in L.KNOWN_HINGLISH] + [(t, "ENGLISH") for t in L.KNOWN_ENGLISH]
    expected = spark.createDataFrame(want, "token string, want string")
    english = spark.createDataFrame([(t,) for t in L.KNOWN_ENGLISH], "word string")
    result = classify.self_test(classify.classify(expected.select("token"), english), expected)
    result.show()
    return result.first()["accuracy"]


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lexloom", description=__doc__)
    parser.add_argument("--vocab", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--english", help="text file with one English word a line")
    parser.add_argument("--lemmas", help="text file with one dictionary form a line, for fuzzy matching")
    parser.add_argument("--skip-self-test", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("lexloom").getOrCreate()
    if not args.skip_self_test:
        self_test(spark)
    label_file(spark, args.vocab, args.out, args.english, args.lemmas)


if __name__ == "__main__":
    main()
