"""Token language: the three-way router and the five-label rules cascade over injected lexicons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.lexicon import AMBIGUOUS_OVERRIDE, HINGLISH_OVERRIDE
from lexloom.functions.text import fuzzy_limit, is_number_like, non_linguistic

MIN_FUZZY = 7


def _flagged(tokens: DataFrame, words: DataFrame, flag: str) -> DataFrame:
    """Mark tokens whose lower case is a word; Spark broadcasts the lexicon if its size allows."""
    known = words.select(F.col("word").alias("_w"), F.lit(True).alias(flag)).distinct()
    return tokens.join(known, F.lower("token") == F.col("_w"), "left").drop("_w").withColumn(flag, F.coalesce(flag, F.lit(False)))


def route(tokens: DataFrame, english: DataFrame) -> DataFrame:
    """Add category: numbers first, then English words, all else is a Hinglish candidate (blank tokens too)."""
    category = F.when(is_number_like(F.col("token")), "NUMERIC_OR_ALPHANUMERIC").when(F.col("_en"), "ENGLISH").otherwise("CANDIDATE_HINGLISH")
    return _flagged(tokens, english, "_en").withColumn("category", category).drop("_en")


def _segment(word: Column, first: Column, last: Column) -> Column:
    return F.substring(word, (first + 1).cast("int"), (last - first).cast("int"))


def fuzzy_matches(tokens: DataFrame, lemmas: DataFrame, common: DataFrame | None, exact: bool = False) -> DataFrame:
    """Distinct tokens of MIN_FUZZY letters or more within 1 edit (2 above 9 letters) of a common lemma that shares the first letter.

    A lemma cut into k + 1 segments keeps one of them whole under k edits, moved by at most k places. So tokens and lemmas meet
    by the hash of lemma length, segment number, segment text and first letter, and only then are compared. Without a list of
    common words every lemma counts. With exact, tokens that equal a lemma match whether or not it is common.
    """
    word = F.lower("token")
    wanted = tokens.select(word.alias("w")).distinct().withColumn("m", F.length("w")).filter(F.col("m") >= MIN_FUZZY).withColumn("k", fuzzy_limit(F.col("m")))
    every = lemmas.select(F.col("word").alias("l")).distinct()
    pool = every
    if common is not None:
        pool = pool.join(common.select(F.col("word").alias("l")), "l", "left_semi")
    edge = lambda n, k, i: F.floor(n * i / (k + 1))
    first = lambda c: F.substring(c, 1, 1)
    pool = pool.withColumn("n", F.length("l")).filter(F.col("n") >= MIN_FUZZY - 1)
    parts = [F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), _segment(F.col("l"), edge(F.col("n"), k, i), edge(F.col("n"), k, i + 1)).alias("s")) for k in (1, 2) for i in range(k + 1)]
    pool = pool.select("l", "n", F.explode(F.array(*parts)).alias("p")).select("l", F.xxhash64("p.k", "n", "p.i", "p.s", first("l")).alias("key"))
    near = wanted.select("w", "m", "k", F.explode(F.sequence(F.col("m") - F.col("k"), F.col("m") + F.col("k"))).alias("n"))
    near = near.select("w", "k", "n", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i")).select("w", "k", "n", "i", edge(F.col("n"), F.col("k"), F.col("i")).alias("a"), edge(F.col("n"), F.col("k"), F.col("i") + 1).alias("b"))
    near = near.select("*", F.explode(F.sequence(-F.col("k"), F.col("k"))).alias("d")).filter((F.col("a") + F.col("d") >= 0) & (F.col("b") + F.col("d") <= F.length("w")))
    near = near.select("w", "k", F.xxhash64("k", "n", "i", _segment(F.col("w"), F.col("a") + F.col("d"), F.col("b") + F.col("d")), first("w")).alias("key"))  # a word's few equal keys go with the matches' distinct
    distance = F.levenshtein("w", "l", 2)
    found = near.join(pool, "key").filter((distance >= 0) & (distance <= F.col("k")) & (first("w") == first("l"))).select("w")
    if exact and common is not None:
        found = found.union(wanted.select("w").join(every, F.col("w") == F.col("l"), "left_semi"))
    return found.select(F.col("w").alias("word")).distinct()


def classify(tokens: DataFrame, english: DataFrame, lemmas: DataFrame | None = None, common: DataFrame | None = None) -> DataFrame:
    """Add label and method by the first rule that holds. Fuzzy matching sees only tokens no earlier rule took."""
    word = F.lower("token")
    out = _flagged(tokens, english, "_en").withColumn("_odd", non_linguistic(F.col("token")))
    taken = F.col("_odd") | word.isin(*AMBIGUOUS_OVERRIDE, *HINGLISH_OVERRIDE) | F.col("_en")
    if lemmas is not None:
        out = _flagged(out, fuzzy_matches(out.filter(~taken), lemmas, common, exact=True), "_near")
    else:
        out = out.withColumn("_near", F.lit(False))
    near = F.col("_near") & ~taken
    rule = lambda label, method: F.struct(F.lit(label).alias("label"), (F.lit(method) if isinstance(method, str) else method).alias("method"))
    label = (
        F.when(F.col("_odd"), rule("NON_LINGUISTIC", "regex_prefilter"))
        .when(word.isin(*AMBIGUOUS_OVERRIDE), rule("AMBIGUOUS", "override_ambiguous"))
        .when(word.isin(*HINGLISH_OVERRIDE), rule("HINGLISH", "override_hinglish"))
        .when(F.col("_en"), rule("ENGLISH", "wordnet_exact"))
        .when(near, rule("ENGLISH", F.concat(F.lit("wordnet_fuzzy_edit"), fuzzy_limit(F.length(word)).cast("string"))))
        .otherwise(rule("UNCERTAIN_NEEDS_LLM", "unresolved"))
    )
    return out.withColumn("_l", label).withColumns({"label": F.col("_l.label"), "method": F.col("_l.method")}).drop("_l", "_en", "_odd", "_near")


def self_test(classified: DataFrame, expected: DataFrame) -> DataFrame:
    """correct, deferred, wrong and accuracy of labelled tokens. expected: token, want."""
    got = expected.join(classified.select("token", "label"), "token", "left")
    deferred = F.col("label").isNull() | F.col("label").isin("UNCERTAIN_NEEDS_LLM", "AMBIGUOUS")
    right = F.col("label") == F.col("want")
    out = got.agg(F.count_if(right).alias("correct"), F.count_if(deferred & ~F.coalesce(right, F.lit(False))).alias("deferred"), F.count(F.lit(1)).alias("total"))
    wrong = F.col("total") - F.col("correct") - F.col("deferred")
    accuracy = F.when(F.col("total") > 0, F.round(100 * F.col("correct") / F.col("total"), 4)).otherwise(0.0)
    return out.select("correct", "deferred", wrong.alias("wrong"), accuracy.alias("accuracy"))
