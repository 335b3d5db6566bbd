"""Adjudication of uncertain tokens: prompts, a pluggable model, response parsing and the final decision."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.lexicon import PROMPT_HEAD, PROMPT_TAIL, VERDICTS
from lexloom.functions.text import parse_json


def prompt(token: Column, examples: Column) -> Column:
    """The adjudicator's prompt with numbered example sentences."""
    head = [F.replace(F.lit(line), F.lit("{token}"), token) for line in PROMPT_HEAD]
    numbered = F.array_join(F.transform(examples, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")
    return F.concat_ws("\n", *head, F.when(F.size(examples) > 0, numbered), *[F.lit(line) for line in PROMPT_TAIL])


def parsed(response: Column) -> Column:
    """Struct (ok, label, reason) of a response; label from its field, else from anywhere in the object."""
    v = parse_json(response)
    pattern = rf"(?i)\b({'|'.join(VERDICTS)})\b"
    named = F.regexp_extract(F.coalesce(F.try_variant_get(v, "$.label", "string"), F.lit("")), pattern, 1)
    anywhere = F.regexp_extract(F.coalesce(F.to_json(v), F.lit("")), pattern, 1)
    label = F.nullif(F.upper(F.when(named != "", named).otherwise(anywhere)), F.lit(""))
    return F.struct(v.isNotNull().alias("ok"), label.alias("label"), F.coalesce(F.trim(F.try_variant_get(v, "$.reason", "string")), F.lit("")).alias("reason"))


def decision(label: Column, reason: Column, error: Column) -> Column:
    """Struct (label, reason): failures and unknown labels default to HINGLISH, ambiguous tokens await review."""
    out = lambda name, why: F.struct(name.alias("label"), why.alias("reason"))
    return (
        F.when(label.isNull(), out(F.lit("HINGLISH"), F.concat(F.lit("llm_call_failed_default:"), F.coalesce(error, F.lit("")))))
        .when(label == "ENGLISH", out(label, reason))
        .when(label == "AMBIGUOUS", out(F.lit("PENDING_MANUAL_REVIEW"), reason))
        .otherwise(out(F.lit("HINGLISH"), F.when(reason == "", "ambiguous-unsure-default").otherwise(reason)))
    )


def decide(rows: DataFrame) -> DataFrame:
    """rows: token, freq, examples (array), response, error. Tokens without an example are not judged at all."""
    p = rows.withColumn("_p", parsed(F.col("response"))).withColumn("_d", decision(F.col("_p.label"), F.col("_p.reason"), F.col("error")))
    none = F.size("examples") == 0
    return p.select("token", "freq", F.when(none, "HINGLISH").otherwise(F.col("_d.label")).alias("label"), F.when(none, "no_context_default").otherwise(F.col("_d.reason")).alias("reason"))


def pending(pool: DataFrame, done: DataFrame) -> DataFrame:
    """Tokens of the pool that no earlier run finished; failed calls are tried again."""
    return pool.join(done.filter(~F.col("reason").startswith("llm_call_failed_default")), "token", "left_anti")


def call_model(prompts: DataFrame, model: Callable[[str], str], attempts: int = 2) -> DataFrame:
    """token, response, error from a pluggable text model, called on the executors; an exception becomes the row's error."""

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            out, errors = [], []
            for text in pdf.prompt:
                answer, error = None, None
                for _ in range(attempts):
                    try:
                        answer, error = model(text), None
                        break
                    except Exception as e:  # the plug-in may raise anything; the row records it
                        error = f"{type(e).__name__}: {e}"
                out.append(answer)
                errors.append(error)
            yield pdf[["token"]].assign(response=out, error=errors)

    return prompts.select("token", "prompt").mapInPandas(run, "token string, response string, error string")


def error_kind(code: Column, message: Column, timed_out: Column) -> Column:
    """Class of a failed call."""
    text = F.replace(F.lower(F.coalesce(message, F.lit(""))), F.lit("_"), F.lit(" "))
    key = text.rlike("api key|key not valid|unauthenticated|permission denied")
    return (
        F.when(timed_out, "network-or-timeout")
        .when(code == 429, "rate-limit")
        .when(code.isin(400, 401, 403) & key, "bad-key")
        .when(code.between(500, 599), "server-error")
        .when(code.isNotNull(), "client-error")
        .otherwise("other")
    )


def back_off(kind: Column, retry_after: Column, streak: Column) -> Column:
    """Seconds to wait: 3, or one more than the server asks; rate limits multiply by their streak, at least 10; at most 300."""
    base = F.coalesce(retry_after + 1, F.lit(3))
    return F.least(F.when(kind == "rate-limit", F.greatest(base * streak, F.lit(10))).otherwise(base), F.lit(300))


def preferred(names: DataFrame, order: list[str], family: str = "", fallback: str | None = None) -> DataFrame:
    """One row: the first preferred name that exists, else the first stable one, else the first, else the fallback.

    names: name, pos (place in the catalogue). Only names that hold `family` take part.
    """
    spark = names.sparkSession
    ranks = spark.createDataFrame(list(enumerate(order)), "pref int, name string")
    ranked = names.filter(F.col("name").contains(family)).select(F.regexp_replace("name", "^models/", "").alias("name"), "pos").join(F.broadcast(ranks), "name", "left")
    key = F.struct(F.coalesce("pref", F.lit(len(order))), F.when(F.col("name").endswith("-preview"), 1).otherwise(0), "pos")
    return ranked.agg(F.coalesce(F.min_by("name", key), F.lit(fallback).cast("string")).alias("name"))


def selection_prompt(token: Column, examples: Column, candidates: Column) -> Column:
    """The prompt that asks for one of the candidates, by number, or none."""
    listed = lambda c: F.array_join(F.transform(c, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")
    ask = 'Answer with only JSON: {"pick": <number of the candidate, 0 if none is usable>, "reason": "one line"}'
    return F.concat_ws("\n", F.concat(F.lit("Choose the written form of the token: "), token), F.lit("Sentences:"), listed(examples), F.lit("Candidates:"), listed(candidates), F.lit(ask))


def select_candidate(rows: DataFrame) -> DataFrame:
    """token, pick, form, reason. rows: token, candidates (array), response, error.

    The answer may name a candidate by number or by its text. Whatever is none of the candidates picks nothing: a form is
    never invented.
    """
    v = parse_json(F.col("response"))
    said = F.trim(F.coalesce(F.try_variant_get(v, "$.pick", "string"), F.lit("")))
    number = F.when(said.rlike("^[0-9]{1,4}$"), said.cast("int"))
    place = F.when(number.between(1, F.size("candidates")), number).when(number.isNull() & (said != ""), F.nullif(F.array_position("candidates", said).cast("int"), F.lit(0)))
    why = F.when(F.col("response").isNull(), F.concat(F.lit("llm_call_failed:"), F.coalesce("error", F.lit("")))).when(v.isNull(), "unparseable").otherwise(F.coalesce(F.trim(F.try_variant_get(v, "$.reason", "string")), F.lit("")))
    return rows.select("token", place.alias("pick"), F.get("candidates", place - 1).alias("form"), why.alias("reason"))


def health(spark, model: Callable[[str], str], wanted: str = "ok") -> DataFrame:
    """check, ok, kind, ms: a plain call and a call that must answer with JSON, timed on the driver before a large run."""
    rows = []
    for check, text in (("plain", "Answer with one word."), ("json", f'Respond with only this JSON: {{"status": "{wanted}"}}')):
        began, answer, kind = time.perf_counter(), None, None
        try:
            answer = model(text)
            kind = None if (answer or "").strip() else "empty"
        except Exception as e:  # the plug-in may raise anything; the row records it
            kind = type(e).__name__
        rows.append((check, answer, kind, (time.perf_counter() - began) * 1000))
    got = spark.createDataFrame(rows, "check string, answer string, kind string, ms double")
    bad = (F.col("check") == "json") & ~F.coalesce(F.try_variant_get(parse_json(F.col("answer")), "$.status", "string") == wanted, F.lit(False))
    kind = F.coalesce("kind", F.when(bad, "unparseable"))
    return got.select("check", kind.isNull().alias("ok"), kind.alias("kind"), "ms")
