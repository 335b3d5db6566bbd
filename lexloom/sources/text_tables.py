"""Delimited and JSON interchange files, always with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Unquoted, so that tokens may hold quotes; empty fields stay empty text."""
    return spark.read.schema(schema).option("header", True).option("sep", "\t").option("quote", "").option("emptyValue", "").csv(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """token, freq (null if absent) of lines `token` or `token<TAB>freq`; blank lines and a header go."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).filter(F.trim("value") != "")
    out = rows.select(F.get(parts, F.lit(0)).alias("token"), F.try_to_number(F.get(parts, F.lit(1)), F.lit("999999999999")).cast("long").alias("freq"))
    return out.filter(~((F.col("token") == "token") & F.col("freq").isNull()))


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_tsv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Unquoted; tabs and line breaks in text become spaces."""
    text = {c: F.translate(c, "\t\r\n", "   ") for c, kind in df.dtypes if kind == "string"}
    df.withColumns(text).write.mode(mode).option("header", True).option("sep", "\t").option("quote", "").option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def write_split(df: DataFrame, path: str, by: dict[str, str], mode: str = "append") -> None:
    """One unquoted file set per named condition, from one computed result."""
    from lexloom.plans.staging import staged

    once = staged(df, "split")
    for name, condition in by.items():
        write_tsv(once.filter(condition), f"{path}/{name}", mode)


def markdown(summary: DataFrame, order: list[Column]) -> DataFrame:
    """pos, line: a small summary (an aggregate, never data) as a Markdown table in the given order."""
    head = [(0, f"| {' | '.join(summary.columns)} |"), (1, "|" + "-|" * len(summary.columns))]
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in summary.columns]
    rows = summary.select((F.row_number().over(Window.orderBy(*order)) + 1).cast("long").alias("pos"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    return summary.sparkSession.createDataFrame(head, "pos long, line string").unionByName(rows)


def console(summary: DataFrame, order: list[Column]) -> DataFrame:
    """pos, line: a small summary (an aggregate, never data) as an aligned text table: numbers to the right, all else to the left."""
    numbers = {c for c, kind in summary.dtypes if kind in ("tinyint", "smallint", "int", "bigint", "float", "double")}
    text = summary.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("pos"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in summary.columns])
    text = summary.sparkSession.createDataFrame([(0, *summary.columns)], "pos long, " + ", ".join(f"`{c}` string" for c in summary.columns)).unionByName(text)
    width = {c: F.max(F.length(c)).over(Window.partitionBy()) for c in summary.columns}
    cells = [F.lpad(c, width[c], " ") if c in numbers else F.rpad(c, width[c], " ") for c in summary.columns]
    return text.select("pos", F.rtrim(F.concat_ws("  ", *cells)).alias("line"))


def top_lexicon(freqs: DataFrame, n: int) -> DataFrame:
    """word: the n most frequent tokens, equal ones in order of the token."""
    return freqs.orderBy(F.desc("freq"), "token").limit(n).select(F.col("token").alias("word"))


def optional_lexicon(spark: SparkSession, words: DataFrame | None) -> DataFrame:
    return words if words is not None else spark.createDataFrame([], "word string")


def neighbours(turns: DataFrame) -> DataFrame:
    """Parallel pairs from a dialogue: a user turn and the assistant turn that follows it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    both = turns.withColumns({"next_role": F.lead("role").over(w), "translation": F.lead("text").over(w)})
    return both.filter("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("sentence"), "translation")
