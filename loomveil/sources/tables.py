"""Readers and writers of survey tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Metadata headers that are no questions.
METADATA = ["id", "institution", "academic_year", "location", "programme", "study_mode", "cohort", "jaar", "actuele naam instelling volgens rio", "actuele brin-volgnummer volgens rio", "leerroute_track", "actuele opleidingsnaam volgens rio", "opleidingsvorm (vt dt du)", "studiejaar volgens instelling", "type student", *(f"label{i}" for i in range(1, 8))]
STARTS = ["wil jij", "waarom", "wat voor soort"]


def read_csv(spark: SparkSession, path: str, sep: str = ";", limit: int | None = None, skip_bad: bool = False) -> DataFrame:
    """All columns as strings; a byte-order mark before the first header goes."""
    df = spark.read.options(header=True, sep=sep, multiLine=True, escape='"', mode="DROPMALFORMED" if skip_bad else "PERMISSIVE").csv(path)
    df = df.toDF(*(c.lstrip("﻿") for c in df.columns))
    return df if limit is None else df.limit(limit)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "")


def infer_separators(spark: SparkSession, path: str, lines: int = 50) -> DataFrame:
    """(path, sep): for each file the separator with the most fields a line, fewest odd lines."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("i"))
    first = text.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy("i"))).where(F.col("r") <= lines)
    seps = F.array(*(F.struct(F.lit(s).alias("sep"), F.lit(i).alias("rank")) for i, s in enumerate([";", ",", "\t"])))
    counted = first.select("path", "value", F.explode(seps).alias("s")).select("path", "s.sep", "s.rank", F.size(F.expr("split(value, concat('\\\\Q', s.sep, '\\\\E'), -1)")).alias("n"))
    common = counted.groupBy("path", "sep", "rank").agg(F.mode("n").alias("fields"), F.variance("n").alias("spread"))
    score = F.struct((F.col("fields") > 1).cast("int"), "fields", -F.coalesce("spread", F.lit(0.0)), -F.col("rank"))
    return common.groupBy("path").agg(F.max_by("sep", score).alias("sep"))


def is_question(header: str) -> bool:
    name = header.strip().lower()
    return name not in METADATA and not name.startswith("themascore") and ("?" in name or name.startswith(tuple(STARTS)))


def is_question_column(header: Column) -> Column:
    """The same rule over a table of headers."""
    name = F.lower(F.trim(header))
    starts = [name.startswith(s) for s in STARTS]
    return ~name.isin(METADATA) & ~name.startswith("themascore") & (name.contains("?") | starts[0] | starts[1] | starts[2])


def first_samples(df: DataFrame, order: str) -> DataFrame:
    """(column, sample): the first non-blank value of each column."""
    columns = [c for c in df.columns if c != order]
    first = [F.min_by(F.struct(F.col(c).cast("string")), F.when(F.trim(F.col(c).cast("string")) != "", F.col(order))).getField("col1").alias(c) for c in columns]
    return df.agg(*first).unpivot([], columns, "column", "sample")


def save_blocklist(words: DataFrame, path: str) -> None:
    distinct_words(words).write.mode("overwrite").parquet(path)


def distinct_words(words: DataFrame) -> DataFrame:
    """(word, ord) trimmed, the first of words that differ in case only."""
    clean = words.select(F.trim("word").alias("word"), "ord").where("word <> ''")
    return clean.groupBy(F.lower("word").alias("k")).agg(F.min(F.struct("ord", "word")).alias("m")).select("m.word", "m.ord")


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else getattr(writer, kind)(path)
