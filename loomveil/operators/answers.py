"""Wide survey rows to long answers, canonical metadata, facets and filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["institution", "academic_year", "location", "programme", "study_mode", "cohort", "sector", "language"]


def unpivot(df: DataFrame, ids: list[str], questions: list[str], blanks: bool = False) -> DataFrame:
    """(ids, question, q_no, answer) of non-null, and unless asked for non-blank, answers."""
    long = df.unpivot(ids, questions, "question", "answer").where("answer is not null")
    long = long if blanks else long.where("trim(answer) <> ''")
    return long.withColumn("q_no", F.array_position(F.array(*map(F.lit, questions)), F.col("question")))


def first_filled(columns: list[str]) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*(F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string")) for c in columns))


def canonical(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Adds each canonical key from its aliases, in their order, as far as they are columns."""
    have = {k: [c for c in v if c in df.columns] for k, v in aliases.items()}
    return df.withColumns({k: first_filled(v) if v else F.lit(None).cast("string") for k, v in have.items()})


def raw_map(df: DataFrame, columns: list[str]) -> Column:
    """Other columns as a map of non-null values by lower-case name."""
    return F.map_filter(F.map_from_arrays(F.array(*(F.lit(c.lower()) for c in columns)), F.array(*(F.col(c).cast("string") for c in columns))), lambda _, v: v.isNotNull())


def facets(df: DataFrame, keys: list[str]) -> DataFrame:
    """(facet, value): distinct non-blank values of each key."""
    cast = df.select(*(F.col(k).cast("string").alias(k) for k in keys))
    return cast.unpivot([], keys, "facet", "value").where("trim(value) <> ''").distinct()


def normalized(filters: dict) -> dict[str, str]:
    """Without nulls, blanks and 'all'; as strings, keys sorted."""
    return {k: str(v).strip() for k, v in sorted(filters.items()) if v is not None and str(v).strip() and str(v).strip().lower() != "all"}


def condition(filters: dict, aliases: dict[str, list[str]] | None = None) -> Column:
    """All keys must hold; a key holds if one of its columns equals the value."""
    parts = [reduce(lambda a, b: a | b, [F.col(c) == v for c in (aliases or {}).get(k, [k])]) for k, v in normalized(filters).items()]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def preview(text: Column, n: int, dots: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(dots))).otherwise(text)


def year_of(text: Column) -> Column:
    return F.try_to_number(F.split_part(text, F.lit("/"), F.lit(1)), F.lit("9999")).cast("int")


def sentiment_band(score: Column) -> Column:
    return F.when(score >= 65, "positive").when(score <= 38, "critical").otherwise("neutral")


def sentiment_label(score: Column) -> Column:
    return F.when(score >= 75, "very positive").when(score >= 60, "positive").when(score >= 45, "neutral").when(score >= 30, "negative").otherwise("very negative")


def to_percent(sentiment: Column) -> Column:
    """-1..1 to 0..100, half up."""
    return F.floor((sentiment + 1) / 2 * 100 + 0.5)


def strip_quotes(text: Column) -> Column:
    return F.regexp_replace(text, '^"+|"+$', "")
