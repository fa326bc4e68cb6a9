"""Batches of answers, prompts, replies, subtheme mentions, cache and dashboard comparisons."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BATCH_DOCS = 60
MAX_DOCS = 240
# Words of a label that count for nothing.
STOP_WORDS = ["and", "the", "for", "with", "from", "that", "this", "over", "into", "aan", "een", "het", "van", "voor", "met", "naar"]
WORD = "[a-zA-ZÀ-ÿ0-9]+"


def number_batches(docs: DataFrame, group: str, order: list, size: int = BATCH_DOCS, cap: int | None = MAX_DOCS) -> DataFrame:
    """Adds rn and batch_no within a group; cap keeps the nearest documents of a theme (top-k)."""
    out = docs.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    out = out if cap is None else out.where(F.col("rn") <= cap)
    return out.withColumn("batch_no", F.floor((F.col("rn") - 1) / size))


def batch_prompts(numbered: DataFrame, group: str, text: str, head: str = "Summarise the answers on {theme_name}, batch {n}:\n") -> DataFrame:
    """(group, batch_no, n_docs, prompt): answers of a batch, at most its size, in order."""
    gathered = numbered.groupBy(group, "batch_no").agg(F.array_sort(F.collect_list(F.struct("rn", F.col(text).alias("d")))).alias("docs"))
    lines = F.array_join(F.transform("docs", lambda d: F.concat(F.lit("- "), d["d"], F.lit("\n"))), "")
    title = F.replace(F.replace(F.lit(head), F.lit("{theme_name}"), F.col(group).cast("string")), F.lit("{n}"), (F.col("batch_no") + 1).cast("string"))
    return gathered.select(group, "batch_no", F.size("docs").alias("n_docs"), F.concat(title, lines).alias("prompt"))


def reduce_prompts(summaries: DataFrame, group: str, head: str = "Combine the summaries:\n") -> DataFrame:
    rows = F.to_json(F.array_sort(F.collect_list(F.struct("batch_no", "summary"))))
    return summaries.groupBy(group).agg(F.concat(F.lit(head), rows).alias("prompt"))


def parse_reply(reply: Column, schema: str) -> Column:
    """The outermost braces of a reply as a struct; null if they hold no JSON of that form."""
    return F.from_json(F.nullif(F.regexp_extract(reply, r"\{[\s\S]*\}", 0), F.lit("")), schema, {"mode": "PERMISSIVE"})


def _starts(root: str):
    return lambda word: word.startswith(root)


def subtheme_mentions(docs: DataFrame, text: str, labels: list[str]) -> DataFrame:
    """(subtheme, mentions, doc_percentage, percentage): a document mentions a label if it holds it, a
    word of it over three letters, or a word that starts like a long word of it."""
    labels = [label.strip() for label in labels if label.strip()]
    schema = "subtheme string, mentions bigint, doc_percentage bigint, percentage bigint"
    if not labels:
        return docs.sparkSession.createDataFrame([], schema)
    lower = F.lower(F.col(text))
    words = F.array_distinct(F.filter(F.split(lower, "[^a-zA-ZÀ-ÿ0-9]+"), lambda w: F.length(w) > 3))
    base = docs.select(lower.alias("t"), words.alias("w"))
    counts = []
    for i, label in enumerate(labels):
        low = label.lower()
        tokens = [w for w in dict.fromkeys(re.findall(WORD, low)) if len(w) > 3 and w not in STOP_WORDS]
        hit = F.col("t").contains(low)
        if tokens:
            hit = hit | F.arrays_overlap("w", F.array(*map(F.lit, tokens)))
        for root in dict.fromkeys(w[:6] for w in tokens if len(w) > 6):
            hit = hit | F.exists("w", _starts(root))
        counts.append(F.count_if(hit).alias(f"c{i}"))
    rows = base.agg(F.count(F.lit(1)).alias("n"), *counts)  # one row; labels may hold any character, so they are no columns
    pairs = F.array(*(F.struct(F.lit(label).alias("subtheme"), F.col(f"c{i}").alias("mentions")) for i, label in enumerate(labels)))
    total = sum((F.col(f"c{i}") for i in range(len(labels))), F.lit(0))
    share = lambda a, b: F.when(b > 0, F.bround(a / b * 100)).otherwise(0).cast("bigint")
    long = rows.where("n > 0").select("n", total.alias("total"), F.explode(pairs).alias("p"))
    return long.select("p.subtheme", "p.mentions", share(F.col("p.mentions"), F.col("n")).alias("doc_percentage"), share(F.col("p.mentions"), F.col("total")).alias("percentage"))


def cache_key(theme: Column, filters: Column) -> Column:
    """theme, and the non-blank filters in order of their keys."""
    entries = F.array_sort(F.map_entries(F.map_filter(filters, lambda _, v: v.isNotNull() & (F.trim(v) != "") & (F.lower(F.trim(v)) != "all"))))
    return F.when(F.size(entries) > 0, F.concat(theme, F.lit("::filters="), F.to_json(F.map_from_entries(entries)))).otherwise(theme)


def split_cache(wanted: DataFrame, cached: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) by null-safe equality on key and settings."""
    a, b = wanted.alias("a"), cached.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in on]
    return a.join(b, same, "left_semi"), a.join(b, same, "left_anti")


def overlay(layers: list[DataFrame], key: str) -> DataFrame:
    """Rows of later layers replace those of earlier ones with the same key."""
    numbered = [d.withColumn("__p", F.lit(i)) for i, d in enumerate(layers)]
    out = numbered[0]
    for d in numbered[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    last = Window.partitionBy(key).orderBy(F.desc("__p"))
    return out.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__p", "__r")


def compare_groups(rows: DataFrame, group: str, score: str, theme: str, top: int = 5) -> DataFrame:
    """(group, mean_score, responses, themes): themes holds the top themes with counts."""
    totals = rows.groupBy(group).agg(F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("responses"))
    counts = rows.groupBy(group, theme).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), theme))).where(F.col("r") <= top)
    themes = ranked.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("r", F.col(theme).cast("string").alias("theme"), "n"))).alias("themes"))
    return totals.join(themes, group)


def shares(counts: DataFrame, n: str = "n") -> DataFrame:
    """Adds share: whole percents, half up, of a table of a few rows."""
    total = F.sum(n).over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("share", F.floor(100 * F.col(n) / F.greatest(total, F.lit(1)) + 0.5))


def related(shared: DataFrame, key: str, share: str, k: int = 3) -> DataFrame:
    """(key, other, gap): for each of a few themes the k others nearest in share."""
    a, b = shared.select(F.col(key).alias("a"), F.col(share).alias("x")), shared.select(F.col(key).alias("b"), F.col(share).alias("y"))
    pairs = a.join(b, F.col("a") != F.col("b")).withColumn("gap", F.abs(F.col("x") - F.col("y")))
    return pairs.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("gap", "b"))).where(F.col("r") <= k).select(F.col("a").alias(key), F.col("b").alias("other"), "gap", "r")


def trend_selection(shared: DataFrame, key: str, share: str, active, k: int = 5) -> DataFrame:
    """The top k themes by share, with the active one in the last place if it is not among them."""
    r = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(share), key))
    ranked = shared.withColumn("r", r)
    is_active, of_active = F.col(key) == F.lit(active), F.max(F.when(F.col(key) == F.lit(active), F.col("r"))).over(Window.partitionBy(F.lit(1)))
    return ranked.withColumn("ra", of_active).where(is_active | (F.col("r") <= F.when(F.col("ra") > k, k - 1).otherwise(k))).select(key, share, F.least("r", F.lit(k)).alias("place"))


def pair_difference(rows: DataFrame, group: str, left, right, key: str, value: str, least: float = 0.4) -> DataFrame:
    """(key, left, right, gap, significant) of metrics of two groups."""
    a = rows.where(F.col(group) == left).select(key, F.col(value).alias("left"))
    b = rows.where(F.col(group) == right).select(key, F.col(value).alias("right"))
    gap = F.abs(F.col("left") - F.col("right"))
    return a.join(b, key).withColumns({"gap": gap, "significant": gap >= least})


def pair_comparison(rows: DataFrame, group: str, left, right, key: str, value: str, least: float = 0.4) -> DataFrame:
    """pair_difference with the place of each metric by its gap, and whether it is the largest; few metrics."""
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("gap"), key))
    return pair_difference(rows, group, left, right, key, value, least).withColumn("place", place).withColumn("largest", F.col("place") == 1)


def merge_cards(cards: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Cards with live values over their own, and live rows without a card."""
    both = [c for c in live.columns if c != key and c in cards.columns]
    renamed = live.select(key, *(F.col(c).alias(f"__{c}") for c in live.columns if c != key))
    left = cards.join(renamed, key, "left").select(key, *(F.coalesce(f"__{c}", c).alias(c) if c in both else F.col(c) for c in cards.columns if c != key))
    return left.unionByName(live.join(cards, key, "left_anti"), allowMissingColumns=True)
