"""What a dashboard asks of answers, themes and insights: filters, ranks, payloads, reports, stores."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomveil.operators import insights as I
from loomveil.operators import vectors as V
from loomveil.operators.masking import TAG_PATTERN, number_rows, tag_counts, totals
from loomveil.sources.snapshots import SnapshotTable

# Filter keys, location codes, dashboard names of filters, words of a label that count for nothing.
FILTER_KEYS = ["institution", "academic_year", "location", "programme", "study_mode", "cohort", "sector", "language"]
CITIES = {"0": "Eindhoven", "2": "Meijerijstad", "3": "Venlo", "4": "Sittard-geleen", "8": "s-Hertogenbosch", "13": "Tilburg", "20": "Bergen op Zoom", "23": "Rotterdam", "24": "Utrecht", "26": "Nijmegen"}
DASHBOARD_NAMES = {"academic_year": "jaar", "location": "locatie", "programme": "opleiding", "study_mode": "studievorm", "language": "taal"}
LABEL_STOP_WORDS = ["and", "the", "for", "with", "from", "that", "this", "over", "into"]
PAYLOAD_ITEMS = 3
DRILL_DOWN = 500


def api_filters(chosen: dict[str, str]) -> dict[str, str]:
    """Canonical filters of dashboard filters; cities become their codes, blanks and All go."""
    codes = {city: code for code, city in CITIES.items()}
    out = {key: chosen.get(name) for key, name in DASHBOARD_NAMES.items()}
    if out["location"]:
        out["location"] = codes.get(out["location"], out["location"])
    return {k: v for k, v in out.items() if v and v != "All"}


def checked_filters(given: dict[str, str], all_value: str = "All") -> dict[str, str]:
    """The filters that are known and set."""
    return {k: given[k] for k in FILTER_KEYS if given.get(k) and given[k] != all_value}


def city_of(code: Column) -> Column:
    """The city of a location code; other values stay as they are."""
    pairs = [F.lit(x) for kv in CITIES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), code)


def metadata_value(meta: Column, names: list[str]) -> Column:
    """The first of the names whose value in a map is not blank."""
    return F.coalesce(*(F.when(F.trim(v) != "", v) for v in (F.try_element_at(meta, F.lit(n)) for n in names)))


def fallback_mentions(docs: DataFrame, text: str, labels: list[str]) -> DataFrame:
    """(subtheme, mentions, doc_percentage, percentage): a text mentions a label if it holds the first six
    characters of a word of it over three letters; percents are rounded half up; blank texts do not count."""
    low = docs.select(F.lower(F.col(text)).alias("t")).where("t <> ''")
    roots = [list(dict.fromkeys(w[:6] for w in re.findall("[a-z0-9]+", label.lower()) if len(w) > 3 and w not in LABEL_STOP_WORDS)) for label in labels]
    hits = [F.count_if(F.lit(False) if not r else F.greatest(*(F.col("t").contains(x) for x in r), F.lit(False))).alias(f"c{i}") for i, r in enumerate(roots)]
    rows = low.agg(F.count(F.lit(1)).alias("n"), *hits)
    total = sum((F.col(f"c{i}") for i in range(len(labels))), F.lit(0))
    pairs = F.array(*(F.struct(F.lit(label).alias("subtheme"), F.col(f"c{i}").alias("mentions")) for i, label in enumerate(labels)))
    share = lambda a, b: F.when(b > 0, F.floor(a / b * 100 + 0.5)).otherwise(0).cast("bigint")
    long = rows.select("n", total.alias("total"), F.explode(pairs).alias("p"))
    return long.select("p.subtheme", "p.mentions", share(F.col("p.mentions"), F.col("n")).alias("doc_percentage"), share(F.col("p.mentions"), F.col("total")).alias("percentage"))


def other_subthemes(mentions: DataFrame, current: str) -> DataFrame:
    return mentions.where(~F.col("subtheme").eqNullSafe(current))


def themes_by_share(themes: DataFrame, share: str, order: str) -> DataFrame:
    return themes.orderBy(F.desc(share), order)


def popular_subthemes(themes: DataFrame, theme: str, mentions: str = "subtheme_mentions", k: int = 5) -> DataFrame:
    """(theme, subtheme, mentions) of the k subthemes with the most mentions over all themes."""
    listed = themes.select(theme, F.explode(mentions).alias("m")).select(theme, "m.subtheme", F.coalesce("m.mentions", F.lit(0)).alias("mentions"))
    return listed.orderBy(F.desc("mentions"), theme, "subtheme").limit(k)


def drill_down(items: DataFrame, query: list[float], key: str, where: Column | None = None, n: int = DRILL_DOWN) -> DataFrame:
    """The n nearest items of a free query, with their similarity."""
    return V.nearest(items, query, n, key, where=where).withColumn("similarity", V.similarity(F.col("distance")))


def theme_payloads(parsed: DataFrame, counts: DataFrame, mentions: DataFrame, theme: str) -> DataFrame:
    """One row a theme: counts, summary, and lists of three comments of each kind at most; a theme without
    a reply has empty lists.  mentions is (theme, subtheme, mentions, ...) over all documents of the theme."""
    first = lambda c: F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, PAYLOAD_ITEMS).alias(c)
    every = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    rows = [c for c in mentions.columns if c != theme]
    listed = mentions.groupBy(theme).agg(F.array_sort(F.collect_list(F.struct(*rows))).alias("subtheme_mentions"))
    out = counts.join(parsed, theme, "left").join(listed, theme, "left")
    return out.select(
        *counts.columns, F.coalesce("summary", F.lit("Summary could not be parsed.")).alias("summary"), every("sentiments"), first("positive_comments"), first("critical_comments"), first("student_suggestions"), every("subthemes"),
        F.coalesce("subtheme_mentions", F.array().cast(listed.schema["subtheme_mentions"].dataType)).alias("subtheme_mentions"),
    )


#: fixed values: summaries of themes without documents, and without a reply that could be read
NO_DOCUMENTS, NO_REPLY = "No responses were semantically assigned to this theme.", "Summary could not be parsed."


def insight_payloads(selected: DataFrame, parsed: DataFrame, mentions: DataFrame, quotes: DataFrame, theme: str, settings: dict, filters: dict[str, str]) -> DataFrame:
    """One row a theme with all that a dashboard shows and a cache needs.

    selected is (theme, frequency, document_count, vector_relevant_count, total_filtered_documents,
    llm_document_count); parsed is (theme, summary, sentiments, positive_comments, critical_comments,
    student_suggestions, subthemes); mentions is (theme, subtheme, mentions, doc_percentage, percentage) and
    comes out in the order of subthemes; quotes is (theme, rn, text) of the documents that were read, whose
    number number_batches bounds.  Themes without documents have empty lists."""
    none = F.array().cast("array<string>")
    three = lambda c: F.slice(F.coalesce(c, none), 1, PAYLOAD_ITEMS).alias(c)
    row = F.struct("subtheme", "mentions", "doc_percentage", "percentage")
    by_label = mentions.groupBy(theme).agg(F.map_from_entries(F.collect_list(F.struct("subtheme", row.alias("row")))).alias("__rows"))
    read = quotes.groupBy(theme).agg(F.array_sort(F.collect_list(F.struct("rn", "text"))).alias("__read"))
    out = selected.join(parsed, theme, "left").join(by_label, theme, "left").join(read, theme, "left")
    listed = F.transform(F.filter("subthemes", lambda x: F.map_contains_key("__rows", x)), lambda x: F.try_element_at("__rows", x))
    empty = F.array().cast(f"array<{by_label.schema['__rows'].dataType.valueType.simpleString()}>")
    filled = F.create_map(*(F.lit(x) for kv in sorted(filters.items()) for x in kv)) if filters else F.create_map().cast("map<string,string>")
    return out.select(
        *selected.columns, F.col("llm_document_count").alias("hierarchical_document_count"), F.when(F.col("document_count") == 0, NO_DOCUMENTS).otherwise(F.coalesce("summary", F.lit(NO_REPLY))).alias("summary"),
        F.coalesce("sentiments", F.array().cast(parsed.schema["sentiments"].dataType)).alias("sentiments"), three("positive_comments"), three("critical_comments"), three("student_suggestions"),
        F.coalesce("subthemes", none).alias("subthemes"), F.coalesce(listed, empty).alias("subtheme_mentions"), F.coalesce(F.transform("__read", lambda q: q["text"]), none).alias("quotes"),
        filled.alias("filters_applied"), *(F.lit(v).alias(k) for k, v in settings.items()),
    )


def theme_prompts(assigned: DataFrame, theme: str, key: str, text: str, head: str, cached: DataFrame | None = None, size: int = I.BATCH_DOCS, cap: int | None = I.MAX_DOCS) -> DataFrame:
    """Prompts of the batches of all themes that are not cached, nearest documents first.  A theme that
    fails later is a row without a reply and stops no other."""
    left = assigned if cached is None else assigned.join(cached.select(theme).distinct(), theme, "left_anti")
    return I.batch_prompts(I.number_batches(left, theme, ["distance", key], size, cap), theme, text, head)


def versioned_key(theme: Column, filters: Column, version: Column) -> Column:
    """The cache key of an insight; vectors that were rebuilt have another version, so old entries do not fit."""
    return F.concat(I.cache_key(theme, filters), F.lit("::vectors="), version.cast("string"))


# Fields that a cached insight must have to be shown.
REQUIRED_FIELDS = ["frequency", "vector_relevant_count", "llm_document_count", "summary", "sentiments", "positive_comments", "critical_comments", "student_suggestions", "subthemes", "subtheme_mentions", "quotes"]
CACHE_SETTINGS = ["cache_version", "llm_context_documents", "hierarchical_batch_documents", "reranker"]


def valid_insight(settings: dict, optional: dict | None = None, required: list[str] | None = None) -> Column:
    """Whether a cached row can be shown: it was made with the settings (all of CACHE_SETTINGS), and, of
    optional ones such as llm_provider, llm_model and llm_generation_settings, with those that are not None, and
    has all required fields.  Settings are compared null-safely; a struct of settings is a dict here."""
    if set(settings) != set(CACHE_SETTINGS):
        raise ValueError(f"settings are {CACHE_SETTINGS}")
    lit = lambda v: F.struct(*(F.lit(x).alias(k) for k, x in v.items())) if isinstance(v, dict) else F.lit(v)
    same = [F.col(k).eqNullSafe(lit(v)) for k, v in {**settings, **{k: v for k, v in (optional or {}).items() if v is not None}}.items()]
    return reduce(lambda a, b: a & b, same + [F.col(c).isNotNull() for c in (REQUIRED_FIELDS if required is None else required)])


class InsightCache:
    """Insights in a table of (key, ...) rows; saving replaces rows with the same key.  A save that stops half
    way leaves the table as it was."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.table = SnapshotTable(spark, path, schema)

    def load(self) -> DataFrame:
        return self.table.load()

    def save(self, rows: DataFrame) -> None:
        self.table.commit(lambda now: I.overlay([now, rows.select(now.columns)], "key"), "save")

    def clear(self) -> None:
        self.table.commit(lambda now: now.limit(0), "clear")


def masking_report(masked: DataFrame, checked: DataFrame, columns: list[str], key: str, samples: int = 5) -> DataFrame:
    """One row: cells, affected, entities, percent, counts by tag, and by tag what a verification (tag,
    missed, removed) found, zero-filled, with the first masked cells by key as samples."""
    tags = tag_counts(masked, columns).join(checked, "tag", "left")
    listed = tags.agg(F.array_sort(F.collect_list(F.struct("tag", "n", F.coalesce("missed", F.lit(0)).alias("missed"), F.coalesce("removed", F.lit(0)).alias("removed")))).alias("tags"))
    cells = masked.select(key, F.explode(F.array(*columns)).alias("cell")).where(F.col("cell").rlike(TAG_PATTERN)).orderBy(key, "cell").limit(samples)
    shown = cells.agg(F.array_sort(F.collect_list(F.struct(key, "cell"))).alias("samples"))
    return totals(masked, columns).join(F.broadcast(listed)).join(F.broadcast(shown))  # one row each


def review_report(reviewed: DataFrame, by: str) -> DataFrame:
    """Lines of a review (by, tp, fp, fp_rate), the worst first."""
    return reviewed.orderBy(F.desc("fp_rate"), by).select(F.format_string("%s: %d of %d false (%.1f %%)", F.col(by), "fp", F.col("tp") + F.col("fp"), "fp_rate").alias("line"))


def review_summary(results: DataFrame, rows: int) -> DataFrame:
    """One row of a review's results (row, column, text, entity, verdict: TP, FP or null for a reply that could
    not be read) over so many sampled rows."""
    tp, fp = F.count_if(F.col("verdict") == "TP"), F.count_if(F.col("verdict") == "FP")
    cells = results.groupBy("row", "column").agg(tp.alias("tp"), fp.alias("fp"), F.count_if(F.col("verdict").isNull()).alias("errors"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = cells.agg(F.count(F.lit(1)).alias("cells_with_entities"), total("tp").alias("true_positives"), total("fp").alias("false_positives"), total("errors").alias("parse_errors"))
    checked = F.col("true_positives") + F.col("false_positives")
    rate = F.coalesce(F.round(100 * F.col("false_positives") / F.nullif(checked, F.lit(0)), 1), F.lit(0.0))
    return out.withColumns({"rows_sampled": F.lit(rows), "false_positive_rate_pct": rate})


def review_details(results: DataFrame) -> DataFrame:
    """(row, column, text_snippet, entities_detected, results): a row a cell, entities in their order."""
    one = F.struct("entity", "verdict")
    cells = results.groupBy("row", "column").agg(F.first(F.substring("text", 1, 120)).alias("text_snippet"), F.count(F.lit(1)).alias("entities_detected"), F.array_sort(F.collect_list(one)).alias("results"))
    return cells.select("row", "column", "text_snippet", "entities_detected", "results")


def column_preview(df: DataFrame, order: str, rows: int = 3) -> DataFrame:
    """(row, column, value) of the first rows, blanks and NaN as null."""
    columns = [c for c in df.columns if c != order]
    first = df.orderBy(order).limit(rows).select(order, *(F.col(c).cast("string").alias(c) for c in columns))
    long = first.unpivot([order], columns, "column", "value")
    return long.withColumn("value", F.when(~F.lower(F.trim("value")).isin("", "nan"), F.col("value")))


def inspect_output(df: DataFrame) -> DataFrame:
    """(column, is_text, filled, records) of each column of a masked table."""
    texts = {f.name for f in df.schema if f.dataType.simpleString() == "string"}
    counts = df.agg(F.count(F.lit(1)).alias("records"), *(F.count(F.when(F.trim(F.col(c).cast("string")) != "", 1)).alias(f"c{i}") for i, c in enumerate(df.columns)))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(c in texts).alias("is_text"), F.col(f"c{i}").alias("filled")) for i, c in enumerate(df.columns)))
    return counts.select(F.explode(rows).alias("r"), "records").select("r.*", "records")


def rebuild_collection(answers: DataFrame, path: str, prefix: str = "doc_", metadata: list[str] | None = None) -> DataFrame:
    """Writes the collection anew: (id, document, embedding, metadata) with ids by the order of answer_id,
    a version of its own, and either all metadata or the columns named."""
    out = number_rows(answers, ["answer_id"], "__n").withColumn("id", F.concat(F.lit(prefix), F.col("__n").cast("string"))).drop("__n")
    out = out if metadata is None else out.select("id", "answer_id", "answer", "embedding", *metadata)
    out.write.mode("overwrite").parquet(path)
    return answers.sparkSession.read.schema(out.schema).parquet(path)
