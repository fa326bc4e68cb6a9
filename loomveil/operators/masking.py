"""Masking of text columns, its counts, verification, comparison and review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from loomveil.functions import spans as S
from loomveil.functions.recognizers import TAGS, Toggles

TAG_PATTERN = r"\[(NAME|PII|LOCATION|TITLE|HEALTH)\]"
BATCH_ROWS = 512


def found_spans(text: Column, toggles: Toggles = Toggles(), entities: list[str] | None = None, detections: Column | None = None) -> Column:
    """Spans of all layers that pass the filters."""
    layers = [S.detect(text, toggles, entities)] + ([] if detections is None else [F.coalesce(detections, S.no_spans())])
    return S.filter_spans(text, S.extend_particles(text, S.merge_layers(*layers)), toggles)


def text_spans(text: Column, toggles: Toggles = Toggles(), entities: list[str] | None = None, detections: Column | None = None) -> Column:
    return S.extend_original(text, found_spans(text, toggles, entities, detections))


def _masked(text: Column, spans: Column, words: list[str] | None) -> Column:
    masked = S.apply_spans(text, S.resolve(spans))
    masked = S.blocklist(masked, words) if words else masked
    return F.when(text.isNull() | (F.trim(text) == ""), text).otherwise(masked)


def mask_columns(df: DataFrame, columns: list[str], toggles: Toggles = Toggles(), entities: list[str] | None = None, words: list[str] | None = None, checks: str | None = None) -> DataFrame:
    """Masks columns without a shuffle; names are carried forward inside a cell.  Null and blank cells stay.
    checks names a column for what verification finds, see checked."""
    return _finish(_found(df, columns, toggles, entities, None), df, columns, toggles, entities, words, checks, [F.col(f"__names_{i}") for i in range(len(columns))])


def mask_batches(df: DataFrame, key: str, columns: list[str], toggles: Toggles = Toggles(), entities: list[str] | None = None, words: list[str] | None = None, detections: dict[str, DataFrame] | None = None, size: int = BATCH_ROWS, checks: str | None = None) -> DataFrame:
    """Masks columns with all layers: recognizers, outside detections (for each column a table of key and
    spans, as ``detections_to_spans`` gives), and names that other rows of the same batch hold in the column.

    Batches are ``size`` rows of a dense row number ``key`` (``number_rows`` gives one); names of rows without a
    key stay in their row.  Recognizers run once, before the only shuffle of the texts, which brings the rows of
    a batch together for all columns at once; outside detections of all columns come by one join before it.
    A text meets the names of its batch by their first words, in a hash set, and is searched for those alone.
    """
    layers = [d.select(F.col(key), F.lit(c).alias("c"), F.col("spans").alias("s")) for c, d in (detections or {}).items()]
    rows = df
    if layers:
        together = reduce(DataFrame.unionByName, layers).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("c", "s"))).alias("__seen"))
        rows = df.join(together, key, "left")
    found = _found(rows, columns, toggles, entities, F.col("__seen") if layers else None)
    own = [F.col(f"__names_{i}") for i in range(len(columns))]
    if not (layers or S.may_name(toggles, entities)):
        return _finish(found, df, columns, toggles, entities, words, checks, own)
    batch = Window.partitionBy("__batch")
    keyed = found.where(F.col(key).isNotNull()).withColumn("__batch", F.floor(F.col(key) / size))
    known = keyed.withColumns({f"__names_{i}": F.array_distinct(F.flatten(F.collect_set(f"__names_{i}").over(batch))) for i in range(len(columns))})
    loose = found.where(F.col(key).isNull())
    return _finish(known, df, columns, toggles, entities, words, checks, own).unionByName(_finish(loose, df, columns, toggles, entities, words, checks, own))


def _found(rows: DataFrame, columns: list[str], toggles: Toggles, entities: list[str] | None, seen: Column | None) -> DataFrame:
    """Adds the spans of each column, as they are before names are carried forward, and its names."""
    spans = rows.withColumns({f"__spans_{i}": found_spans(F.col(c), toggles, entities, None if seen is None else F.try_element_at(seen, F.lit(c))) for i, c in enumerate(columns)})
    names = S.names_of if seen is not None or S.may_name(toggles, entities) else lambda text, spans: F.lit(None).cast("array<string>")
    return spans.withColumns({f"__names_{i}": names(F.col(c), F.col(f"__spans_{i}")) for i, c in enumerate(columns)})


def _finish(found: DataFrame, df: DataFrame, columns: list[str], toggles: Toggles, entities: list[str] | None, words: list[str] | None, checks: str | None, known: list[Column]) -> DataFrame:
    """Masks by spans and known names."""
    near = found.withColumns({f"__near_{i}": S.names_in(F.col(c), n) for i, (c, n) in enumerate(zip(columns, known))})
    new = {}
    for i, c in enumerate(columns):
        spans = F.col(f"__spans_{i}")
        new[f"__masked_{i}"] = _masked(F.col(c), S.extend_original(F.col(c), S.merge_layers(spans, S.carried_spans(F.col(c), F.col(f"__near_{i}"), spans))), words)
    masked = near.withColumns(new)
    out = [F.col(f"__masked_{columns.index(c)}").alias(c) if c in columns else F.col(c) for c in df.columns]
    if checks:
        seen = lambda c: [F.coalesce(F.try_element_at("__seen", F.lit(c)), S.no_spans())] if "__seen" in found.columns else []
        again = [checked(c, F.col(c), S.filter_spans(F.col(c), S.merge_layers(S.detect(F.col(c), toggles, entities), *seen(c)), toggles), F.col(f"__masked_{i}")) for i, c in enumerate(columns)]
        # in a step of its own: a select would take the masked column for the original inside lambdas
        masked = masked.withColumn("__checks", F.concat(*again))
        out.append(F.col("__checks").alias(checks))
    return masked.select(out)


def checked(column: str, before: Column, spans: Column, after: Column) -> Column:
    """array<struct<column,tag,value,stands>>: values of the spans of three characters at least, and whether the
    masked text still holds them as whole words in any case."""
    values = F.filter(F.transform(spans, lambda s: F.struct(s["tag"].alias("tag"), S.covered(before, s).alias("value"))), lambda v: F.length(F.trim(v["value"])) >= 3)
    return F.transform(values, lambda v: F.struct(F.lit(column).alias("column"), v["tag"].alias("tag"), v["value"].alias("value"), F.coalesce(F.regexp_like(after, S.whole_word(S.literal_pattern(v["value"]))), F.lit(False)).alias("stands")))


def report(df: DataFrame, columns: list[str], path: str, mask=mask_columns, **options) -> DataFrame:
    """(tag, n, missed, removed, missed_samples, removed_samples, cells, affected, entities, percent), a row a tag.

    One pass detects, masks, checks and writes the masked table to ``path`` with a column ``checks``; totals and
    counts by tag are observed as it is written.  Samples come from that column of the written table alone.
    mask is mask_columns, or mask_batches with its options."""
    spark, seen = df.sparkSession, Observation()
    hits = F.concat(*(F.coalesce(F.regexp_extract_all(F.col(c), F.lit(TAG_PATTERN), F.lit(1)), F.array().cast("array<string>")) for c in columns))
    filled = sum(((F.col(c).isNotNull() & (F.trim(c) != "")).cast("int") for c in columns), F.lit(0))
    touched = sum((F.coalesce(F.col(c).rlike(TAG_PATTERN), F.lit(False)).cast("int") for c in columns), F.lit(0))
    of_tag = lambda t: F.sum(F.size(F.filter(hits, lambda h: h == t))).alias(t)
    stood = lambda t, stands: F.sum(F.size(F.filter("checks", lambda v: (v["tag"] == t) & (v["stands"] == F.lit(stands)))))
    counts = [of_tag(t) for t in TAGS] + [stood(t, x).alias(f"{t}_{k}") for t in TAGS for k, x in (("missed", True), ("removed", False))]
    masked = mask(df, columns=columns, checks="checks", **options)
    masked.observe(seen, F.sum(filled).alias("cells"), F.sum(touched).alias("affected"), *counts).write.parquet(path)
    got = {k: v or 0 for k, v in seen.get.items()}
    entities = sum(got[t] for t in TAGS)
    percent = round(100 * got["affected"] / got["cells"], 1) if got["cells"] else 0.0
    rows = [(t, got[t], got[f"{t}_missed"], got[f"{t}_removed"], got["cells"], got["affected"], entities, percent) for t in TAGS]
    table = spark.createDataFrame(rows, "tag string, n bigint, missed bigint, removed bigint, cells bigint, affected bigint, entities bigint, percent double")
    samples = check_samples(spark.read.schema(masked.schema).parquet(path).select("checks"), "checks")
    none = F.array().cast("array<string>")
    return table.join(samples, "tag", "left").withColumns({c: F.coalesce(c, none) for c in ("missed_samples", "removed_samples")})


def number_rows(df: DataFrame, order: list[str], name: str = "row_no") -> DataFrame:
    """Adds dense row numbers from 0 in an order, by ranges and the counts of the ranges before: no task
    holds more than its range."""
    part = Window.partitionBy("__p").orderBy(*order)
    ranged = df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    sizes = ranged.groupBy("__p").count()
    before = sizes.select("__p", (F.sum("count").over(Window.orderBy("__p")) - F.col("count")).alias("__b"))  # a row a partition
    numbered = ranged.withColumn("__r", F.row_number().over(part) - 1).join(F.broadcast(before), "__p")
    return numbered.withColumn(name, F.col("__b") + F.col("__r")).drop("__p", "__b", "__r")


def detections_to_spans(detections: DataFrame, texts: DataFrame, key: str, text: str, toggles: Toggles = Toggles()) -> DataFrame:
    """(key, spans) from outside detections (key, start, end, label, score), one shuffle by key."""
    rows = detections.join(texts.select(key, F.col(text).alias("__t")), key)
    value = F.substring("__t", F.col("start") + 1, F.col("end") - F.col("start"))
    tag = S.detection_tag(F.col("label"), value)
    shaped = F.when(tag == "LOCATION", S.plausible_location(value)).when(tag == "PII", S.plausible_pii(value)).otherwise(True)
    good = rows.where((F.col("score") >= toggles.min_detection_score) & (F.trim(value) != "") & (F.length(value) >= 2) & shaped & S.allowed(tag, toggles))
    return good.groupBy(key).agg(F.array_sort(F.collect_list(S.span(F.col("start"), F.col("end"), tag, F.col("label"), F.col("score"), "layer2"))).alias("spans"))


def lexicon_spans(texts: DataFrame, lexicon: DataFrame, key: str, text: str) -> DataFrame:
    """(key, spans) of whole words found in a lexicon (term, entity, tag): tokens meet terms by an
    equi-join, which Spark broadcasts only if the lexicon is small."""
    hits = texts.select(key, F.explode(S.regex_spans(F.col(text), r"[\p{L}\p{N}'-]+", "X", "TOKEN", 1.0)).alias("s"), F.col(text).alias("__t"))
    named = hits.withColumn("term", F.lower(S.covered(F.col("__t"), F.col("s")))).join(lexicon.withColumn("term", F.lower("term")), "term")
    return named.groupBy(key).agg(F.array_sort(F.collect_list(S.span(F.col("s.start"), F.col("s.end"), F.col("tag"), F.col("entity"), 1.0, "lexicon"))).alias("spans"))


def carry_forward(rows: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """(key, spans): names found in a batch of rows, looked for in all texts of that batch.

    rows has batch_no; names is (batch_no, name).  Both are bounded by the batch size, so the join of
    a batch's texts with its names stays inside a batch."""
    named = names.select("batch_no", S.canonical_name(F.col("name")).alias("name")).where("length(name) >= 3")
    known = named.groupBy("batch_no").agg(F.collect_set("name").alias("__names"))
    near = rows.join(known, "batch_no").withColumn("__near", S.names_in(F.col(text), F.col("__names")))
    found = near.select(key, S.carried_spans(F.col(text), F.col("__near"), S.no_spans()).alias("spans"))
    return found.where(F.size("spans") > 0)


def tag_counts(masked: DataFrame, columns: list[str]) -> DataFrame:
    """(tag, n) for all tags, zero-filled."""
    tags = masked.sparkSession.createDataFrame([(t,) for t in TAGS], "tag string")
    cells = masked.select(F.explode(F.array(*(F.coalesce(F.col(c), F.lit("")) for c in columns))).alias("t"))
    found = cells.select(F.explode(F.regexp_extract_all("t", F.lit(TAG_PATTERN), F.lit(1))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return tags.join(F.broadcast(found), "tag", "left").select("tag", F.coalesce("n", F.lit(0)).alias("n"))  # at most one row a tag


def totals(masked: DataFrame, columns: list[str]) -> DataFrame:
    """cells, affected, entities, percent: of non-blank cells."""
    cells = masked.select(F.explode(F.array(*(F.col(c) for c in columns))).alias("t")).where("t is not null and trim(t) <> ''")
    n = F.size(F.regexp_extract_all("t", F.lit(TAG_PATTERN), F.lit(0)))
    out = cells.agg(F.count(F.lit(1)).alias("cells"), F.count_if(n > 0).alias("affected"), F.coalesce(F.sum(n), F.lit(0)).alias("entities"))
    return out.withColumn("percent", F.coalesce(F.round(100 * F.col("affected") / F.nullif("cells", F.lit(0)), 1), F.lit(0.0)))


def verify(original: DataFrame, masked: DataFrame, key: str, text: str, toggles: Toggles = Toggles(), entities: list[str] | None = None) -> DataFrame:
    """(tag, missed, removed) of two tables that were written apart: one shuffle by key."""
    both = original.select(key, F.col(text).alias("before")).join(masked.select(key, F.col(text).alias("after")), key)
    spans = S.filter_spans(F.col("before"), S.merge_layers(S.detect(F.col("before"), toggles, entities)), toggles)
    return check_counts(both.select(checked(text, F.col("before"), spans, F.col("after")).alias("checks")), "checks")


def check_counts(table: DataFrame, checks: str) -> DataFrame:
    """(tag, missed, removed): checked values that stand, or no longer stand, in the masked texts."""
    values = table.select(F.explode(checks).alias("v"))
    return values.groupBy(F.col("v.tag").alias("tag")).agg(F.count_if("v.stands").alias("missed"), F.count_if(~F.col("v.stands")).alias("removed"))


def check_samples(table: DataFrame, checks: str) -> DataFrame:
    """(tag, missed_samples, removed_samples): of the distinct values of each kind, the one with the least MD5
    digest for each first digit of it, 16 at most.  Minima merge, so tasks shuffle a few rows each."""
    digest = F.md5(F.col("v.value").cast("binary"))
    values = table.select(F.explode(checks).alias("v")).select("v.tag", "v.stands", F.substring(digest, 1, 1).alias("digit"), F.struct(digest.alias("d"), F.col("v.value").alias("value")).alias("s"))
    least = values.groupBy("tag", "stands", "digit").agg(F.min("s").alias("s"))
    kept = lambda stands: F.array_sort(F.collect_list(F.when(F.col("stands") == F.lit(stands), F.col("s.value"))))
    return least.groupBy("tag").agg(kept(True).alias("missed_samples"), kept(False).alias("removed_samples"))


def changed_cells(original: DataFrame, masked: DataFrame, key: str, text: str) -> DataFrame:
    """(key, before, after) of cells that differ, null-safe."""
    both = original.select(key, F.col(text).alias("before")).join(masked.select(key, F.col(text).alias("after")), key)
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def change_summary(before_after: DataFrame, key: str, first: int = 30) -> DataFrame:
    """One row: cells, changed_cells, rows, changed_rows and the first changes by key, of (key, column, before,
    after); the first ones are the feature.  Keys name rows, not cells."""
    changed = ~F.col("before").eqNullSafe(F.col("after"))
    by_row = before_after.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(changed).alias("c"))
    counts = by_row.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cells"), F.coalesce(F.sum("c"), F.lit(0)).alias("changed_cells"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("c") > 0).alias("changed_rows"))
    shown = before_after.where(changed).orderBy(key, "column").limit(first).agg(F.array_sort(F.collect_list(F.struct(key, "column", "before", "after"))).alias("first"))
    return counts.join(F.broadcast(shown))  # one row each


def sample_rows(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows (or all), the same for a seed; the sampling is the feature."""
    return df.orderBy(F.rand(seed)).limit(n)


def review(verdicts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp and the false-positive rate in percent of verdicts (verdict: TP or FP)."""
    tp, fp = F.count_if(F.col("verdict") == "TP").alias("tp"), F.count_if(F.col("verdict") == "FP").alias("fp")
    out = verdicts.groupBy(*(by or [])).agg(tp, fp)
    return out.withColumn("fp_rate", F.coalesce(F.round(100 * F.col("fp") / F.nullif(F.col("fp") + F.col("tp"), F.lit(0)), 1), F.lit(0.0)))


def batches(df: DataFrame, key: str, size: int = BATCH_ROWS) -> DataFrame:
    """Adds batch_no from a dense row key, without a window over the table."""
    return df.withColumn("batch_no", F.floor(F.col(key) / size))


def vote_language(texts: DataFrame, stop_words: DataFrame, key: str, text: str) -> DataFrame:
    """(key, lang): the language with the most stop words (stop_words: word, lang), ties by name."""
    tokens = texts.select(key, F.explode(F.split(F.lower(text), r"\W+")).alias("word")).join(stop_words, "word")
    n = tokens.groupBy(key, "lang").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy(key).orderBy(F.desc("n"), "lang")
    return n.withColumn("r", F.row_number().over(first)).where("r = 1").select(key, "lang")
