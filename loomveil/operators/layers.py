"""Layers of masking: presets, mapping of outside detectors, direct masking, phrases and languages."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomveil.functions import spans as S
from loomveil.functions.recognizers import LABEL_TAGS, PATTERNS, POLICY, Toggles
from loomveil.operators import masking as M

# Layers of the presets; labels of the filter layer; the tags and labels that layers are said to mask.
PRESETS = {"fast": ["recognizers"], "recommended": ["recognizers", "detector"], "deep": ["recognizers", "detector", "filter"]}
FILTER_LABELS = {"private_person": "NAME", "private_address": "LOCATION"}
SPEC = {
    "recognizers": {
        "NAME": ["PERSON", "NRP", "TEACHER_NAME_CONTEXT"], "LOCATION": ["LOCATION", "DUTCH_POSTCODE", "FLOOR_REFERENCE"],
        "PII": ["EMAIL_ADDRESS", "PHONE_NUMBER", "STUDENT_NUMBER", "USERNAME", "OBFUSCATED_EMAIL", "NL_BSN", "DUTCH_PHONE"], "TITLE": ["DUTCH_HONORIFIC"],
    },
    "detector": {
        "NAME": ["*NAME*", "*PERSON*"], "LOCATION": ["*ADDRESS*", "*CITY*", "*ZIPCODE*", "*LOCATION*"],
        "HEALTH": ["*HEALTH*", "*MEDICAL*", "*CONDITION*", "*DIAGNOSIS*", "*ILLNESS*", "*DISEASE*", "*DISABILITY*", "*MEDICATION*"], "PII": ["(everything else: email/phone/iban/ids/etc.)"],
    },
}
#: recognizers of languages that have none of their own
GENERAL = ["EMAIL_ADDRESS", "PHONE_NUMBER"]
#: languages with recognizers of their own, and the one that is taken where no other is found
OWN_LANGUAGES, FALLBACK = ["nl", "en"], "nl"
PHRASE_WORDS = 5
PROFILE_GRAMS = 400
#: texts that are scored at once
_SCORED = 1000
_MARKS = 1 << 26


def masking_spec(spark: SparkSession) -> DataFrame:
    """(layer, tag, label, place) of what layers are said to mask."""
    return spark.createDataFrame([(layer, tag, label, i) for layer, tags in SPEC.items() for tag, labels in tags.items() for i, label in enumerate(labels)], "layer string, tag string, label string, place int")


def policy_table(spark: SparkSession, toggles: Toggles = Toggles()) -> DataFrame:
    """(entity, tag) of what the recognizers and their policy really mask; a null tag is left alone."""
    return spark.createDataFrame([(e, toggles.tag_of(e)) for e in sorted({*POLICY, *(p[0] for p in PATTERNS)})], "entity string, tag string")


def filter_tag(label: Column) -> Column:
    """Tag of a label of the filter layer: its BIOES prefix goes, persons and addresses have labels of their
    own, words of health are HEALTH, and all others PII."""
    bare = F.lower(F.regexp_replace(F.trim(label), r"^[BIESO]-(?=.)", ""))
    health = next(words for tag, words in LABEL_TAGS if tag == "HEALTH")
    tag = F.when(bare.rlike("|".join(w.lower() for w in health)), "HEALTH").otherwise("PII")
    for name, to in FILTER_LABELS.items():
        tag = F.when(bare == name, to).otherwise(tag)
    return F.when(label.isNull(), "PII").otherwise(tag)


def filter_to_spans(detections: DataFrame, texts: DataFrame, key: str, text: str, toggles: Toggles = Toggles()) -> DataFrame:
    """(key, spans) of the filter layer (key, start, end, label): two characters at least, no score, no shapes,
    the longest first."""
    rows = detections.join(texts.select(key, F.col(text).alias("__t")), key)
    value = F.substring("__t", F.col("start") + 1, F.col("end") - F.col("start"))
    tag = filter_tag(F.col("label"))
    good = rows.where((F.trim(value) != "") & (F.length(value) >= 2) & S.allowed(tag, toggles))
    one = F.struct((F.col("start") - F.col("end")).alias("k"), S.span(F.col("start"), F.col("end"), tag, F.col("label"), 1.0, "layer2").alias("s"))
    return good.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]).alias("spans"))


def mask_preset(df: DataFrame, key: str, columns: list[str], preset: str, found: dict[str, dict[str, DataFrame]] | None = None, **options) -> DataFrame:
    """Masks by the layers of a preset.  found has, for each outside layer and column, a table (key, spans);
    spans of earlier layers win ties.  options are those of mask_batches."""
    layers = PRESETS[preset]
    options = options if "recognizers" in layers else {**options, "entities": []}
    together = {}
    for c in columns:
        tables = [found[layer][c].select(key, F.lit(i).alias("n"), "spans") for i, layer in enumerate(layers) if layer in (found or {}) and c in found[layer]]
        if tables:
            rows = reduce(DataFrame.unionByName, tables)
            together[c] = rows.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "spans"))), lambda x: x["spans"])).alias("spans"))
    return M.mask_batches(df, key, columns, detections=together or None, **options)


def mask_direct(text: Column, toggles: Toggles = Toggles(), entities: list[str] | None = None) -> Column:
    """The recognizers' matches replaced in place: no filters, no particles, no carried names."""
    masked = S.apply_spans(text, S.resolve(S.merge_layers(S.detect(text, toggles, entities))))
    return F.when(text.isNull() | (F.trim(text) == ""), text).otherwise(masked)


def replace_direct(text: Column, detections: Column, toggles: Toggles = Toggles()) -> Column:
    """A text with the values of its detections (array of start, end, label; few a text), the longest first,
    replaced by their tags wherever they stand, in any case.  Values are those of the text as it came, and a
    later one also meets what earlier ones put in."""
    order = F.array_sort(F.transform(detections, lambda d, i: F.struct((d["start"] - d["end"]).alias("k"), i.alias("i"), d.alias("d"))))
    values = F.transform(order, lambda x: F.struct(F.substring(text, x["d"]["start"] + 1, x["d"]["end"] - x["d"]["start"]).alias("value"), x["d"]["label"].alias("label")))
    tagged = F.transform(values, lambda v: F.struct(v["value"].alias("value"), S.detection_tag(v["label"], v["value"]).alias("tag")))
    good = F.filter(tagged, lambda v: (F.trim(v["value"]) != "") & (F.length(v["value"]) >= 2) & S.allowed(v["tag"], toggles))
    done = F.aggregate(good, text, lambda acc, v: F.regexp_replace(acc, F.concat(F.lit("(?iU)"), S.literal_pattern(v["value"])), F.concat(F.lit("["), v["tag"], F.lit("]"))))
    return F.when(detections.isNull(), text).otherwise(done)


def phrase_spans(texts: DataFrame, lexicon: DataFrame, key: str, text: str) -> DataFrame:
    """(key, spans) of phrases of a lexicon (term, entity, tag) of PHRASE_WORDS words at most, in any case.

    Words of the texts meet the first words of the terms; only where these are equal are the phrases that start
    there, of one word and more, joined with the terms.  Of the matches of a text the leftmost, then the longest,
    is taken, and the search goes on behind it.  Between words of a phrase anything but words may stand.

    The key is unique; null texts have no spans; longer terms are refused."""
    word = r"[\p{L}\p{N}'-]+"
    split = lambda c: F.regexp_extract_all(F.lower(c), F.lit(word), F.lit(0))
    terms = lexicon.select(split(F.col("term")).alias("w"), "entity", "tag").where(F.size("w") > 0)
    terms = terms.withColumn("w", F.when(F.size("w") <= PHRASE_WORDS, F.col("w")).otherwise(F.raise_error(F.lit(f"a term has more than {PHRASE_WORDS} words"))))
    terms = terms.groupBy(F.array_join("w", " ").alias("phrase")).agg(F.min(F.struct("entity", "tag")).alias("e"), F.first(F.col("w")[0]).alias("first"))
    pieces = F.zip_with(F.split(text, word, -1), F.regexp_extract_all(text, F.lit(word), F.lit(0)), lambda p, m: F.struct(F.length(p).alias("before"), m.alias("word")))
    said = texts.select(key, F.posexplode(pieces).alias("at", "p")).where("p.word is not null")
    order = Window.partitionBy(key).orderBy("at")
    ends = said.withColumn("end", F.sum(F.col("p.before") + F.length("p.word")).over(order)).withColumn("w", F.lower("p.word"))
    ahead = [F.struct(F.lead("w", n).over(order).alias("w"), F.lead("end", n).over(order).alias("end")) for n in range(PHRASE_WORDS)]
    here = ends.select(key, (F.col("end") - F.length("p.word")).cast("int").alias("start"), "w", F.array(*ahead).alias("next"))
    begun = here.join(terms.select(F.col("first").alias("w")).distinct(), "w", "left_semi")
    lengths = F.array(*(F.lit(n) for n in range(1, PHRASE_WORDS + 1)))
    phrases = F.transform(F.filter(lengths, lambda n: F.col("next")[n - 1]["w"].isNotNull()), lambda n: F.struct(F.array_join(F.transform(F.slice("next", F.lit(1), n), lambda x: x["w"]), " ").alias("phrase"), F.col("next")[n - 1]["end"].cast("int").alias("end")))
    met = begun.select(key, "start", F.explode(phrases).alias("x")).select(key, "start", "x.phrase", "x.end").join(terms.select("phrase", "e"), "phrase")
    one = F.struct("start", (-F.col("end")).alias("k"), S.span(F.col("start"), F.col("end"), F.col("e.tag"), F.col("e.entity"), 1.0, "lexicon").alias("s"))
    found = met.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("found"))
    begin = F.struct(F.lit(0).alias("at"), S.no_spans().alias("out"))
    chosen = F.aggregate("found", begin, lambda acc, x: F.when(x["start"] >= acc["at"], F.struct(x["s"]["end"].alias("at"), F.array_append(acc["out"], x["s"]).alias("out"))).otherwise(acc), lambda acc: acc["out"])
    return found.select(key, chosen.alias("spans"))


def words(text: Column) -> Column:
    """The distinct words of a text in lower case."""
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+")), lambda w: w != "")


def _distinct(values: np.ndarray, end: int) -> np.ndarray:
    """Distinct values from 0 up to an end, in order; marked in a table where that is small."""
    if end > _MARKS:
        return np.unique(values)
    seen = np.zeros(end, dtype=bool)
    seen[values] = True
    return np.flatnonzero(seen)


def _grams(column: pa.ListArray, known: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(row, gram) once for each distinct run of three characters in the words of a row, with a blank before
    and after each word, and the runs; of known ones only where these are given, numbered as they are.

    Every distinct word of the batch is cut once."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    coded = column.flatten().dictionary_encode()
    number = {} if known is None else known
    held, ends = [], [0]
    for w in coded.dictionary.to_pylist():
        w = f" {w} "
        for i in range(len(w) - 2):
            g = w[i : i + 3]
            n = number.setdefault(g, len(number)) if known is None else number.get(g, -1)
            if n >= 0:
                held.append(n)
        ends.append(len(held))
    of_word, held, ends = coded.indices.to_numpy(zero_copy_only=False), np.array(held, dtype=np.int64), np.array(ends)
    many = np.diff(ends)[of_word]
    first = np.cumsum(many) - many
    gram = held[np.arange(int(many.sum())) + np.repeat(ends[of_word] - first, many)]
    both = _distinct(np.repeat(np.repeat(np.arange(len(size)) * len(number), size), many) + gram, len(size) * len(number))
    return both // max(1, len(number)), both % max(1, len(number)), list(number)


def language_profiles(labelled: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, weight): the PROFILE_GRAMS commonest runs of each language with the logarithm of their share of
    its texts, and under no gram the weight of one that the profile lacks; counts are summed in each task first."""
    n = labelled.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("texts"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SCORED):
                part = batch.slice(at, _SCORED)
                row, gram, runs = _grams(part.column(1))
                langs = part.column(0).dictionary_encode("encode")
                both, times = np.unique(langs.indices.to_numpy(zero_copy_only=False)[row] * max(1, len(runs)) + gram, return_counts=True)
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(both // max(1, len(runs)))), pa.array(runs, pa.string()).take(pa.array(both % max(1, len(runs)))), pa.array(times)], names=["lang", "gram", "n"])

    kind = labelled.schema[lang].dataType.simpleString()
    rows = labelled.select(F.col(lang).alias("lang"), words(F.col(text)).alias("words"))
    counts = rows.mapInArrow(count, f"lang {kind}, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= PROFILE_GRAMS)
    known = ranked.join(n, "lang").select("lang", "gram", F.log((F.col("n") + 1) / (F.col("texts") + 2)).alias("weight"))
    return known.unionByName(n.select("lang", F.lit("").alias("gram"), F.log(1 / (F.col("texts") + 2)).alias("weight")))


def languages(texts: DataFrame, profiles: DataFrame, key: str, text: str) -> DataFrame:
    """(key, lang): the language whose profile makes the text's runs most likely; a run that a profile lacks
    counts as one in no text.  A text without a known run has FALLBACK.  The key is unique.

    The profiles (PROFILE_GRAMS rows a language) are sent to the tasks, which score each text where it is."""
    rows = profiles.select("lang", "gram", "weight").collect()
    least = {r.lang: r.weight for r in rows if r.gram == ""}
    names = sorted(least, key=lambda x: (x is not None, x))  # ties go to the first
    place = {x: i for i, x in enumerate(names)}
    number: dict[str, int] = {}
    entries: list[tuple[int, int, float]] = [(number.setdefault(r.gram, len(number)), place[r.lang], r.weight - least[r.lang]) for r in rows if r.gram != ""]
    entries.sort()
    gram_at = np.searchsorted(np.array([e[0] for e in entries], dtype=np.int64), np.arange(len(number) + 1))
    lang_of, more = np.array([e[1] for e in entries], dtype=np.int64), np.array([e[2] for e in entries])
    model = texts.sparkSession.sparkContext.broadcast((number, gram_at, lang_of, more, np.array([least[x] for x in names]), names))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, gram_at, lang_of, more, base, names = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, _SCORED):
                part = batch.slice(at, _SCORED)
                row, gram, _ = _grams(part.column(1), number)
                many = np.diff(gram_at)[gram]
                entry = np.arange(int(many.sum())) + np.repeat(gram_at[gram] - (np.cumsum(many) - many), many)
                total = np.bincount(np.repeat(row, many) * len(names) + lang_of[entry], more[entry], part.num_rows * len(names)).reshape(part.num_rows, len(names))
                held = np.bincount(row, minlength=part.num_rows)
                best = np.round(total + held[:, None] * base, 6).argmax(axis=1) if names else np.zeros(part.num_rows, dtype=np.int64)
                found = [names[b] if h and names[b] is not None else FALLBACK for b, h in zip(best.tolist(), held.tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string())], names=[key, "lang"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(F.col(key), words(F.col(text)).alias("words")).mapInArrow(score, f"`{key}` {kind}, lang string")


def mask_by_language(df: DataFrame, columns: list[str], lang: str, toggles: Toggles = Toggles()) -> DataFrame:
    """Masks each row by the recognizers of its language: all of them for OWN_LANGUAGES and where it is not
    known, GENERAL ones for others."""
    known = F.coalesce(F.col(lang), F.lit(FALLBACK)).isin(OWN_LANGUAGES)
    return M.mask_columns(df.where(known), columns, toggles).unionByName(M.mask_columns(df.where(~known), columns, toggles, GENERAL))
