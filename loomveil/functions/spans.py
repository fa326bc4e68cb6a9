"""Span algebra as native column expressions.

A span is struct<start,end,tag,entity,score,layer,ord> with half-open code-point offsets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomveil.functions.recognizers import CARRY_STOP_WORDS, HONORIFICS, LABEL_TAGS, NAME_STOP_WORDS, NAME_TOKENS, NEEDED, NEVER_MASKED, PARTICLES, PATTERNS, ROLES, TAGS, Toggles

SPAN = "struct<start:int,end:int,tag:string,entity:string,score:double,layer:string,ord:int>"


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def span(start: Column, end: Column, tag, entity, score, layer="layer1", order=0) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), lit(tag).alias("tag"), lit(entity).alias("entity"), lit(score).cast("double").alias("score"), lit(layer).alias("layer"), lit(order).cast("int").alias("ord"))


def regex_spans(text: Column, pattern: str, tag: str | None, entity: str, score: float, layer: str = "layer1") -> Column:
    """Spans of all matches; offsets are sums over the parts between matches and the matches."""
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), no_spans().alias("out"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + F.length(x["part"])
        end = first + F.length(x["hit"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], span(first, end, tag if tag else F.lit(None).cast("string"), entity, score, layer)).alias("out"))

    pairs = F.zip_with(F.slice(parts, F.lit(1), F.size(found)), found, lambda p, m: F.struct(p.alias("part"), m.alias("hit")))
    return F.when(F.size(found) > 0, F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(no_spans())


def detect(text: Column, toggles: Toggles = Toggles(), entities: list[str] | None = None, keep: bool = False) -> Column:
    """Spans of the pattern recognizers; keep also returns entities that the policy leaves alone.  Letters,
    digits and blanks of patterns are those of Unicode; a pattern runs only where the text holds what it needs."""
    out = []
    for (entity, score, pattern), needed in zip(PATTERNS, NEEDED, strict=True):
        tag = toggles.tag_of(entity)
        if (entities is None or entity in entities) and (keep or tag):
            may = text.rlike(needed) if isinstance(needed, str) else reduce(lambda a, b: a | b, [text.contains(x) for x in needed])
            out.append(F.when(may, regex_spans(text, f"(?U){pattern}", tag, entity, score)).otherwise(no_spans()))
    return F.concat(*out) if out else no_spans()


def may_name(toggles: Toggles, entities: list[str] | None = None) -> bool:
    """Whether the recognizers can find names at all."""
    return any(toggles.tag_of(e) == "NAME" for e, _, _ in PATTERNS if entities is None or e in entities)


def covered(text: Column, s: Column) -> Column:
    return F.substring(text, s["start"] + 1, s["end"] - s["start"])


def _shape(value: Column) -> dict[str, Column]:
    letters = value.rlike(r"\p{L}")
    return {
        "one": ~value.contains(" "),
        "caps": (F.upper(value) == value) & letters,
        "lower": (F.lower(value) == value) & letters,
        "word": value.rlike(r"^\p{L}+$"),
        "camel": value.rlike("[a-z][A-Z]"),
        "digits": F.length(F.regexp_replace(value, "[^0-9]", "")),
        "size": F.length(value),
    }


def plausible_name(value: Column) -> Column:
    """Not all capitals up to 5, one token over 12, one token in camel case, all lower, mostly digits."""
    s = _shape(F.trim(value))
    return (s["size"] > 0) & ~((s["caps"] & (s["size"] <= 5)) | (s["one"] & ((s["size"] > 12) | s["camel"])) | s["lower"] | (2 * s["digits"] > s["size"]))


def plausible_location(value: Column) -> Column:
    """Several tokens, or one that is not over 15, in camel case, a lower-case word, up to 5 capitals
    without a digit, or ends in a digit."""
    s = _shape(F.trim(value))
    bad = (s["size"] > 15) | s["camel"] | (s["word"] & s["lower"]) | (s["caps"] & (s["size"] <= 5) & (s["digits"] == 0)) | F.trim(value).rlike("[0-9]$")
    return (s["size"] > 0) & ~(s["one"] & bad)


def plausible_pii(value: Column) -> Column:
    """Several tokens, or one that is not in camel case, a lower-case word, or up to 4 capitals."""
    s = _shape(F.trim(value))
    bad = s["camel"] | (s["word"] & s["lower"]) | (s["caps"] & (s["size"] <= 4) & (s["digits"] == 0))
    return (s["size"] > 0) & ~(s["one"] & bad)


def canonical_name(value: Column) -> Column:
    """Without quotes, possessives and a leading role word."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(value), '^"+|"+$', ""), r"(?U)['’][sS]\b", "")
    return F.trim(F.regexp_replace(bare, "^(?:" + "|".join(ROLES) + ")", ""))


def name_shaped(value: Column) -> Column:
    """Whether the canonical form is capitalised words, three characters at least, and no stop word."""
    name = canonical_name(value)
    return (F.length(name) >= 3) & ~F.lower(name).isin(NAME_STOP_WORDS) & name.rlike(NAME_TOKENS)


def carried_name(name: Column) -> Column:
    """Whether a canonical name is looked for in other texts."""
    return (F.length(name) >= 3) & ~F.lower(name).isin(CARRY_STOP_WORDS) & name.rlike(NAME_TOKENS)


def extend_particles(text: Column, spans: Column) -> Column:
    """Lengthens NAME spans over surname particles and the surname that follow directly."""
    follow = r"^(?:\s+(?:" + "|".join(PARTICLES) + r")\s+[A-ZÀ-ɏ][A-Za-zÀ-ɏ'-]+)+"
    return F.transform(spans, lambda s: F.when(s["tag"] == "NAME", s.withField("end", s["end"] + F.length(F.regexp_extract(F.substring(text, s["end"] + 1, F.length(text)), follow, 0)))).otherwise(s))


def extend_original(text: Column, spans: Column) -> Column:
    """Takes a possessive after a span, then quotes on either side, into the span."""

    def grow(s: Column) -> Column:
        own = F.when(F.substring(text, s["end"] + 1, 3).rlike(r"(?U)^['’][sS]\b"), 2).otherwise(0)
        before = F.when((s["start"] > 0) & (F.substring(text, F.greatest(s["start"], F.lit(1)), 1) == '"'), 1).otherwise(0)
        after = F.when(F.substring(text, s["end"] + own + 1, 1) == '"', 1).otherwise(0)
        return s.withField("end", s["end"] + own + after).withField("start", s["start"] - before)

    return F.transform(spans, grow)


def filter_spans(text: Column, spans: Column, toggles: Toggles = Toggles()) -> Column:
    """Drops bare forms of address, low scores and implausible names; cuts a leading form of address."""

    def kept(s: Column) -> Column:
        value = covered(text, s)
        word = F.lower(F.regexp_replace(F.trim(value), r"\.+$", ""))
        gone = word.isin(NEVER_MASKED) | (F.lit(not toggles.titles) & word.isin(HONORIFICS))
        scored = ~s["tag"].isin("NAME", "LOCATION") | (s["score"] >= toggles.min_score)
        first = s["layer"] == "layer1"  # shapes of the first layer; outside detections have had their own
        shape = F.when(s["tag"] == "NAME", name_shaped(value) & (~first | plausible_name(canonical_name(value)))).when((s["tag"] == "LOCATION") & first & (s["entity"] == "LOCATION"), plausible_location(value)).otherwise(True)
        return s["tag"].isNotNull() & ~gone & scored & shape

    def cut(s: Column) -> Column:
        value = F.lower(covered(text, s))
        length = F.lit(0)
        for word in NEVER_MASKED:
            length = F.when(value.startswith(word + " "), len(word) + 1).otherwise(length)
        return s.withField("start", s["start"] + length)

    return F.filter(F.transform(F.filter(spans, kept), cut), lambda s: s["start"] < s["end"])


def merge_layers(*layers: Column) -> Column:
    """One list, earlier layers first, numbered by position."""
    return F.transform(F.concat(*layers), lambda s, i: s.withField("ord", i.cast("int")))


def names_of(text: Column, spans: Column) -> Column:
    """Canonical forms of the NAME spans of a text that are looked for in other texts; null if there are none."""
    names = F.transform(F.filter(spans, lambda s: s["tag"] == "NAME"), lambda s: canonical_name(covered(text, s)))
    kept = F.array_distinct(F.filter(names, carried_name))
    return F.when(F.size(kept) > 0, kept)


def first_word(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(?U)^\w+", 0))


def names_in(text: Column, names: Column) -> Column:
    """The names whose first word the text holds, whatever the number of names; null if there are none.  The
    words of both meet in a hash set; only these names are searched for."""
    first = F.array_intersect(F.transform(names, first_word), F.split(F.lower(text), r"(?U)\W+"))
    # bound to a variable: inside the inner lambda the intersection would be computed anew for each name
    bound = F.array(F.struct(first.alias("first"), names.alias("names")))
    kept = F.transform(bound, lambda b: F.when(F.size(b["first"]) > 0, F.filter(b["names"], lambda n: F.array_contains(b["first"], first_word(n)))))
    return F.when(names.isNotNull(), kept[0])


def literal_pattern(value: Column) -> Column:
    """A pattern that matches the value itself."""
    return F.regexp_replace(value, r"([^\p{L}\p{N}\s])", r"\\$1")


def whole_word(pattern: Column) -> Column:
    """The pattern in any case, with no word character before or after."""
    return F.concat(F.lit(r"(?iU)(?<!\w)(?:"), pattern, F.lit(r")(?!\w)"))


def carried_spans(text: Column, names: Column, spans: Column) -> Column:
    """Spans of whole words of a few names, in any case, longest first, that no span covers at either end."""
    longest = F.transform(F.array_sort(F.transform(names, lambda n: F.struct((-F.length(n)).alias("k"), n.alias("n")))), lambda x: literal_pattern(x["n"]))
    pattern = whole_word(F.array_join(longest, "|"))
    hits = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda p, m: F.struct(F.length(p).alias("before"), F.length(m).alias("size")))
    start = F.struct(F.lit(0).alias("at"), no_spans().alias("out"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + x["before"]
        return F.struct((first + x["size"]).alias("at"), F.array_append(acc["out"], span(first, first + x["size"], "NAME", "CARRY_FORWARD", 1.0, "carry")).alias("out"))

    found = F.aggregate(F.filter(hits, lambda h: h["size"].isNotNull()), start, step, lambda acc: acc["out"])
    free = lambda s: ~F.exists(spans, lambda o: ((o["start"] <= s["start"]) & (s["start"] < o["end"])) | ((o["start"] < s["end"]) & (s["end"] <= o["end"])))
    return F.when(names.isNotNull(), F.filter(found, free)).otherwise(no_spans())


def resolve(spans: Column) -> Column:
    """Longest first, ties by position in the list; keeps spans that overlap none kept before."""
    keyed = F.transform(spans, lambda s: F.struct((s["start"] - s["end"]).alias("k"), s["ord"].alias("o"), s.alias("s")))
    hits = lambda out, s: F.exists(out, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]))
    kept = F.aggregate(F.array_sort(keyed), no_spans(), lambda out, x: F.when(hits(out, x["s"]), out).otherwise(F.array_append(out, x["s"])))
    return F.array_sort(kept)


def apply_spans(text: Column, resolved: Column) -> Column:
    """The text with each span replaced by its tag; spans outside the text are skipped."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    inside = F.filter(resolved, lambda s: (s["start"] >= 0) & (s["end"] <= F.length(text)) & (s["start"] < s["end"]))
    step = lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["tag"], F.lit("]")).alias("out"))
    return F.aggregate(inside, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def normalize_for_ner(text: Column) -> Column:
    """Same length: quotes and possessives become blanks, words in capitals keep only their first."""
    plain = F.regexp_replace(F.regexp_replace(text, '"([^"]+)"', " $1 "), "['’]s\\b", "  ")
    parts, caps = F.split(plain, r"\b[A-Z]{2,}\b", -1), F.regexp_extract_all(plain, F.lit(r"\b[A-Z]{2,}\b"), F.lit(0))
    joined = F.zip_with(parts, F.transform(caps, F.initcap), lambda p, c: F.concat(p, F.coalesce(c, F.lit(""))))
    return F.array_join(joined, "")


def blocklist(text: Column, words: list[str]) -> Column:
    """Whole words of the list, in its order and in any case, become [PII]."""
    for word in words:
        quoted = "\\Q" + word.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        text = F.regexp_replace(text, f"(?iU)(?<!\\w){quoted}(?!\\w)", "[PII]")
    return text


def detection_tag(label: Column, value: Column) -> Column:
    """Tag of an outside label by the words in it; number-like HEALTH and all other labels are PII."""
    name = F.upper(label)
    digits, size = F.length(F.regexp_replace(value, "[^0-9]", "")), F.length(F.trim(value))
    tag = F.lit("PII")
    for to, words in reversed(LABEL_TAGS):
        fits = name.rlike("|".join(words))
        tag = F.when(fits & ~((digits > 0) & (digits > 0.6 * size)) if to == "HEALTH" else fits, to).otherwise(tag)
    return tag


def allowed(tag: Column, toggles: Toggles) -> Column:
    return tag.isin([t for t in TAGS if toggles.allows(t)])
