import math
import random
import re

from pyspark.sql import functions as F

from loomveil.operators import layers as L
from loomveil.operators import masking as M

SF = "/root/testdata/sf0.001"


def test_presets_merge_their_layers(spark):
    df = spark.createDataFrame([(0, "mail a@b.nl, ik heb astma in Utrecht"), (1, "niets"), (2, None)], "k bigint, t string")
    detector = M.detections_to_spans(spark.createDataFrame([(0, 20, 25, "CONDITION", 0.9)], "k bigint, start int, end int, label string, score double"), df, "k", "t")
    outside = L.filter_to_spans(spark.createDataFrame([(0, 29, 36, "B-private_address"), (0, 35, 36, "x")], "k bigint, start int, end int, label string"), df, "k", "t")
    found = {"detector": {"t": detector}, "filter": {"t": outside}}
    got = {p: L.mask_preset(df, "k", ["t"], p, found).orderBy("k").first().t for p in L.PRESETS}
    assert got == {"fast": "mail [PII], ik heb astma in Utrecht", "recommended": "mail [PII], ik heb [HEALTH] in Utrecht", "deep": "mail [PII], ik heb [HEALTH] in [LOCATION]"}


def test_filter_labels(spark):
    labels = ["B-private_person", "private_address", "S-Medical_note", "O-x", "private_persons", "O-", None]
    got = [r.t for r in spark.createDataFrame(list(enumerate(labels)), "i int, l string").orderBy("i").select(L.filter_tag(F.col("l")).alias("t")).collect()]
    assert got == ["NAME", "LOCATION", "HEALTH", "PII", "PII", "PII", "PII"]


def test_direct_masking_follows_the_order_of_the_detections(spark):
    cases = [("Anna en anna de Vries, ANNA", [(0, 4, "PERSON"), (8, 21, "PERSON")]), ("pii a@b.nl", [(0, 3, "OTHER"), (4, 10, "EMAIL")]), ("a.b axb", [(0, 3, "CITY")]), ("x", [(0, 1, "CITY")]), ("tekst", None), (None, [(0, 2, "CITY")])]
    tag = lambda label: {"PERSON": "NAME", "CITY": "LOCATION"}.get(label, "PII")
    rows = spark.createDataFrame([(i, t, d) for i, (t, d) in enumerate(cases)], "i int, t string, d array<struct<start:int,end:int,label:string>>")
    for r in rows.select("i", L.replace_direct(F.col("t"), F.col("d")).alias("x")).collect():
        text, found = cases[r.i]
        want = text
        for a, b, label in sorted(found or [], key=lambda d: d[0] - d[1]) if text else []:
            if len(text[a:b]) >= 2:
                want = re.sub(re.escape(text[a:b]), f"[{tag(label)}]", want, flags=re.I)
        assert r.x == want
    assert spark.createDataFrame([("lokaal 5, 1234567 en a@b.nl",)], "t string").select(L.mask_direct(F.col("t")).alias("x")).first().x == "lokaal 5, [PII] en [PII]"
    assert {r.tag for r in L.masking_spec(spark).collect()} == {"NAME", "LOCATION", "PII", "TITLE", "HEALTH"} and L.policy_table(spark).where("entity = 'NL_BSN'").first().tag == "PII"


def test_phrases_against_brute_force(spark):
    rnd = random.Random(5)
    words = ["den", "haag", "Den", "HAAG", "rotterdam", "aan", "zee", "é", "bergen", "op", "zoom"]
    terms = ["Den Haag", "haag", "Bergen aan Zee", "bergen", "den haag aan zee rotterdam", "zee", "é"]
    texts = [rnd.choice([" ", ", "]).join(rnd.choice(words) for _ in range(rnd.randint(0, 14))) for _ in range(80)] + [None, "", "..."]
    df = spark.createDataFrame(list(enumerate(texts)), "k bigint, t string")
    lexicon = spark.createDataFrame([(t, t.upper(), "LOCATION") for t in terms], "term string, entity string, tag string")
    got = {r.k: [(s.start, s.end, s.entity) for s in r.spans] for r in L.phrase_spans(df, lexicon, "k", "t").collect()}
    known = {tuple(t.lower().split()): t.upper() for t in terms}
    for k, text in enumerate(texts):
        tokens, want, i = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[\w'-]+", text or "")], [], 0
        while i < len(tokens):
            n = next((n for n in range(5, 0, -1) if i + n <= len(tokens) and tuple(t[0] for t in tokens[i : i + n]) in known), 0)
            if n:
                want.append((tokens[i][1], tokens[i + n - 1][2], known[tuple(t[0] for t in tokens[i : i + n])]))
            i += max(n, 1)
        assert got.get(k, []) == want, text


def test_languages_route_masking(spark):
    dutch, german = "Ik vind het vak goed en de docent ook", "Ich finde den Kurs gut und die Lehrer auch"
    known = spark.createDataFrame([(dutch, "nl"), (german, "de"), ("The course is good and the teachers are too", "en")], "t string, lang string")
    df = spark.createDataFrame([(0, "de docent vind ik goed 1234567"), (1, "die Lehrer finde ich gut 1234567 a@b.de"), (2, "12"), (3, None)], "k bigint, t string")
    lang = L.languages(df, L.language_profiles(known, "t", "lang"), "k", "t")
    assert {r.k: r.lang for r in lang.collect()} == {0: "nl", 1: "de", 2: "nl", 3: "nl"}
    masked = L.mask_by_language(df.join(lang, "k"), ["t"], "lang")
    assert {r.k: r.t for r in masked.collect()} == {0: "de docent vind ik goed [PII]", 1: "die Lehrer finde ich gut 1234567 [PII]", 2: "12", 3: None}


def test_profiles_tell_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    learn, rest = docs.where("crc32(cast(doc_id as string)) % 5 <> 0"), docs.where("crc32(cast(doc_id as string)) % 5 = 0")
    out = rest.join(L.languages(rest, L.language_profiles(learn, "text", "lang"), "doc_id", "text").withColumnRenamed("lang", "found"), "doc_id")
    right, n = out.where("lang = found").count(), out.count()
    majority = rest.groupBy("lang").count().agg(F.max("count")).first()[0]
    assert n > 20 and right >= majority


def test_languages_do_not_shuffle_runs_and_count_each_once_a_text(spark):
    rnd = random.Random(4)
    texts = [(i, " ".join(rnd.choice(["Één", "an", "ANN", "été", "xy"]) for _ in range(rnd.randint(0, 6))) or None, rnd.choice(["a", "b", None])) for i in range(40)]
    df = spark.createDataFrame(texts, "k bigint, t string, lang string")
    profiles = L.language_profiles(df, "t", "lang")
    runs = lambda t: {f" {w} "[i : i + 3] for w in (t or "").lower().split() for i in range(len(w))}
    want = {(g, la): sum(g in runs(t) for _, t, x in texts if x == la) for la in "ab" for _, t, x in texts if x == la for g in runs(t)}
    many = {la: sum(x == la for _, _, x in texts) for la in "ab"}
    got = {(r.gram, r.lang): r.weight for r in profiles.where("gram <> '' and lang is not null").collect()}
    assert set(got) == set(want) and all(abs(math.exp(got[g, la]) - (n + 1) / (many[la] + 2)) < 1e-9 for (g, la), n in want.items())
    plan = L.languages(df, profiles, "k", "t")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
