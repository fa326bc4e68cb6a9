from pyspark.sql import functions as F

from loomveil.functions import spans as S
from loomveil.operators import answers as A
from loomveil.operators import insights as I
from loomveil.operators import masking as M
from loomveil.operators import vectors as V
from loomveil.sources import tables as R


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("x")).first().x


def test_masks_golden_sentences(spark):
    rows = [
        ("Mijn nummer is 1234567.", "Mijn nummer is [PII]."),
        ("mail a.b@c.nl of @handle", "mail [PII] of [PII]"),
        ("Ik woon op 1234 AB hier", "Ik woon op [LOCATION] hier"),
        ("docent Jansen is goed", "docent [NAME] is goed"),
        ("bel +31612345678 nu", "bel [PII] nu"),
        ("lokaal 2 is op de 3e etage", "lokaal 2 is op de 3e etage"),
        ("docent Jan van der Berg praat", "docent [NAME] praat"),
        ("", ""),
        (None, None),
    ]
    got = M.mask_columns(spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t string"), ["t"]).orderBy("i").collect()
    assert [r.t for r in got] == [r[1] for r in rows]


def test_resolution_prefers_the_longest_then_the_first(spark):
    def spans(t):
        return F.array(S.span(F.lit(0), F.lit(3), "NAME", "a", 1.0, order=0), S.span(F.lit(2), F.lit(8), "PII", "b", 1.0, order=1), S.span(F.lit(8), F.lit(11), "LOCATION", "c", 1.0, order=2))

    assert one(spark, "abcdefghijk", lambda t: S.apply_spans(t, S.resolve(spans(t)))) == "ab[PII][LOCATION]"


def test_normalization_keeps_the_length(spark):
    text = 'Zij zei "hallo" tegen JAN in Piet\'s huis'
    assert len(one(spark, text, S.normalize_for_ner)) == len(text)
    assert "Jan" in one(spark, text, S.normalize_for_ner)


def test_blocklist_whole_words_any_case(spark):
    assert one(spark, "Foo foobar FOO.", lambda t: S.blocklist(t, ["foo"])) == "[PII] foobar [PII]."


def test_carry_forward_stays_in_its_batch(spark):
    rows = spark.createDataFrame([(1, 0, "Anna kwam"), (2, 0, "met anna"), (3, 1, "anna")], "k int, batch_no int, t string")
    names = spark.createDataFrame([(0, "Anna")], "batch_no int, name string")
    got = {r.k: [(s.start, s.end) for s in r.spans] for r in M.carry_forward(rows, "k", "t", names).collect()}
    assert got == {1: [(0, 4)], 2: [(4, 8)]}


def test_shares_sum_to_100(spark):
    rows = spark.createDataFrame([(0, 1), (1, 1), (2, 1)], "theme_idx int, n bigint")
    assert [r.percentage for r in V.largest_remainder(rows).orderBy("theme_idx").collect()] == [34, 33, 33]
    zero = spark.createDataFrame([(0, 0), (1, 0)], "theme_idx int, n bigint")
    assert [r.percentage for r in V.largest_remainder(zero).collect()] == [0, 0]


def test_earlier_theme_wins_ties(spark):
    rows = spark.createDataFrame([([1.0, 0.0],)], "embedding array<float>")
    assert V.assign_themes(rows, [[0.0, 1.0], [1.0, 0.0], [1.0, 0.0]]).first().theme_idx == 1


def test_reply_parsing(spark):
    assert one(spark, 'so: {"a": 1} ok', lambda t: I.parse_reply(t, "a int")).a == 1
    assert one(spark, "no json", lambda t: I.parse_reply(t, "a int")) is None


def test_csv_source_and_questions(spark, tmp_path):
    (tmp_path / "x.csv").write_text("﻿ID;Waarom dan?\n1;\"a\nb\"\n", encoding="utf-8")
    df = R.read_csv(spark, str(tmp_path / "x.csv"))
    assert df.columns == ["ID", "Waarom dan?"] and df.first()[1] == "a\nb"
    assert R.infer_separators(spark, str(tmp_path / "x.csv")).first().sep == ";"
    assert [R.is_question(c) for c in ("ID", "Waarom dan?", "themascore?", "Label1")] == [False, True, False, False]


def test_filters_and_metadata(spark):
    assert A.normalized({"b": " x ", "a": "All", "c": None}) == {"b": "x"}
    df = A.canonical(spark.createDataFrame([(" ", "y")], "p string, q string"), {"k": ["p", "q"], "none": ["zz"]})
    assert df.first().k == "y" and df.first().none is None


def test_incremental_runs_once(spark, tmp_path):
    from loomveil.streaming.incremental import run_available

    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    spark.createDataFrame([(1, "a")], "k int, t string").write.parquet(src)
    assert run_available(spark, src, "k int, t string", out, mark, lambda d: d) == 1
    assert run_available(spark, src, "k int, t string", out, mark, lambda d: d) == 0
    assert spark.read.parquet(out).count() == 1


def masked(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "i bigint, t string")
    return [r.t for r in M.mask_batches(df, "i", ["t"], **more).orderBy("i").collect()]


def test_words_before_feedback_are_no_names(spark):
    texts = ["The feedback was good", "Timely feedback helps", "Our module is fine", "Anna feedback was late"]
    assert masked(spark, texts) == [*texts[:3], "[NAME] feedback was late"]


def test_names_are_carried_forward_in_their_batch_only(spark):
    texts = ["docent Jansen praat", "ik zag jansen's les", "Jansenius niet", "niets", "jansen"]
    assert masked(spark, texts, size=4) == ["docent [NAME] praat", "ik zag [NAME] les", "Jansenius niet", "niets", "jansen"]


def test_detections_are_masked_with_the_other_layers(spark):
    texts = ["Ik heb astma en mail a@b.nl", "in HaagCity en 12345", "Piet woont in Den Haag"]
    df = spark.createDataFrame(list(enumerate(texts)), "i bigint, t string")
    found = [(0, 7, 12, "B-CONDITION", 0.99), (1, 3, 11, "CITY", 0.99), (1, 15, 20, "LOCATION", 0.99), (2, 0, 4, "FIRSTNAME", 0.5), (2, 14, 22, "STREET", 0.9)]
    spans = M.detections_to_spans(spark.createDataFrame(found, "i bigint, start int, end int, label string, score double"), df, "i", "t")
    assert masked(spark, texts, detections={"t": spans}) == ["Ik heb [HEALTH] en mail [PII]", "in HaagCity en [PII]", "Piet woont in [LOCATION]"]


def test_shapes_and_tags(spark):
    rows = [("12345", False, True), ("A B C", True, True), ("in HaagCity", True, True), ("HaagCity", False, False), ("peer", False, False), ("HBO", False, False), ("Utrecht", True, True), ("", False, False)]
    got = spark.createDataFrame([(r[0],) for r in rows], "v string").select("v", S.plausible_location(F.col("v")).alias("l"), S.plausible_pii(F.col("v")).alias("p")).collect()
    assert {r.v: (r.l, r.p) for r in got} == {v: (a, b) for v, a, b in rows}
    tags = [("STREET", "x", "LOCATION"), ("COUNTRY", "x", "LOCATION"), ("DIAGNOSIS", "flu", "HEALTH"), ("MEDICATION", "287066633", "PII"), ("BLOCK", "x", "PII"), ("B-PERSON", "x", "NAME")]
    got = spark.createDataFrame([t[:2] for t in tags], "l string, v string").select("l", S.detection_tag(F.col("l"), F.col("v")).alias("t")).collect()
    assert [r.t for r in got] == [t[2] for t in tags]


def test_phones_of_several_forms(spark):
    for phone in ("+1 (212) 555-0100", "+44 20 7946 0958", "(0201) 555 0100", "+31 20 123 4567"):
        assert one(spark, f"call {phone}, please", lambda t: S.apply_spans(t, S.resolve(S.detect(t, entities=["PHONE_NUMBER"])))) == "call [PII], please"


def test_subtheme_mentions_follow_the_rules(spark):
    def count(texts, labels):
        return [(r.subtheme, r.mentions) for r in I.subtheme_mentions(spark.createDataFrame([(t,) for t in texts], "t string"), "t", labels).collect()]

    assert count(["gaat naar huis", "mijn toets", "a.b c"], ["Kijken naar elkaar", "Toets, rooster", "a.b", " "]) == [("Kijken naar elkaar", 0), ("Toets, rooster", 1), ("a.b", 1)]
    assert count([], ["x"]) == [] and count(["x"], []) == []
