"""Queries of the survey operators over the given tables, with equivalent SQL.

documents stand for answers (source as institution, lang as language), embeddings for the vector
collection (label as facet; the vectors of ids 0 to 6 as themes), labels for verdicts, events for scores
by group, conversations for long answers (role as question)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomveil.functions import spans as S
from loomveil.functions.recognizers import PHONE
from loomveil.operators import answers as A
from loomveil.operators import dashboard as D
from loomveil.operators import insights as I
from loomveil.operators import layers as L
from loomveil.operators import ledger as G
from loomveil.operators import masking as M
from loomveil.operators import vectors as V
from loomveil.sources import tables as R
from loomveil.sources.shared import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

N_THEMES = 7
ENTITIES = ["EMAIL_ADDRESS", "PHONE_NUMBER"]
LABELS = ["tion and the", "Licensed under Apache", "heedes whrere", "reserved rights"]
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_MASKED = f"regexp_replace(regexp_replace(text, '{EMAIL}', '[PII]', 'g'), '{PHONE}', '[PII]', 'g')"
_DIST = "1 - list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _themes(spark: SparkSession, sf_dir: str) -> list[list[float]]:
    rows = _t(spark, sf_dir, "embeddings").where(F.col("vec_id") < N_THEMES).orderBy("vec_id").collect()  # seven rows
    return [r.embedding for r in rows]


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mask_columns(_t(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], entities=ENTITIES)


@query(f"SELECT doc_id, {_MASKED} AS text FROM documents")
def mask_documents(spark, sf_dir):
    return _masked(spark, sf_dir)


@query()
def mask_documents_all_recognizers(spark, sf_dir):
    """All recognizers, with names carried forward in batches; tests hold it against the patterns in Python."""
    return M.mask_batches(_t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", ["text"])


@query()
def recognizer_spans(spark, sf_dir):
    """Every span of every recognizer in all documents; tests hold it against the patterns in Python."""
    found = _t(spark, sf_dir, "documents").select("doc_id", "text", F.explode(S.detect(F.col("text"), keep=True)).alias("s"))
    return found.select("doc_id", "s.entity", "s.start", "s.end", S.covered(F.col("text"), F.col("s")).alias("value"), "s.score")


@query()
def mask_two_questions(spark, sf_dir):
    """Answers to two questions, masked by all recognizers; the first word of each opening turn stands for a
    model's detection of a name, and is carried forward to the same column of its batch."""
    turns = _t(spark, sf_dir, "conversations")
    asked = lambda r: F.when(F.col("role") == r, F.col("text")).alias(f"question_{r}")
    wide = M.number_rows(turns.select("conv_id", "turn", asked("user"), asked("assistant")), ["conv_id", "turn"])
    word = lambda c: F.regexp_extract(c, r"^\S+", 0)
    first = wide.where("turn = 0")
    named = {c: first.where(F.col(c).isNotNull()).select("row_no", F.lit(0).alias("start"), F.length(word(c)).alias("end"), F.lit("FIRSTNAME").alias("label"), F.lit(0.9).alias("score")) for c in ("question_user", "question_assistant")}
    detections = {c: M.detections_to_spans(d, first, "row_no", c) for c, d in named.items()}
    return M.mask_batches(wide, "row_no", ["question_user", "question_assistant"], detections=detections).drop("row_no")


@query()
def mask_documents_in_batches(spark, sf_dir):
    """All layers: recognizers, outside detections (the labels of toxic documents stand for a model's
    HEALTH detections of their first word), and names carried forward in batches."""
    docs, labels = _t(spark, sf_dir, "documents").select("doc_id", "text"), _t(spark, sf_dir, "labels")
    word = F.regexp_extract("text", r"^\S+", 0)
    seen = docs.join(labels.where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.lit(0).alias("start"), F.length(word).alias("end"), F.lit("CONDITION").alias("label"), F.lit(0.9).alias("score"))
    return M.mask_batches(docs, "doc_id", ["text"], detections={"text": M.detections_to_spans(seen, docs, "doc_id", "text")})


@query(f"""WITH m AS (SELECT unnest(regexp_extract_all({_MASKED}, '\\[(NAME|PII|LOCATION|TITLE|HEALTH)\\]', 1)) AS tag FROM documents)
SELECT t.tag, count(m.tag) AS n FROM (VALUES ('NAME'), ('PII'), ('LOCATION'), ('TITLE'), ('HEALTH')) t(tag) LEFT JOIN m ON m.tag = t.tag GROUP BY t.tag""")
def tag_counts(spark, sf_dir):
    return M.tag_counts(_masked(spark, sf_dir), ["text"])


@query(f"""WITH m AS (SELECT len(regexp_extract_all({_MASKED}, '\\[(NAME|PII|LOCATION|TITLE|HEALTH)\\]')) AS n FROM documents WHERE trim(text) <> '')
SELECT count(*) AS cells, count(*) FILTER (n > 0) AS affected, CAST(sum(n) AS BIGINT) AS entities, round(100.0 * count(*) FILTER (n > 0) / count(*), 1) AS percent FROM m""")
def masking_totals(spark, sf_dir):
    return M.totals(_masked(spark, sf_dir), ["text"])


@query(f"""SELECT doc_id, 'EMAIL_ADDRESS' AS entity, CAST(len(regexp_extract_all(text, '{EMAIL}')) AS INT) AS n, CAST(strpos(text, regexp_extract(text, '{EMAIL}')) - 1 AS INT) AS first
FROM documents WHERE regexp_matches(text, '{EMAIL}')""")
def detect_spans(spark, sf_dir):
    spans = S.detect(F.col("text"), entities=["EMAIL_ADDRESS"])
    return _t(spark, sf_dir, "documents").withColumn("s", spans).where(F.size("s") > 0).select("doc_id", F.col("s")[0]["entity"].alias("entity"), F.size("s").alias("n"), F.col("s")[0]["start"].alias("first"))


_VALUES = f"""b AS (SELECT doc_id, text, {_MASKED} AS after FROM documents),
v AS (SELECT after, unnest(regexp_extract_all(text, '{EMAIL}') || regexp_extract_all(text, '{PHONE}')) AS value FROM b),
c AS (SELECT value, regexp_matches(after, '(^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape(value) || '($|[^\\p{{L}}\\p{{N}}_])', 'i') AS stands FROM v WHERE length(trim(value)) >= 3)"""


@query(f"WITH {_VALUES} SELECT 'PII' AS tag, count(*) FILTER (stands) AS missed, count(*) FILTER (NOT stands) AS removed FROM c HAVING count(*) > 0")
def verify_masking(spark, sf_dir):
    """Masked and checked in one projection: no join of texts."""
    docs = _t(spark, sf_dir, "documents").select("text")
    return M.check_counts(M.mask_columns(docs, ["text"], entities=ENTITIES, checks="checks").select("checks"), "checks")


@query(f"""WITH {_VALUES}, t AS (SELECT count(*) AS cells, count(*) FILTER (n > 0) AS affected, CAST(coalesce(sum(n), 0) AS BIGINT) AS entities FROM (SELECT len(regexp_extract_all(after, '\\[PII\\]')) AS n FROM b WHERE trim(text) <> '')),
s AS (SELECT stands, min_by(value, md5(value)) AS value FROM c GROUP BY stands, substr(md5(value), 1, 1)),
n AS (SELECT count(*) FILTER (stands) AS missed, count(*) FILTER (NOT stands) AS removed FROM c)
SELECT tag, CASE WHEN tag = 'PII' THEN entities ELSE 0 END AS n, CASE WHEN tag = 'PII' THEN missed ELSE 0 END AS missed, CASE WHEN tag = 'PII' THEN removed ELSE 0 END AS removed,
 CASE WHEN tag = 'PII' THEN coalesce((SELECT string_agg(value, chr(10) ORDER BY value) FROM s WHERE stands), '') ELSE '' END AS missed_samples,
 CASE WHEN tag = 'PII' THEN coalesce((SELECT string_agg(value, chr(10) ORDER BY value) FROM s WHERE NOT stands), '') ELSE '' END AS removed_samples,
 cells, affected, entities, round(100.0 * affected / cells, 1) AS percent FROM (VALUES ('NAME'), ('PII'), ('LOCATION'), ('TITLE'), ('HEALTH')) g(tag), t, n""")
def masking_report(spark, sf_dir):
    """Counts are observed while the masked table is written; samples are read from its column of checks."""
    out = M.report(_t(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], shared_path(spark, "masked"), entities=ENTITIES)
    return out.withColumns({c: F.array_join(c, "\n") for c in ("missed_samples", "removed_samples")})


@query(f"SELECT doc_id, text AS before, {_MASKED} AS after FROM documents WHERE text <> {_MASKED}")
def changed_cells(spark, sf_dir):
    """Before and after stand in one row, so no text is shuffled."""
    both = _t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("before"), F.col("text").alias("after"))
    return M.mask_columns(both, ["after"], entities=ENTITIES).where(~F.col("before").eqNullSafe(F.col("after")))


@query(r"""SELECT doc_id, regexp_replace(text, '(^|[^\p{L}\p{N}_])(license|licensed)([^\p{L}\p{N}_]|$)', '\1[PII]\3', 'gi') AS text FROM documents WHERE regexp_matches(text, 'licens', 'i')""")
def blocklist_mask(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").where("regexp_like(text, '(?i)licens')")
    return docs.select("doc_id", S.blocklist(F.col("text"), ["license", "licensed"]).alias("text"))


@query("""SELECT lang, count(*) FILTER (toxic = 0) AS tp, count(*) FILTER (toxic = 1) AS fp, round(100.0 * count(*) FILTER (toxic = 1) / count(*), 1) AS fp_rate
FROM labels JOIN documents USING (doc_id) GROUP BY lang""")
def detector_review(spark, sf_dir):
    verdicts = _t(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "FP").otherwise("TP").alias("verdict"))
    return M.review(verdicts.join(_t(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id"), ["lang"])


@query("""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) AS word FROM documents),
s AS (SELECT * FROM (VALUES ('the', 'en'), ('and', 'en'), ('of', 'en'), ('der', 'de'), ('und', 'de'), ('die', 'de'), ('les', 'fr'), ('une', 'fr'), ('que', 'es'), ('los', 'es'), ('del', 'es')) s(word, lang)),
n AS (SELECT doc_id, s.lang AS lang, count(*) AS n FROM w JOIN s USING (word) GROUP BY 1, 2)
SELECT doc_id, lang FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lang) = 1""")
def language_vote(spark, sf_dir):
    words = [("the", "en"), ("and", "en"), ("of", "en"), ("der", "de"), ("und", "de"), ("die", "de"), ("les", "fr"), ("une", "fr"), ("que", "es"), ("los", "es"), ("del", "es")]
    return M.vote_language(_t(spark, sf_dir, "documents"), spark.createDataFrame(words, "word string, lang string"), "doc_id", "text")


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}''-]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
m AS (SELECT doc_id, i, CASE WHEN a = 'licensed' AND b = 'under' AND c = 'apache' THEN 'LICENSE' WHEN a = 'all' AND b = 'rights' AND c = 'reserved' THEN 'RIGHTS' WHEN a = 'licensed' THEN 'LICENSED' WHEN a = 'rights' THEN 'RIGHT' END AS entity FROM g),
k AS (SELECT *, lag(CASE WHEN entity = 'RIGHTS' THEN i + 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS skip FROM m)
SELECT doc_id, entity, count(*) AS n FROM k WHERE entity IS NOT NULL AND skip IS DISTINCT FROM i GROUP BY ALL""")
def phrase_detections(spark, sf_dir):
    """Phrases of a lexicon in all documents, the leftmost and longest of those that overlap."""
    lexicon = spark.createDataFrame([("Licensed under Apache", "LICENSE", "PII"), ("All rights reserved", "RIGHTS", "PII"), ("licensed", "LICENSED", "PII"), ("rights", "RIGHT", "PII")], "term string, entity string, tag string")
    spans = L.phrase_spans(_t(spark, sf_dir, "documents"), lexicon, "doc_id", "text")
    return spans.select("doc_id", F.explode("spans.entity").alias("entity")).groupBy("doc_id", "entity").agg(F.count(F.lit(1)).alias("n"))


@query()
def detect_languages(spark, sf_dir):
    """Languages by profiles of all documents; lang is what they are labelled as."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return docs.select("doc_id", F.col("lang").alias("labelled")).join(L.languages(docs, L.language_profiles(docs, "text", "lang"), "doc_id", "text"), "doc_id")


@query(f"SELECT doc_id, CASE WHEN lang = 'en' THEN NULL ELSE {_MASKED} END AS text FROM documents")
def mask_by_language(spark, sf_dir):
    """Recognizers by the language of the row; of English rows, whose patterns SQL cannot follow, tests tell."""
    out = L.mask_by_language(_t(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ["text"], "lang")
    return out.select("doc_id", F.when(F.col("lang") != "en", F.col("text")).alias("text"))


@query(r"""WITH d AS (SELECT doc_id, text, regexp_extract(text, '^\S+') AS word FROM documents)
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AND length(word) >= 2 AND NOT regexp_matches(word, '[0-9]')
 THEN regexp_replace(text, '(?i)' || regexp_escape(word), '[HEALTH]', 'g') ELSE text END AS text FROM d""")
def replace_detections(spark, sf_dir):
    """Direct masking: the first word of toxic documents, which stands for a model's HEALTH detection, wherever it stands."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    toxic = _t(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct().withColumn("toxic", F.lit(True))
    first = F.regexp_extract("text", r"^\S+", 0)
    seen = F.when(F.col("toxic") & ~first.rlike("[0-9]"), F.array(F.struct(F.lit(0).alias("start"), F.length(first).alias("end"), F.lit("CONDITION").alias("label"))))
    return docs.join(toxic, "doc_id", "left").select("doc_id", L.replace_direct(F.col("text"), seen).alias("text"))


@query()
def carry_forward_names(spark, sf_dir):
    docs = M.batches(_t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    handles = docs.select("batch_no", F.explode(F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0))).alias("name")).distinct()
    return M.carry_forward(docs, "doc_id", "text", handles).select("doc_id", F.size("spans").alias("n"))


@query("SELECT conv_id, turn, 'question_' || role AS question, text AS answer, length(text) AS n_chars FROM conversations WHERE trim(text) <> ''")
def unpivot_answers(spark, sf_dir):
    roles = ["user", "assistant", "system"]
    wide = _t(spark, sf_dir, "conversations").select("conv_id", "turn", *(F.when(F.col("role") == r, F.col("text")).alias(f"question_{r}") for r in roles))
    return A.unpivot(wide, ["conv_id", "turn"], [f"question_{r}" for r in roles]).select("conv_id", "turn", "question", "answer", F.length("answer").cast("bigint").alias("n_chars"))


@query("SELECT c_custkey, coalesce(nullif(trim(c_mktsegment), ''), c_name) AS sector, c_name AS institution FROM customer")
def canonical_metadata(spark, sf_dir):
    df = A.canonical(_t(spark, sf_dir, "customer"), {"sector": ["c_mktsegment", "c_name"], "institution": ["missing", "c_name"]})
    return df.select("c_custkey", "sector", "institution")


@query("SELECT DISTINCT 'lang' AS facet, lang AS value FROM documents UNION SELECT DISTINCT 'source', source FROM documents")
def facets(spark, sf_dir):
    return A.facets(_t(spark, sf_dir, "documents"), ["lang", "source"])


@query("SELECT doc_id, lang, source, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS preview FROM documents WHERE lang = 'en' AND source = 'src0'")
def filtered_previews(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").where(A.condition({"lang": "en", "source": "src0", "cohort": "All"}))
    return docs.select("doc_id", "lang", "source", A.preview(F.col("text"), 300).alias("preview"))


@query(f"""WITH d AS (SELECT b.vec_id AS vec_id, b.label AS label, {_DIST} AS distance FROM embeddings a, embeddings b WHERE a.vec_id = 3 AND b.label < 5)
SELECT vec_id, label, round(distance, 6) + 0.0 AS distance FROM d ORDER BY d.distance, vec_id LIMIT 20""")
def cosine_top_k(spark, sf_dir):
    items = _t(spark, sf_dir, "embeddings")
    q = _themes(spark, sf_dir)[3]
    return V.nearest(items, q, 20, "vec_id", where=F.col("label") < 5).select("vec_id", "label", (F.round("distance", 6) + F.lit(0.0)).alias("distance"))


@query(f"""WITH d AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {_DIST} AS distance FROM embeddings a, embeddings b WHERE a.vec_id < {N_THEMES})
SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INT) AS rank, round(distance, 6) + 0.0 AS distance FROM d
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 10""")
def batch_search(spark, sf_dir):
    items = _t(spark, sf_dir, "embeddings")
    queries = items.where(F.col("vec_id") < N_THEMES).select(F.col("vec_id").alias("query_id"), "embedding")
    return V.search(items, queries, 10, "vec_id").withColumn("distance", F.round("distance", 6) + F.lit(0.0))


@query(f"""WITH d AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {_DIST} AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)
SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INT) AS rank, round(distance, 6) + 0.0 AS distance FROM d
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 10""")
def batch_search_hundredth(spark, sf_dir):
    """Every row whose id is divisible by 100 against all rows."""
    items = _t(spark, sf_dir, "embeddings")
    queries = items.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return V.search(items, queries, 10, "vec_id").withColumn("distance", F.round("distance", 6) + F.lit(0.0))


_SPLIT = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


@query(f"""WITH c AS (SELECT vec_id, embedding, text FROM embeddings JOIN documents ON vec_id = doc_id),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {_DIST} AS distance FROM c a, c b WHERE a.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p QUALIFY rank <= 25),
w AS (SELECT vec_id, len({_SPLIT.format('text')}) AS words, unnest({_SPLIT.format('text')}) AS term FROM c),
n AS (SELECT vec_id, term, words, count(*) AS n FROM w GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM n GROUP BY 1),
s AS (SELECT count(*) AS docs, avg(len({_SPLIT.format('text')})) AS mean FROM c),
q AS (SELECT vec_id AS query_id, unnest(list_distinct({_SPLIT.format('text')})) AS term FROM c WHERE vec_id % 100 = 0),
r AS (SELECT k.query_id, k.vec_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * words / mean))), 9) AS score
 FROM k JOIN n USING (vec_id) JOIN q ON q.query_id = k.query_id AND q.term = n.term JOIN f ON f.term = n.term, s GROUP BY 1, 2),
o AS (SELECT query_id, vec_id, distance, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0) DESC, rank) AS id, count(*) OVER (PARTITION BY query_id) AS candidate_count FROM k LEFT JOIN r USING (query_id, vec_id))
SELECT query_id, CAST(id AS INT) AS id, vec_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS preview, round_even(greatest(0, 1 - distance), 3) AS similarity,
 round_even(100 * greatest(0, 1 - distance), 1) AS percentage, round(score, 6) AS reranker_score, least(candidate_count, 5) AS count, candidate_count FROM o JOIN c USING (vec_id) WHERE id <= 5""")
def two_stage_search(spark, sf_dir):
    """Every item whose id is divisible by 100 as a query, with its whole text, against all items with a text."""
    docs = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding").join(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    queries = docs.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("text").alias("query_text"), "embedding")
    return V.two_stage_search(docs, queries, 5, "vec_id", "text").withColumn("reranker_score", F.round("reranker_score", 6))


_ASSIGNED = f"""d AS (SELECT b.vec_id AS vec_id, b.label AS label, a.vec_id AS theme_idx, {_DIST} AS distance FROM embeddings a, embeddings b WHERE a.vec_id < {N_THEMES}),
assigned AS (SELECT vec_id, label, CAST(theme_idx AS INT) AS theme_idx, distance FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, theme_idx) = 1)"""


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.assign_themes(_t(spark, sf_dir, "embeddings"), _themes(spark, sf_dir))


@query(f"WITH {_ASSIGNED} SELECT vec_id, theme_idx, round(distance, 6) + 0.0 AS distance FROM assigned")
def nearest_theme(spark, sf_dir):
    return _assigned(spark, sf_dir).select("vec_id", "theme_idx", (F.round("distance", 6) + F.lit(0.0)).alias("distance"))


@query(f"""WITH {_ASSIGNED}, c AS (SELECT theme_idx, count(*) AS n FROM assigned GROUP BY 1),
f AS (SELECT *, CAST(floor(100.0 * n / sum(n) OVER ()) AS BIGINT) AS fl, (100 * n) % CAST(sum(n) OVER () AS BIGINT) AS m FROM c)
SELECT theme_idx, n, fl + CASE WHEN row_number() OVER (ORDER BY m DESC, n DESC, theme_idx) <= 100 - CAST(sum(fl) OVER () AS BIGINT) THEN 1 ELSE 0 END AS percentage FROM f""")
def theme_shares(spark, sf_dir):
    return V.largest_remainder(V.theme_counts(_assigned(spark, sf_dir), N_THEMES))


@query(f"WITH {_ASSIGNED} SELECT vec_id, label, round(distance, 6) + 0.0 AS distance, round(greatest(0, 1 - distance), 2) AS similarity FROM assigned WHERE theme_idx = 2")
def theme_documents(spark, sf_dir):
    return _assigned(spark, sf_dir).where("theme_idx = 2").orderBy("distance", "vec_id").select("vec_id", "label", (F.round("distance", 6) + F.lit(0.0)).alias("distance"), F.round(F.greatest(F.lit(0.0), 1 - F.col("distance")), 2).alias("similarity"))


@query("""WITH n AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rn FROM documents)
SELECT source, (rn - 1) // 60 AS batch_no, CAST(count(*) AS INT) AS n_docs, sha256('Batch ' || source || ' ' || ((rn - 1) // 60 + 1) || chr(10) || string_agg('- ' || text || chr(10), '' ORDER BY rn)) AS prompt_sha
FROM n WHERE rn <= 240 GROUP BY 1, 2""")
def insight_batches(spark, sf_dir):
    numbered = I.number_batches(_t(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", "text"), "source", ["n_chars", "doc_id"])
    out = I.batch_prompts(numbered, "source", "text", "Batch {theme_name} {n}\n")
    return out.select("source", "batch_no", "n_docs", F.sha2("prompt", 256).alias("prompt_sha"))


@query("""SELECT source AS theme, CAST(least(count(*), 240) AS BIGINT) AS n_docs, CAST(ceil(least(count(*), 240) / 60.0) AS BIGINT) AS n_batches, CAST(NULL AS VARCHAR) AS error FROM documents GROUP BY source""")
def reduced_summaries(spark, sf_dir):
    """A ledger of prompts for the documents of each source; the model's stand-in counts batches and adds counts up."""
    ledger = G.Ledger(spark, shared_path(spark, "ledger"))
    ledger.plan(_t(spark, sf_dir, "documents").select(F.col("source").alias("theme"), "doc_id", "n_chars", "text"), ["n_chars", "doc_id"])
    total = F.aggregate(F.from_json(F.regexp_extract("prompt", r"(?s)\[.*\]", 0), "array<struct<n:bigint>>"), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    one = F.when(F.col("level") == 0, F.lit(1).cast("bigint")).otherwise(total)
    ledger.run(lambda prompts: prompts.select("prompt_id", F.to_json(F.struct(one.alias("n"))).alias("reply"), F.lit(None).cast("string").alias("error")))
    return ledger.results("n bigint").select("theme", "n_docs", F.col("parsed.n").alias("n_batches"), "error")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def parse_replies(spark, sf_dir):
    events = _t(spark, sf_dir, "events").withColumn("reply", F.concat(F.lit("Here: "), "props", F.lit(" done")))
    return events.select("event_id", I.parse_reply(F.col("reply"), "k int")["k"].alias("k"), "event_type").where("k is not null")


@query("""WITH d AS (SELECT lower(text) AS t, regexp_split_to_array(lower(text), '[^a-zA-ZÀ-ÿ0-9]+') AS w FROM documents),
m AS (SELECT count(*) AS n, count(*) FILTER (contains(t, 'tion and the') OR list_has_any(w, ['tion'])) AS a,
 count(*) FILTER (contains(t, 'licensed under apache') OR list_has_any(w, ['licensed', 'under', 'apache']) OR len(list_filter(w, lambda x: x LIKE 'licens%')) > 0) AS b,
 count(*) FILTER (contains(t, 'heedes whrere') OR list_has_any(w, ['heedes', 'whrere'])) AS c,
 count(*) FILTER (contains(t, 'reserved rights') OR list_has_any(w, ['reserved', 'rights']) OR len(list_filter(w, lambda x: x LIKE 'reserv%')) > 0) AS d FROM d),
l AS (SELECT n, unnest(['tion and the', 'Licensed under Apache', 'heedes whrere', 'reserved rights']) AS subtheme, unnest([a, b, c, d]) AS mentions FROM m)
SELECT subtheme, mentions, CAST(round_even(100.0 * mentions / n, 0) AS BIGINT) AS doc_percentage, CAST(round_even(100.0 * mentions / sum(mentions) OVER (), 0) AS BIGINT) AS percentage FROM l""")
def subtheme_mentions(spark, sf_dir):
    return I.subtheme_mentions(_t(spark, sf_dir, "documents"), "text", LABELS)


@query("""SELECT doc_id, lang FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id AND quality = 1)""")
def cache_misses(spark, sf_dir):
    wanted = _t(spark, sf_dir, "documents").select("doc_id", "lang", F.lit(1).alias("quality"))
    return I.split_cache(wanted, _t(spark, sf_dir, "labels"), ["doc_id", "quality"])[1].select("doc_id", "lang")


@query("""WITH t AS (SELECT event_type, avg(value) AS mean_score, count(*) AS responses FROM events GROUP BY 1),
c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS r FROM c QUALIFY r <= 5)
SELECT t.event_type, round(mean_score, 4) AS mean_score, responses, string_agg(user_id || ':' || n, ',' ORDER BY r) AS top FROM t JOIN r USING (event_type) GROUP BY ALL""")
def compare_groups(spark, sf_dir):
    out = I.compare_groups(_t(spark, sf_dir, "events"), "event_type", "value", "user_id")
    top = F.array_join(F.transform("themes", lambda t: F.concat(t["theme"], F.lit(":"), t["n"].cast("string"))), ",")
    return out.select("event_type", F.round("mean_score", 4).alias("mean_score"), "responses", top.alias("top"))


@query("""WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), s AS (SELECT label, CAST(floor(100.0 * n / sum(n) OVER () + 0.5) AS BIGINT) AS share FROM c)
SELECT a.label, b.label AS other, abs(a.share - b.share) AS gap, CAST(row_number() OVER (PARTITION BY a.label ORDER BY abs(a.share - b.share), b.label) AS INT) AS r
FROM s a JOIN s b ON a.label <> b.label QUALIFY r <= 3""")
def related_themes(spark, sf_dir):
    counts = _t(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return I.related(I.shares(counts), "label", "share")


@query("""WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) AS r FROM c), a AS (SELECT r AS ra FROM r WHERE label = 9)
SELECT label, n, CAST(least(r, 5) AS INT) AS place FROM r, a WHERE label = 9 OR r <= CASE WHEN ra > 5 THEN 4 ELSE 5 END""")
def trend_selection(spark, sf_dir):
    counts = _t(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return I.trend_selection(counts, "label", "n", 9)


@query("""WITH m AS (SELECT n_nationkey AS k, c_mktsegment AS g, avg(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT CAST(a.k AS BIGINT) AS k, round(abs(a.v - b.v), 4) AS gap, abs(a.v - b.v) >= 0.4 AS significant FROM m a JOIN m b ON a.k = b.k AND a.g = 'BUILDING' AND b.g = 'MACHINERY'""")
def pair_difference(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("bigint").alias("k"), F.col("c_mktsegment").alias("g")).agg(F.avg("c_acctbal").alias("v"))
    return I.pair_difference(rows, "g", "BUILDING", "MACHINERY", "k", "v").select("k", F.round("gap", 4).alias("gap"), "significant")


@query("""WITH m AS (SELECT n_nationkey AS k, c_mktsegment AS g, avg(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
d AS (SELECT CAST(a.k AS BIGINT) AS k, abs(a.v - b.v) AS gap FROM m a JOIN m b ON a.k = b.k AND a.g = 'BUILDING' AND b.g = 'MACHINERY')
SELECT k, round(gap, 4) AS gap, CAST(row_number() OVER (ORDER BY gap DESC, k) AS INT) AS place, row_number() OVER (ORDER BY gap DESC, k) = 1 AS largest FROM d""")
def pair_comparison(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("bigint").alias("k"), F.col("c_mktsegment").alias("g")).agg(F.avg("c_acctbal").alias("v"))
    return I.pair_comparison(rows, "g", "BUILDING", "MACHINERY", "k", "v").select("k", F.round("gap", 4).alias("gap"), "place", "largest")


@query(f"""WITH {_ASSIGNED}, c AS (SELECT t.i AS theme_idx, count(vec_id) AS n FROM range({N_THEMES}) t(i) LEFT JOIN assigned ON theme_idx = t.i GROUP BY 1),
f AS (SELECT *, CAST(sum(n) OVER () AS BIGINT) AS total, CAST(floor(100.0 * n / sum(n) OVER ()) AS BIGINT) AS fl, (100 * n) % CAST(sum(n) OVER () AS BIGINT) AS m FROM c),
s AS (SELECT theme_idx, n AS frequency, total, fl + CASE WHEN row_number() OVER (ORDER BY m DESC, n DESC, theme_idx) <= 100 - CAST(sum(fl) OVER () AS BIGINT) THEN 1 ELSE 0 END AS share FROM f)
SELECT row_number() OVER (ORDER BY distance, vec_id) AS rank, vec_id, round_even(greatest(0, 1 - distance), 3) AS similarity, round_even(100 * greatest(0, 1 - distance), 1) AS percentage, frequency, share, total
FROM assigned JOIN s ON s.theme_idx = assigned.theme_idx WHERE assigned.theme_idx = 2""")
def theme_report(spark, sf_dir):
    out = V.theme_documents(_assigned(spark, sf_dir), 2, N_THEMES, "vec_id")
    return out.select("rank", "vec_id", "similarity", "percentage", "frequency", "share", "total")


@query(f"""WITH b AS (SELECT doc_id, 'text' AS "column", text AS before, {_MASKED} AS after FROM documents UNION ALL SELECT doc_id, 'source', source, source FROM documents),
f AS (SELECT string_agg(doc_id || ':' || "column", ',' ORDER BY doc_id, "column") AS first FROM (SELECT * FROM b WHERE before <> after ORDER BY doc_id, "column" LIMIT 30))
SELECT count(*) AS cells, count(*) FILTER (before <> after) AS changed_cells, count(DISTINCT doc_id) AS rows, count(DISTINCT doc_id) FILTER (before <> after) AS changed_rows, coalesce(any_value(first), '') AS first FROM b, f""")
def change_summary(spark, sf_dir):
    both = _t(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("before"), F.col("text").alias("after"))
    masked = M.mask_columns(both, ["after"], entities=ENTITIES)
    cells = F.array(F.struct(F.lit("text").alias("column"), "before", "after"), F.struct(F.lit("source").alias("column"), F.col("source").alias("before"), F.col("source").alias("after")))
    out = M.change_summary(masked.select("doc_id", F.explode(cells).alias("c")).select("doc_id", "c.*"), "doc_id")
    return out.withColumn("first", F.array_join(F.transform("first", lambda x: F.concat(x["doc_id"].cast("string"), F.lit(":"), x["column"])), ","))


@query("""SELECT c_custkey, CASE WHEN c_acctbal / 100 >= 65 THEN 'positive' WHEN c_acctbal / 100 <= 38 THEN 'critical' ELSE 'neutral' END AS band,
CASE WHEN c_acctbal / 100 >= 75 THEN 'very positive' WHEN c_acctbal / 100 >= 60 THEN 'positive' WHEN c_acctbal / 100 >= 45 THEN 'neutral' WHEN c_acctbal / 100 >= 30 THEN 'negative' ELSE 'very negative' END AS label FROM customer""")
def sentiment_bands(spark, sf_dir):
    score = F.col("c_acctbal") / 100
    return _t(spark, sf_dir, "customer").select("c_custkey", A.sentiment_band(score).alias("band"), A.sentiment_label(score).alias("label"))


@query("""SELECT d.doc_id, CASE WHEN l.quality IS NOT NULL THEN l.quality ELSE -1 END AS quality FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)""")
def overview_overlay(spark, sf_dir):
    base = _t(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("quality"))
    live = _t(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return I.overlay([base, live], "doc_id")


@query("""SELECT coalesce(s.s_suppkey, p.p_partkey) AS key, s.s_name AS card, p.p_name AS live FROM (SELECT * FROM supplier) s FULL JOIN (SELECT * FROM part) p ON s.s_suppkey = p.p_partkey""")
def merge_cards(spark, sf_dir):
    cards = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("card"), F.lit(None).cast("string").alias("live"))
    live = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("live"))
    return I.merge_cards(cards, live, "key").select("key", "card", "live")


@query("SELECT lower(c_mktsegment) AS word, CAST(min(c_custkey) AS BIGINT) AS ord FROM customer GROUP BY 1")
def distinct_blocklist(spark, sf_dir):
    words = _t(spark, sf_dir, "customer").select(F.concat(F.lit(" "), F.lower("c_mktsegment")).alias("word"), F.col("c_custkey").cast("bigint").alias("ord"))
    return R.distinct_words(words)


@query("""SELECT name, (contains(lower(name), '?') OR starts_with(lower(name), 'waarom')) AS question FROM (SELECT 'Waarom ' || n_name AS name FROM nation UNION ALL SELECT n_name || '?' FROM nation UNION ALL SELECT 'Label1' FROM region)""")
def question_columns(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    names = n.select(F.concat(F.lit("Waarom "), "n_name").alias("name")).unionByName(n.select(F.concat("n_name", F.lit("?")).alias("name"))).unionByName(_t(spark, sf_dir, "region").select(F.lit("Label1").alias("name")))
    return names.select("name", R.is_question_column(F.col("name")).alias("question"))


@query("SELECT count(*) AS total, count(DISTINCT label) AS labels, max(len(embedding)) AS dims FROM embeddings")
def collection_stats(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("total"), F.countDistinct("label").alias("labels"), F.max(F.size("embedding")).cast("bigint").alias("dims"))


@query("""WITH w AS (SELECT doc_id, list_intersect(['licensed', 'under', 'version'], regexp_split_to_array(lower(text), '[^a-z0-9_]+')) AS x FROM documents),
s AS (SELECT doc_id, len(x) / 3.0 AS score FROM w) SELECT doc_id, round(score, 4) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 10""")
def rerank_overlap(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("rank"), V.token_overlap("licensed under version", F.col("text")).alias("score"))
    return docs.orderBy(F.desc("score"), "rank").limit(10).select("doc_id", F.round("score", 4).alias("score"))


@query("""WITH d AS (SELECT lower(text) AS t FROM documents WHERE text <> ''),
m AS (SELECT count(*) AS n, count(*) FILTER (contains(t, 'tion')) AS a, count(*) FILTER (contains(t, 'licens') OR contains(t, 'under') OR contains(t, 'apache')) AS b,
 count(*) FILTER (contains(t, 'heedes') OR contains(t, 'whrere')) AS c, count(*) FILTER (contains(t, 'reserv') OR contains(t, 'rights')) AS d FROM d),
l AS (SELECT n, unnest(['tion and the', 'Licensed under Apache', 'heedes whrere', 'reserved rights']) AS subtheme, unnest([a, b, c, d]) AS mentions FROM m)
SELECT subtheme, mentions, CAST(floor(100.0 * mentions / n + 0.5) AS BIGINT) AS doc_percentage, CAST(floor(100.0 * mentions / sum(mentions) OVER () + 0.5) AS BIGINT) AS percentage FROM l""")
def fallback_mentions(spark, sf_dir):
    return D.fallback_mentions(_t(spark, sf_dir, "documents"), "text", LABELS)


@query(f"""SELECT b.vec_id, b.label, round({_DIST}, 6) + 0.0 AS distance FROM embeddings a, embeddings b WHERE a.vec_id = 3 AND b.label <> 2 ORDER BY {_DIST}, b.vec_id LIMIT 500""")
def drill_down(spark, sf_dir):
    items = _t(spark, sf_dir, "embeddings")
    return D.drill_down(items, _themes(spark, sf_dir)[3], "vec_id", F.col("label") != 2).select("vec_id", "label", (F.round("distance", 6) + F.lit(0.0)).alias("distance"))


@query("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT source, lang AS subtheme, n AS mentions FROM c ORDER BY n DESC, source, lang LIMIT 5""")
def popular_subthemes(spark, sf_dir):
    counts = _t(spark, sf_dir, "documents").groupBy("source", F.col("lang").alias("subtheme")).agg(F.count(F.lit(1)).alias("mentions"))
    themes = counts.groupBy("source").agg(F.collect_list(F.struct("subtheme", "mentions")).alias("subtheme_mentions"))
    return D.popular_subthemes(themes, "source")


@query("""SELECT c_custkey, CASE c_nationkey WHEN 0 THEN 'Eindhoven' WHEN 2 THEN 'Meijerijstad' WHEN 3 THEN 'Venlo' WHEN 4 THEN 'Sittard-geleen' WHEN 8 THEN 's-Hertogenbosch' WHEN 13 THEN 'Tilburg' WHEN 20 THEN 'Bergen op Zoom'
 WHEN 23 THEN 'Rotterdam' WHEN 24 THEN 'Utrecht' ELSE CAST(c_nationkey AS VARCHAR) END AS city FROM customer""")
def customer_cities(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", D.city_of(F.col("c_nationkey").cast("string")).alias("city"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS value FROM documents")
def metadata_values(spark, sf_dir):
    meta = F.create_map(F.lit("Label3"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(" "), F.lit("Label5"), F.col("lang"))
    return _t(spark, sf_dir, "documents").select("doc_id", D.metadata_value(meta, ["sector", "Label3", "Label5"]).alias("value"))


@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)
SELECT source, count(*) AS document_count, coalesce(max(lang) FILTER (r = 1 AND doc_id % 2 = 0), 'Summary could not be parsed.') AS summary,
 CAST(coalesce(max(least(3, n_words)) FILTER (r = 1 AND doc_id % 2 = 0), 0) AS INT) AS n_positive, CAST(count(DISTINCT lang) AS INT) AS n_mentions
FROM (SELECT *, len(regexp_split_to_array(text, ' ')) AS n_words FROM d) GROUP BY source""")
def theme_payloads(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    none = F.array().cast("array<string>")
    first = docs.groupBy("source").agg(F.min_by(F.struct("doc_id", "lang", "text"), "doc_id").alias("d")).where("d.doc_id % 2 = 0")
    parsed = first.select("source", F.col("d.lang").alias("summary"), none.alias("sentiments"), F.split("d.text", " ").alias("positive_comments"), none.alias("critical_comments"), none.alias("student_suggestions"), none.alias("subthemes"))
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("document_count"))
    mentions = docs.groupBy("source", F.col("lang").alias("subtheme")).agg(F.count(F.lit(1)).alias("mentions"))
    out = D.theme_payloads(parsed, counts, mentions, "source")
    return out.select("source", "document_count", "summary", F.size("positive_comments").alias("n_positive"), F.size("subtheme_mentions").alias("n_mentions"))


@query("""WITH l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1)
SELECT doc_id AS key, (source = 'src0') IS TRUE AND lang = 'en' AND quality IS NOT NULL AS valid FROM documents LEFT JOIN l USING (doc_id)""")
def cache_validity(spark, sf_dir):
    """Cached insights, saved twice: first without the fields that labels give, then replaced where labels are
    known.  source stands for the reranker, lang for the provider."""
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.lit(3).alias("cache_version"), F.lit(240).alias("llm_context_documents"), F.lit(60).alias("hierarchical_batch_documents"), F.col("source").alias("reranker"), F.col("lang").alias("llm_provider"))
    quality = _t(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("key")).agg(F.max("quality").cast("string").alias("value"))
    schema = ", ".join(["key bigint, cache_version int, llm_context_documents int, hierarchical_batch_documents int, reranker string, llm_provider string", *(f"{c} string" for c in D.REQUIRED_FIELDS)])
    cache = D.InsightCache(spark, shared_path(spark, "insights"), schema)
    cache.save(docs.select("*", *(F.lit(None).cast("string").alias(c) for c in D.REQUIRED_FIELDS)))
    cache.save(docs.join(quality, "key").select(docs.columns + [F.col("value").alias(c) for c in D.REQUIRED_FIELDS]))
    settings = {"cache_version": 3, "llm_context_documents": 240, "hierarchical_batch_documents": 60, "reranker": "src0"}
    return cache.load().select("key", D.valid_insight(settings, {"llm_provider": "en", "llm_model": None}).alias("valid"))


@query("""SELECT c.name AS "column", c.is_text, c.filled, c.records FROM (
 SELECT unnest(['doc_id', 'text', 'lang', 'source', 'n_chars']) AS name, unnest([false, true, true, true, false]) AS is_text,
 unnest([count(doc_id), count(*) FILTER (trim(text) <> ''), count(*) FILTER (trim(lang) <> ''), count(*) FILTER (trim(source) <> ''), count(n_chars)]) AS filled, count(*) AS records FROM documents) c""")
def inspect_output(spark, sf_dir):
    return D.inspect_output(_t(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


@query("""SELECT i AS doc_id, c AS "column", v AS value FROM (SELECT doc_id AS i, unnest(['lang', 'n_chars', 'source', 'text']) AS c, unnest([lang, CAST(n_chars AS VARCHAR), source, CASE WHEN trim(text) <> '' THEN text END]) AS v
 FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 3))""")
def column_preview(spark, sf_dir):
    return D.column_preview(_t(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"), "doc_id")


@query("""WITH l AS (SELECT lang, count(*) FILTER (toxic = 0) AS tp, count(*) FILTER (toxic = 1) AS fp FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT lang || ': ' || fp || ' of ' || (tp + fp) || ' false (' || printf('%.1f', round(100.0 * fp / (tp + fp), 1)) || ' %)' AS line FROM l""")
def review_report(spark, sf_dir):
    verdicts = _t(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "FP").otherwise("TP").alias("verdict"))
    return D.review_report(M.review(verdicts.join(_t(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id"), ["lang"]), "lang")


_RESULTS = """r AS (SELECT doc_id AS "row", text, unnest(['quality', 'toxic']) AS entity, unnest([CASE quality WHEN 1 THEN 'TP' WHEN 0 THEN 'FP' END, CASE toxic WHEN 0 THEN 'TP' ELSE NULL END]) AS verdict FROM labels JOIN documents USING (doc_id))"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as a review of documents: quality 0 is a false positive, and toxic 1 a reply that cannot be read."""
    both = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    of = lambda name, verdict: F.struct(F.lit(name).alias("entity"), verdict.alias("verdict"))
    pair = F.array(of("quality", F.when(F.col("quality") == 1, "TP").when(F.col("quality") == 0, "FP")), of("toxic", F.when(F.col("toxic") == 0, "TP")))
    return both.select(F.col("doc_id").alias("row"), F.lit("text").alias("column"), "text", F.explode(pair).alias("p")).select("row", "column", "text", "p.entity", "p.verdict")


@query(f"""WITH {_RESULTS} SELECT count(DISTINCT "row") AS cells_with_entities, count(*) FILTER (verdict = 'TP') AS true_positives, count(*) FILTER (verdict = 'FP') AS false_positives, count(*) FILTER (verdict IS NULL) AS parse_errors,
 CAST((SELECT count(*) FROM labels) AS INT) AS rows_sampled, round(100.0 * count(*) FILTER (verdict = 'FP') / count(*) FILTER (verdict IS NOT NULL), 1) AS false_positive_rate_pct FROM r""")
def review_summary(spark, sf_dir):
    return D.review_summary(_results(spark, sf_dir), _t(spark, sf_dir, "labels").count())


@query(f"""WITH {_RESULTS} SELECT "row", 'text' AS "column", any_value(substr(text, 1, 120)) AS text_snippet, count(*) AS entities_detected, string_agg(entity || ':' || coalesce(verdict, '?'), ',' ORDER BY entity, verdict NULLS FIRST) AS results FROM r GROUP BY "row" """)
def review_details(spark, sf_dir):
    return D.review_details(_results(spark, sf_dir)).withColumn("results", F.array_join(F.transform("results", lambda r: F.concat(r["entity"], F.lit(":"), F.coalesce(r["verdict"], F.lit("?")))), ","))


@query("""WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), p AS (SELECT source, arg_min(lang, doc_id) AS lang, arg_min(text, doc_id) AS text, min(doc_id) AS first FROM documents GROUP BY 1),
m AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2),
q AS (SELECT source, string_agg(doc_id::VARCHAR, ',' ORDER BY n_chars, doc_id) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rn FROM documents) WHERE rn <= 240 GROUP BY 1)
SELECT source AS theme, s.n AS document_count, least(s.n, 240) AS llm_document_count, CASE WHEN first % 2 = 0 THEN p.lang ELSE 'Summary could not be parsed.' END AS summary,
 CASE WHEN first % 2 = 0 THEN array_to_string(string_split(p.text, ' ')[1:3], ' ') ELSE '' END AS positive,
 CASE WHEN first % 2 = 0 THEN (SELECT string_agg(m.lang || ':' || m.n, ',' ORDER BY m.lang DESC) FROM m WHERE m.source = s.source) ELSE '' END AS mentions, ids AS quotes, 'lang' AS filter, 3 AS cache_version
FROM s JOIN p USING (source) JOIN q USING (source)""")
def insight_payloads(spark, sf_dir):
    """Payloads of sources as themes; the first document stands for a reply, languages for subthemes, ids for quotes."""
    docs = _t(spark, sf_dir, "documents").withColumnRenamed("source", "theme")
    n = F.count(F.lit(1))
    selected = docs.groupBy("theme").agg(n.alias("frequency"), n.alias("document_count"), n.alias("vector_relevant_count"), n.alias("total_filtered_documents"), F.least(n, F.lit(240)).alias("llm_document_count"))
    none = F.array().cast("array<string>")
    labels = docs.groupBy("theme").agg(F.reverse(F.array_sort(F.collect_set("lang"))).alias("subthemes"))
    first = docs.groupBy("theme").agg(F.min_by(F.struct("doc_id", "lang", "text"), "doc_id").alias("d")).where("d.doc_id % 2 = 0").join(labels, "theme")
    parsed = first.select("theme", F.col("d.lang").alias("summary"), none.alias("sentiments"), F.split("d.text", " ").alias("positive_comments"), none.alias("critical_comments"), none.alias("student_suggestions"), "subthemes")
    mentions = docs.groupBy("theme", F.col("lang").alias("subtheme")).agg(n.alias("mentions"), F.lit(0).alias("doc_percentage"), F.lit(0).alias("percentage"))
    quotes = I.number_batches(docs.select("theme", "doc_id", "n_chars"), "theme", ["n_chars", "doc_id"]).select("theme", "rn", F.col("doc_id").cast("string").alias("text"))
    out = D.insight_payloads(selected, parsed, mentions, quotes, "theme", {"cache_version": 3}, {"language": "lang"})
    said = F.array_join(F.transform("subtheme_mentions", lambda m: F.concat(m["subtheme"], F.lit(":"), m["mentions"].cast("string"))), ",")
    return out.select("theme", "document_count", "llm_document_count", "summary", F.array_join("positive_comments", " ").alias("positive"), said.alias("mentions"), F.array_join("quotes", ",").alias("quotes"), F.col("filters_applied")["language"].alias("filter"), "cache_version")
