"""Cosine search, theme assignment and shares over columns of unit vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distance(a: Column, b: Column) -> Column:
    """1 - dot product, added up in order, in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.lit(1.0) - F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def unit(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def candidate_size(k: int, n: int, cap: int = 240) -> int:
    return min(max(5 * k, k), max(n, 1), cap)


def nearest(items: DataFrame, query: Sequence[float], k: int, key: str, vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """The k nearest items of one query: filter, distance, top-k without a full sort."""
    kept = items if where is None else items.where(where)
    return kept.withColumn("distance", distance(F.col(vector), literal(query))).orderBy("distance", key).limit(k)


#: vectors of a block at most
BLOCK_ROWS = 2048


def _blocks(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(block, ids, data): vectors of BLOCK_ROWS rows at most as one matrix, made where the rows are read."""
    import numpy as np
    import pyarrow as pa

    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for n, batch in enumerate(batches):
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                ids = part.column(0)
                data = np.array(part.column(1).to_pylist(), dtype=np.float64).tobytes()
                listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([listed, pa.array([data], pa.binary())], names=["ids", "data"])

    packed = rows.select(key, vector).where(F.col(vector).isNotNull() & F.col(key).isNotNull()).mapInArrow(run, f"ids array<{kind}>, data binary")
    return packed.withColumn("block", F.xxhash64(F.col("ids")[0], F.size("ids")))


def search(items: DataFrame, queries: DataFrame, k: int, key: str, query_key: str = "query_id", vector: str = "embedding", max_queries: int = 8 * BLOCK_ROWS) -> DataFrame:
    """(query, item, distance, rank) of the k nearest items of each query, ties by item.

    Queries and items are packed to blocks of vectors, and blocks are dealt to the cells of a grid: a query
    block goes to its row, an item block to its column, so each pair of blocks meets in one cell, by an
    equi-join of cells.  A row of the grid holds about max_queries queries, so items are copied once a row
    and queries once a column, and neither is read by the driver.  A task scores pairs of blocks as they come
    and keeps the best k a query of its cells; these are merged by query.  The plan is the same at every size."""
    kinds = {c: d.schema[c].dataType.simpleString() for c, d in ((key, items), (query_key, queries))}
    asked = _blocks(queries, query_key, "embedding" if "embedding" in queries.columns else vector)
    rows = max(1, -(-(asked.agg(F.sum(F.size("ids"))).first()[0] or 0) // max_queries))
    columns = max(1, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")) // rows)
    left = asked.select(F.pmod("block", F.lit(rows)).alias("r"), F.col("ids").alias("q"), F.col("data").alias("qv")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    right = _blocks(items, key, vector).select(F.pmod("block", F.lit(columns)).alias("c"), F.col("ids").alias("i"), F.col("data").alias("iv")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    cell = (F.col("r") * columns + F.col("c")).cast("bigint").alias("cell")
    met = left.select(cell, "q", "qv").join(right.select(cell, "i", "iv"), "cell").select("q", "qv", "i", "iv")
    best = met.mapInArrow(_scorer(k), f"q {kinds[query_key]}, i {kinds[key]}, distance double")
    rank = Window.partitionBy("q").orderBy("distance", "i")
    return best.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select(F.col("q").alias(query_key), F.col("i").alias(key), "distance", "rank")


def _scorer(k: int):
    import heapq

    import numpy as np
    import pyarrow as pa

    def run(batches):
        best: dict = {}
        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(c).type.value_type for c in ("q", "i")]
            for n in range(batch.num_rows):
                q, i = batch.column(0)[n].as_py(), batch.column(2)[n].as_py()
                a = np.frombuffer(batch.column(1)[n].as_py()).reshape(len(q), -1)
                b = np.frombuffer(batch.column(3)[n].as_py()).reshape(len(i), -1)
                for at in range(0, len(q), 256):
                    d = 1.0 - a[at : at + 256] @ b.T
                    part = np.partition(d, min(k, len(i)) - 1, axis=1)[:, min(k, len(i)) - 1]
                    for j, edge in enumerate(part):
                        own = [(d[j, x], i[x]) for x in np.flatnonzero(d[j] <= edge)]
                        best[q[at + j]] = heapq.nsmallest(k, best.get(q[at + j], []) + own)
        flat = [(q, i, v) for q, some in best.items() for v, i in some]
        for at in range(0, len(flat), 1 << 16):
            q, i, v = zip(*flat[at : at + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array(q, kinds[0]), pa.array(i, kinds[1]), pa.array(v, pa.float64())], names=["q", "i", "distance"])

    return run


def postings(docs: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, term, n, words, df): how often documents hold the terms (one column), their lengths, and in how
    many documents each term stands.  Only postings of the terms are shuffled."""
    split = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    words = docs.select(key, split.alias("w")).select(key, F.size("w").alias("words"), F.explode("w").alias("term"))
    held = words.join(terms.toDF("term").distinct(), "term").groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"), F.first("words").alias("words"))
    return held.join(held.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term")


def bm25(candidates: DataFrame, docs: DataFrame, queries: DataFrame, key: str, text: str, query_key: str = "query_id", query_text: str = "query_text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, key, score) of candidate pairs: Okapi BM25 with statistics of all documents.  Pairs without a
    common term are left out; a term counts once in a query, null texts have no words."""
    split = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    asked = queries.select(query_key, F.explode(F.array_distinct(split(F.col(query_text)))).alias("term"))
    size = docs.agg(F.count(F.lit(1)).alias("docs"), F.avg(F.coalesce(F.size(split(F.col(text))), F.lit(0))).alias("mean"))  # one row
    found = candidates.select(query_key, key).join(postings(docs, key, text, asked.select("term")), key).join(asked, [query_key, "term"])
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("n") * (k1 + 1) / (F.col("n") + k1 * (1 - b + b * F.col("words") / F.col("mean")))
    return found.join(F.broadcast(size)).groupBy(query_key, key).agg(F.round(F.sum(weight), 9).alias("score"))


def two_stage_search(docs: DataFrame, queries: DataFrame, k: int, key: str, text: str, vector: str = "embedding", query_key: str = "query_id", query_text: str = "query_text", reranker: bool = True) -> DataFrame:
    """(query, id, key, preview, similarity, percentage, reranker_score, count, candidate_count) of each query
    (query_key, query_text, embedding): the nearest candidates, five times k of them and 240 at most, ordered
    anew by BM25, then by distance; k are kept.  Without a reranker they stay in order of distance."""
    n = candidate_size(k, docs.count())
    near = search(docs, queries, n, key, query_key, vector)
    if reranker:
        near = near.join(bm25(near, docs, queries, key, text, query_key, query_text), [query_key, key], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    else:
        near = near.withColumn("score", F.lit(None).cast("double"))
    own = Window.partitionBy(query_key)  # n rows at most
    placed = near.withColumns({"id": F.row_number().over(own.orderBy(F.col("score").desc_nulls_last(), "rank")), "candidate_count": F.count(F.lit(1)).over(own)}).where(F.col("id") <= k)
    shown = placed.join(docs.select(key, F.when(F.length(text) > 300, F.concat(F.substring(text, 1, 300), F.lit("..."))).otherwise(F.col(text)).alias("preview")), key)
    return shown.select(query_key, "id", key, "preview", similarity(F.col("distance")).alias("similarity"), percentage(F.col("distance")).alias("percentage"), F.col("score").alias("reranker_score"), F.least("candidate_count", F.lit(k)).alias("count"), "candidate_count")


def assign_themes(items: DataFrame, themes: Sequence[Sequence[float]], vector: str = "embedding") -> DataFrame:
    """Adds theme_idx and distance of the nearest theme; the earlier theme wins ties.  No shuffle: the
    few theme vectors are literals of the plan."""
    options = F.array(*(F.struct(distance(F.col(vector), literal(t)).alias("d"), F.lit(i).alias("i")) for i, t in enumerate(themes)))
    return items.withColumn("__best", F.array_min(options)).withColumns({"theme_idx": F.col("__best.i"), "distance": F.col("__best.d")}).drop("__best")


def theme_counts(assigned: DataFrame, n_themes: int) -> DataFrame:
    """(theme_idx, n) of all themes, zero-filled."""
    found = assigned.groupBy("theme_idx").agg(F.count(F.lit(1)).alias("n"))
    every = assigned.sparkSession.range(n_themes).select(F.col("id").cast("int").alias("theme_idx"))
    return every.join(F.broadcast(found), "theme_idx", "left").select("theme_idx", F.coalesce("n", F.lit(0)).alias("n"))  # one row a theme


def largest_remainder(counts: DataFrame, order: str = "theme_idx", n: str = "n") -> DataFrame:
    """Adds percentage: whole percents that sum to 100, or all 0, of a table of a few rows."""
    everything = Window.partitionBy(F.lit(1))
    total = F.sum(n).over(everything)
    rows = counts.withColumns({"__t": total, "__f": F.floor(100 * F.col(n) / F.greatest(total, F.lit(1))), "__m": (100 * F.col(n)) % F.greatest(total, F.lit(1))})
    rows = rows.withColumns({"__rest": 100 - F.sum("__f").over(everything), "__r": F.row_number().over(everything.orderBy(F.desc("__m"), F.desc(n), order))})
    share = F.when(F.col("__t") == 0, 0).otherwise(F.col("__f") + (F.col("__r") <= F.col("__rest")).cast("int"))
    return rows.withColumn("percentage", share.cast("bigint")).drop("__t", "__f", "__m", "__rest", "__r")


def similarity(d: Column) -> Column:
    return F.bround(F.greatest(F.lit(0.0), 1 - d), 3)


def percentage(d: Column) -> Column:
    return F.bround(100 * F.greatest(F.lit(0.0), 1 - d), 1)


def rerank(candidates: DataFrame, scores: DataFrame, on: list[str], n: int, query_key: str | None = None) -> DataFrame:
    """The best n candidates by an outside score, then by rank."""
    joined = candidates.join(scores, on, "left")
    order = [F.col("score").desc_nulls_last(), "rank"]
    if query_key is None:
        return joined.orderBy(*order).limit(n)
    return joined.withColumn("position", F.row_number().over(Window.partitionBy(query_key).orderBy(*order))).where(F.col("position") <= n)


def token_overlap(query: str, text: Column) -> Column:
    """A built-in second-stage score: share of the query's words that the text holds."""
    words = F.array(*(F.lit(w) for w in sorted(set(query.lower().split()))))
    return F.size(F.array_intersect(words, F.split(F.lower(text), r"\W+"))) / F.size(words)


def theme_query_text(theme: Column, definition: Column) -> Column:
    return F.concat_ws(". ", theme, definition)


def theme_documents(assigned: DataFrame, theme: int, n_themes: int, key: str) -> DataFrame:
    """(rank, key, ..., distance, similarity, percentage, frequency, share, total) of the documents of a theme, the nearest first:
    frequency and share (whole percents that sum to 100 over themes) are the theme's, total is that of all themes.

    Ranks are dense row numbers by ranges, so a theme of any size is sorted by many tasks."""
    from loomveil.operators.masking import number_rows

    counts = largest_remainder(theme_counts(assigned, n_themes))
    own = counts.select("theme_idx", F.col("n").alias("frequency"), F.col("percentage").alias("share"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("total")).where(F.col("theme_idx") == theme)
    ranked = number_rows(assigned.where(F.col("theme_idx") == theme), ["distance", key], "rank").withColumn("rank", F.col("rank") + 1)
    return ranked.join(F.broadcast(own), "theme_idx").withColumns({"similarity": similarity(F.col("distance")), "percentage": percentage(F.col("distance"))})  # one row
