"""Removal of passages that repeat across documents.

Two kinds of paragraphs are looked for in words (ASCII lower case):

* Lines that are near-duplicates.  A paragraph is a line of ``min_words`` words at least, or
  consecutive shorter lines, without a blank line between, that have as many together.  MinHash signatures of
  their five-word shingles are cut into bands, paragraphs that collide in a band are candidates, each
  pair is verified by its exact Jaccard similarity, and the components of the verified links are the
  clusters.  Bands and rows are tuned for recall at the threshold (``tune_bands``).
* Windows of ``min_run`` words, wherever they start and end, across lines and sentences.  Their MinHash
  signature is one hash, the least of their ``anchor``-word n-grams, in one band: equal windows always
  collide.  Only windows whose hash occurs in several documents are shuffled, by all their words, which
  verifies them (edit distance 0); those of one source that overlap make the exact span.  Words that no
  single earlier document holds in such a window stay.

Of each cluster, or window, the document with the smallest id keeps its text; all others lose it.
Clusters come first: a paragraph that goes as a near copy may have words of its own, so a window that
touches it is no source, and documents that quote such words keep them.
Repeats inside one document stay.

Equal paragraphs are collapsed before the bands meet, buckets are handled by ``linking.link``, and
parities of their sets drop most false candidates before whole sets are built.  Only documents that lose text are shuffled with their text.

Defined cases: null, empty and blank texts have no spans and stay as they are; rows with a null id
neither lose text nor cause a loss; of rows with one id, each is cut where its own words are the ones
that were found (verbatim passages: where its whole text is the one); equal rows under different ids are copies, so the later ones lose their long lines; an
empty table gives no rows; other columns are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomveil.llm import textops
from loomveil.llm.linking import FILTER_IDS, IdFilter, link
from loomveil.llm.ngram_join import SIGS, exact_check, needed, parity_close
from loomveil.llm.shared import discard, free, stash, tidy


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    percent: int = 80
    recall: float = 0.998
    min_words: int = 30
    min_run: int = 45
    anchor: int = 12
    #: runs whose anchor stands in more places than this are joined by salted keys
    hot: int = 10_000


_SALTS = 32


def tune_bands(threshold: float, recall: float, most: int = 48) -> tuple[int, int]:
    """(bands, rows) with the most rows a band, so fewest false candidates, among those that find a
    pair at the threshold with the recall asked for in at most ``most`` hashes."""
    for rows in range(8, 0, -1):
        for bands in range(1, most // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                return bands, rows
    return most, 1


@dataclass
class Spans:
    """Word spans of a block of documents."""

    doc: np.ndarray
    first: np.ndarray
    end: np.ndarray

    def __len__(self) -> int:
        return len(self.doc)


def _cut(w: textops.Words, breaks: np.ndarray, least: int) -> Spans:
    """Spans between breaks (a break after word i), of at least so many words."""
    if not len(w.starts):
        none = np.zeros(0, dtype=np.int64)
        return Spans(none, none, none)
    end = np.flatnonzero(breaks) + 1
    first = np.append(0, end[:-1])
    keep = end - first >= least
    return Spans(w.doc_of()[first[keep]], first[keep], end[keep])


def _breaks(w: textops.Words) -> np.ndarray:
    """Whether a line or a document ends after each word."""
    at = np.searchsorted(np.flatnonzero(w.data == 10), w.starts)
    out = np.ones(len(at), dtype=bool)
    out[:-1] = at[1:] != at[:-1]
    last = w.ptr[1:] - 1
    out[last[np.diff(w.ptr) > 0]] = True
    return out


def paragraphs(w: textops.Words, least: int) -> Spans:
    breaks = _breaks(w)
    end = np.flatnonzero(breaks) + 1
    if len(end) > 1:
        n, line = np.diff(end, prepend=0), np.searchsorted(np.flatnonzero(w.data == 10), w.starts[end - 1])
        doc = w.doc_of()[end - 1]
        joins = (n[:-1] < least) & (n[1:] < least) & (np.diff(line) == 1) & (doc[1:] == doc[:-1])
        breaks[end[:-1][joins] - 1] = False
    return _cut(w, breaks, least)


def _blocks(column):
    yield from textops.word_blocks(column, textops.SPACE_WORDS, lower=True)


def span_table(docs: DataFrame, s: Settings) -> DataFrame:
    """(id, at, n, hash) of the paragraphs of rows (id, text)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, w in _blocks(batch.column(1)):
                spans = paragraphs(w, s.min_words)
                key = textops.span_hashes(w.hashes(), spans.first, spans.end).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(spans.doc + at)), pa.array((spans.first - w.ptr[spans.doc]).astype(np.int32)), pa.array((spans.end - spans.first).astype(np.int32)), pa.array(key)], names=["id", "at", "n", "hash"])

    return docs.where("id is not null").mapInArrow(run, "id bigint, at int, n int, hash bigint")


def _shingles(h: np.ndarray, spans: Spans, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each span and their bounds."""
    gram = textops.grams(h, k)
    parts = [np.unique(gram[a : max(a + 1, b - k + 1)], sorted=True) for a, b in zip(spans.first.tolist(), spans.end.tolist())]
    bounds = np.cumsum([0, *(len(p) for p in parts)])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), bounds


def signature_table(docs: DataFrame, s: Settings) -> DataFrame:
    """(item, n_shingles, sig1 to sig4, buckets) of each distinct paragraph: a bitmap of parities of its
    shingles, and the bucket of each of its bands."""
    bands, rows = tune_bands(s.percent / 100, s.recall)
    odd = textops.mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, w in _blocks(batch.column(1)):
                spans = paragraphs(w, s.min_words)
                if not len(spans):
                    continue
                h = w.hashes()
                item, at = np.unique(textops.span_hashes(h, spans.first, spans.end).view(np.int64), return_index=True)
                values, bounds = _shingles(h, Spans(spans.doc[at], spans.first[at], spans.end[at]), s.shingle)
                sig = textops.parities(values, bounds)
                # shingles are mixed already, so an odd factor is a hash of its own
                least = np.stack([np.minimum.reduceat(values * k, bounds[:-1]) for k in odd], axis=1)
                buckets = np.empty((len(item), bands), dtype=np.uint64)
                for b in range(bands):
                    bucket = np.full(len(item), b + 1, dtype=np.uint64)
                    for r in range(rows):
                        bucket = textops.mix(bucket ^ least[:, b * rows + r]) + np.uint64(r)
                    buckets[:, b] = bucket
                listed = textops.list_array(buckets.ravel().view(np.int64), np.arange(len(item) + 1) * bands)
                yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(np.diff(bounds)), *(pa.array(np.ascontiguousarray(sig[:, j])) for j in range(4)), listed], names=["item", "n_shingles", *SIGS, "buckets"])

    found = docs.where("id is not null").mapInArrow(run, "item bigint, n_shingles bigint, " + ", ".join(f"{x} bigint" for x in SIGS) + ", buckets array<bigint>")
    return found.dropDuplicates(["item"])


def _pair_key(item: np.ndarray, owner: np.ndarray) -> np.ndarray:
    return textops.mix(item.view(np.uint64) ^ textops.mix(owner.astype(np.int64).view(np.uint64))).view(np.int64)


def paragraph_sets(docs: DataFrame, items: DataFrame, firsts: DataFrame, s: Settings) -> DataFrame:
    """(item, shingles) of paragraphs, each built from the first document that holds it, and of a few others."""
    docs, some = docs.where("id is not null"), stash(firsts.join(items, "item", "left_semi").select("item", "lo"), "wanted")
    fits = some.count() <= FILTER_IDS
    wanted = docs.sparkSession.sparkContext.broadcast(IdFilter.of(some, _pair_key)) if fits else None
    holding = docs.sparkSession.sparkContext.broadcast(IdFilter.of(some.select("lo").distinct())) if fits else None
    if not fits:
        docs = docs.join(some.select(F.col("lo").alias("id")), "id", "left_semi")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if holding:  # other documents need not be cut into words
                batch = batch.filter(pa.array(holding.value(batch.column(0).to_numpy(zero_copy_only=False))))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, _, w in _blocks(batch.column(1)):
                spans = paragraphs(w, s.min_words)
                h = w.hashes()
                item = textops.span_hashes(h, spans.first, spans.end).view(np.int64)
                own = np.flatnonzero(wanted.value(_pair_key(item, ids[at + spans.doc]))) if wanted else np.arange(len(item))
                spans, item = Spans(spans.doc[own], spans.first[own], spans.end[own]), item[own]
                values, bounds = _shingles(h, spans, s.shingle)
                yield pa.RecordBatch.from_arrays([pa.array(item), textops.list_array(values.view(np.int64), bounds)], names=["item", "shingles"])

    return docs.mapInArrow(run, "item bigint, shingles array<bigint>")


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of so many values from each position on; the last width - 1 mean nothing."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[: len(out) - step] = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before in any column; the first does."""
    out = np.ones(len(columns[0]), dtype=bool)
    out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return out


def _runs(w: textops.Words, h: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of min_run words start, and the least anchor of each."""
    at = textops.gram_positions(w.ptr, s.min_run)
    return at, _least(textops.grams(h, s.anchor), s.min_run - s.anchor + 1)[at] if len(at) else np.zeros(0, dtype=np.uint64)


def anchor_table(docs: DataFrame, s: Settings) -> DataFrame:
    """(hash, id) of the least anchors of the runs of rows (id, text), once for neighbouring runs."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, w in _blocks(batch.column(1)):
                at, key = _runs(w, w.hashes(), s)
                if len(at):
                    doc = w.doc_of()[at]
                    new = _changes(key, doc)
                    yield pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), batch.column(0).take(pa.array(doc[new] + first))], names=["hash", "id"])

    return docs.select("id", "text").mapInArrow(run, "hash bigint, id bigint")


def _rows_of(docs: DataFrame, id_at: int, wanted, passing: bool) -> DataFrame:
    """The rows whose id passes the filter, or all others."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(id_at).cast(pa.int64())
            may = wanted.value(ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(may if passing else ~may))

    return docs.mapInArrow(run, docs.schema)


_GONE = "array<struct<at: int, n: int, hash: bigint>>"


def _with_gone(docs: DataFrame, gone: DataFrame | None) -> DataFrame:
    """Rows (id, text) with the list that gone (id, gone) has for them; texts without one are not shuffled,
    unless ids are too many for a filter."""
    none = F.lit(None).cast(_GONE).alias("gone")
    n = gone.count() if gone is not None else 0
    if not n:
        return docs.select("id", "text", none)
    if n > FILTER_IDS:
        return docs.join(gone, "id", "left").select("id", "text", "gone")
    wanted = docs.sparkSession.sparkContext.broadcast(IdFilter.of(gone.select("id")))
    hit = _rows_of(docs, 0, wanted, True).join(gone, "id", "left").select("id", "text", "gone")
    return hit.unionByName(_rows_of(docs, 0, wanted, False).select("id", "text", none))


def _sound(w: textops.Words, h: np.ndarray, at: np.ndarray, gone: pa.Array, s: Settings) -> np.ndarray:
    """Whether runs keep clear of the spans of gone that are found in their texts."""
    own, n = gone.flatten(), pc.fill_null(pc.list_value_length(gone), 0).to_numpy()
    start = np.repeat(w.ptr[:-1], n) + own.field(0).to_numpy(zero_copy_only=False)
    end = start + own.field(1).to_numpy(zero_copy_only=False)
    fits = end <= np.repeat(w.ptr[1:], n)
    start, end = start[fits], end[fits]
    same = textops.span_hashes(h, start, end).view(np.int64) == own.field(2).to_numpy(zero_copy_only=False)[fits]
    edge = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(edge, start[same], 1)
    np.add.at(edge, end[same], -1)
    lost = np.append(0, np.cumsum(np.cumsum(edge[:-1]) > 0))
    return lost[at + s.min_run] == lost[at]


def _places(batch: pa.RecordBatch, s: Settings, passes) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash, document, place, sound) of the runs of a batch (id, text, gone) whose least anchor passes,
    with (id, print) of its documents."""
    ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
    for first, _, w in _blocks(batch.column(1)):
        h = w.hashes()
        at, key = _runs(w, h, s)
        at = at[passes(key.view(np.int64))]
        if len(at):
            docs = np.arange(len(w.ptr) - 1)
            prints = textops.span_hashes(h, w.ptr[:-1], w.ptr[1:]).view(np.int64)
            doc = w.doc_of()[at]
            sound = _sound(w, h, at, lists.slice(first, len(docs)), s)
            yield textops.span_hashes(h, at, at + s.min_run), doc, (at - w.ptr[doc]).astype(np.int32), sound, ids[first + docs], prints


_DEALT = "bucket int, hashes array<bigint>, at array<int>, sound array<tinyint>, n array<int>, ids array<bigint>, prints array<bigint>"
_LOST = "bucket int, at array<int>, n array<int>, ids array<bigint>, prints array<bigint>, sources array<bigint>"


def _bounds(bucket: np.ndarray, *owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of places in order of bucket and owner: first place of each bucket, of each owner, and the bounds
    of the lists of places and of owners."""
    rows, heads = np.flatnonzero(_changes(bucket)), np.flatnonzero(_changes(bucket, *owner))
    return rows, heads, np.append(rows, len(bucket)), np.append(np.searchsorted(heads, rows), len(heads))


def _dealt(docs: DataFrame, s: Settings, parts: int, wanted, hot) -> DataFrame:
    """Runs of min_run words whose least anchor is in wanted and not in hot, packed by bucket and dealt out:
    of each row, hashes and places, and how many of them are of which document."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = (lambda key: wanted.value(key) & ~hot.value(key)) if hot else wanted.value
        for batch in batches:
            for key, doc, at, sound, ids, prints in _places(batch, s, passes):
                bucket = (textops.mix(key) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                key, doc, at, sound, bucket = (x[order] for x in (key, doc, at, sound, bucket))
                rows, heads, bounds, groups = _bounds(bucket, doc)
                owner = doc[heads]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[rows].astype(np.int32)), textops.list_array(key.view(np.int64), bounds), textops.list_array(at, bounds), textops.list_array(sound.astype(np.int8), bounds), textops.list_array(np.diff(np.append(heads, len(at))).astype(np.int32), groups), textops.list_array(ids[owner], groups), textops.list_array(prints[owner], groups)],
                    names=["bucket", "hashes", "at", "sound", "n", "ids", "prints"],
                )

    # a task gets one bucket: dealt by hash, some would get several, and hold and sort them all
    return docs.mapInArrow(run, _DEALT).repartitionById(parts, "bucket")


def _packed(ids: np.ndarray, prints: np.ndarray, source: np.ndarray, at: np.ndarray, parts: int) -> pa.RecordBatch:
    """Lost places as rows of _LOST: one for each bucket of documents, whatever the number of places."""
    bucket = (textops.mix(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((at, source, prints, ids, bucket))
    bucket, ids, prints, source, at = (x[order] for x in (bucket, ids, prints, source, at))
    rows, heads, bounds, groups = _bounds(bucket, ids, prints, source)
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[rows].astype(np.int32)), textops.list_array(at.astype(np.int32), bounds), textops.list_array(np.diff(np.append(heads, len(at))).astype(np.int32), groups), *(textops.list_array(x[heads], groups) for x in (ids, prints, source))],
        names=["bucket", "at", "n", "ids", "prints", "sources"],
    )


def _hot_losses(docs: DataFrame, s: Settings, parts: int, hot) -> DataFrame:
    """Lost places of the runs whose least anchor is in hot: sources come from a partial aggregation, and
    places meet them in a salted join, so that a run that all documents hold is no task's burden."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, doc, at, sound, ids, prints in _places(batch, s, hot.value):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[doc]), pa.array(prints[doc]), pa.array(at), pa.array(sound)], names=["hash", "id", "print", "at", "sound"])

    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _packed(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "print", "source", "at")), parts)

    places = stash(docs.mapInArrow(run, "hash bigint, id bigint, print bigint, at int, sound boolean"), "hot_places")
    sources = places.groupBy("hash").agg(F.min(F.when(F.col("sound"), F.col("id"))).alias("source"), F.max("id").alias("hi")).where("hi > source")
    salted = sources.select("hash", "source", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    lost = places.withColumn("salt", F.pmod(F.xxhash64("id", "at"), F.lit(_SALTS)).cast("int")).join(salted, ["hash", "salt"]).where("id > source")
    return lost.select("id", "print", "source", "at").mapInArrow(pack, _LOST)


def verbatim_spans(docs: DataFrame, s: Settings, gone: DataFrame | None = None) -> DataFrame:
    """(id, at, n, hash, kind, source) of the spans of rows (id, text) that consist of runs of min_run words
    that an earlier document holds and keeps; hash is that of the whole text.  gone (id, gone) lists spans that
    documents lose and that stand nowhere else word for word: a run that touches one is nobody's source."""

    @tidy
    def losing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], [], [], []]
        for batch in batches:
            key, at, sound, n, ids, prints = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("hashes", "at", "sound", "n", "ids", "prints"))
            for part, values in zip(held, (key, np.repeat(ids, n), at, np.repeat(prints, n), sound == 0)):
                part.append(values.copy())
        if not held[0]:
            return
        key, ids, at, prints, unsound = (np.concatenate(part) for part in held)
        held.clear()
        order = np.lexsort((ids, unsound, key))
        # one column at a time, so that two copies of all are never held
        key = key[order]
        ids = ids[order]
        unsound = unsound[order]
        new = _changes(key)
        least = np.where(unsound[new], np.iinfo(np.int64).max, ids[new])
        source = least[np.cumsum(new) - 1]
        lost = np.flatnonzero(ids > source)
        if len(lost):
            ids, source, order = ids[lost], source[lost], order[lost]
            del key, unsound, new, least
            yield _packed(ids, prints[order], source, at[order], parts)

    @tidy
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], [], []]
        for batch in batches:
            at, n, *of = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("at", "n", "ids", "prints", "sources"))
            for part, values in zip(held, (at, *(np.repeat(x, n) for x in of))):
                part.append(values.copy())
        if not held[0]:
            return
        at, ids, prints, source = (np.concatenate(part) for part in held)
        order = np.lexsort((at, source, prints, ids))
        at, ids, prints, source = (x[order] for x in (at, ids, prints, source))
        # runs of one source that overlap or touch are one span
        first = _changes(ids, prints, source)
        first[1:] |= np.diff(at) > s.min_run
        lo = np.flatnonzero(first)
        hi = np.append(lo[1:], len(at)) - 1
        yield pa.RecordBatch.from_arrays([pa.array(ids[lo]), pa.array(at[lo].astype(np.int32)), pa.array((at[hi] - at[lo] + s.min_run).astype(np.int32)), pa.array(prints[lo]), pa.array(source[lo])], names=["id", "at", "n", "hash", "source"])

    spark, docs = docs.sparkSession, docs.where("id is not null").select("id", "text")
    found = anchor_table(docs, s).groupBy("hash").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    anchors = stash(found.select("hash", "n"), "anchors")
    often = anchors.where(F.col("n") > s.hot).select("hash")
    hot = spark.sparkContext.broadcast(IdFilter.of(often)) if often.take(1) else None
    wanted = spark.sparkContext.broadcast(IdFilter.of(anchors.select("hash")))
    # so many runs have an anchor in common at most; a task sorts one million of them
    runs = (anchors.agg(F.sum(F.least("n", F.lit(s.hot)))).first()[0] or 0) * (s.min_run - s.anchor + 1)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), runs // 1_000_000)
    discard(anchors)
    docs = _with_gone(docs, gone)
    lost = _dealt(docs, s, parts, wanted, hot).mapInArrow(losing, _LOST)
    if hot:
        lost = lost.unionByName(_hot_losses(docs, s, parts, hot))
    return lost.repartitionById(parts, "bucket").mapInArrow(merged, "id bigint, at int, n int, hash bigint, source bigint").withColumn("kind", F.lit("w"))


def duplicate_spans(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(id, at, n, hash, kind, source) of the spans of rows (id, text) whose text an earlier document
    (source) holds: paragraphs in a cluster, and verbatim passages."""
    lines = stash(span_table(docs, s), "paragraphs")
    firsts = stash(lines.groupBy(F.col("hash").alias("item")).agg(F.min("id").alias("lo"), F.max("id").alias("hi")), "firsts")
    signed = stash(signature_table(docs, s), "signatures")
    bands = signed.select("item", F.col("n_shingles").cast("int").alias("n_shingles"), F.posexplode("buckets").alias("at", "bucket"))
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    members = stash(bands.join(shared, "bucket").select("bucket", "item", "at", "n_shingles"), "members")

    def may_link(x: str, y: str):
        """Length filter."""
        return F.least(f"{x}.n_shingles", f"{y}.n_shingles") >= needed(x, y, s.percent)

    check = exact_check(lambda items: paragraph_sets(docs, items, firsts, s), s.percent)
    found = link(members, signed, check, may_link, parity_close(s.percent)).toDF("item", "component")
    discard(members, signed)
    clustered = firsts.join(found, "item")
    kept = clustered.groupBy("component").agg(F.min("lo").alias("keep"))
    near = clustered.join(kept, "component").select("item", "hi", F.col("keep").alias("source"), (F.col("lo") != F.col("keep")).alias("differs"))
    alone = firsts.where("lo <> hi").join(found, "item", "left_anti").select("item", "hi", F.col("lo").alias("source"), F.lit(False).alias("differs"))
    losing = near.unionByName(alone).where("hi > source").select(F.col("item").alias("hash"), "source", "differs")
    whole = stash(lines.join(losing, "hash").where("id > source").withColumn("kind", F.lit("p")), "whole")
    gone = whole.where("differs").groupBy("id").agg(F.collect_list(F.struct("at", "n", "hash")).alias("gone"))
    order = ["id", "at", "n", "hash", "kind", "source"]
    return whole.select(order).unionByName(verbatim_spans(docs, s, gone).select(order))


def cut_spans(text: str, found: list[dict]) -> tuple[str, int, int, list[int]]:
    """(text without the spans that count, removed words, removed spans, ids that keep them)."""
    for _, _, w in _blocks(pa.array([text], pa.large_string())):
        h, gone = w.hashes(), np.zeros(len(w.starts) + 1, dtype=bool)
        first, n = np.array([f["at"] for f in found], dtype=np.int64), np.array([f["n"] for f in found], dtype=np.int64)
        fits = first + n <= len(h)
        own = np.zeros(len(found), dtype=bool)
        own[fits] = textops.span_hashes(h, first[fits], (first + n)[fits]).view(np.int64) == np.array([f["hash"] for f in found], dtype=np.int64)[fits]
        own_text = int(textops.span_hashes(h, np.array([0]), np.array([len(h)])).view(np.int64)[0])
        own |= np.array([f["kind"] == "w" and f["hash"] == own_text for f in found])
        source = set()
        for f in (f for f, ok in zip(found, own) if ok):
            gone[f["at"] : f["at"] + f["n"]] = True
            source.add(f["source"])
        edge = np.diff(np.concatenate([[0], gone.astype(np.int8)]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        data, out, at = text.encode(), [], 0
        for a, b in zip(starts.tolist(), ends.tolist()):
            lo, hi = int(w.starts[a]), int(w.ends[b - 1])
            out.append(data[at:lo])
            line_start = not out[-1].strip(b" \t\r\x0b\x0c") or out[-1].rstrip(b" \t\r\x0b\x0c").endswith(b"\n")
            if line_start and data[hi : hi + 1] == b"\n":
                hi += 1
            at = hi
        out.append(data[at:])
        return b"".join(out).decode(), int(gone[:-1].sum()), len(starts), sorted(source)
    return text, 0, 0, []


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings(), report: bool = False, chars_col: str | None = None) -> DataFrame:
    """docs with repeated passages cut out of their texts, all other columns as they were, but that
    chars_col becomes the length of texts that were cut; with report also n_removed_words,
    n_removed_spans and source_ids, each with ``_`` added while docs has a column of that name."""
    own = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"))
    spans = duplicate_spans(own, s)
    found = stash(spans.groupBy("id").agg(F.collect_list(F.struct("at", "n", "hash", "kind", "source")).alias("spans")), "spans")
    fits = found.count() <= FILTER_IDS
    wanted = docs.sparkSession.sparkContext.broadcast(IdFilter.of(found.select("id"))) if fits else None
    taken = [c.lower() for c in docs.columns]
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    chars_at = docs.columns.index(chars_col) if chars_col else None
    names = [free(n, taken) for n in ("n_removed_words", "n_removed_spans", "source_ids")]
    extra = [T.StructField(n, k) for n, k in zip(names, (T.LongType(), T.LongType(), T.ArrayType(T.LongType())))]
    schema = T.StructType([*docs.schema.fields, *extra])
    listed = free("spans", taken)

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, more = [], []
            chars = batch.column(chars_at).to_pylist() if chars_col else []
            for k, (text, found) in enumerate(zip(batch.column(text_at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())):
                text, *rest = cut_spans(text, found) if text and found else (text, 0, 0, [])
                texts.append(text)
                more.append(rest)
                if chars_col and rest[0]:
                    chars[k] = len(text)
            columns = [*batch.columns[:-1], *(pa.array([m[j] for m in more], k) for j, k in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64()))))]
            columns[text_at] = pa.array(texts, pa.string())
            if chars_col:
                columns[chars_at] = pa.array(chars, columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    hit = _rows_of(docs, id_at, wanted, True) if fits else docs
    named = found.toDF("__id", listed)
    joined = hit.join(named, hit[id_col].cast("bigint") == named["__id"], "left").select(*(hit[c] for c in docs.columns), named[listed])
    out = joined.mapInArrow(cut, schema)
    if fits:
        none = [F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.array().cast("array<bigint>")]
        out = out.unionByName(_rows_of(docs, id_at, wanted, False).withColumns(dict(zip(names, none))))
    return out if report else out.select(docs.columns)
