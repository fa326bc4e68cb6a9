"""Benchmark decontamination with suffix arrays over shards of the training text.

A shard is a block of documents (``SHARD_BYTES`` of text).  Its suffix array holds the word suffixes
that begin with the first words of some test suffix (no other suffix can match), in order of their
leading window and then word by word.  Every test suffix is binary-searched in it: the range of its
leading window gives all occurrences of that window, and narrowing the range word by word gives its
longest verbatim match and the places of it.  Shards are independent, so documents are read once and
never shuffled.

A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one
window.  A document word is hit if it lies in any occurrence of a window.

The test set is shipped to the tasks in blocks of at most ``BLOCK_CHARS`` characters, of which a task
holds one at a time per pass; a larger test set takes more passes over the same rows, each adding its
hits to those of the pass before.

Defined cases: a null, empty or wordless text has no words and no hits; a null, empty or wordless item
occurs nowhere; a null item_id is dropped; equal items all count; equal rows are judged one by one; an
empty test set leaves every document clean; other columns are passed on or not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomveil.llm import textops
from loomveil.llm.shared import free, tidy

WINDOW = 10
BLOCK_CHARS = 32_000_000
SHARD_BYTES = 2_000_000


@dataclass
class TestSet:
    """The words of a block of items."""

    ids: np.ndarray  #: item id of each item, as strings
    words: np.ndarray
    ptr: np.ndarray

    @staticmethod
    def of(rows: list[tuple[str, str | None]]) -> TestSet:
        ids, words, counts = np.array([r[0] for r in rows], dtype=object), [np.zeros(0, np.uint64)], [0]
        for _, _, w in textops.word_blocks(pa.array([r[1] for r in rows], pa.large_string()), textops.ALNUM_WORDS, lower=True):
            words.append(w.hashes())
            counts.extend(w.counts.tolist())
        return TestSet(ids, np.concatenate(words), np.cumsum(counts))

    def suffixes(self, window: int) -> dict[int, np.ndarray]:
        """Positions of test suffixes by the length of their leading window."""
        n, out = np.diff(self.ptr), {}
        for m in np.unique(np.minimum(n[n > 0], window)).tolist():
            of = np.zeros(len(n), dtype=bool)
            of[n == m if m < window else n >= window] = True
            fit = textops.gram_positions(self.ptr, m)
            out[m] = fit[np.repeat(of, n)[fit]]
        return out


@dataclass
class Matches:
    """What one shard holds of the test suffixes of one window length."""

    at: np.ndarray  #: indices into TestSet.words of suffixes whose window occurs
    longest: np.ndarray  #: words of the longest match of each
    where: np.ndarray  #: a word position of it in the shard, the first one
    lo: np.ndarray  #: range of the leading window in the suffix array
    hi: np.ndarray
    order: np.ndarray  #: the suffix array


def search_shard(words: np.ndarray, ptr: np.ndarray, tests: TestSet, m: int, at: np.ndarray) -> Matches:
    """Builds the suffix array of a shard for leading windows of m words and searches test suffixes."""
    none = np.zeros(0, dtype=np.int64)
    lead = textops.grams(tests.words, m)[at]
    wanted = np.unique(lead)
    seen = np.zeros(1 << 20, dtype=bool)
    seen[(wanted >> np.uint64(44)).astype(np.int64)] = True
    key = textops.grams(words, m)
    some = textops.gram_positions(ptr, m)
    some = some[seen[(key[some] >> np.uint64(44)).astype(np.int64)]]
    if len(some):
        slot = np.minimum(np.searchsorted(wanted, key[some]), len(wanted) - 1)
        some = some[wanted[slot] == key[some]]
    if not len(some):
        return Matches(none, none, none, none, none, none)
    doc_end = np.repeat(ptr[1:], np.diff(ptr))
    padded = np.append(words, np.uint64(0))
    order = some[np.lexsort((some, key[some]))]
    # suffixes that tie on the window are put in order word by word, ends of documents first
    item_end = np.repeat(tests.ptr[1:], np.diff(tests.ptr))
    deepest = int((item_end[at] - at).max())
    group = np.append(0, np.cumsum(key[order][1:] != key[order][:-1]))
    for depth in range(m, deepest):
        size = np.bincount(group)
        slots = np.flatnonzero(size[group] > 1)
        if not len(slots):
            break
        x = order[slots] + depth
        inside = x < doc_end[order[slots]]
        if not inside.any():
            break
        follow = np.where(inside, padded[np.minimum(x, len(words))], np.uint64(0))
        by = np.lexsort((order[slots], follow, inside, group[slots]))
        order[slots] = order[slots][by]
        new = np.ones(len(order), dtype=bool)
        new[1:] = group[1:] != group[:-1]
        inner = (follow[by][1:] != follow[by][:-1]) | (inside[by][1:] != inside[by][:-1])
        new[slots[1:]] |= inner
        group = np.cumsum(new) - 1
    sorted_key = key[order]
    lo, hi = np.searchsorted(sorted_key, lead, side="left"), np.searchsorted(sorted_key, lead, side="right")
    found = hi > lo
    at, lo, hi = at[found], lo[found], hi[found]
    longest = np.full(len(at), m, dtype=np.int64)
    low, high, live, depth = lo.copy(), hi.copy(), np.arange(len(at)), m
    while len(live):
        live = live[at[live] + depth < item_end[at[live]]]
        if not len(live):
            break
        target = tests.words[at[live] + depth]
        a = _bound(order, padded, doc_end, low[live], high[live], depth, target, False)
        b = _bound(order, padded, doc_end, low[live], high[live], depth, target, True)
        ok = b > a
        live = live[ok]
        low[live], high[live] = a[ok], b[ok]
        depth += 1
        longest[live] = depth
    return Matches(at, longest, order[low] if len(at) else none, lo, hi, order)


def _bound(order, padded, doc_end, lo, hi, depth, target, upper):
    """First suffix of each range whose word at depth is not below (upper: is above) the target."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) >> 1
        x = order[mid] + depth
        inside = x < doc_end[order[mid]]
        word = padded[np.minimum(x, len(padded) - 1)]
        below = ~inside | ((word <= target[open_]) if upper else (word < target[open_]))
        lo[open_[below]] = mid[below] + 1
        hi[open_[~below]] = mid[~below]


def judge_column(column, tests: TestSet, window: int = WINDOW):
    """For each text: number of words, flags of hit words, numbers of the occurring items (arrays)."""
    by_length = tests.suffixes(window)
    item_of = np.repeat(np.arange(len(tests.ids)), np.diff(tests.ptr))
    for _, _, w in textops.word_blocks(column, textops.ALNUM_WORDS, lower=True, block_bytes=SHARD_BYTES):
        words = w.hashes()
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        docs = w.doc_of()
        pairs = [np.zeros(0, dtype=np.int64)]
        for m, at in by_length.items():
            found = search_shard(words, w.ptr, tests, m, at)
            inside = np.zeros(len(found.order) + 1, dtype=np.int64)
            np.add.at(inside, found.lo, 1)
            np.add.at(inside, found.hi, -1)
            matched = found.order[np.cumsum(inside[:-1]) > 0]  # suffixes in the range of a test window
            np.add.at(edge, matched, 1)
            np.add.at(edge, matched + m, -1)
            for item, lo, hi in zip(item_of[found.at].tolist(), found.lo.tolist(), found.hi.tolist()):
                pairs.append(np.unique(docs[found.order[lo:hi]]) * len(tests.ids) + item)
        hit = np.cumsum(edge[:-1]) > 0
        pair = np.unique(np.concatenate(pairs))
        owner, item = pair // max(1, len(tests.ids)), pair % max(1, len(tests.ids))
        cut = np.searchsorted(owner, np.arange(len(w.ptr)))
        for d in range(len(w.ptr) - 1):
            yield int(w.ptr[d + 1] - w.ptr[d]), hit[w.ptr[d] : w.ptr[d + 1]], item[cut[d] : cut[d + 1]]


def test_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> list[list[tuple[str, str]]]:
    """The test set as blocks of bounded size; benchmarks are small, and their size is checked."""
    rows = benchmark.select(benchmark[item_col].cast("string").alias("item"), F.coalesce(benchmark[text_col], F.lit("")).alias("text")).where("item is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks: list[list[tuple[str, str]]] = [[]]
    if total <= block_chars:
        blocks[0] = [(r.item, r.text) for r in rows.collect()]
        return blocks
    size = 0
    for r in rows.toLocalIterator():
        if size and size + len(r.text) > block_chars:
            blocks.append([])
            size = 0
        blocks[-1].append((r.item, r.text))
        size += len(r.text)
    return blocks


_PASS = (("__words", T.LongType()), ("__hits", T.BinaryType()), ("__items", T.ArrayType(T.StringType())))


def _pass_names(docs: DataFrame) -> list[str]:
    """Names of what with_hits adds, none of them a column of docs."""
    taken = [c.lower() for c in docs.columns]
    return [free(name, taken) for name, _ in _PASS]


def with_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with __words (number), __hits (a bit per word, or null) and __items (sorted item ids), each with
    ``_`` added while docs has a column of that name."""
    more = [T.StructField(name, kind) for name, (_, kind) in zip(_pass_names(docs), _PASS)]
    at = docs.columns.index(text_col)
    out = docs
    for block in test_blocks(benchmark, block_chars=block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        first = out is docs
        schema = T.StructType([*docs.schema.fields, *more])

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=first, schema=schema) -> Iterator[pa.RecordBatch]:
            tests = TestSet.of(shared.value)
            for batch in batches:
                n_words, hits, items = [], [], []
                for k, (n, hit, item) in enumerate(judge_column(batch.column(at), tests, window)):
                    names = set(tests.ids[item].tolist())
                    bits = np.packbits(hit)
                    if not first:
                        names |= set(batch.column(batch.num_columns - 1)[k].as_py() or ())
                        before = batch.column(batch.num_columns - 2)[k].as_py()
                        if before is not None:
                            bits |= np.frombuffer(before, dtype=np.uint8)
                    n_words.append(n)
                    hits.append(bits.tobytes() if bits.any() else None)
                    items.append(sorted(names))
                kept = batch.columns if first else batch.columns[:-3]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(n_words, pa.int64()), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))], names=schema.names)

        out = out.mapInArrow(run, schema)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of docs: n_words, n_hit, n_items, items_sha256, contaminated, and the items."""
    slim = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__text"))
    out = with_hits(slim, benchmark, "__text", window, block_chars).drop("__text")
    ones = [bin(b).count("1") for b in range(256)]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in ("n_words", "n_hit", "n_items")), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()), T.StructField("items", T.ArrayType(T.StringType()))])

    @tidy
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [sum(ones[b] for b in bits or b"") for bits in batch.column(2).to_pylist()]
            items = batch.column(3).to_pylist()
            sha = [hashlib.sha256(",".join(i).encode()).hexdigest() for i in items]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array(sha), pa.array([h > 0 for h in hit]), batch.column(3)], names=schema.names)

    return out.mapInArrow(digest, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs without a hit word, all columns as they were."""
    names = _pass_names(docs)
    return with_hits(docs, benchmark, text_col, window).where(F.col(names[1]).isNull()).drop(*names)


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item_id, test_word, n_words, id, doc_word): for each test suffix with an occurring window its
    longest verbatim match over all shards and one place of it (smallest id and position)."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("test_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField(id_col, kind), T.StructField("doc_word", T.LongType())])
    out = None
    for block in test_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tests = TestSet.of(shared.value)
            item_of = np.repeat(np.arange(len(tests.ids)), np.diff(tests.ptr))
            for batch in batches:
                for first, _, w in textops.word_blocks(batch.column(1), textops.ALNUM_WORDS, lower=True, block_bytes=SHARD_BYTES):
                    words, docs_of = w.hashes(), w.doc_of()
                    for m, at in tests.suffixes(window).items():
                        f = search_shard(words, w.ptr, tests, m, at)
                        if len(f.at):
                            d = docs_of[f.where]
                            yield pa.RecordBatch.from_arrays([pa.array(tests.ids[item_of[f.at]].tolist(), pa.string()), pa.array(f.at - tests.ptr[item_of[f.at]]), pa.array(f.longest), batch.column(0).take(pa.array(d + first)), pa.array(f.where - w.ptr[d])], names=schema.names)

        part = docs.select(docs[id_col], docs[text_col]).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    best = F.max_by(F.struct(id_col, "doc_word"), F.struct("n_words", -F.col("doc_word")))
    return out.groupBy("item_id", "test_word").agg(F.max("n_words").alias("n_words"), best.alias("at")).select("item_id", "test_word", "n_words", f"at.{id_col}", "at.doc_word")
