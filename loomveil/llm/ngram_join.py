"""Self-join of documents on the Jaccard similarity of their word n-gram sets.

Shingles are put in a global order, rare ones first, and a document is known by the first pairs of
neighbours in its ordered set, as many as any set similar enough must meet.  Sets that share such a pair
are candidates; length, positional and suffix filters drop most of them, and each remaining pair of sets is
verified once on the whole sets.

A pair of neighbours is lost with each of its shingles that the other set lacks (two pairs a shingle) and
with each shingle that the other set has between them (one pair).  If x lacks B shingles of y and y lacks A
of x, at most 2A + B pairs of x come before the first common one; for a similarity t of 1/2 at least this is
largest where y has t * size(x) shingles, all of x: 2 * (1 - t) * size(x).  One shingle alone is shared
by chance, by a number of sets that grows with the corpus; it is taken only below ``PAIRS_FROM`` percent, where
small sets have too few pairs.

* Equal sets are collapsed before the join, so groups of copies cost one item.
* The order comes from counts of all shingles of the corpus in a fixed number of hashed counters
  (``COUNTERS``), by eighth powers of two, ties by hash.  Any order gives the same result; counting only
  keeps frequent shingles out of the prefixes.
* Prefixes are written once and never shuffled.  A first pass deals out 32 bits of the hash of each bucket and
  finds those that occur twice or more (``Repeats``, a bitmap); only members of these are written.
* Buckets of the prefixes meet by ``linking.link``: components without all pairs of a bucket.
* The suffix filter cuts whole sets at fixed places of the hash order into 256 parts and bounds their
  difference by that of the sizes of the parts, which are kept modulo two (``parity_close``); it takes the
  place of the recursive search for pivots, which would need whole sets before the join.  In the last round,
  which pairs all components left in a bucket, items also have parities of four bits or more a shingle
  (``wide_close``), so that near copies of one text that are not similar enough are told apart in the join.
* Whole sets are built again only for items in candidate pairs, found by a Bloom filter of bounded
  size, or by a shuffled join where ids are too many for it.

Sets are of 64-bit hashes of n-grams of 64-bit word hashes.

Defined cases: null, empty and wordless texts have the empty set and link with nothing; with fewer
words than n the whole sequence is the one shingle; rows with a null id link with nothing and have a
null component; rows with one id all get the smallest component of their sets; equal rows share a
component; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomveil.llm import textops
from loomveil.llm.linking import FILTER_IDS, IdFilter, link
from loomveil.llm.shared import discard, free, stash, tidy

COUNTER_BITS = 21
COUNTERS = 1 << COUNTER_BITS
_PIECE = 1 << 14
_ROWS = 1 << 16
#: bits of the bitmap of repeated buckets, two for each bucket up to so many; buckets that one task counts
REPEAT_BITS = 1 << 29
_DEALT = 4_000_000
_HELD = 1 << 20
#: from this similarity on sets meet by pairs of neighbours (with 2 shingles or more they have enough of them)
PAIRS_FROM = 80
#: 64-bit words of a set's wide parities at most
WIDE_WORDS = 1 << 9
SIGS = ["sig1", "sig2", "sig3", "sig4"]


def _sets(column, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, shingles, bounds) of blocks of a column."""
    for at, _, w in textops.word_blocks(column, textops.SPACE_WORDS, lower=True):
        values, bounds = textops.shingle_sets(w, w.hashes(), n)
        yield at, values, bounds


def _counter(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def rarity(docs: DataFrame, n: int) -> np.ndarray:
    """A level for each hashed counter: how often its shingles occur in documents."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for _, values, _ in _sets(batch.column(0), n):
                total += np.bincount(_counter(values), minlength=COUNTERS)
        yield pieces(total.reshape(-1, _PIECE))

    @tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(data, dtype=np.uint32).astype(np.int64)
                held[i] = held[i] + own if i in held else own
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["piece", "data"])

    def pieces(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([r.astype(np.uint32).tobytes() for r in rows], pa.binary())], names=["piece", "data"])

    schema = "piece int, data binary"
    total = np.zeros(COUNTERS, dtype=np.int64)
    for r in docs.mapInArrow(count, schema).repartition(COUNTERS // _PIECE, "piece").mapInArrow(add, schema).collect():
        total[r.piece * _PIECE :][:_PIECE] += np.frombuffer(r.data, dtype=np.int64)
    return np.minimum(255, np.rint(8 * np.log2(total + 1))).astype(np.uint8)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def prefix_of(ordered: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of sets whose shingles stand in the global order, and their bounds: hashes of the first
    pairs of neighbours, or the first shingles where small sets have too few pairs."""
    size = np.diff(bounds)
    if percent >= PAIRS_FROM:
        values = textops.mix(np.append(ordered[1:], ordered[:1]) + textops.mix(ordered))
        length = np.where(size > 1, 2 * (100 - percent) * size // 100 + 1, 0)
    else:
        values, length = ordered, np.where(size > 0, size - (percent * size + 99) // 100 + 1, 0)
    take = np.arange(len(ordered)) - np.repeat(bounds[:-1], size) < np.repeat(length, size)
    return values[take], np.concatenate([[0], np.cumsum(length)])


def prefix_length(size, percent: int):
    """How many buckets a set of a size (a column) has at most."""
    return F.floor((2 if percent >= PAIRS_FROM else 1) * (100 - percent) * size / 100) + 1


def set_table(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(id, n_shingles, key1, key2, sig1 to sig4, prefix) of rows (id, text): the digest of each set, a
    bitmap of parities of its shingles, and its buckets in the global order."""
    level = docs.sparkSession.sparkContext.broadcast(rarity(docs.select("text"), n))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = level.value
        for batch in batches:
            for at, values, bounds in _sets(batch.column(1), n):
                size = np.diff(bounds)
                spread = textops.mix(values)
                key1, key2 = textops.sums(spread, bounds), textops.sums(textops.mix(spread ^ np.uint64(0xA5A5A5A5)), bounds)
                owner = np.repeat(np.arange(len(size)), size)
                sig = textops.parities(values, bounds)
                order = np.lexsort((values, levels[_counter(values)], owner))
                prefix, cut = prefix_of(values[order], bounds, percent)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(size)), pa.array(size, pa.int64()), pa.array(_signed(key1)), pa.array(_signed(key2)), *(pa.array(np.ascontiguousarray(sig[:, j])) for j in range(4)), textops.list_array(_signed(prefix), cut)],
                    names=["id", "n_shingles", "key1", "key2", *SIGS, "prefix"],
                )

    return docs.mapInArrow(run, "id bigint, n_shingles bigint, key1 bigint, key2 bigint, " + ", ".join(f"{s} bigint" for s in SIGS) + ", prefix array<bigint>")


def _head_key(item: np.ndarray, key: np.ndarray) -> np.ndarray:
    return textops.mix(key.view(np.uint64) ^ textops.mix(item.astype(np.int64).view(np.uint64))).view(np.int64)


def _head_rows(batch: pa.RecordBatch, wanted) -> pa.RecordBatch:
    """The rows (item, n_shingles, prefix, key1) of a batch that may be heads."""
    return batch.filter(pa.array(wanted.value(_head_key(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("item", "key1")))))) if wanted else batch


class Repeats:
    """Which buckets may occur twice or more: a bitmap over their hashes, a piece for each part of them.

    Others than repeated ones pass where they share a bit with one; no repeated one is lost."""

    def __init__(self, bits: np.ndarray, parts: int, piece_bits: int):
        self.bits, self.parts, self.piece_bits = bits, parts, piece_bits

    @staticmethod
    def _split(bucket: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
        h = textops.mix(bucket.view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        return (h >> np.uint64(32)) % np.uint64(parts), h & np.uint64(0xFFFFFFFF)

    @classmethod
    def of(cls, heads: DataFrame, total: int, wanted=None) -> Repeats:
        """From rows (item, n_shingles, prefix, key1) whose prefixes have about total buckets; pieces are
        built on the executors.  Of a bucket, a task sends no more than two for each _HELD that it reads."""
        parts = max(int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // _DEALT))
        piece_bits = max(3, min(31, (2 * total // parts).bit_length(), (REPEAT_BITS // parts).bit_length() - 1))

        def pack(held: list[np.ndarray]) -> pa.RecordBatch:
            part, low = cls._split(np.concatenate(held), parts)
            found = np.sort(part << np.uint64(32) | low)
            keep = np.ones(len(found), dtype=bool)
            keep[2:] = found[2:] != found[:-2]
            found = found[keep]
            part, low = (found >> np.uint64(32)).astype(np.int32), found.astype(np.uint32)
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            return pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array([low[a:b].tobytes() for a, b in zip(first, [*first[1:], len(low)])], pa.binary())], names=["part", "data"])

        @tidy
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for batch in batches:
                own = _head_rows(batch, wanted).column(2).flatten().to_numpy(zero_copy_only=False)
                for lo in range(0, len(own), _HELD):
                    held.append(own[lo : lo + _HELD].copy())
                    n += len(held[-1])
                    if n >= _HELD:
                        yield pack(held)
                        held, n = [], 0
            if n:
                yield pack(held)

        @tidy
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                for part, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                    held.setdefault(part, []).append(np.frombuffer(data.as_buffer(), dtype=np.uint32).copy())
            for part in list(held):
                low = np.sort(np.concatenate(held.pop(part)))
                bits = np.zeros(1 << piece_bits, dtype=bool)
                bits[low[1:][low[1:] == low[:-1]] >> np.uint32(32 - piece_bits)] = True
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["part", "data"])

        schema, size = "part int, data binary", (1 << piece_bits) // 8
        bits = np.zeros(parts * size, dtype=np.uint8)
        for r in heads.mapInArrow(deal, schema).repartition(parts, "part").mapInArrow(count, schema).collect():
            bits[r.part * size :][:size] = np.frombuffer(r.data, dtype=np.uint8)
        return cls(bits, parts, piece_bits)

    def __call__(self, bucket: np.ndarray) -> np.ndarray:
        part, low = self._split(bucket, self.parts)
        place = ((part << np.uint64(self.piece_bits)) + (low >> np.uint64(32 - self.piece_bits))).astype(np.int64)
        return (self.bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1


def bucket_members(heads: DataFrame, wanted=None, repeats=None) -> DataFrame:
    """(item, n_shingles, at, bucket, before) of rows (item, n_shingles, prefix): the buckets of each item
    with their places, and the bucket before each.  wanted (of rows with key1) and repeats, both broadcast,
    tell which rows may be heads and which buckets may be shared."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _head_rows(batch, wanted)
            prefix, size = batch.column(2), batch.column(2).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            bucket = prefix.flatten()
            owner = np.repeat(np.arange(len(size)), size)
            at = np.arange(len(bucket)) - np.repeat(np.cumsum(size) - size, size)
            before = pa.array(np.roll(bucket.to_numpy(zero_copy_only=False), 1), pa.int64(), mask=at == 0)
            whole = [pa.array(at, pa.int32()), bucket, before]
            if repeats:
                some = np.flatnonzero(repeats.value(bucket.to_numpy(zero_copy_only=False)))
                owner, whole = owner[some], [c.take(pa.array(some)) for c in whole]
            whole = [batch.column(0).take(pa.array(owner)), batch.column(1).cast(pa.int32()).take(pa.array(owner)), *whole]
            for lo in range(0, len(owner), _ROWS):
                yield pa.RecordBatch.from_arrays([c.slice(lo, _ROWS) for c in whole], names=["item", "n_shingles", "at", "bucket", "before"])

    return heads.mapInArrow(run, "item bigint, n_shingles int, at int, bucket bigint, before bigint")


def _of_items(docs: DataFrame, items: DataFrame, n: int, name: str, make: Callable[[np.ndarray, np.ndarray], tuple]) -> DataFrame:
    """(item, n_shingles, an array of bigint) of the documents in items (one column), and of a few others, as make
    gives it from shingles and bounds; docs are read once."""
    docs = docs.where("id is not null")
    fits = items.count() <= FILTER_IDS
    wanted = docs.sparkSession.sparkContext.broadcast(IdFilter.of(items)) if fits else None
    if not fits:
        docs = docs.join(items.select(F.col("item").alias("id")), "id", "left_semi")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if wanted is not None:
                batch = batch.filter(pa.array(wanted.value(batch.column(0).to_numpy(zero_copy_only=False))))
            for at, values, bounds in _sets(batch.column(1), n):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(bounds) - 1), pa.array(np.diff(bounds), pa.int64()), textops.list_array(*make(values, bounds))], names=["item", "n_shingles", name])

    return docs.mapInArrow(run, f"item bigint, n_shingles bigint, {name} array<bigint>")


def whole_sets(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """(item, shingles) of the documents in items, and of a few others."""
    return _of_items(docs, items, n, "shingles", lambda values, bounds: (_signed(values), bounds)).drop("n_shingles")


def wide_traits(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """(item, n_shingles, wide) of the documents in items, and of a few others: parities that grow with the set.
    256 of them tell sets of some hundred shingles hardly apart."""
    return _of_items(docs, items, n, "wide", lambda values, bounds: textops.wide_parities(values, bounds, WIDE_WORDS)).dropDuplicates()


def exact_check(sets: Callable[[DataFrame], DataFrame], percent: int):
    """Keeps pairs (a, b) whose sets have a Jaccard similarity of percent at least; sets(items) gives
    (item, shingles) of a column of items.  Sets are built once for both sides of all pairs."""

    def check(pairs: DataFrame) -> DataFrame:
        items = stash(pairs.select(F.explode(F.array("a", "b")).alias("item")).distinct(), "items")
        table = stash(sets(items), "shingles")
        common = F.size(F.array_intersect("sa", "sb"))
        both = pairs.join(table.toDF("a", "sa"), "a").join(table.toDF("b", "sb"), "b").select("a", "b", common.alias("c"), (F.size("sa") + F.size("sb")).alias("s"))
        linked = stash(both.where(100 * F.col("c") >= percent * (F.col("s") - F.col("c"))).select("a", "b").distinct(), "links")
        discard(items, table)
        return linked

    return check


def needed(x: str, y: str, percent: int):
    """Shingles that two sets of n_shingles must have in common."""
    return F.ceil(percent * (F.col(f"{x}.n_shingles") + F.col(f"{y}.n_shingles")) / F.lit(100 + percent))


def parity_distance(x: str, y: str):
    """In how many places the parities of two sets differ; the sets differ in as many at least."""
    return sum((F.bit_count(F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))) for s in SIGS), F.lit(0))


def parity_close(percent: int):
    """Suffix filter: linked sets differ in no more shingles, so in no more parities, than this."""

    def close(x: str, y: str):
        return parity_distance(x, y) <= F.col(f"{x}.n_shingles") + F.col(f"{y}.n_shingles") - 2 * needed(x, y, percent)

    return close


def wide_close(percent: int):
    """The suffix filter on wide parities; sets of unlike sizes are compared at the width of the smaller one."""

    def close(x: str, y: str):
        words = [F.col(f"{s}.wide") for s in (x, y)]
        least = F.least(*(F.size(w) for w in words))
        folded = [F.when(F.size(w) == least, w).otherwise(F.zip_with(F.slice(w, 1, least), F.slice(w, least + 1, least), lambda p, q: p.bitwiseXOR(q))) for w in words]
        apart = F.aggregate(F.zip_with(*folded, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, one: total + one)
        most = F.col(f"{x}.n_shingles") + F.col(f"{y}.n_shingles") - 2 * needed(x, y, percent)
        return F.when(F.greatest(*(F.size(w) for w in words)) <= 2 * least, apart <= most).otherwise(True)

    return close


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """(id, n_shingles, component_id) of each row of docs."""
    own = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"))
    table = stash(set_table(own, n, percent), "sets")
    keys = ["n_shingles", "key1", "key2"]
    real = table.where("id is not null and n_shingles > 0")
    groups = real.groupBy(*keys).agg(F.min("id").alias("item"))
    own_item = F.when(F.col("id").isNotNull(), F.col("item")).alias("item")
    rows = stash(table.select("id", *keys).join(groups, keys, "left").select("id", "n_shingles", own_item), "rows")
    heads = stash(real.drop("prefix").join(groups, keys).where("id = item").dropDuplicates(["item", *keys]).select("item", "n_shingles", "key1", *SIGS), "heads")
    # prefixes stay where they were written: a filter finds the rows of heads, and few copies of them
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(IdFilter.of(heads.select("item", "key1"), _head_key))
    whole = real.select(F.col("id").alias("item"), "n_shingles", "prefix", "key1")
    total = heads.agg(F.sum(prefix_length(F.col("n_shingles"), percent))).first()[0] or 0
    repeats = spark.sparkContext.broadcast(Repeats.of(whole, total, wanted))
    members = stash(bucket_members(whole, wanted, repeats), "members")
    discard(table)

    def may_link(x: str, y: str):
        """Length and positional filter."""
        need, at = needed(x, y, percent), [F.col(f"{s}.at") for s in (x, y)]
        size = [F.col(f"{s}.n_shingles") for s in (x, y)]
        rest = F.least(size[0] - at[0], size[1] - at[1])
        return (F.least(*size) >= need) & (F.least(*at) + rest >= need)

    check = exact_check(lambda items: whole_sets(own, items, n), percent)
    found = link(members, heads.drop("key1"), check, may_link, parity_close(percent), sharp=(lambda items: wide_traits(own, items, n), wide_close(percent))).toDF("item", "component")
    discard(members, heads)
    named = rows.where("item is not null").join(found, "item", "left").groupBy("id").agg(F.min(F.coalesce("component", "item")).alias("component_id"))
    return rows.select("id", "n_shingles").join(named, "id", "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """The rows of docs whose id is the smallest of their component.  Rows with a null id stay; of rows
    that are equal in every column one stays; rows with one id and other texts or columns all stay."""
    found = similar_documents(docs, id_col, text_col, n, percent)
    gone = found.where(f"`{id_col}` <> component_id").select(id_col).distinct()
    left = docs.join(gone, id_col, "left_anti").select(docs.columns)
    again = stash(found.where(f"`{id_col}` is not null").groupBy(id_col).count().where("count > 1").select(id_col), "again")
    if again.isEmpty():
        return left
    return left.join(again, id_col, "left_anti").select(docs.columns).unionByName(_distinct(left.join(again, id_col, "left_semi").select(docs.columns)))


def _distinct(rows: DataFrame) -> DataFrame:
    """Rows that are equal in every column once; columns with maps are compared by their JSON."""
    maps = [f.name for f in rows.schema if "map<" in f.dataType.simpleString()]
    if not maps:
        return rows.dropDuplicates()
    key = free("__maps", [c.lower() for c in rows.columns])
    return rows.withColumn(key, F.to_json(F.struct(*maps))).dropDuplicates([c for c in rows.columns if c not in maps] + [key]).drop(key)
