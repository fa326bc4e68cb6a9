"""Similarity links inside buckets, without all pairs of a bucket, and components of links.

Items meet in buckets (a shared prefix shingle, a MinHash band).  Only components are wanted, so pairs
of items that are in one component already need no check.  Rounds therefore go:

1. Star rounds.  Each bucket that still holds more than one component names a pivot; its other items
   are paired with the pivot (linear in the bucket), narrowed by filters on whole items, checked
   exactly, and components grow.  After ``STAR_ROUNDS`` of them more follow, each with other pivots, while
   the last round would make many times more pairs than a star round and a tenth of the checked pairs is linked.
2. A last exhaustive round.  In buckets that still hold several components, every pair of different
   components is checked, except pairs inside the largest component.  After it no link between
   components can be missing, so the result is that of all pairs.

A pair is checked once: pairs of earlier rounds are left out of later ones, and where items carry their
lists of buckets, the exhaustive round joins a pair only in the first bucket that both have in common;
where members name the bucket ``before`` theirs, only where the two came there from different buckets.  Buckets are aggregated
before they are shuffled, and pairs come from sort-merge joins, whose hot keys Spark splits.  Buckets
carry no more of an item than the first filters need, and a round looks only at those that the round before
found to hold several components.  Tables of a round are removed from the shared
folder when the tables that replace them are written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomveil.llm.shared import discard, stash, tidy
from loomveil.llm.textops import mix

STAR_ROUNDS = 2
#: star rounds go on up to so many, while the last round would make STAR_GAIN times the pairs of one
MOST_STAR_ROUNDS = 3
STAR_GAIN = 4
FILTER_BITS = 1 << 26
#: so many ids fit a filter; beyond, callers narrow documents by a shuffled join instead
FILTER_IDS = FILTER_BITS // 12
_PIECE = 1 << 16


class IdFilter:
    """A Bloom filter over 64-bit ids, of a size that fits their number and is at most FILTER_BITS.

    It only spares work: rows that pass are joined exactly afterwards.  With more ids than fit it
    passes more rows, and nothing is lost."""

    def __init__(self, bits: np.ndarray, size: int):
        self.bits, self.size = bits, size

    @staticmethod
    def _slots(ids: np.ndarray, size: int) -> list[np.ndarray]:
        h = mix(ids.astype(np.int64).view(np.uint64))
        step = mix(h) | np.uint64(1)
        return [((h + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64) for i in range(4)]

    @classmethod
    def of(cls, ids: DataFrame, key: Callable[..., np.ndarray] | None = None) -> IdFilter:
        """From a one-column table, or from key(columns) of one without nulls; built in pieces on the
        executors, put together on the driver."""
        n = ids.count()
        size = 1 << 16
        while size < min(12 * n, FILTER_BITS):
            size *= 2

        @tidy
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros(size, dtype=bool)
            for batch in batches:
                columns = [c.drop_null().to_numpy(zero_copy_only=False) for c in batch.columns]
                for s in cls._slots(key(*columns) if key else columns[0], size):
                    own[s] = True
            yield pieces({i: np.packbits(own[i * _PIECE : (i + 1) * _PIECE]) for i in range(size // _PIECE) if own[i * _PIECE : (i + 1) * _PIECE].any()})

        @tidy
        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    own = np.frombuffer(data, dtype=np.uint8)
                    held[i] = held[i] | own if i in held else own
            yield pieces(held)

        def pieces(held: dict[int, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([b.tobytes() for b in held.values()], pa.binary())], names=["piece", "data"])

        schema = "piece int, data binary"
        bits = np.zeros(size // 8, dtype=np.uint8)
        for r in ids.mapInArrow(part, schema).repartition(max(1, min(64, size // _PIECE)), "piece").mapInArrow(merge, schema).collect():
            bits[r.piece * _PIECE // 8 :][: _PIECE // 8] = np.frombuffer(r.data, dtype=np.uint8)
        return cls(bits, size)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        """Which ids may be in the set."""
        out = np.ones(len(ids), dtype=bool)
        for s in self._slots(ids, self.size):
            out &= (self.bits[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 == 1
        return out


def narrow(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs whose id is in ids (one column), and a few others; docs are not shuffled unless
    ids are too many for a filter.  Rows with a null id are left out."""
    if ids.count() > FILTER_IDS:
        return docs.join(ids.toDF(id_col), id_col, "left_semi").select(docs.columns)
    wanted = docs.sparkSession.sparkContext.broadcast(IdFilter.of(ids))
    at = docs.columns.index(id_col)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(at).cast(pa.int64())
            yield batch.filter(pa.array(wanted.value(own.fill_null(0).to_numpy(zero_copy_only=False)) & own.is_valid().to_numpy(zero_copy_only=False)))

    return docs.mapInArrow(run, docs.schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of (a, b) edges can reach.

    Alternating large-star and small-star steps; each step is written to the shared folder."""
    now = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v")  # repeated edges go in the small-star step
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        old, now = now, stash(small, "edges")
        discard(old)
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == (seen.n, seen.h):
            break
        mark = (seen.n, seen.h)
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def link(members: DataFrame, traits: DataFrame, check: Callable[[DataFrame], DataFrame], may_link: Callable[[str, str], Column], close: Callable[[str, str], Column], star_rounds: int = STAR_ROUNDS, sharp: tuple[Callable[[DataFrame], DataFrame], Callable[[str, str], Column]] | None = None) -> DataFrame:
    """(node, component) of items with links, given members (bucket, item, at, ...) of buckets and traits
    (item, ...) of items.  Traits may hold short lists of ``buckets``; bucket is then the one at place ``at``.
    Members may have the bucket ``before`` theirs in the order of their item's buckets (null: none).

    check(pairs of a, b) keeps the pairs that are linked, as a stored table; may_link(x, y) is a condition
    on the columns of two members, given as prefixes, that every linked pair fulfils in the first bucket
    they share, and close(x, y) one on their traits.  Star rounds, whose pairs are few, look traits up by
    pair; the last round has them in the buckets, so that it makes no pairs that they rule out.  There, sharp
    may give more traits (item, ...) of a column of items, and a condition on them for the pairs that are close;
    only rows with a partner that is close get them."""
    extra = ["item", *(c for c in members.columns if c not in ("bucket", "item"))]
    lean = F.struct(*(F.col(f"x.{c}") for c in extra if c != "before")).alias("x")
    whole = F.struct(*extra)
    found = seen = None

    def with_traits(df: DataFrame, item: str, name: str, columns: list[str]) -> DataFrame:
        own = traits.select(F.col("item").alias("__item"), F.struct(*columns).alias(name))
        return df.join(own, F.col(item) == F.col("__item")).drop("__item")

    def narrow(new: DataFrame) -> DataFrame:
        slim = [c for c in traits.columns if c != "buckets"]
        return with_traits(with_traits(new, "a", "xt", slim), "b", "yt", slim).where(close("xt", "yt")).select("a", "b").distinct()

    def pairs(left: DataFrame, right: DataFrame, on: Column | None = None) -> DataFrame:
        both = left.join(right, "bucket").where(may_link("x", "y"))
        both = both if on is None else both.where(on)
        new = both.select(F.least("x.item", "y.item").alias("a"), F.greatest("x.item", "y.item").alias("b")).where("a <> b").distinct()
        return new if seen is None else new.join(seen, ["a", "b"], "left_anti")

    def sharpened(few: DataFrame, other: DataFrame, wanted: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The rows of few and of other with a partner among the other ones, with sharp traits, and the table that
        they come from.  Most rows have none, so traits that grow with the set are not dealt to all buckets."""
        may = (F.col("bucket") == F.col("__bucket")) & may_link("x", "y") & wanted
        right = other.withColumnRenamed("bucket", "__bucket")
        near = few.join(right, may, "left_semi").select("bucket", "comp", "main", "x", "xt", F.lit(True).alias("is_few"))
        met = right.join(few, may, "left_semi").select(F.col("__bucket").alias("bucket"), F.col("other").alias("comp"), F.lit(None).cast("bigint").alias("main"), F.col("y").alias("x"), F.col("yt").alias("xt"), F.lit(False).alias("is_few"))
        both = stash(near.unionByName(met), "near")
        items = stash(both.select("x.item").distinct(), "items")
        more = stash(sharp[0](items), "traits")
        of_item = more.select(F.col("item").alias("__item"), F.struct(*(c for c in more.columns if c != "item")).alias("xs"))
        rows = stash(both.join(of_item, F.col("x.item") == F.col("__item")).drop("__item"), "mixed")
        discard(both, items, more)
        few = rows.where("is_few").drop("is_few")
        other = rows.where("not is_few").select("bucket", F.col("comp").alias("other"), F.col("x").alias("y"), F.col("xt").alias("yt"), F.col("xs").alias("ys"))
        return few, other, rows

    def many_pairs(named: DataFrame) -> bool:
        """Whether the buckets of named hold STAR_GAIN times as many pairs of different components as rows."""
        n = named.groupBy("bucket", "comp").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
        r = n.agg(F.sum("n").alias("rows"), F.sum((F.col("n") * F.col("n") - F.col("own")) / 2).alias("pairs")).first()
        return r.pairs > STAR_GAIN * r.rows

    k, star, n_linked, latest, rest = 0, True, 0, None, members
    while star:
        if found is None:
            named = rest.select("bucket", whole.alias("x"), F.col("item").alias("comp"))
        else:
            named = rest.join(found.withColumnRenamed("node", "item"), "item", "left").select("bucket", whole.alias("x"), F.coalesce("component", "item").alias("comp"))
        if k:  # only buckets with several components
            mixed = named.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
            named, old = stash(named.join(mixed, "bucket", "left_semi"), "mixed"), rest
            rest = named.select("bucket", "x.*")
            if k > 1:
                discard(old)
            if named.isEmpty():
                discard(named)
                break
        star = k < star_rounds
        if not star:
            star = latest is not None and k < MOST_STAR_ROUNDS and 10 * n_linked >= latest.count() and many_pairs(named)
        if star:
            # at first the same few items are pivots of most buckets, then each bucket names its own
            slim = named.select("bucket", lean, "comp")
            best = F.struct("x") if k == 0 else F.struct(F.xxhash64("x.item", "bucket", F.lit(k)).alias("h"), "comp", "x")
            pivots = slim.groupBy("bucket").agg(F.min(best).alias("p")).select("bucket", F.col("p.x.item" if k == 0 else "p.comp").alias("pivot_comp"), F.col("p.x").alias("y"))
            new = pairs(slim, pivots, F.col("comp") != F.col("pivot_comp"))
        else:
            slim, named = named, stash(with_traits(named, "x.item", "xt", [c for c in traits.columns if c != "item"]), "mixed")
            if k:
                discard(slim)
            sizes = named.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
            main = sizes.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("m")).select("bucket", F.col("m.comp").alias("main"))
            few = named.join(main, "bucket").where("comp <> main")
            other = named.select("bucket", F.col("comp").alias("other"), F.col("x").alias("y"), F.col("xt").alias("yt"))
            wanted = (F.col("comp") != F.col("other")) & ((F.col("other") == F.col("main")) | (F.col("comp") < F.col("other"))) & close("xt", "yt")
            if "buckets" in traits.columns:
                wanted &= ~F.arrays_overlap(*(F.slice(f"{s}t.buckets", F.lit(1), F.col(f"{s}.at")) for s in ("x", "y")))
            if "before" in extra:
                wanted &= F.coalesce(F.col("x.before") != F.col("y.before"), F.lit(True))
            if sharp:
                few, other, aside = sharpened(few, other, wanted)
                discard(named)
                named, wanted = aside, wanted & sharp[1]("xs", "ys")
            new = pairs(few, other, wanted)
        new = stash(narrow(new) if star else new, "pairs")
        linked = check(new)
        if not star:
            discard(named)
        k, n_linked, latest = k + 1, linked.count(), new
        seen = new if seen is None else seen.unionByName(new)
        if found is not None and linked.isEmpty():
            discard(linked)
            continue
        if found is None:
            found = stash(components(linked), "components")
        else:
            of_a, of_b = found.toDF("a", "ca"), found.toDF("b", "cb")
            lifted = linked.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
            merged = components(lifted)
            old = found.join(merged.toDF("component", "now"), "component", "left").select("node", F.coalesce("now", "component").alias("component"))
            fresh = merged.join(found, "node", "left_anti")
            before, found = found, stash(old.unionByName(fresh), "components")
            discard(before)
        discard(linked)
    return found
