"""Packs documents into sequences of at most 1024 ids by cutting-stock column generation.

Each document is its ids and an end; what fills whole sequences is cut off first, and the rest, shorter than
a sequence, is an item.  Only the histogram of item lengths, in units of UNIT ids (256 numbers, whatever the
input), goes to the driver.  There a linear program covers the histogram by the fewest patterns, that is,
lengths that share a sequence.  The revised simplex method holds a basis of patterns; its dual prices go to
a knapsack, whose dynamic program names new patterns, until the cover is within GAP of a proven bound.
Patterns are rounded down, then up while items last, and the program is solved again for what is left.  The
last items, and those of patterns with most room as far as the others have room, form a stream, which is cut
to fill the room of the patterns; what is left of it fills sequences of its own, at last with lengths that
are powers of two and need no padding.  So only what rounding to units leaves is padded, UNIT - 1 ids an item
at most.

Items are ranked by units: their rank in their task, which the table of ids holds, and the counts of the
tasks before it.  A rank names the pattern, its copy and the place in it by arithmetic (in the stream,
positions go by ids, so lengths of the same units are ranked apart), and no group of equal lengths meets
in a task.  Ids are computed once and written to the shared folder; lost tasks read them there.  Offsets are
running sums within a sequence, over rows without ids.

Defined cases: null and empty texts are an end alone; ids are those of the public byte-level vocabulary, with
its one special string, wherever it stands; null and repeated ids of documents are kept as such; ties are
in order of the input's partitions; texts may be of any length; an empty table gives no rows; other columns
are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomveil.llm.packing import byte_encoder
from loomveil.llm.shared import stash

ROW = 1024
END = 0
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
UNIT = 4
ROOM = ROW // UNIT
GAP = 5e-3
#: how far new patterns are priced by ids alone, in turn
STEADY = (0.95, 0.8, 0.5, 0.0)
ROUNDS = 8
#: counts by task and length are broadcast up to so many rows (24 bytes each), and joined by a shuffle beyond
BROADCAST_ROWS = 1 << 18
#: sequences that one document fills have ids from here on
FULL = 1 << 62

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_IDS = "doc_id bigint, ids binary, doc_tokens bigint, tail int, part int, rank bigint, full bigint"
_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
_LONG = 1 << 20


def encode(text: str | None, vocabulary: str | None = None) -> np.ndarray:
    """Ids of a whole text and the end.  Long texts are cut before words, where the pattern of the
    vocabulary cuts anyway."""
    encoder, out = byte_encoder(vocabulary), []
    for k, own in enumerate((text or "").split(SPECIAL)):
        if k:
            out.append(np.array([SPECIAL_ID], np.uint16))
        at = 0
        while at < len(own):
            cut = _CUT.search(own, at + _LONG) if len(own) - at > _LONG else None
            to = cut.start() if cut else len(own)
            out.append(np.array(encoder.encode(own[at:to]), np.uint16))
            at = to
    return np.concatenate([*out, np.array([END], np.uint16)])


Pattern = tuple[tuple[int, int], ...]  #: (units, copies), the longest first


class Master:
    """The linear program of a histogram of units, by the revised simplex method with generated columns."""

    def __init__(self, histogram: dict[int, int]):
        self.sizes = np.array(sorted(histogram), np.int64)
        self.need = np.array([histogram[n] for n in self.sizes.tolist()], np.float64)
        self.need += 1e-4 * (np.arange(len(self.need)) * 0.618034 % 1)  # slightly more, by different shares, so that no step is idle
        copies = ROOM // self.sizes
        self.basis = np.diag(copies).astype(np.int16)  # a pattern a row: copies of each size
        self.inverse = np.diag(1.0 / copies)
        self.x = self.need / copies
        self.price = 1.0 / copies

    def solve(self) -> list[tuple[Pattern, float]]:
        """(pattern, how often) of a cover by as few patterns as prices prove to be needed, within GAP."""
        least, steady = float(self.sizes @ self.need) / ROOM, 0
        while self.x.sum() > (1 + GAP) * least and steady < len(STEADY):
            # a size is worth its share of a sequence in the best case; new patterns are priced near that, so that prices do not swing
            price = STEADY[steady] * self.sizes / ROOM + (1 - STEADY[steady]) * self.price
            columns, worth = self._columns(price)
            least = max(least, price @ self.need / worth)  # prices scaled to suit every pattern bound the cover from below
            table, moved = columns.astype(np.float64), False
            while self.x.sum() > (1 + GAP) * least:
                gain = 1.0 - table @ self.price
                best = int(gain.argmin())
                if gain[best] > -1e-6:
                    break
                self._enter(columns[best], table[best], gain[best])
                moved = True
            steady += not moved
        every = ((tuple((int(self.sizes[i]), int(row[i])) for i in np.flatnonzero(row)[::-1]), x) for row, x in zip(self.basis, self.x.tolist()))
        return [(pattern, x) for pattern, x in every if x > 1e-3]

    def _enter(self, column: np.ndarray, weights: np.ndarray, gain: float) -> None:
        """Takes a pattern into the basis in place of the one that is used up first."""
        held = np.flatnonzero(weights)
        step = self.inverse[:, held] @ weights[held]
        up = step > 1e-9
        ratio = np.where(up, self.x / np.where(up, step, 1.0), np.inf)
        out = int(ratio.argmin())
        row = self.inverse[out] / step[out]
        self.price = self.price + gain * row
        changed, across = np.flatnonzero(np.abs(step) > 1e-12), np.flatnonzero(row)
        self.inverse[np.ix_(changed, across)] -= step[changed, None] * row[across]
        self.inverse[out] = row
        amount = ratio[out]
        self.x = np.maximum(self.x - amount * step, 0.0)
        self.x[out] = amount
        self.basis[out] = column

    def _columns(self, price: np.ndarray) -> tuple[np.ndarray, float]:
        """The pattern of most worth with each size, by dynamic programming over exact sums, and the most worth."""
        m = len(self.sizes)
        worth, made = np.full(ROOM + 1, -np.inf), np.zeros((ROOM + 1, m), np.int16)
        worth[0], top = 0.0, np.zeros(ROOM + 1, np.int64)  # top: the sum of most worth up to each room
        fits = np.searchsorted(self.sizes, np.arange(ROOM + 1), side="right")
        for c in range(1, ROOM + 1):
            k = fits[c]
            if k:
                value = worth[c - self.sizes[:k]] + price[:k]
                best = int(value.argmax())
                worth[c] = value[best]
                if worth[c] > -np.inf:
                    made[c] = made[c - self.sizes[best]]
                    made[c, best] += 1
            top[c] = c if worth[c] > worth[top[c - 1]] else top[c - 1]
        return made[top[ROOM - self.sizes]] + np.eye(m, dtype=np.int16), float(worth[top[ROOM]])


def units(length: int) -> int:
    return -(-length // UNIT)


def room_of(pattern: Pattern) -> int:
    return ROW - UNIT * sum(n * k for n, k in pattern)


def rounded(histogram: dict[int, int]) -> list[tuple[Pattern, int]]:
    """Patterns and how often, of a histogram of units; what they leave is less than half in each round, or all of it."""
    left, out = dict(histogram), []
    for _ in range(ROUNDS):
        if not left:
            break
        before = sum(n * k for n, k in left.items())
        for pattern, x in sorted(Master(left).solve(), key=lambda c: -(c[1] % 1)):
            times = min(min(left.get(n, 0) // k for n, k in pattern), int(x) + (x % 1 > 0.01))
            if times:
                out.append((pattern, times))
                for n, k in pattern:
                    left[n] -= k * times
        left = {n: k for n, k in left.items() if k}
        if 2 * sum(n * k for n, k in left.items()) > before:
            break
    return out


class Plan:
    """Where the items of each length go.  An item is named by its length and its rank in that length."""

    def __init__(self, histogram: dict[int, int]):
        held: dict[int, int] = {}
        self.before = {}  # of each length, the items of the same units that rank before
        for n in sorted(histogram, reverse=True):
            self.before[n] = held.get(units(n), 0)
            held[units(n)] = self.before[n] + histogram[n]
        patterns = sorted(rounded(held), key=lambda p: (room_of(p[0]), p))
        # drop patterns of most room until the stream of the items that are left over fills the room of the others
        least = lambda: sum(n * k for n, k in self._rest(histogram, patterns).items())
        while patterns and (lacking := sum(room_of(p) * t for p, t in patterns) - least()) > 0:
            pattern, times = patterns.pop()
            gone = min(times, max(1, lacking // ROW))  # one gives its ids and spares its room, ROW ids at most
            if times > gone:
                patterns.append((pattern, times - gone))
        self.patterns, self.count, at = patterns, sum(t for _, t in patterns), 0
        spans: dict[int, list] = {}
        self.fills, base = [], 0
        for pattern, times in patterns:
            slot = 0
            for n, k in pattern:
                spans.setdefault(n, []).append((k * times, base, k, slot))
                slot += k
            if room := room_of(pattern):
                self.fills.append((at, base, room))
                at += room * times
            base += times
        self.spans = {n: (np.cumsum([0] + [s[0] for s in own]), *(np.array([s[k] for s in own], np.int64) for k in (1, 2, 3))) for n, own in spans.items()}
        self.filled, self.rest, self.rest_at = at, self._rest(histogram, patterns), {}
        self.fill_starts = np.array([f[0] for f in self.fills], np.int64)
        at = 0
        for n in sorted(self.rest, reverse=True):
            self.rest_at[n] = at
            at += n * self.rest[n]
        self.histogram = histogram
        whole, left = divmod(at - self.filled, ROW)
        self.ends = [self.filled + whole * ROW]
        self.whole = whole
        for k in reversed(range(ROW.bit_length() - 1)):
            if left >> k & 1:
                self.ends.append(self.ends[-1] + (1 << k))

    def _rest(self, histogram: dict[int, int], patterns: list[tuple[Pattern, int]]) -> dict[int, int]:
        """How many items of each length no pattern takes."""
        taken: dict[int, int] = {}
        for pattern, times in patterns:
            for n, k in pattern:
                taken[n] = taken.get(n, 0) + k * times
        left = {n: max(0, min(c, self.before[n] + c - taken.get(units(n), 0))) for n, c in histogram.items()}
        return {n: c for n, c in left.items() if c}

    def places(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """(ids, sequence, slot) of the parts of an item; parts of a sequence go by slot."""
        size, k = units(length), rank + self.before[length]
        starts, base, copies, slots = self.spans.get(size, (np.zeros(1, np.int64), *[np.zeros(0, np.int64)] * 3))
        if k < starts[-1]:
            j = int(np.searchsorted(starts, k, side="right")) - 1
            times, copy = divmod(k - int(starts[j]), int(copies[j]))
            return [(length, int(base[j]) + times, int(slots[j]) + copy)]
        at, out = self.rest_at[length] + (rank - (self.histogram[length] - self.rest[length])) * length, []
        while length:
            if at < self.filled:
                j = int(np.searchsorted(self.fill_starts, at, side="right")) - 1
                start, first, room = self.fills[j]
                sequence, within = first + (at - start) // room, (at - start) % room
                slot, more = ROW + within, room - within
            elif at < self.ends[0]:
                sequence, slot = divmod(at - self.filled, ROW)
                sequence, more = self.count + sequence, ROW - slot
            else:
                j = int(np.searchsorted(self.ends, at, side="right")) - 1
                sequence, slot, more = self.count + self.whole + j, at - self.ends[j], self.ends[j + 1] - at
            n = min(length, more)
            out.append((n, sequence, slot))
            at, length = at + n, length - n
        return out


def token_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids, doc_tokens, tail, part, rank, full): ids in 16 bits, the task, and how many items of the
    same length, and whole sequences, its earlier rows have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, ranks, full = context.partitionId() if context else 0, [0] * ROW, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for doc, text in zip(batch.column(0).slice(at, 64).to_pylist(), batch.column(1).slice(at, 64).to_pylist()):
                    ids = encode(text, vocabulary)
                    whole, tail = divmod(len(ids), ROW)
                    rows.append((doc, ids.astype("<u2").tobytes(), len(ids), tail, part, ranks[tail], full))
                    ranks[tail] += 1
                    full += whole
                kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in _IDS.split(", ")])

    return docs.select(docs[id_col].cast("bigint"), docs[text_col]).mapInArrow(run, _IDS)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, ids: bool = False) -> DataFrame:
    """PIECES of all documents, with their ids (32 bits, little-endian) if asked for."""
    tokens = stash(token_table(docs, id_col, text_col, vocabulary), "tokens")
    counts = stash(tokens.groupBy("part", "tail").agg(F.count(F.lit(1)).alias("n")), "counts")
    plan = Plan({r.tail: r.n for r in counts.where("tail > 0").groupBy("tail").agg(F.sum("n").alias("n")).collect()})  # a row a length
    earlier = counts.select("part", "tail", (F.sum("n").over(Window.partitionBy("tail").orderBy("part")) - F.col("n")).alias("earlier"))
    ranked = tokens.join(F.broadcast(earlier) if counts.count() <= BROADCAST_ROWS else earlier, ["part", "tail"])
    shared = docs.sparkSession.sparkContext.broadcast(plan)  # a row a pattern and length at most
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, slot bigint" + (", ids binary" if ids else "")
    names, kinds = [f.split()[0] for f in schema.split(", ")], [pa.int64()] * 7 + [pa.binary()] * ids
    columns = ["doc_id", "ids", "doc_tokens", "tail", "part", "rank", "full", "earlier"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, held, n, tail, task, rank, full, earlier in zip(*(part.column(c).to_pylist() for c in columns)):
                    data = np.frombuffer(held, "<u2").astype("<u4").tobytes()
                    places = [(ROW, FULL + (task << 36) + full + k, 0) for k in range(n // ROW)]
                    places += shared.value.places(tail, earlier + rank) if tail else []
                    start = 0
                    for length, sequence, slot in places:
                        own = data[4 * start : 4 * (start + length)]
                        rows.append((doc, start, length, zlib.crc32(own), n, sequence, slot, *((own,) if ids else ())))
                        start += length
                    if len(rows) >= 4096:
                        yield out()
                        rows = []
        if rows:
            yield out()

    placed = ranked.select(columns).mapInArrow(run, schema)
    inside = Window.partitionBy("sequence_id").orderBy("slot")  # ROW pieces at most
    return placed.withColumn("offset", F.sum("length").over(inside) - F.col("length")).select(*[f.split()[0] for f in PIECES.split(", ")], *(["ids"] if ids else []))


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, cu_seqlens) of pieces with ids: a sequence's ids and the bounds of its pieces."""
    own = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))  # ROW pieces at most
    bounds = F.transform(F.col("own"), lambda p: (p["offset"] + p["length"]).cast("int"))
    return pieces.groupBy("sequence_id").agg(own.alias("own")).select("sequence_id", F.aggregate(F.col("own"), F.lit(b""), lambda s, p: F.concat(s, p["ids"])).alias("ids"), F.concat(F.array(F.lit(0)), bounds).alias("cu_seqlens"))
