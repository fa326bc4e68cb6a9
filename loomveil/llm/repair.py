"""Repairs the structure of conversations by the cheapest edits, found by bidirectional Dijkstra.

A conversation is well formed if its role initials are ``(s?(ua)+)?``.  Edits: Keep (0), Rerole to user or
assistant (1), Delete (2; the only choice for blank rows and for rows seen before), Insert an empty user or
assistant row (5); a truncated row that is not deleted adds 5.  The edit lattice has a node for each place
between rows and each kind of row that was put out last.  A forward and a reverse heap settle nodes by cost
until no cheaper crossing can follow; then all crossings of that cost are finished and the least audit (the
edits' initials, in ASCII order) is picked.  Two audits of the same least cost between the same nodes never
begin with one another, so least parts make least wholes; conversations are therefore solved in blocks of
``BLOCK`` rows, between all kinds of rows at their bounds, and what the open audits have in common is handed
on as a chunk.  A task holds a block, the open audits and one Arrow batch, however long a conversation is.

Three shuffles by conversation: marks of the rows (no texts), chunks of audits, and the rows, which are
repaired and hashed as a stream.  A conversation's hash and audit are sequential by their definition, so
one task reads its rows in order.

Defined cases: null ids form one conversation, null roles and texts are one space, null turns come first;
rows of the same turn go by role, then by the digest of role and text; rows that are equal are duplicates
of the first; a role without an initial, or with another, must be changed or deleted; conversations without
rows have zeros, an empty audit and the hash of an empty string; an empty table gives no rows; other columns
are not looked at, and texts may be of any length.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
BLANKS = " \t\n\x0b\x0c\r"
#: what was put out last: nothing, a system, user or assistant row
STATES = "-sua"
COSTS = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED = 5
ROLES = {"u": "user", "a": "assistant"}

RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_CHUNK = "conv_id bigint, turn bigint, role string, digest string, chunk bigint, audit string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"


def after(state: str, kind: str) -> str | None:
    """The state once a row of a kind follows; None: it must not."""
    return kind if (kind == "s" and state == "-") or (kind == "u" and state in "-sa") or (kind == "a" and state == "u") else None


def _edges(code: str) -> list[tuple[int, str, str, str]]:
    """(cost, edit, state before, state after) of the edits that use up a row.  A code is the row's kind
    (s, u, a, x: another), in capitals if it is truncated, or d if it must go."""
    out = [(COSTS["D"], "D", g, g) for g in STATES]
    if code != "d":
        more = TRUNCATED if code.isupper() else 0
        out += [(COSTS["K"] + more, "K", g, to) for g in STATES if (to := after(g, code.lower()))]
        out += [(COSTS["R"] + more, "R", g, to) for g in STATES for kind in "ua" if (to := after(g, kind))]
    return out


_FROM = {c: {g: [(w, op, b) for w, op, a, b in _edges(c) if a == g] for g in STATES} for c in "suaxSUAXd"}
_INTO = {c: {g: [(w, op, a) for w, op, a, b in _edges(c) if b == g] for g in STATES} for c in "suaxSUAXd"}
_INSERT = [(g, to) for g in STATES for kind in "ua" if (to := after(g, kind))]


@lru_cache(maxsize=1 << 16)
def cheapest(codes: str, entry: str, exits: str) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits of the rows between two states, the least audit among equals."""
    n = len(codes)

    def ahead(node):
        i, g = node
        if i < n:
            for w, op, to in _FROM[codes[i]][g]:
                yield w, op, (i + 1, to)
        for a, to in _INSERT:
            if a == g:
                yield COSTS["I"], "I", (i, to)

    def back(node):
        i, g = node
        if i:
            for w, op, a in _INTO[codes[i - 1]][g]:
                yield w, op, (i - 1, a)
        for a, to in _INSERT:
            if to == g:
                yield COSTS["I"], "I", (i, a)

    sources, targets = [(0, entry)], [(n, g) for g in exits]
    sides = [({v: (0, "") for v in sources}, set(), [(0, v[0], v) for v in sources], ahead, 1), ({v: (0, "") for v in targets}, set(), [(0, -v[0], v) for v in targets], back, -1)]
    heapq.heapify(sides[1][2])
    most = min((0 for v in sources if v in targets), default=float("inf"))
    while sides[0][2] and sides[1][2] and sides[0][2][0][0] + sides[1][2][0][0] <= most:
        mine = 0 if sides[0][2][0][0] <= sides[1][2][0][0] else 1
        labels, settled, heap, near, sign = sides[mine]
        other = sides[1 - mine][0]
        cost, _, node = heapq.heappop(heap)
        if node in settled or cost > labels[node][0]:
            continue
        settled.add(node)  # edits of cost 0 lead on in the order of the heap, so the audit is final, too
        for w, op, to in near(node):
            audit = labels[node][1]
            label = (cost + w, audit + op if mine == 0 else op + audit)
            if to not in labels or label < labels[to]:
                if to not in labels or label[0] < labels[to][0]:
                    heapq.heappush(heap, (label[0], sign * to[0], to))
                labels[to] = label
                if to in other:
                    most = min(most, label[0] + other[to][0])
    (ahead_of, done, *_), (back_of, done_back, *_) = sides
    found = [ahead_of[v] for v in targets if v in done] + [back_of[v] for v in sources if v in done_back]
    for u in done:
        cost, audit = ahead_of[u]
        if cost <= most:
            found += [(cost + w + back_of[v][0], audit + op + back_of[v][1]) for w, op, v in ahead(u) if v in done_back and cost + w + back_of[v][0] == most]
    return min(found, default=None)


class Solver:
    """Edits of one conversation, whose rows come in order."""

    def __init__(self):
        self.codes: list[str] = []
        self.open: dict[str, tuple[int, str]] = {"-": (0, "")}

    def add(self, code: str) -> str:
        """Takes a row; returns the part of the audit that is now certain."""
        self.codes.append(code)
        return self._solve(STATES) if len(self.codes) > BLOCK else ""

    def end(self) -> tuple[int, str]:
        """The cost, and the rest of the audit."""
        self._solve("-a", last=True)
        return self.open["."]

    def _solve(self, exits: str, last: bool = False) -> str:
        codes, self.codes = ("".join(self.codes), []) if last else ("".join(self.codes[:BLOCK]), self.codes[BLOCK:])
        found = {}
        for to in [exits] if last else exits:
            ways = [(cost + way[0], audit + way[1]) for g, (cost, audit) in self.open.items() if (way := cheapest(codes, g, to))]
            if ways:
                found["." if last else to] = min(ways)
        self.open = found
        if last:
            return ""
        low, high = min(a for _, a in found.values()), max(a for _, a in found.values())
        same = next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), len(low))
        self.open = {g: (cost, audit[same:]) for g, (cost, audit) in found.items()}
        return low[:same]


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults by the checksum of ``conv_id:turn`` modulo 20: 0 drops a row,
    1 empties its text, 2 takes out its ends of sentences, 3 repeats it, 4 makes it a user's."""
    spoken = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spoken("conv_id"), F.lit(":"), spoken("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spoken("text"), "[.!?]", "")).otherwise(spoken("text"))
    copies = F.when(kind == 3, 2).when(kind == 0, 0).otherwise(1)
    rows = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(spoken("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"))
    return rows.drop("copy")


def _digest() -> Column:
    return F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))


def _by_conversation(rows: DataFrame, *more: str) -> DataFrame:
    """Rows of a conversation in one partition, in order."""
    return rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("digest").asc_nulls_first(), *more)


def _audits(turns: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """Chunks of the audits, at the place of the row at which each became certain, and on the last chunk of a
    conversation its figures."""
    rest = F.rtrim(F.col("text"), F.lit(BLANKS))
    rows = turns.select("conv_id", "turn", "role", _digest().alias("digest"), (rest == "").alias("blank"), (~F.right(rest, F.lit(1)).isin(".", "!", "?")).alias("truncated"), F.lit(True).alias("here"))
    if every is not None:
        absent = every.select(F.col("conv_id").cast("bigint")).distinct()
        rows = rows.unionByName(absent.select("conv_id", F.lit(False).alias("here")), allowMissingColumns=True)
    # the window needs no shuffle of its own: rows of a conversation are already together
    first = F.row_number().over(Window.partitionBy("conv_id", "digest", "here").orderBy(F.col("turn").asc_nulls_first())) == 1
    marked = _by_conversation(rows.repartition(F.col("conv_id")).withColumn("first", first), "here")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, out = [f.split()[0] for f in _CHUNK.split(", ")], []
        conv, solver, chunk, counts, turns_seen, prior = None, None, 0, {}, [None, None, 0], None
        waiting: deque[tuple] = deque()  # places of the rows whose edits are not certain yet

        def put(audit: str, figures: dict | None = None) -> None:
            nonlocal chunk
            f, key = figures or {}, waiting[0] if waiting else (None, None, None)
            out.append((conv, *key, chunk, audit, *(f.get(k, 0) for k in names[6:])))
            chunk += 1
            for _ in range(len(audit) - audit.count("I")):
                waiting.popleft()

        def close() -> None:
            cost, audit = solver.end()
            low, high, n = turns_seen
            put(audit, {**counts, "cost": cost, "gaps": 0 if low is None else high - low + 1 - n})

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 6]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
            out.clear()
            return batch

        for batch in batches:
            for conv_id, turn, role, digest, blank, truncated, here, first in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "digest", "blank", "truncated", "here", "first"))):
                if solver is None or conv_id != conv:
                    if solver is not None:
                        close()
                    conv, solver, chunk, counts, turns_seen, prior = conv_id, Solver(), 0, dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0), [None, None, 0], None
                if not here:
                    continue
                fault = "blank" if blank else "duplicate" if not first else "truncated" if truncated else None
                if fault:
                    counts[fault] += 1
                initial = role[:1]
                if prior is not None and prior + initial not in ("su", "ua", "au"):
                    counts["illegal"] += 1
                prior = initial
                if turn is not None and turn != turns_seen[1]:
                    turns_seen = [turn if turns_seen[0] is None else turns_seen[0], turn, turns_seen[2] + 1]
                kind = initial if initial and initial in "sua" else "x"
                waiting.append((turn, role, digest))
                sure = solver.add("d" if fault in ("blank", "duplicate") else kind.upper() if fault else kind)
                if sure:
                    put(sure)
            if len(out) >= 1024:
                yield flush()
        if solver is not None:
            close()
        if out:
            yield flush()

    return marked.mapInArrow(run, _CHUNK)


def repair(turns: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """(conv_id, position, role, text) of the repaired conversations.  every: conversations that are reported even if they have no rows."""
    return _applied(turns, every, "conv_id bigint, position bigint, role string, text string", _Rows)


def repair_report(turns: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """RESULT of each conversation."""
    return _applied(turns, every, RESULT, _Report)


class _Rows:
    """Repaired rows."""

    def __init__(self, conv: int | None):
        self.conv, self.n = conv, 0

    def row(self, role: str, text: str) -> list[tuple]:
        self.n += 1
        return [(self.conv, self.n - 1, role, text)]

    def end(self, figures: list[int], audit: list[str]) -> list[tuple]:
        return []


class _Report:
    """Figures and a running hash."""

    def __init__(self, conv: int | None):
        self.conv, self.hash, self.n = conv, hashlib.sha256(), 0

    def row(self, role: str, text: str) -> list[tuple]:
        if self.n:
            self.hash.update(b"\n")
        self.n = 1
        self.hash.update(f"{role}:".encode())
        self.hash.update(text.encode("utf-8", "surrogatepass"))
        return []

    def end(self, figures: list[int], audit: list[str]) -> list[tuple]:
        return [(self.conv, *figures, "".join(audit), self.hash.hexdigest())]


def _applied(turns: DataFrame, every: DataFrame | None, schema: str, sink: type) -> DataFrame:
    """Rows and chunks in one ordered stream: a chunk comes with or before the rows that it tells of."""
    spoken = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), spoken("role"), spoken("text"))
    texts = rows.withColumn("digest", _digest())
    both = _by_conversation(texts.unionByName(_audits(rows, every), allowMissingColumns=True), F.col("chunk").asc_nulls_last())
    figures = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    names, kinds = [f.split()[0] for f in schema.split(", ")], [pa.int64() if f.endswith("bigint") else pa.string() for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, conv, held, out = False, None, None, []
        state, chunks, at, waiting, totals, audit = "-", [], 0, [], [0] * 6, []

        def take() -> str | None:
            """The next edit of the audit."""
            nonlocal at
            while chunks and at >= len(chunks[0]):
                chunks.pop(0)
                at = 0
            if not chunks:
                return None
            at += 1
            return chunks[0][at - 1]

        def put(kind: str, role: str, text: str) -> None:
            nonlocal state
            state = after(state, kind)
            out.extend(held.row(role, text))

        def insert() -> str | None:
            """Puts out inserted rows and returns the edit that follows."""
            while (edit := take()) == "I":
                kind = "a" if state == "u" else "u"
                put(kind, ROLES[kind], "")
            return edit

        def work() -> None:
            """Applies edits to the waiting rows, as far as edits are known."""
            done = 0
            for role, text in waiting:
                edit = insert()
                if edit is None:
                    break
                done += 1
                if edit != "D":
                    kind = role[:1] if edit == "K" else "a" if state == "u" else "u"
                    put(kind, role if edit == "K" else ROLES[kind], text)
            del waiting[:done]

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
            out.clear()
            return batch

        def close() -> None:
            work()
            insert()
            out.extend(held.end(totals, audit))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "chunk", "audit", *figures)]
            for conv_id, role, text, chunk, part, *own in zip(*columns):
                if not begun or conv_id != conv:
                    if begun:
                        close()
                    begun, conv, held = True, conv_id, sink(conv_id)
                    state, chunks, at, waiting, totals, audit = "-", [], 0, [], [0] * 6, []
                if chunk is None:
                    waiting.append((role, text))
                    work()
                else:
                    chunks.append(part)
                    audit.append(part)
                    totals = [a + b for a, b in zip(totals, own)]
                if len(out) >= 4096:
                    yield flush()
            if out:
                yield flush()
        if begun:
            close()
        if out:
            yield flush()

    return both.mapInArrow(run, schema)
