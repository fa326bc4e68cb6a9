"""Language-model scores by online logistic mixing of hashed-context bit predictors.

Texts are word tokens and one end.  A token is a string of bits: the path of its code, a Huffman code
over the ``VOCABULARY`` most frequent training words that occur twice or more, the end, and classes of
all other words.  A class is a hash of the word; there are so many that ``CLASS_WORDS`` words of training
share one (at most ``CLASSES``), and a word has the probability (c+1)/(M+W+1) in its class, with c its
training count, M and W the tokens and the distinct words of training in the class.  So rare words, and
words of no training text, are mixed as all others are.  Every bit is predicted by

* the count of training tokens below the node of the code (order 0),
* three tables of bit counts, hashed by node and context, at every node and for every word: the last
  one of the ``COMMON`` most frequent words (it tells languages and styles apart), the last word, the
  last two words,
* a match model: what followed the last occurrence of the last two words in the same document.

Their logits are mixed with weights that belong to the document and to a gate (how often the longest
context was seen, state of the match) and that are refined by the gradient of the coding cost after
every ``STEP`` words of the document: the gradients of their bits, each taken at the weights before,
are summed.  (A step a bit would be a loop in Python over all bits of the corpus.)  An adaptive
probability map refines what the mixer says: for each document, state of the match and interval of the
mixed logit, it learns by the same steps how far the bits depart from it.  Each bit is predicted
from what stands before it, so the sum of the logs is the log probability of the token sequence.

Spark gathers from all training documents: the count of every token (a shuffled aggregation), the code
from its most frequent entries, and the bit counts, summed piece by piece over tasks in 64 bits; sums that do
not fit 32 bits are halved with their partner, so that their ratio stays.  There is a task for each
``TASK_BYTES`` of text.  Model tables grow with the training tokens up to a size that can be broadcast
(``SLOT_BITS``, ``VOCABULARY``, ``CLASSES``); contexts beyond share slots.  Counts of the other tokens,
which have no bound, are never broadcast: each document sends its tokens beyond the vocabulary to a join
with the token counts.  Tokens are known by 64-bit hashes.

Defined cases: a null text is empty and scores its end alone; without training documents all counts
are 0 and the code has only the end and one class; a null id counts as training; equal rows are scored
alike; tokens tie in the vocabulary by hash; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomveil.llm import textops
from loomveil.llm.shared import stash

VOCABULARY = 1 << 18
#: hashed contexts have one slot for SLOT_TOKENS tokens of training, 2^21 at least and 2^SLOT_BITS at most
SLOT_BITS = 22
SLOT_TOKENS = 16
CLASS_WORDS = 32
CLASSES = 1 << 16
COMMON = 256
STEP = 64
RATE = 0.02
#: the probability map: intervals of the logit, and how fast they learn (a step has too few bits to overshoot)
LEVELS = 25
MAP_RATE = 0.1
TASK_BYTES = 512 << 20
BLOCK_BYTES = 400_000
WORDS = 20_000
_PIECE = 1 << 16
_TABLES = 3
_LEAST_BITS = 21
#: bits whose logits are made at once
_CHUNK = 1 << 14
_LANES = 4
#: tokens of several documents whose weights move at once, about so many
_SLICE = 1200
_INDEX_BITS = 20
BACKOFF = (6.0, 4.0, 2.0)
_WEIGHTS = np.array([1.0, 0.9, 0.4, 0.3, 0.5], dtype=np.float32)
_GATES = 12
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
END = 0


class Code:
    """A Huffman code: flat paths of nodes and bits, and the share of ones below each node.

    The end is symbol 0, then come the classes, whose number is a power of two, then the words."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, ends: int, others: np.ndarray, distinct: np.ndarray):
        """others and distinct: tokens and distinct words of each class in training."""
        order = np.argsort(keys)
        self.keys = keys[order]  # sorted hashes of the words
        self.classes = len(others)
        self.first = 1 + self.classes  # symbol of the first word
        weights = np.concatenate([[max(1, ends)], np.maximum(1, others), counts[order]]).astype(np.int64)
        self.index: np.ndarray | None = None  # made where it is used
        self.counts = counts[order]
        self.class_bits = np.log2(others + distinct + 1.0)  # what a word of count 0 costs in its class
        self.rank = np.full(len(weights), len(weights), dtype=np.int64)
        self.rank[self.first :][np.argsort(-self.counts, kind="stable")] = np.arange(len(self.counts))
        n = len(weights)
        heap = [(int(w), i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, side, total = np.zeros(2 * n - 1, dtype=np.int64), np.zeros(2 * n - 1, dtype=np.uint8), np.zeros(2 * n - 1, dtype=np.float64)
        total[:n] = weights
        for node in range(n, 2 * n - 1):
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[x] = parent[y] = node
            side[y] = 1
            total[node] = a + b
            heapq.heappush(heap, (a + b, node))
        root = 2 * n - 2
        depth = np.zeros(2 * n - 1, dtype=np.int32)
        for node in range(root - 1, -1, -1):
            depth[node] = depth[parent[node]] + 1
        self.ptr = np.concatenate([[0], np.cumsum(depth[:n])])
        self.nodes, self.bits = np.zeros(self.ptr[-1], dtype=np.int32), np.zeros(self.ptr[-1], dtype=np.uint8)
        at, live, left = np.arange(n), np.arange(n), depth[:n].astype(np.int64)
        while len(live):
            live = live[left[live] > 0]
            here = self.ptr[live] + left[live] - 1
            self.nodes[here], self.bits[here] = parent[at[live]] - n, side[at[live]]
            at[live] = parent[at[live]]
            left[live] -= 1
        ones = np.zeros(n - 1)
        right = np.flatnonzero(side[:root] == 1)
        ones[parent[right] - n] = total[right]
        below = total[n:]
        self.logit = np.log((ones + 0.5) / (below - ones + 0.5)).astype(np.float32)
        self.share = ((ones + 0.5) / (below + 1)).astype(np.float32)

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """The symbol of each word hash, that of its class where the word is not in the code."""
        own = 1 + (h & np.uint64(self.classes - 1)).astype(np.int64)
        if not len(self.keys):
            return own
        # hashes are spread evenly, so a word is looked for among the few that share its first bits
        if self.index is None:
            self.index = np.searchsorted(self.keys >> np.uint64(64 - _INDEX_BITS), np.arange(1 << _INDEX_BITS, dtype=np.uint64)).astype(np.int32)
        at = self.index.take((h >> np.uint64(64 - _INDEX_BITS)).view(np.int64), mode="clip").astype(np.int64)
        own_key = self.keys.take(at, mode="clip")
        live = np.flatnonzero(own_key < h)
        while len(live):
            at[live] += 1
            live = live[at[live] < len(self.keys)]
            own_key[live] = self.keys[at[live]]
            live = live[own_key[live] < h[live]]
        return np.where(own_key == h, at + self.first, own)


class Tokens:
    """The tokens of a block of documents: words, with an end after those of each document."""

    def __init__(self, w: textops.Words, code: Code, match: bool = True):
        """match: whether the match model is wanted, which bit counts do not need."""
        h, docs = w.hashes(), np.arange(len(w.ptr) - 1)
        n = len(h) + len(docs)
        self.w, self.ptr = w, w.ptr + np.arange(len(w.ptr))
        is_end = np.zeros(n, dtype=bool)
        is_end[self.ptr[1:] - 1] = True
        self.word = np.flatnonzero(~is_end)
        self.hash = np.zeros(n, dtype=np.uint64)
        self.hash[self.word] = h
        self.symbol = np.zeros(n, dtype=np.int64)
        self.symbol[self.word] = code.symbols(h)
        self.doc = np.repeat(docs, np.diff(self.ptr))
        first = self.ptr[:-1][self.doc]
        self.at = np.arange(n) - first
        scope = textops.mix(np.uint64(7) + np.zeros(n, dtype=np.uint64))
        last = np.where(self.at >= 1, np.roll(self.hash, 1), scope)
        before = np.where(self.at >= 2, np.roll(self.hash, 2), scope)
        rank = code.rank[self.symbol]
        mark = np.where((rank < COMMON) & ~is_end, np.arange(n), -1)
        near = np.maximum.accumulate(np.append(-1, mark[:-1])) if n else mark
        frequent = np.where(near >= first, self.hash[np.maximum(near, 0)], scope)
        self.contexts = [textops.mix(frequent + np.uint64(1)), textops.mix(last + np.uint64(2)), textops.mix(textops.mix(last) ^ (before + np.uint64(3)))]
        if not match:
            return
        key = textops.in_scope(self.contexts[2], self.doc)
        order = np.argsort(key, kind="stable")
        same = np.append(False, key[order][1:] == key[order][:-1]) if n else np.zeros(0, dtype=bool)
        self.match = np.full(n, -1, dtype=np.int64)
        self.match[order[same]] = order[np.flatnonzero(same) - 1]
        self.match[self.at < 2] = -1
        three = np.where(self.at >= 3, np.roll(self.hash, 3), scope)
        self.long = (self.match >= 0) & (three == three[np.maximum(self.match, 0)]) & (self.at >= 3)


class Bits:
    """All predicted bits of some tokens, in their order, and their slots in tables of 2^slot_bits."""

    def __init__(self, t: Tokens, code: Code, some: np.ndarray, slot_bits: int):
        symbol = t.symbol[some]
        self.size = np.diff(code.ptr)[symbol]
        before = np.cumsum(self.size) - self.size
        self.where = np.arange(int(self.size.sum())) + np.repeat(code.ptr[symbol] - before, self.size)
        self.node, self.bit = code.nodes.take(self.where, mode="clip"), code.bits.take(self.where, mode="clip")
        spread = self.node.astype(np.uint64)
        spread *= _ODD[3]
        self.slots = []
        for c, odd in zip(t.contexts, _ODD):
            slot = np.repeat(c[some], self.size)
            slot ^= spread
            slot *= odd
            slot >>= np.uint64(64 - slot_bits)
            self.slots.append(slot.view(np.int64))

    def guess(self, t: Tokens, code: Code, tokens: np.ndarray) -> None:
        """The match model: the bits it votes on, its votes (1 or -1), and its states there (0 elsewhere)."""
        some = np.flatnonzero(np.repeat(t.match[tokens] >= 0, self.size))
        has = np.flatnonzero(t.match[tokens] >= 0)
        token = np.repeat(tokens[has], self.size[has])
        other = t.symbol[t.match[token]]
        there = self.where[some] - code.ptr[t.symbol[token]] + code.ptr[other]
        inside = there < code.ptr[other + 1]
        some, token, there = some[inside], token[inside], there[inside]
        agree = code.nodes[there] == self.node[some]
        self.live = some[agree]
        self.vote = np.where(code.bits[there[agree]] == 1, np.float32(1), np.float32(-1))
        self.state = 1 + t.long[token[agree]]


def _ranges(t: Tokens) -> Iterator[tuple[int, int]]:
    """Ranges of about WORDS tokens that end where a document or a step of it ends."""
    cuts = np.append(np.flatnonzero(t.at % STEP == 0), len(t.hash))
    lo = 0
    while lo < len(t.hash):
        hi = int(cuts[np.searchsorted(cuts, lo + WORDS, side="right") - 1])
        yield lo, hi
        lo = hi


def _turns(t: Tokens) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens in order of their step, in ranges of about WORDS, and where the slices of a range begin: parts of
    a step of about _SLICE tokens, of whole steps of documents."""
    step = t.at // STEP
    turn = np.argsort(step.astype(np.uint16) if len(step) and step.max() < 1 << 16 else step, kind="stable")
    step, doc = step[turn], t.doc[turn]
    cuts = np.append(np.flatnonzero(np.append(True, (step[1:] != step[:-1]) | (doc[1:] != doc[:-1]))), len(turn))
    lo = 0
    while lo < len(turn):
        hi = int(cuts[np.searchsorted(cuts, lo + WORDS, side="right") - 1])
        own = cuts[np.searchsorted(cuts, lo) : np.searchsorted(cuts, hi)]
        new = np.append(True, step[own[1:]] != step[own[:-1]])
        begin = own[new][np.cumsum(new) - 1]  # of the step, in the range
        part = (own - begin) // _SLICE
        new[1:] |= part[1:] != part[:-1]
        yield turn[lo:hi], own[new] - lo
        lo = hi


def _columns(column) -> Iterator[tuple[int, int, textops.Words]]:
    return textops.word_blocks(column, textops.SPACE_WORDS, lower=True, block_bytes=BLOCK_BYTES)


def token_counts(training: DataFrame) -> DataFrame:
    """(word, n): how often each word hash occurs in the texts of training (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = np.sort(np.concatenate([np.zeros(0, np.uint64), *(w.hashes() for _, _, w in textops.word_blocks(batch.column(0), textops.SPACE_WORDS, lower=True))]))
            first = np.flatnonzero(np.append(True, held[1:] != held[:-1])) if len(held) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(held[first].view(np.int64)), pa.array(np.diff(np.append(first, len(held))))], names=["word", "n"])

    return training.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Counts:
    """Counts of zeros and ones for each table and slot, (tables, 2 x slots), emptied before they overflow."""

    def __init__(self, slot_bits: int, limit: int = 0xFFFFFFFF):
        self.slot_bits, self.limit, self.held = slot_bits, limit, 0
        self.total = np.zeros((_TABLES, 2 << slot_bits), dtype=np.uint32)

    def add(self, t: Tokens, code: Code) -> Iterator[pa.RecordBatch]:
        """Counts the bits of a block; gives counts out where there is no room for more."""
        for lo, hi in _ranges(t):
            b = Bits(t, code, np.arange(lo, hi), self.slot_bits)
            if self.held + len(b.bit) > self.limit:
                yield from self.give()
            self.held += len(b.bit)
            for k, slot in enumerate(b.slots):
                slot <<= 1
                slot |= b.bit
                np.add.at(self.total[k], slot, np.uint32(1))

    def give(self) -> Iterator[pa.RecordBatch]:
        """(piece, data) of the pieces with counts, which are set back to 0."""
        flat = self.total.reshape(-1, piece_size(self.slot_bits))
        for i in range(0, len(flat), 16):
            some = [(j, flat[j].tobytes()) for j in range(i, min(i + 16, len(flat))) if flat[j].any()]
            yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in some], pa.int32()), pa.array([s[1] for s in some], pa.binary())], names=["piece", "data"])
        self.total[:] = 0
        self.held = 0


def piece_size(slot_bits: int) -> int:
    return min(_PIECE, 2 << slot_bits)


def fitting(x: np.ndarray) -> np.ndarray:
    """Counts of zeros and ones in turn as 32-bit numbers; pairs too large are halved until they fit."""
    pair = x.reshape(-1, 2).copy()
    while (large := (pair > 0xFFFFFFFF).any(axis=1)).any():
        pair[large] >>= 1
    return pair.ravel().astype(np.uint32)


def bit_counts(training: DataFrame, code, slot_bits: int, tasks: int) -> np.ndarray:
    """Counts of zeros and ones (last axis) for each table and slot, summed over all training texts."""
    size, piece = _TABLES * 2 << slot_bits, piece_size(slot_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(slot_bits)
        for batch in batches:
            for _, _, w in _columns(batch.column(0)):
                yield from counts.add(Tokens(w, code.value, match=False), code.value)
        yield from counts.give()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[i] = held.get(i, 0) + np.frombuffer(data, dtype=np.uint32).astype(np.int64)
        for i, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([fitting(x).tobytes()], pa.binary())], names=["piece", "data"])

    # a task sends its whole tables, so tasks follow the bytes of text, not the pieces of files
    schema = "piece int, data binary"
    out = np.zeros(size, dtype=np.uint32)
    for r in training.coalesce(tasks).mapInArrow(run, schema).repartition(size // piece, "piece").mapInArrow(add, schema).toLocalIterator():
        out[r.piece * piece :][:piece] = np.frombuffer(r.data, dtype=np.uint32)
    return out.reshape(_TABLES, 1 << slot_bits, 2)


def predictions(b: Bits, code: Code, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits of a range of bits by order 0 and the tables, (predictors, bits), and the confidence level of the
    longest context.

    A context's probability leans on that of the context before it with a weight of ``BACKOFF``
    counts, and its predictor is by how much its logit departs from that one's."""
    x = np.empty((len(b.slots) + 1, len(b.bit)), dtype=np.float32)
    level = np.empty(len(b.bit), dtype=np.int8)
    tables = [c.reshape(-1).view(np.uint64) for c in counts]  # two counts in one look-up
    for lo in range(0, len(b.bit), _CHUNK):  # scratch space stays in the cache
        hi = min(lo + _CHUNK, len(b.bit))
        node = b.node[lo:hi]
        last, p = code.logit.take(node, mode="clip"), code.share.take(node, mode="clip")
        x[0, lo:hi] = last
        for k, slot in enumerate(b.slots):
            both = tables[k].take(slot[lo:hi], mode="clip").view(np.uint32)
            ones = both[1::2].astype(np.float32)
            total = both[::2].astype(np.float32)
            total += ones
            p *= np.float32(BACKOFF[k])
            p += ones
            p /= total + np.float32(BACKOFF[k])
            np.minimum(np.maximum(p, np.float32(1e-6), out=p), np.float32(1 - 1e-6), out=p)
            now = 1 - p
            np.divide(p, now, out=now)
            np.log(now, out=now)
            np.subtract(now, last, out=x[k + 1, lo:hi])
            last = now
        seen = (total >= 1).view(np.int8)
        seen += (total >= 4).view(np.int8)
        seen += (total >= 16).view(np.int8)
        level[lo:hi] = seen
    return x, level


def summed(lanes: np.ndarray, weights: np.ndarray | None, n: int) -> np.ndarray:
    """Sums of weights (or counts) at n places, dealt to lanes: sums of neighbours at one place need not wait for each other."""
    return np.bincount(lanes, weights, _LANES * n).reshape(_LANES, n).sum(axis=0)


def score_block(t: Tokens, code: Code, counts: np.ndarray) -> np.ndarray:
    """log2 probability of the codes of each document of a block."""
    n_docs, slot_bits = len(t.ptr) - 1, counts.shape[1].bit_length() - 1
    weights = np.repeat(_WEIGHTS[:, None], n_docs * _GATES, axis=1)
    refined = np.zeros(n_docs * 3 * LEVELS, dtype=np.float32)
    score = np.zeros(n_docs)
    for some, first in _turns(t):  # a step of many documents is one slice of bits
        b = Bits(t, code, some, slot_bits)
        b.guess(t, code, some)
        x, level = predictions(b, code, counts)
        doc = t.doc[some]
        row = np.repeat(doc * _GATES, b.size)
        row += level
        row[b.live] += 4 * b.state
        place = np.repeat(doc * 3 * LEVELS, b.size)
        place[b.live] += LEVELS * b.state
        sign = 2 * b.bit.astype(np.float32) - 1
        voted = 2 * b.vote
        cost = np.empty(len(row), dtype=np.float32)
        cuts = np.append(np.cumsum(b.size) - b.size, len(row))[np.append(first, len(some))]
        voters = np.searchsorted(b.live, cuts).tolist()
        cuts = cuts.tolist()
        until = doc[np.append(first[1:], len(some)) - 1].tolist()
        turns = np.arange(len(row)) % _LANES
        for i, d in enumerate(doc[first].tolist()):
            from_, to, n_rows = cuts[i], cuts[i + 1], (until[i] + 1 - d) * _GATES
            live, vote = b.live[voters[i] : voters[i + 1]] - from_, voted[voters[i] : voters[i + 1]]
            xs, signs, base = x[:, from_:to], sign[from_:to], d * _GATES
            rows = row[from_:to] - base
            lanes = turns[: to - from_] * n_rows
            lanes += rows
            seen = summed(lanes, None, n_rows)
            own = weights[:, base : base + n_rows]
            z = own[0].take(rows, mode="clip")
            z *= xs[0]
            for k in range(1, len(xs)):
                part = own[k].take(rows, mode="clip")
                part *= xs[k]
                z += part
            voting = rows[live]
            z[live] += vote * own[-1].take(voting, mode="clip")
            np.minimum(np.maximum(z, np.float32(-12), out=z), np.float32(12), out=z)
            error = signs * z
            np.exp(error, out=error)
            error += 1
            np.divide(signs, error, out=error)
            rate = RATE / np.sqrt(np.maximum(seen, 1))
            for k in range(len(xs)):
                own[k] += rate * summed(lanes, xs[k] * error, n_rows)
            own[-1] += rate * np.bincount(voting, vote * error[live], n_rows)
            base = d * 3 * LEVELS
            cells = place[from_:to] - base
            cells += np.rint((z + 12) * np.float32((LEVELS - 1) / 24)).astype(np.int64)
            z += refined[base:].take(cells, mode="clip")
            z *= signs
            odds = np.exp(np.negative(z, out=z), out=z)
            both = 1 + odds
            np.log(both, out=cost[from_:to])
            odds /= both
            odds *= signs
            n_cells = (until[i] + 1 - d) * 3 * LEVELS
            cells += turns[: to - from_] * n_cells
            seen = summed(cells, None, n_cells)
            refined[base : base + n_cells] += (MAP_RATE / np.sqrt(np.maximum(seen, 1))) * summed(cells, odds, n_cells)
        score -= np.bincount(row, cost, n_docs * _GATES).reshape(n_docs, _GATES).sum(axis=1)
    return score / math.log(2)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, vocabulary: int = VOCABULARY, class_words: int = CLASS_WORDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of each row.

    Documents whose crc32 of the id as text leaves held_fold modulo folds are held out: nothing is
    learned from them."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    held = F.coalesce(F.crc32(docs[id_col].cast("string").cast("binary")) % folds == held_fold, F.lit(False))
    own = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), held.alias("held_out"))
    training = own.where("not held_out").select("text")
    counts = stash(token_counts(training), "tokens")
    known = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    seen = training.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    ends = seen.n
    n_train, distinct = (known.n or 0) + ends, known.v + (ends > 0)
    top = counts.where("n > 1").orderBy(F.desc("n"), "word").limit(vocabulary).toArrow()  # bounded by the parameter
    keys = top.column("word").to_numpy().view(np.uint64)
    sizes = top.column("n").to_numpy()
    classes = 1
    while classes < min(CLASSES, (known.v - len(keys)) // class_words):
        classes *= 2
    sums = counts.groupBy(F.col("word").bitwiseAND(F.lit(classes - 1)).cast("int").alias("k")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toArrow()  # a row a class
    others, words = np.zeros(classes, dtype=np.int64), np.zeros(classes, dtype=np.int64)
    at = sums.column("k").to_numpy()
    others[at], words[at] = sums.column("n").to_numpy(), sums.column("v").to_numpy()
    own_class = (keys & np.uint64(classes - 1)).astype(np.int64)
    np.subtract.at(others, own_class, sizes)
    np.subtract.at(words, own_class, 1)
    code = spark.sparkContext.broadcast(Code(keys, sizes, ends, others, words))
    slot_bits = max(_LEAST_BITS, min(SLOT_BITS, (n_train // SLOT_TOKENS).bit_length()))
    tasks = max(spark.sparkContext.defaultParallelism, -(-(seen.bytes or 0) // TASK_BYTES))
    tables = spark.sparkContext.broadcast(bit_counts(training, code, slot_bits, tasks))
    denominator = n_train + distinct + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, counted = code.value, tables.value
        of_symbol = np.concatenate([[ends], np.zeros(c.classes), c.counts]).astype(np.float64)
        for batch in batches:
            for at, to, w in _columns(batch.column(1)):
                t = Tokens(w, c)
                inside = (t.symbol == END) | (t.symbol >= c.first)
                base = np.bincount(t.doc[inside], np.log10((of_symbol[t.symbol[inside]] + 1) / denominator), to - at)
                kept = np.bincount(t.doc[inside], of_symbol[t.symbol[inside]] > 0, to - at).astype(np.int64)
                rare = np.flatnonzero(~inside)
                score = score_block(t, c, counted) - np.bincount(t.doc[rare], c.class_bits[t.symbol[rare] - 1], to - at)
                order = rare[np.lexsort((t.hash[rare], t.doc[rare]))]
                new = np.append(True, (t.hash[order][1:] != t.hash[order][:-1]) | (t.doc[order][1:] != t.doc[order][:-1])) if len(order) else np.zeros(0, dtype=bool)
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(order)))
                cut = np.searchsorted(t.doc[order[first]], np.arange(to - at + 1))
                mark = textops.sums(textops.mix(t.hash + t.at.astype(np.uint64)), t.ptr).view(np.int64)
                size = np.diff(w.bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), batch.column(2).slice(at, to - at), pa.array(mark), pa.array(np.diff(t.ptr)), pa.array(kept), pa.array(base), pa.array(score), pa.array(size), textops.list_array(t.hash[order[first]].view(np.int64), cut), textops.list_array(times.astype(np.int32), cut)],
                    names=["id", "held_out", "mark", "n_tokens", "kept", "base", "bits", "bytes", "rare", "times"],
                )

    id_type = kind.simpleString()
    scored = stash(own.mapInArrow(run, f"id {id_type}, held_out boolean, mark bigint, n_tokens bigint, kept bigint, base double, bits double, bytes bigint, rare array<bigint>, times array<int>"), "scored")
    # tokens beyond the vocabulary meet their counts; rows of one id and one text send the same ones
    sent = scored.select("id", "mark", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("id", "mark", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    found = sent.join(counts, "word", "left").groupBy("id", "mark").agg(F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(denominator)))).alias("more"), F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0))).alias("inner"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("also"))
    copies = scored.groupBy(F.col("id").alias("cid"), F.col("mark").alias("cmark")).agg(F.count(F.lit(1)).alias("copies"))
    rest = found.join(copies, F.col("id").eqNullSafe(F.col("cid")) & (F.col("mark") == F.col("cmark"))).select(F.col("id").alias("rid"), F.col("mark").alias("rmark"), (F.col("more") / F.col("copies")).alias("more"), (F.col("inner") / F.col("copies")).alias("inner"), (F.col("also") / F.col("copies")).cast("bigint").alias("also"))
    out = scored.drop("rare", "times").join(rest, F.col("id").eqNullSafe(F.col("rid")) & (F.col("mark") == F.col("rmark")), "left")
    score = F.col("bits") * math.log10(2) + F.coalesce("inner", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("kept") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(n_train).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), score.alias("score"), (-score / math.log10(2) / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"),
    )
