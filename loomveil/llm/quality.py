"""Quality rules: word, symbol, line and repetition figures of each text, and a verdict.

Repetition beyond the base figures comes from a suffix array over the words of each document.
Suffixes are ordered by prefix doubling, only among positions whose word occurs again (no other
suffix has a repeat).  The longest common prefix of neighbours gives the
intervals of maximal repeated substrings; each position is covered by the longest repeat that starts
there, so the union of the spans is the cover of all maximal repeats.  All documents of a block are
sorted together, with keys that never tie between documents.

There is no shuffle: each text is judged where it is read.

Defined cases: null, empty and blank texts have no words and fail the base rule; a text of fewer
words than ``min_repeat`` has no covered words; rows with equal ids or equal texts are judged one by
one; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomveil.llm import textops
from loomveil.llm.shared import tidy

_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
_NOT_NEWLINE = np.arange(256) != 10

FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict.  A repeat counts towards the covered part from ``min_repeat`` words on;
    the longest repeat counts against a text from ``min_longest`` words and its percentage on."""

    min_words: int = 50
    max_repeat_percent: int = 50
    min_repeat: int = 10
    max_covered_percent: int = 30
    min_longest: int = 25
    max_longest_percent: int = 20


def suffix_repeats(h: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the length in words of the longest repeat that starts there, and the
    suffix-array neighbour that shares it (-1: none)."""
    n = len(h)
    longest, mate = np.zeros(n, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    order, group = textops.repeated(textops.in_scope(h, np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))))
    m = len(order)
    if not m:
        return longest, mate
    # Repeated words share a rank; all other words, and the end, have one of their own.
    rank = np.arange(n + 1, dtype=np.int32) + m
    rank[order] = np.searchsorted(group, group)
    levels, k = [(1, rank)], 1
    open_slots = np.arange(m)
    while len(open_slots):
        some = order[open_slots]
        own, follow = rank[some].astype(np.int64), rank[np.minimum(some + k, n)]
        by = np.argsort((own << 32) | follow, kind="stable")
        some, own, follow = some[by], own[by], follow[by]
        order[open_slots] = some
        new = np.ones(len(some), dtype=bool)
        new[1:] = (own[1:] != own[:-1]) | (follow[1:] != follow[:-1])
        rank = rank.copy()
        rank[some] = open_slots[np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))]
        k *= 2
        levels.append((k, rank))
        tied = ~new
        tied[:-1] |= ~new[1:]
        open_slots = open_slots[tied]
    a, b = order[:-1], order[1:]
    common = np.zeros(m - 1, dtype=np.int64)
    for k, of in reversed(levels):
        common += np.where(of[np.minimum(a + common, n)] == of[np.minimum(b + common, n)], k, 0)
    left, right = np.append(0, common), np.append(common, 0)
    longest[order] = np.maximum(left, right)
    mate[order] = np.where(left >= right, np.append(-1, order[:-1]), np.append(order[1:], -1))
    mate[longest == 0] = -1
    return longest, mate


def cover(longest: np.ndarray, least: int) -> np.ndarray:
    """Whether each word lies in a repeat of at least so many words."""
    edge = np.zeros(len(longest) + 1, dtype=np.int64)
    at = np.flatnonzero(longest >= least)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + longest[at], -1)
    return np.cumsum(edge[:-1]) > 0


def figures(column, rules: Rules = Rules()) -> dict[str, np.ndarray]:
    """The figures and the verdict of each text of an Arrow column."""
    parts: list[list[np.ndarray]] = [[] for _ in FIGURES]
    for _, _, w in textops.word_blocks(column, textops.SPACE_WORDS, lower=False):
        h, docs = w.hashes(), w.doc_of()
        points = textops.code_points(w.data)
        chars = textops.sums(points & textops.SPACE_WORDS[w.data], w.bounds)
        symbols = textops.sums(_SYMBOLS[w.data], w.bounds)
        lines = textops.split_words(w.data, w.bounds, _NOT_NEWLINE, lower=False)
        full = np.searchsorted(w.starts, lines.starts) < np.searchsorted(w.starts, lines.ends)
        owner, line = lines.doc_of()[full], textops.in_scope(lines.hashes()[full], lines.doc_of()[full])
        at, group = textops.repeated(line)
        dup = np.zeros(len(w.ptr) - 1, dtype=np.int64)
        np.add.at(dup, owner[at], 1)
        if len(at):
            np.add.at(dup, owner[at[np.searchsorted(group, np.arange(group[-1] + 1))]], -1)
        longest, _ = suffix_repeats(h, w.ptr)
        triples = textops.sums(cover(np.where(longest >= 3, 3, 0), 3), w.ptr)
        covered = textops.sums(cover(longest, rules.min_repeat), w.ptr)
        most = np.zeros(len(w.ptr) - 1, dtype=np.int64)
        np.maximum.at(most, docs, longest)
        for part, values in zip(parts, (w.counts, chars, symbols, dup, triples, covered, most)):
            part.append(np.asarray(values, dtype=np.int64))
    out = {name: np.concatenate(p) if p else np.zeros(0, dtype=np.int64) for name, p in zip(FIGURES, parts)}
    n = out["n_words"]
    out["base_failed"] = (n < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_percent * n)
    covered = 100 * out["n_covered_words"] > rules.max_covered_percent * n
    long = (out["longest_repeat"] >= rules.min_longest) & (100 * out["longest_repeat"] > rules.max_longest_percent * n)
    out["kept"] = ~out["base_failed"] & ~covered & ~long
    return out


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row of figures and verdict for each row of docs; see the module for the defined cases."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(f, T.LongType()) for f in FIGURES), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])

    @tidy
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = figures(batch.column(1), rules)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[f.name]) for f in schema[1:])], names=schema.names)

    return docs.select(docs[id_col], docs[text_col]).mapInArrow(judge, schema)


def keep_good(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of docs whose text is kept, all columns as they were."""
    at = docs.columns.index(text_col)

    @tidy
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(figures(batch.column(at), rules)["kept"]))

    return docs.mapInArrow(judge, docs.schema)


def repeat_spans(text: str | None, least: int = 10) -> list[tuple[int, int]]:
    """Word spans (first, end) of the union of all repeats of at least so many words."""
    for _, _, w in textops.word_blocks(pa.array([text], pa.large_string()), textops.SPACE_WORDS, lower=False):
        inside = cover(suffix_repeats(w.hashes(), w.ptr)[0], least).astype(np.int8)
        edge = np.diff(np.concatenate([[0], inside, [0]]))
        return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
    return []
