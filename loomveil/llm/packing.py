"""Packs documents into rows of a fixed number of token ids.

Texts become ids where they are read; a document longer than a row is split into full rows and a rest,
so no id is lost.  Pieces are packed shard by shard (a shard holds ``SHARD_TOKENS`` ids of consecutive
documents of a task): longest first, each into the open row with the least room that suffices, which a
segment tree over room sizes finds in steps of its depth.  A row is stored as a binary of
little-endian uint16 ids, filled up with the pad id, next to its cumulative segment lengths and its
position resets (the offsets at which positions start from 0 again).

There is no shuffle, and a lost task packs the same shards again.

Defined cases: null and empty texts have no ids and stand in no row; runs of white space may be of any
length; pieces of equal length are packed
in the order in which they came; equal rows are packed once each; null ids are kept as such; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from loomveil.llm.shared import new_path

ROW_TOKENS = 2048
SHARD_TOKENS = 1 << 21
PAD = 50256

ROWS = "row_id string, ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<bigint>, doc_offsets array<bigint>"


#: white space of the pattern; runs of so many are set apart, as its look-ahead overflows the stack on them
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2000,}")


class ByteEncoder:
    """The byte-level BPE of a public vocabulary file."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._texts = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._piece = tiktoken.Encoding("piece", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> list[int]:
        """All ids of a text.  A long run of white space is one piece of the pattern, but for its last
        character where more follows."""
        out, at = [], 0
        for run in _BLANKS.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            out += self._texts(text[at : run.start()])
            out += self._piece(text[run.start() : end])
            at = end
        return out + self._texts(text[at:]) if at else self._texts(text)


@lru_cache(maxsize=2)
def byte_encoder(path: str | None = None) -> ByteEncoder:
    import public_tokenizers

    return ByteEncoder(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))


class RoomTree:
    """A segment tree over rooms 0 to size - 1 that counts the open rows of each room."""

    def __init__(self, size: int):
        self.leaves = 1 << (size - 1).bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, by: int) -> None:
        at = self.leaves + room
        while at:
            self.count[at] += by
            at >>= 1

    def least(self, room: int) -> int:
        """The smallest room of an open row that is room at least; -1: none."""
        at, count = self.leaves + room, self.count
        while not count[at]:
            while at & 1:  # a right child: up
                at >>= 1
            if not at:
                return -1
            at += 1
            if at == 1 << (at.bit_length() - 1):  # past the last leaf of this level
                return -1
        while at < self.leaves:
            at = 2 * at if count[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit_decreasing(lengths: list[int], row: int) -> list[list[int]]:
    """Rows of piece numbers; no row exceeds ``row``, every piece stands in one."""
    tree, open_rows, out = RoomTree(row + 1), [[] for _ in range(row + 1)], []
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[piece]
        room = tree.least(n)
        if room < 0:
            at, room = len(out), row
            out.append([])
        else:
            at = open_rows[room].pop()
            tree.add(room, -1)
        out[at].append(piece)
        if room > n:
            open_rows[room - n].append(at)
            tree.add(room - n, 1)
    return out


def split(n: int, row: int) -> list[tuple[int, int]]:
    """Bounds of the pieces of n ids."""
    return [(a, min(a + row, n)) for a in range(0, n, row)]


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: int = ROW_TOKENS, shard_tokens: int = SHARD_TOKENS, vocabulary: str | None = None) -> DataFrame:
    """ROWS of the packed documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, context = byte_encoder(vocabulary), TaskContext.get()
        task, shard = context.partitionId() if context else 0, 0
        pieces: list[tuple[int | None, int, np.ndarray]] = []
        held = 0

        def packed() -> Iterator[pa.RecordBatch]:
            rows = best_fit_decreasing([len(p[2]) for p in pieces], row)
            for at in range(0, len(rows), 256):
                names, ids, sizes, cuts, owners, offsets = [], [], [], [], [], []
                for k, members in enumerate(rows[at : at + 256], at):
                    own = [pieces[m] for m in members]
                    cut = np.cumsum([0, *(len(p[2]) for p in own)])
                    matrix = np.full(row, PAD, dtype="<u2")
                    matrix[: cut[-1]] = np.concatenate([p[2] for p in own])
                    names.append(f"{task}-{shard}-{k}")
                    ids.append(matrix.tobytes())
                    sizes.append(int(cut[-1]))
                    cuts.append(cut.tolist())
                    owners.append([p[0] for p in own])
                    offsets.append([p[1] for p in own])
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(ids, pa.binary()), pa.array(sizes, pa.int32()), pa.array(cuts, ints), pa.array([c[:-1] for c in cuts], ints), pa.array(owners, pa.list_(pa.int64())), pa.array(offsets, pa.list_(pa.int64()))], names=["row_id", "ids", "n_tokens", "cu_seqlens", "position_resets", "doc_ids", "doc_offsets"])

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.array(encoder.encode(text), dtype=np.uint16) if text else np.zeros(0, np.uint16)
                    for a, b in split(len(ids), row):
                        pieces.append((doc, a, ids[a:b]))
                    held += len(ids)
                    if held >= shard_tokens:
                        yield from packed()
                        pieces, held, shard = [], 0, shard + 1
        if pieces:
            yield from packed()

    return docs.select(docs[id_col].cast("bigint"), docs[text_col]).mapInArrow(run, ROWS)


def write_rows(packed: DataFrame, path: str | None = None) -> DataFrame:
    """Writes packed rows as a Parquet table and reads it."""
    path = path or new_path(packed.sparkSession, "packed")
    packed.write.option("compression", "zstd").parquet(path)
    return packed.sparkSession.read.schema(packed.schema).parquet(path)


def unpack(packed: DataFrame) -> DataFrame:
    """(doc_id, doc_offset, ids array<int>) of the pieces, read from the matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, offsets, ids = [], [], []
            for r in batch.to_pylist():
                matrix, cut = np.frombuffer(r["ids"], dtype="<u2"), r["cu_seqlens"]
                docs += r["doc_ids"]
                offsets += r["doc_offsets"]
                ids += [matrix[a:b].astype(np.int32) for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(offsets, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "doc_offset", "ids"])

    return packed.mapInArrow(run, "doc_id bigint, doc_offset bigint, ids array<int>")


def row_digests(packed: DataFrame) -> DataFrame:
    """Packed rows with a digest of the matrix row in place of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest = pa.array([hashlib.sha256(b).hexdigest() for b in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), digest, *batch.columns[2:]], names=["row_id", "ids_sha256", *batch.schema.names[2:]])

    return packed.mapInArrow(run, ROWS.replace("ids binary", "ids_sha256 string"))
