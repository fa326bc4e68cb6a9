"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model goes on past a white-space marker, so the marked words of a text (markers
first, then the letters up to the next marker) are segmented independently.  Each task keeps a table
of the distinct chunks that it has met; the library segments and decodes a chunk once, and texts are
put together by position from the table.  The table has a newer and an older half; when the newer one
is full, the older one goes.  That holds it to ``TABLE_CHUNKS`` chunks and changes no result.

The table is per task, not one for the corpus: joining ids back to every position of every text would
shuffle the corpus twice, while the table of a task already spares nearly all segmentation work.

Defined cases: a null or empty text has no tokens and decodes to the empty string; a very long chunk
is segmented whole; equal rows give equal results; other columns of docs
are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomveil.llm.shared import tidy

TABLE_CHUNKS = 250_000
TEXT_CHARS = 1_000_000
MARKER = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ChunkTable:
    """Segments texts as the model's library does, each distinct chunk once."""

    def __init__(self, model: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        proto = pb.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        pieces = [p.piece for p in proto.pieces]
        crossing = any(re.search(f"[^{MARKER}]{MARKER}", p) for p in pieces)
        #: whether chunks may be segmented apart; else whole texts go to the library
        self.apart = not crossing and not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces and norm.add_dummy_prefix and not proto.trainer_spec.treat_whitespace_as_suffix and all(p.type != 4 for p in proto.pieces)
        norm.add_dummy_prefix = False
        #: no piece holds a line feed, so that it stands alone as a byte, which ends a chunk as a marker does
        feed = not any("\n" in p for p in pieces)
        self.chunks = re.compile(f"{MARKER}*[^{MARKER}\n]+|{MARKER}+|\n" if feed else f"{MARKER}*[^{MARKER}]+|{MARKER}+").findall
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.table: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        #: decoded chunks, where they are not the chunk with spaces for markers
        self.odd: dict[str, str] = {}
        self.sizes: dict[str, int] = {}

    def _learn(self, chunks: list[str]) -> None:
        """Puts chunks into the table: from the older half, or by the library."""
        if len(self.table) + len(chunks) >= TABLE_CHUNKS // 2 and self.table:
            self.old, self.table = self.table, {}
        old, table = self.old, self.table
        fresh = [c for c in chunks if c not in old]
        ids = self.plain.encode(fresh, num_threads=1)
        for chunk, i, back in zip(fresh, ids, self.plain.decode(ids, num_threads=1)):
            table[chunk] = ",".join(map(str, i)).encode()
            if back != chunk.replace(MARKER, " "):
                self.odd[chunk] = back
        for chunk in chunks:
            if chunk in old:
                table[chunk] = old[chunk]

    def forget(self) -> None:
        """Empties the table: workers outlive their tasks."""
        self.table, self.old, self.odd, self.sizes = {}, {}, {}, {}

    def counts(self, texts: list[str | None]) -> list[int]:
        """The number of ids of each text."""
        if not self.apart:
            return [len(self.library.encode(t or "")) for t in texts]
        out = []
        for text in texts:
            chunks = self.chunks(MARKER + text.replace(" ", MARKER)) if text else []
            sizes = self.sizes
            missing = list({c for c in chunks if c not in sizes})
            if len(sizes) + len(missing) > TABLE_CHUNKS:
                sizes, missing = {}, list(set(chunks))
            sizes.update(zip(missing, map(len, self.plain.encode(missing, num_threads=1))))
            self.sizes = sizes
            out.append(sum(map(sizes.__getitem__, chunks)))
        return out

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, bytes, str]]:
        """(number of ids, decimal ids joined by commas, decoded text) of each text."""
        if not self.apart:
            for text in texts:
                ids = self.library.encode(text or "")
                yield len(ids), ",".join(map(str, ids)).encode(), self.library.decode(ids)
            return
        at = 0
        while at < len(texts):  # learn what some texts of bounded length need, then join by position
            pending, size, to = [], 0, at
            while to < len(texts) and (to == at or size + len(texts[to] or "") <= TEXT_CHARS):
                text = texts[to]
                size += len(text or "")
                pending.append(self.chunks(MARKER + text.replace(" ", MARKER)) if text else [])
                to += 1
            new: set[str] = set()
            for chunks in pending:
                new.update(chunks)
            if len(self.odd) > TABLE_CHUNKS:
                self.forget()
            held = self.table
            missing = [c for c in new if c not in held]
            if len(held) + len(missing) >= TABLE_CHUNKS // 2:
                missing = list(new)  # the table is about to become the older half
            self._learn(missing)
            known, odd = self.table, self.odd
            for chunks in pending:
                if not chunks:
                    yield 0, b"", ""
                    continue
                joined = b",".join([known[c] for c in chunks])
                if odd and not odd.keys().isdisjoint(chunks):
                    text = "".join([odd[c] if c in odd else c.replace(MARKER, " ") for c in chunks])
                else:
                    text = "".join(chunks).replace(MARKER, " ")
                yield joined.count(b",") + 1, joined, text[1:]
            at = to


@lru_cache(maxsize=2)
def chunk_table(model: str) -> ChunkTable:
    return ChunkTable(model)


def encode_ids(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded) of each row: the real output of the operator."""
    model = model or default_model()
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = list(table.encode(part.column(1).to_pylist()))
                ids = [[int(i) for i in joined.split(b",")] if joined else [] for _, joined, _ in out]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([o[2] for o in out], pa.string())], names=schema.names)
        table.forget()

    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, schema)


def encode_digests(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each row, without moving ids or texts."""
    model = model or default_model()
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def digest(data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, ids, back = [], [], []
                for count, joined, decoded in table.encode(part.column(1).to_pylist()):
                    n.append(count)
                    ids.append(digest(joined))
                    back.append(digest(decoded.encode()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=schema.names)
        table.forget()

    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, schema)
