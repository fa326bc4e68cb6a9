"""Token totals by source, language and tokenizer version, kept up to date by deltas.

A batch of changes holds inserts, deletes and revisions.  Each change becomes signed rows: an insert
adds its counts, a delete takes them away, a revision does both.  The signed rows of a batch are summed
by key (with partial aggregation, so that a hot source is no hot task) and stored as one commit in a
folder of its own.  A commit is written in full before its marker, a file named by the batch that must not
exist before (the store's create-if-absent), and committing a batch again does nothing, so a repeated or
broken run counts nothing twice, and of two writers of one batch one wins.  Totals are the sum of all
commits; ``compact`` folds commits into one, which goes on to stand for the batches that it holds.

Defined cases: null texts have no tokens; null sources, languages and versions are keys of their own;
the order of changes within a batch is of no effect; repeated rows count again; an empty batch is a
commit without rows; a batch has a name of letters, digits, ``.``, ``_`` and ``-`` that starts with a letter or
digit, any other is refused; keys without documents and counts left are dropped from the totals; other columns
are not looked at.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomveil.llm.packing import byte_encoder
from loomveil.llm.sentences import chunk_table, default_model

KEYS = ["source", "lang", "tokenizer"]
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")
SUMS = ["n_docs", "n_tokens", "n_chars"]
COUNTED = "doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint, n_chars bigint"
DELTA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint, n_chars bigint"


def count_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """COUNTED rows: one for each document and tokenizer version."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = byte_encoder(), chunk_table(default_model())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(3).to_pylist()
                chars = pa.array([len(t or "") for t in texts], pa.int64())
                counts = {"byte_bpe_50k": [len(encoder.encode(t)) if t else 0 for t in texts], "piece_bpe_32k": table.counts(texts)}
                for version, n in counts.items():
                    yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([version] * len(texts)), pa.array(n, pa.int64()), chars], names=["doc_id", "source", "lang", "tokenizer", "n_tokens", "n_chars"])
        table.forget()

    return docs.select(docs["doc_id"].cast("bigint"), "source", "lang", docs[text_col]).mapInArrow(run, COUNTED)


def signed(counted: DataFrame, sign: int) -> DataFrame:
    """DELTA rows that add (1) or take away (-1) counted documents."""
    return counted.select(*KEYS, F.lit(sign).cast("bigint").alias("n_docs"), (sign * F.col("n_tokens")).alias("n_tokens"), (sign * F.col("n_chars")).alias("n_chars"))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """DELTA rows that replace the counts of documents."""
    return signed(before, -1).unionByName(signed(after, 1))


class Rollup:
    """Additive totals in a folder of commits."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _marks(self) -> dict[str, dict]:
        """What the marker of each commit says: where its rows are, and which batches it stands for."""
        fs, at = self._fs(f"{self.folder}/commits")
        out = {}
        for status in fs.listStatus(at) if fs.exists(at) else []:
            stream = fs.open(status.getPath())
            try:
                out[status.getPath().getName()] = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            except ValueError:
                pass  # a writer was lost before its marker was whole
            finally:
                stream.close()
        return out

    def batches(self) -> list[str]:
        """All batches that count, folded ones too."""
        marks = self._marks()
        return sorted({*marks, *(b for m in marks.values() for b in m["folded"])})

    def commit(self, batch: str, delta: DataFrame, folded: list[str] = []) -> bool:
        """Stores the sums of a batch of DELTA rows; False if the batch is there already."""
        if not _NAME.fullmatch(batch):
            raise ValueError(f"not a name of a batch: {batch!r}")
        if batch in self.batches():
            return False
        data = f"{self.folder}/data/{batch}-{uuid.uuid4().hex}"
        delta.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS)).where(" or ".join(f"{c} <> 0" for c in SUMS)).write.parquet(data)
        fs, at = self._fs(f"{self.folder}/commits/{batch}")
        fs.mkdirs(at.getParent())
        broken = fs.exists(at) and batch not in self._marks()
        try:
            stream = fs.create(at, broken)
        except Py4JJavaError:
            if not fs.exists(at):
                raise
            fs.delete(self._fs(data)[1], True)  # another writer was first
            return False
        stream.write(bytearray(json.dumps({"data": data, "folded": folded}).encode()))
        stream.close()
        return True

    def totals(self) -> DataFrame:
        paths = [m["data"] for m in self._marks().values()]
        rows = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        return rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS)).where(" or ".join(f"{c} <> 0" for c in SUMS))

    def compact(self, into: Rollup, name: str = "base") -> bool:
        """Commits the totals as one batch of another rollup, which from then on refuses the batches in it."""
        return into.commit(name, self.totals(), self.batches())
