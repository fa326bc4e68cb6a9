"""A job of prompts that can stop and go on: prompts, replies and errors as rows, reduced until one is left.

Each theme's documents are cut into batches.  One batch makes a single prompt; more make a prompt each, and
their replies are joined ``fan`` at a time by prompts of the next level, until one reply is left.  A prompt's id
is the digest of its text and place, so planning again adds nothing, and a run after a stop asks only what has
no reply.  A reply that holds no JSON is an error of its row; after ``tries`` errors the row is given up and
its theme has no result, while all others go on.  The model is a function of a DataFrame of prompts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomveil.operators import insights as I
from loomveil.sources.snapshots import SnapshotTable

ROWS = "prompt_id string, theme string, level int, node int, n_nodes int, n_docs bigint, prompt string, reply string, error string, tries int"
SINGLE = "Read the answers on {theme_name} and summarise them as JSON.\n\nResponses:\n"
BATCH = "Read batch {n} of {total} of the answers on {theme_name} and summarise it as JSON.\n\nResponses:\n"
REDUCE = "Join the summaries of {docs} answers on {theme_name} to one, as JSON:\n"


def filled(head: str, **values) -> F.Column:
    out = F.lit(head)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


class Ledger:
    def __init__(self, spark: SparkSession, path: str, fan: int = 20, tries: int = 3):
        self.table, self.fan, self.tries = SnapshotTable(spark, path, ROWS), fan, tries

    def rows(self) -> DataFrame:
        return self.table.load()

    def _add(self, prompts: DataFrame, note: str) -> None:
        fresh = prompts.withColumn("prompt_id", F.sha2(F.concat_ws("\n", "theme", "level", "node", "prompt"), 256))
        fresh = fresh.withColumns({"reply": F.lit(None).cast("string"), "error": F.lit(None).cast("string"), "tries": F.lit(0)})
        self.table.commit(lambda now: now.unionByName(fresh.join(now.select("prompt_id"), "prompt_id", "left_anti").select(now.columns)), note)

    def plan(self, docs: DataFrame, order: list, size: int = I.BATCH_DOCS, cap: int | None = I.MAX_DOCS) -> None:
        """Prompts of (theme, text, ...): at most cap documents of a theme, in order, size to a batch."""
        numbered = I.number_batches(docs, "theme", order, size, cap)
        batches = numbered.groupBy("theme", "batch_no").agg(F.array_sort(F.collect_list(F.struct("rn", F.col("text").alias("d")))).alias("docs"))
        totals = batches.groupBy("theme").agg(F.count(F.lit(1)).alias("total"))
        lines = F.array_join(F.transform("docs", lambda d: F.concat(F.lit("- "), F.coalesce(d["d"], F.lit("")), F.lit("\n"))), "")
        head = F.when(F.col("total") == 1, filled(SINGLE, theme_name=F.col("theme"))).otherwise(filled(BATCH, n=F.col("batch_no") + 1, total=F.col("total"), theme_name=F.col("theme")))
        made = batches.join(totals, "theme").select("theme", F.lit(0).alias("level"), F.col("batch_no").cast("int").alias("node"), F.col("total").cast("int").alias("n_nodes"), F.size("docs").cast("bigint").alias("n_docs"), F.concat(head, lines).alias("prompt"))
        self._add(made, "plan")

    def pending(self) -> DataFrame:
        """(prompt_id, theme, level, node, prompt) of rows that have no reply and are not given up."""
        return self.rows().where(F.col("reply").isNull() & (F.col("tries") < self.tries)).select("prompt_id", "theme", "level", "node", "prompt")

    def record(self, answers: DataFrame) -> None:
        """Takes answers (prompt_id, reply, error); of several for a prompt one with a reply is taken."""
        json = F.nullif(F.regexp_extract("reply", r"\{[\s\S]*\}", 0), F.lit(""))
        good = F.when(F.try_parse_json(json).isNotNull(), json)
        checked = answers.select("prompt_id", good.alias("new"), F.coalesce("error", F.lit("the reply holds no JSON")).alias("problem"))
        one = checked.groupBy("prompt_id").agg(F.min("new").alias("new"), F.min("problem").alias("problem"))

        def change(now: DataFrame) -> DataFrame:
            both = now.join(one, "prompt_id", "left")
            asked, open_ = F.col("problem").isNotNull(), F.col("reply").isNull()
            return both.withColumns({
                "error": F.when(open_ & asked, F.when(F.col("new").isNull(), F.col("problem"))).otherwise(F.col("error")),
                "tries": F.when(open_ & asked, F.col("tries") + 1).otherwise(F.col("tries")),
                "reply": F.coalesce("reply", "new"),
            })

        self.table.commit(change, "record")

    def reduce(self) -> None:
        """Prompts of the next level of themes whose highest level is answered and has several nodes."""
        rows = self.rows()
        top = rows.groupBy("theme").agg(F.max("level").alias("level"))
        level = rows.join(top, ["theme", "level"])
        done = level.groupBy("theme").agg((F.count("reply") == F.max("n_nodes")).alias("whole"), F.max("n_nodes").alias("n")).where("whole and n > 1")
        node = F.floor(F.col("node") / self.fan).cast("int")
        joined = level.join(done.select("theme", "n"), "theme").groupBy("theme", "level", "n", node.alias("to")).agg(F.array_sort(F.collect_list(F.struct("node", "reply"))).alias("parts"), F.sum("n_docs").alias("docs"))
        body = F.concat(F.lit("["), F.array_join(F.transform("parts", lambda p: p["reply"]), ","), F.lit("]"))
        made = joined.select("theme", (F.col("level") + 1).alias("level"), F.col("to").alias("node"), F.ceil(F.col("n") / self.fan).cast("int").alias("n_nodes"), F.col("docs").alias("n_docs"), F.concat(filled(REDUCE, docs=F.col("docs"), theme_name=F.col("theme")), body).alias("prompt"))
        self._add(made, "reduce")

    def results(self, schema: str) -> DataFrame:
        """(theme, n_docs, reply, parsed, error): of every theme the last reply, or what stopped it."""
        rows = self.rows()
        last = rows.where((F.col("n_nodes") == 1) & F.col("reply").isNotNull()).groupBy("theme").agg(F.max(F.struct("level", "n_docs", "reply")).alias("r"))
        stuck = rows.where(F.col("reply").isNull()).groupBy("theme").agg(F.min("error").alias("error"))
        out = rows.select("theme").distinct().join(last, "theme", "left").join(stuck, "theme", "left")
        return out.select("theme", "r.n_docs", "r.reply", I.parse_reply(F.col("r.reply"), schema).alias("parsed"), "error")

    def run(self, answer: Callable[[DataFrame], DataFrame]) -> int:
        """Asks until nothing is left to ask; returns the number of rounds."""
        rounds = 0
        while True:
            self.reduce()
            if self.pending().isEmpty():
                return rounds
            self.record(answer(self.pending()))
            rounds += 1


def summary_documents(docs: DataFrame, theme: str, query: list[float] | None = None, key: str = "id", where: F.Column | None = None, n: int = 500) -> DataFrame:
    """(theme, text, distance, ...) of what a summary is made from: a theme's own documents (theme_idx and
    distance given), or those nearest to a query of its own; filtered either way."""
    from loomveil.operators import vectors as V

    kept = docs if where is None else docs.where(where)
    if query is not None:
        return V.nearest(kept, query, n, key).withColumn("theme", F.lit(theme))
    return kept.where(F.col("theme") == theme)
