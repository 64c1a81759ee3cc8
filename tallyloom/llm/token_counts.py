"""Token counts kept as additive rollups, changed by signed deltas.

A commit is a batch of changes, (sign, source, lang, tokenizer, docs, tokens): inserts +, deletes -, a revised count as
the old one - and the new one +. It is summed by key and written to a folder named after the batch; a batch whose folder
is complete is not written again, so a repeated commit changes nothing. Totals are sums over the committed folders.
compact() folds the folders committed when it starts, and no others, into a snapshot that remembers their names;
vacuum() deletes folders that the snapshot before the last one holds already, so readers that began under the last one
still find theirs. Names of batches stay in tables: the driver sees those of folders not yet vacuumed.

Defined cases: null sources, languages and texts are values of their own (a null text has no tokens); repeated rows
count each; an empty batch is committed and adds nothing; keys whose documents are all gone drop out of the totals.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import cut, new_folder, small, table
from tallyloom.llm.tokens import AT_ONCE, encoder, slices, vocabulary

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"


class Rollup:
    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, uri.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.uri}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _done(self, name: str) -> bool:
        fs, path = self._path(f"{name}/_SUCCESS")
        return fs.exists(path)

    def _names(self, prefix: str) -> list[str]:
        fs, path = self._path("")
        found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n for n in found if n.startswith(prefix))

    def _snapshots(self) -> list[str]:
        """The whole snapshots, latest first."""
        return [n for n in reversed(self._names("snapshot=")) if self._done(f"{n}/batches")]

    def _held(self, snapshot: str | None, batches: list[str]) -> set[str]:
        """Which of these batches the snapshot holds."""
        if not snapshot or not batches:
            return set()
        listed = self.spark.read.schema("batch string").parquet(f"{self.uri}/{snapshot}/batches")
        return {r.batch for r in listed.where(F.col("batch").isin(batches)).collect()}

    def _state(self) -> tuple[str | None, list[str]]:
        """The latest snapshot, and the committed batches that it does not hold."""
        snapshot = next(iter(self._snapshots()), None)
        there = [n.removeprefix("batch=") for n in self._names("batch=") if self._done(n)]
        held = self._held(snapshot, there)
        return snapshot, [n for n in there if n not in held]

    def committed(self, batch: str) -> bool:
        """A batch is committed when Spark's writer has finished its folder, or when a snapshot holds it."""
        return self._done(f"batch={batch}") or bool(self._held(next(iter(self._snapshots()), None), [batch]))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """True if the batch was new. changes has KEYS, sign, docs and tokens."""
        if self.committed(batch):
            return False
        signed = changes.groupBy(*KEYS).agg(F.sum(F.col("sign") * F.col("docs")).cast("long").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).cast("long").alias("tokens"))
        signed.write.mode("overwrite").parquet(f"{self.uri}/batch={batch}")
        return True

    def _deltas(self, snapshot: str | None, batches: list[str]) -> DataFrame:
        folders = [f"{self.uri}/{snapshot}/totals"] * bool(snapshot) + [f"{self.uri}/batch={n}" for n in batches]
        return self.spark.read.schema(SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMA)

    def deltas(self) -> DataFrame:
        return self._deltas(*self._state())

    @staticmethod
    def _sums(deltas: DataFrame) -> DataFrame:
        return deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")

    def totals(self) -> DataFrame:
        return self._sums(self.deltas())

    def compact(self) -> None:
        """Folds what is committed now into a snapshot: totals and names come from the same list of folders, so a commit
        meanwhile is left to the next one. The snapshot counts from the moment its names are whole, which come last."""
        snapshot, batches = self._state()
        new = f"snapshot={int(snapshot.removeprefix('snapshot=')) + 1 if snapshot else 0:08d}"
        self._sums(self._deltas(snapshot, batches)).write.mode("overwrite").parquet(f"{self.uri}/{new}/totals")
        names = self.spark.createDataFrame([(n,) for n in batches], "batch string")
        if snapshot:
            names = names.unionByName(self.spark.read.schema("batch string").parquet(f"{self.uri}/{snapshot}/batches"))
        names.write.mode("overwrite").parquet(f"{self.uri}/{new}/batches")

    def vacuum(self) -> int:
        """Deletes folders of batches that the last snapshot but one holds; how many went."""
        there = [n.removeprefix("batch=") for n in self._names("batch=")]
        gone = self._held(next(iter(self._snapshots()[1:]), None), there)
        for n in gone:
            fs, path = self._path(f"batch={n}")
            fs.delete(path, True)
        return len(gone)


def counts(docs: DataFrame, path: str, extra: tuple[str, ...] = ("source", "lang"), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, extra columns, text_key, bpe, words): token counts of every whole text by two tokenizers."""

    def count(batches):
        for batch in small(batches):
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            bpe = [len(ids) // 4 for a, b in slices(texts, AT_ONCE) for ids in encoder(path).ids(texts[a:b])]
            words = [len(t.encode().split()) for t in texts]
            kept = [batch.column(c) for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(bpe, pa.int64()), pa.array(words, pa.int64())], names=[*[c for c in batch.schema.names if c != "_text"], "bpe", "words"])

    held = docs.select(F.col(key).cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in extra], F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("text_key"), F.col(text).alias("_text"))
    schema = "doc_id long, " + "".join(f"{c} string, " for c in extra) + "text_key string, bpe long, words long"
    return held.mapInArrow(count, schema)


BPE, WORDS, BPE_END = "word_bpe_49k@1", "words@1", "word_bpe_49k@2"


def changes(counted: DataFrame, sign: int, tokenizer: str, tokens) -> DataFrame:
    return counted.select(F.lit(sign).alias("sign"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col("docs") if "docs" in counted.columns else F.lit(1).alias("docs"), tokens.alias("tokens"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four commits: all documents inserted; counts revised to tokenizer version 2, which ends every
    document with one more id; every later copy of a text deleted; and the revision once more, which changes nothing."""
    counted = cut(counts(table(spark, sf_dir, "documents"), vocabulary()), "token-counts")
    rollup = Rollup(spark, new_folder(spark, "token-rollup"))
    rollup.commit("insert", changes(counted, 1, BPE, F.col("bpe")).unionByName(changes(counted, 1, WORDS, F.col("words"))))
    revised = changes(counted, -1, BPE, F.col("bpe")).unionByName(changes(counted, 1, BPE_END, F.col("bpe") + 1))
    rollup.commit("revise", revised)
    same = counted.groupBy("text_key", "source", "lang").agg(F.count("*").alias("n"), F.max("bpe").alias("bpe"), F.max("words").alias("words"), F.min("doc_id").alias("first"))
    kept = same.groupBy("text_key").agg(F.min(F.struct("first", "source", "lang")).alias("kept"))
    is_kept = F.col("source").eqNullSafe(F.col("kept.source")) & F.col("lang").eqNullSafe(F.col("kept.lang"))
    gone = same.join(kept, "text_key").withColumn("docs", F.col("n") - is_kept.cast("long"))
    rollup.commit("copies", changes(gone, -1, BPE_END, F.col("docs") * (F.col("bpe") + 1)).unionByName(changes(gone, -1, WORDS, F.col("docs") * F.col("words"))))
    rollup.commit("revise", revised)
    return rollup.totals()
