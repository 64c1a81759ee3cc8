"""What the operators of this subpackage share: tables, cut lineage, files that all executors see, components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset (tests), a temporary folder of this machine, which on
    a cluster would be another one for each executor: an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="tallyloom-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """df, written once to the shared folder and read again: lost executors cost no recomputation of what lies before."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Bytes of an Arrow batch that are unpacked at once.
UNPACKED = 4 << 20


def small(batches: Iterator[pa.RecordBatch], size: int = UNPACKED) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes, one row at least: a batch of thousands of texts is not unpacked,
    worked on and packed again as a whole."""
    for batch in batches:
        step = max(1, batch.num_rows * size // max(1, batch.nbytes))
        for at in range(0, max(1, batch.num_rows), step):
            yield batch.slice(at, step)
    give_back()


def give_back() -> None:
    """Returns what this worker no longer uses to the machine: workers serve many stages, and what one leaves behind would
    be held beside the next one's tables."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


class Store:
    """A folder of files behind a URI, for code that runs in tasks. A file appears whole under its name or not at all,
    so a repeated or speculative attempt only replaces equal bytes."""

    def __init__(self, uri: str):
        parsed = urlparse(uri)
        self.local = parsed.scheme in ("", "file")
        if self.local:
            self.root, self.fs = parsed.path, None
        else:
            self.fs, self.root = pafs.FileSystem.from_uri(uri)

    @contextmanager
    def create(self, name: str) -> Iterator:
        final, part = f"{self.root}/{name}", f"{self.root}/.{name}.{uuid.uuid4().hex}"
        if self.local:
            os.makedirs(self.root, exist_ok=True)
            with open(part, "wb") as f:
                yield f
            os.replace(part, final)
        else:
            self.fs.create_dir(self.root, recursive=True)
            with self.fs.open_output_stream(part) as f:
                yield f
            self.fs.move(part, final)

    def open(self, name: str):
        path = f"{self.root}/{name}"
        return open(path, "rb") if self.local else self.fs.open_input_file(path)


def components(edges: DataFrame, label: str, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges; root is the least node reachable.

    Every round replaces each node's label by the least label of its neighbours and then follows labels once more, on
    tables written to the shared folder. Hubs are aggregated before the shuffle; the joins are plain equi-joins, whose
    hot keys AQE can split. Only a count of changed rows reaches the driver.
    """
    edges = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), f"{label}-edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), f"{label}-0")
    for n in range(1, max_rounds + 1):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        low = labels.join(near, "node", "left").select("node", "root", F.least("root", F.coalesce("near", "root")).alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("far"))
        done = cut(low.join(jump, "low", "left").select("node", F.col("root").alias("was"), F.least("low", F.coalesce("far", "low")).alias("root")), f"{label}-{n}")
        changed = done.where("was <> root").limit(1).count()
        labels = done.select("node", "root")
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return labels
