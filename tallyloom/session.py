"""Session settings that every entry point relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with UTC time, AQE and Arrow on; keyword arguments override settings (dots as ``__``)."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
    }
    base |= {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(master).appName("tallyloom")
    for k, v in base.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the given folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
