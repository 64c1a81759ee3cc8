"""Balanced contiguous shards from global byte-size prefix sums.

Rows are dealt into ranges of (doc_id, checksum, size); every range reports its total; prefix sums over those totals give
each range its base, a running sum inside the range gives each row its global byte position, and equal targets over the
grand total cut the line of rows. Only the totals, one row per range, reach the driver.

Defined cases: a null text counts as empty (size 1, checksum 0); null ids come first; repeated rows keep their number
and are told apart by position only; an empty table gives an empty result; other columns are ignored unless carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import cut, partitions, table

#: The law that holds for shards cut at equal byte targets.
LAW = "bytes"


def global_order(df: DataFrame, keys: list[str], weight: str, label: str) -> tuple[DataFrame, int, int]:
    """df with row_index and weight_before, counted from 0 over all rows in the order of keys; rows and weight in all.

    df is dealt by range and written to the shared folder once, so the ranges stay what they are when tasks repeat.
    """
    spark = df.sparkSession
    ranged = cut(df.repartitionByRange(partitions(spark), *keys).withColumn("_part", F.spark_partition_id()), label)
    totals = ranged.groupBy("_part").agg(F.count("*").alias("n"), F.sum(weight).alias("w")).collect()
    bases, rows, total = [], 0, 0
    for part, n, w in sorted(totals):
        bases.append((part, rows, total))
        rows, total = rows + n, total + w
    base = spark.createDataFrame(bases or [(0, 0, 0)], "_part int, _rows long, _weight long")
    inside = Window.partitionBy("_part").orderBy(*keys)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = (
        ranged.withColumn("_i", F.row_number().over(inside))
        .withColumn("_w", F.sum(weight).over(so_far))
        .join(F.broadcast(base), "_part")  # a row per range
        .withColumn("row_index", F.col("_rows") + F.col("_i") - 1)
        .withColumn("weight_before", F.col("_weight") + F.col("_w") - F.col(weight))
        .drop("_part", "_rows", "_weight", "_i", "_w")
    )
    return out, rows, total


def shard(docs: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, carried columns) for every row.

    A row belongs to the shard that holds the middle of its byte span, so shard sizes differ from the target by half a
    row at either end. slot counts the shard's rows from 0 in order. grown_shard is null: the law speaks of bytes.
    """
    held = F.coalesce(F.col(text), F.lit(""))
    sized = docs.select(F.col(key).alias("doc_id"), (F.octet_length(held) + F.lit(1)).cast("long").alias("size"), F.crc32(held.cast("binary")).alias("text_crc32"), *[F.col(c).alias(f"carried_{c}") for c in carry])
    placed, _, total = global_order(sized, ["doc_id", "text_crc32", "size"], "size", "shard-sizes")
    middle = (F.col("weight_before") * 2 + F.col("size")) * n_shards
    whole = F.call_function("div", middle, F.lit(max(1, 2 * total)).cast("long"))
    cut_rows = cut(placed.withColumn("shard", F.least(whole, F.lit(n_shards - 1)).cast("int")), "shard-rows")
    first = {s: i for s, i in cut_rows.groupBy("shard").agg(F.min("row_index")).collect()}
    start = F.create_map(*[F.lit(x) for s in range(n_shards) for x in (s, first.get(s, 0))])
    return cut_rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        (F.col("row_index") - start[F.col("shard")]).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(f"carried_{c}") for c in carry],
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """The shards as folders shard=0, shard=1, ...; rows arrive in order, so no further exchange is needed."""
    sharded.write.partitionBy("shard").parquet(path)


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
