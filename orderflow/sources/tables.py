"""Stored tables with a layout that readers prune by: logs by block bucket, bars by interval and period.

The layout lies beside the data (`_layout`, which readers of the data pass over), so a reader derives the
partition predicate from its own bounds: a block range reads the buckets that it touches, a range of bars
the periods of its interval. Within a file rows are sorted, so that row group statistics prune further.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.functions.scalars import INTERVALS

#: Blocks of a bucket of logs; bars (of one pool) of a period.
BUCKET_BLOCKS, PERIOD_BARS = 10_000, 10_000


def write_logs(logs: DataFrame, path: str, bucket_blocks: int = BUCKET_BLOCKS, mode: str = "errorifexists") -> None:
    """Stores logs by block bucket. Rows are dealt by ranges of (block, log index): a bucket with many rows
    is written by several tasks, and one task writes few buckets."""
    rows = logs.withColumn("block_bucket", F.floor(F.col("block_number") / bucket_blocks))
    rows.repartitionByRange("block_number", "log_index").sortWithinPartitions("block_bucket", "block_number", "log_index").write.mode(mode).partitionBy("block_bucket").parquet(path)
    logs.sparkSession.range(1).select(F.lit(bucket_blocks).alias("bucket_blocks")).write.mode("overwrite").parquet(f"{path}/_layout")


def scan_logs(spark: SparkSession, path: str, from_block: int, to_block: int, addresses: list[str] | None = None, topics: list[str] | None = None) -> DataFrame:
    """The logs of [from_block, to_block] of some contracts and signatures (all)."""
    width = spark.read.parquet(f"{path}/_layout").first()["bucket_blocks"]
    rows = spark.read.parquet(path).where(F.col("block_bucket").between(from_block // width, to_block // width) & F.col("block_number").between(from_block, to_block))
    for column, wanted in (("address", addresses), ("topic0", topics)):
        if wanted is not None:
            rows = rows.where(F.col(column).isin(*wanted))
    return rows.drop("block_bucket")


def _seconds(interval: str = "interval") -> F.Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in INTERVALS.items() for x in pair]), F.col(interval)).cast("bigint")


def write_candles(bars: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Stores bars by interval and period of PERIOD_BARS bars."""
    rows = bars.withColumn("period", F.floor(F.col("open_time") / (_seconds() * PERIOD_BARS)))
    rows.repartitionByRange("interval", "period", "pool_id", "open_time").sortWithinPartitions("interval", "period", "pool_id", "open_time").write.mode(mode).partitionBy("interval", "period").parquet(path)


def read_candles(spark: SparkSession, path: str, interval: str, *, pool: str | None = None, start: int | None = None, end: int | None = None, limit: int | None = None, newest: bool = False) -> DataFrame:
    """The bars of an interval that open in [start, end), ascending (the newest first), up to a limit."""
    rows, width = spark.read.parquet(path).where(F.col("interval") == interval), INTERVALS[interval] * PERIOD_BARS
    if pool is not None:
        rows = rows.where(F.col("pool_id") == pool)
    if start is not None:
        rows = rows.where((F.col("period") >= start // width) & (F.col("open_time") >= start))
    if end is not None:
        rows = rows.where((F.col("period") <= (end - 1) // width) & (F.col("open_time") < end))
    rows = rows.drop("period")
    return rows if limit is None else rows.orderBy(F.desc("open_time") if newest else F.col("open_time")).limit(limit)
