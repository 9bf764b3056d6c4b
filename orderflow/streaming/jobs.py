"""Structured Streaming jobs: live candles, idempotent trades, debounce, and re-folded tables.

Candles and the deduplication are stateful operators with watermarks. Order and balance folds need
their key's events in log order, and a micro-batch may bring late rows; so each batch appends its
events and re-folds the touched keys alone from their history, which is exact for any arrival order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from orderflow.functions.scalars import seq_of
from orderflow.operators.trades import vwap

GRACE = "1 hour"


def timed(trades: DataFrame) -> DataFrame:
    return trades.withColumn("event_time", F.timestamp_seconds("ts"))


def dedup(trades: DataFrame, grace: str = GRACE) -> DataFrame:
    return timed(trades).withWatermark("event_time", grace).dropDuplicatesWithinWatermark(["tx_hash", "log_index"])


def candles(trades: DataFrame, seconds: int, grace: str = GRACE, *, repeated: bool = False) -> DataFrame:
    """Bars of one interval; update mode shows live bars, append mode closed ones. Replays would count
    twice: `repeated` drops them first, which needs append mode; live bars are to be made from a stream
    that has been through `dedup`."""
    rows = dedup(trades, grace) if repeated else timed(trades).withWatermark("event_time", grace)
    rows = rows.where("price <> 0 and quantity <> 0").withColumn("seq", seq_of(F.col("block_number"), F.col("log_index")))
    quote = F.col("price") * F.col("quantity")
    taker = lambda c: F.sum(F.when(F.col("taker_side") == "BUY", c).otherwise(0))
    bars = rows.groupBy("pool_id", F.window("event_time", f"{seconds} seconds").alias("w")).agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.sum("quantity").alias("volume"), F.sum(quote).alias("quote_volume"), F.count("*").alias("count"),
        taker(F.col("quantity")).alias("taker_buy_base_volume"), taker(quote).alias("taker_buy_quote_volume"), F.lit(0.0).alias("volume_usd"), vwap(F.sum(quote), F.sum("quantity")).alias("average"),
    )
    return bars.select("pool_id", F.unix_seconds("w.start").alias("open_time"), F.unix_seconds("w.end").alias("close_time"), *[c for c in bars.columns if c not in ("pool_id", "w")])


def debounced(events: DataFrame, quiet: str = "1 second", grace: str = GRACE) -> DataFrame:
    """The latest event of each burst of a key: bursts end with a quiet gap."""
    rows = timed(events).withWatermark("event_time", grace)
    return rows.groupBy("channel", F.session_window("event_time", quiet).alias("w")).agg(F.max_by("data", "seq").alias("data"), F.count("*").alias("events")).select("channel", F.unix_seconds("w.start").alias("first"), "data", "events")


def refolding(events: DataFrame, keys: list[str], log_path: str, fold: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], buckets: int = 256) -> DataStreamWriter:
    """A writer that appends each batch to the log and hands `write` the folded rows of touched keys.

    A batch's rows go to a folder of its own number, so a repeated batch replaces itself. The log is kept by
    buckets of the keys' hash, and only the buckets that a batch touches are read again."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def batch(frame: DataFrame, number: int) -> None:
        frame.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{log_path}/batch={number}")
        touched = frame.select(*keys).distinct().persist()
        here = [r.bucket for r in touched.select(bucket.alias("bucket")).distinct().collect()]
        if here:
            whole = frame.sparkSession.read.schema(T.StructType([*frame.schema.fields, T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])).parquet(log_path)
            write(fold(whole.where(F.col("bucket").isin(here)).drop("batch", "bucket").join(touched, keys, "left_semi")), number)
        touched.unpersist()

    return events.writeStream.foreachBatch(batch)
