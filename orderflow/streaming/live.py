"""A live feed end to end: log files in, decoded tables and progress out; late trades; observed metrics."""

from __future__ import annotations

import threading
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener
from pyspark.sql.window import Window

from orderflow.functions.scalars import INTERVALS, bucket_open, ident
from orderflow.operators import decode, sinks, trades
from orderflow.operators.reconcile import insert_ignore

#: Schema of a log line; a line that is none is kept in `_corrupt_record`.
LOG = "address string, topics array<string>, data string, block_number bigint, tx_hash string, log_index bigint, _corrupt_record string"


def log_lines(logs: DataFrame) -> DataFrame:
    """Logs as JSON lines (`value`)."""
    topics = F.array_compact(F.array("topic0", "topic1", "topic2", "topic3"))
    return logs.select(F.to_json(F.struct("address", topics.alias("topics"), "data", "block_number", "tx_hash", "log_index")).alias("value"))


def log_source(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The stream of log files of a folder."""
    reader = spark.readStream.schema(LOG).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    rows = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(path)
    return rows.select("address", *[F.get("topics", F.lit(i)).alias(f"topic{i}") for i in range(4)], "data", "block_number", "tx_hash", "log_index", "_corrupt_record")


# Routing

_KEYS = ["block_number", "log_index", "tx_hash", "address"]


def _events(logs: DataFrame, names: tuple[str, ...], signatures: dict[str, str], columns: dict[str, tuple[str, ...]]) -> DataFrame:
    """The decoded rows of some event types under common names; the first known of the given fields counts."""
    out = None
    for name in names:
        rows = decode.decode(logs.where(F.col("topic0") == signatures[name]), name).where("not overflow")
        value = lambda options, rows=rows: next((F.col(c).cast("string") for c in options if c in rows.columns), F.lit(None).cast("string"))
        rows = rows.select(*_KEYS, F.lit(name).alias("event_type"), *[value(options).alias(c) for c, options in columns.items()])
        out = rows if out is None else out.unionByName(rows)
    return out


def routed(signatures: dict[str, str]) -> dict[str, sinks.Table]:
    """The tables that a batch of logs is split into: by signature, with what can't be decoded apart."""
    known = list(signatures.values())
    good = lambda b: b.where("_corrupt_record is null")
    of = lambda names, **columns: lambda b: _events(good(b), names, signatures, columns)

    def quarantined(batch: DataFrame) -> DataFrame:
        bad = batch.where("_corrupt_record is not null").select(F.lit("corrupt").alias("reason"), F.sha2("_corrupt_record", 256).alias("id"), F.col("_corrupt_record").alias("raw"))
        rest = good(batch).where(F.col("topic0").isNull() | ~F.col("topic0").isin(*known))
        kept = lambda reason, rows: rows.select(F.lit(reason).alias("reason"), ident("tx_hash", "log_index").alias("id"), F.col("data").alias("raw"))
        return bad.unionByName(kept("unknown", rest)).unionByName(kept("overflow", decode.lost(good(batch), signatures)))

    key = ["tx_hash", "log_index"]
    return {
        "pools": sinks.Table(of(decode.POOL_EVENTS, pool_id=("pool_id",), order_book=("order_book",), base_currency=("base_currency",), quote_currency=("quote_currency",)), key),
        "orders": sinks.Table(of(("OrderPlaced", "UpdateOrder", "OrderCancelled"), order_id=("order_id",), user=("user",), side=("side",), price=("price",), quantity=("quantity",), filled=("filled",), status=("status",)), key),
        "trades": sinks.Table(of(("OrderMatched",), user=("user",), side=("side",), ts=("timestamp",), price=("execution_price",), quantity=("executed_quantity",), buy_order_id=("buy_order_id",), sell_order_id=("sell_order_id",)), key),
        "balances": sinks.Table(of(decode.BALANCE_EVENTS, user=("user", "sender"), receiver=("receiver",), token_id=("id",), amount=("amount",), fee_amount=("fee_amount",)), key),
        "quarantine": sinks.Table(quarantined, ["reason", "id"]),
        "progress": sinks.Table(lambda b: good(b).groupBy().agg(F.max("block_number").alias("block")).where("block is not null").select(F.lit("live").alias("name"), "block"), ["name"], order="block"),
    }


def follow_logs(spark: SparkSession, source: str, path: str, signatures: dict[str, str], files_per_batch: int | None = None) -> DataStreamWriter:
    """A writer that routes the log files of a folder to the tables below `path`, all in one pass of a batch."""
    sink = sinks.write_tables(path, routed(signatures))
    return log_source(spark, source, files_per_batch).writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/_checkpoint")


# Late trades


class Bars:
    """Bars of one interval below `path` from batches of trades in any order.

    Trades are appended to a log that is partitioned by stretches of time, replays dropped. Trades after
    the watermark (the latest time of the batches before, less the grace) leave partial bars, which
    compose. Trades at or before it are late: of the bars that they touch, and of these alone, the whole
    bar is made again from the log, and replaces what is there. A repeated batch replaces itself."""

    STRETCH = 64

    def __init__(self, spark: SparkSession, path: str, interval: str, schema: T.StructType, grace: int = 3600):
        self.spark, self.path, self.interval, self.schema, self.grace = spark, path, interval, schema, grace
        self.seconds = INTERVALS[interval]

    def _partials(self, rows: DataFrame) -> DataFrame:
        return trades.partial_bars(trades.candle_input(rows), open_time=bucket_open(F.col("ts"), self.seconds)).withColumn("interval", F.lit(self.interval))

    def _read(self, name: str, like: DataFrame | T.StructType, before: int | None = None) -> DataFrame:
        rows = sinks.stored(self.spark, f"{self.path}/{name}", like if isinstance(like, T.StructType) else like.schema)
        return rows if before is None else rows.where(F.col("batch") < before)

    def __call__(self, batch: DataFrame, number: int) -> None:
        stretch = F.floor(F.col("ts") / (self.seconds * self.STRETCH)).alias("stretch")
        rows = trades.dedup(batch).select("*", stretch).persist()
        touched = [r.stretch for r in rows.select("stretch").distinct().collect()]
        log = T.StructType([*self.schema.fields, T.StructField("stretch", T.LongType())])
        known = self._read("log", log, number).where(F.col("stretch").isin(touched)).drop("batch")
        fresh = insert_ignore(known, rows, ["tx_hash", "log_index"])
        fresh.write.mode("overwrite").partitionBy("stretch").parquet(f"{self.path}/log/batch={number}")
        rows.unpersist()
        fresh = self.spark.read.schema(log).parquet(f"{self.path}/log/batch={number}")
        mark = self._read("marks", T.StructType([T.StructField("mark", T.LongType())]), number).agg(F.max("mark")).first()[0]
        late = fresh.where(F.lit(mark is not None) & (F.col("ts") <= F.lit(mark or 0)))
        self._partials(fresh.where(~(F.lit(mark is not None) & (F.col("ts") <= F.lit(mark or 0)))).drop("stretch")).write.mode("overwrite").parquet(f"{self.path}/partials/batch={number}")
        bars = late.select("pool_id", bucket_open(F.col("ts"), self.seconds).alias("open_time")).distinct()
        late_stretches = [r.stretch for r in late.select("stretch").distinct().collect()]
        whole = self._read("log", log).where((F.col("batch") <= number) & F.col("stretch").isin(late_stretches)).withColumn("open_time", bucket_open(F.col("ts"), self.seconds))
        self._partials(whole.join(bars, ["pool_id", "open_time"], "left_semi").select(self.schema.fieldNames())).write.mode("overwrite").parquet(f"{self.path}/whole/batch={number}")
        fresh.agg((F.max("ts") - self.grace).cast("bigint").alias("mark")).where("mark is not null").write.mode("overwrite").parquet(f"{self.path}/marks/batch={number}")

    def current(self) -> DataFrame:
        """The bars: of each the last whole one, and the partial ones of later batches."""
        like = self._partials(self.spark.createDataFrame([], self.schema))
        keys = ["chain_id", "pool_id", "interval", "open_time"]
        whole = self._read("whole", like).withColumn("since", F.max("batch").over(Window.partitionBy(*keys))).where("batch = since")
        since = whole.select(*keys, "since")
        later = self._read("partials", like).join(since, keys, "left").where("since is null or batch > since")
        return trades.finished(trades.rolled(whole.select(like.columns).unionByName(later.select(like.columns))))


# Metrics


def observed(events: DataFrame, name: str, kinds: list[str]) -> DataFrame:
    """The same stream, with each batch's counts by type and last block as observed metrics."""
    return events.observe(name, F.count("*").alias("events"), F.max("block_number").alias("last_block"), *[F.count_if(F.col("event_type") == k).alias(k) for k in kinds])


class MetricsTable(StreamingQueryListener):
    """Writes each batch's observed metrics as a row (query, batch, metric, value) to a table."""

    SCHEMA = "query string, metrics string, batch bigint, metric string, value bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.ended = spark, path, threading.Event()

    def onQueryStarted(self, event: Any) -> None:
        self.ended.clear()

    def onQueryProgress(self, event: Any) -> None:
        progress = event.progress
        rows = [(str(progress.id), name, progress.batchId, k, v) for name, row in progress.observedMetrics.items() for k, v in row.asDict().items() if v is not None]
        if rows:
            self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        self.ended.set()

    def read(self) -> DataFrame:
        """One row for each batch and metric, whatever was told twice."""
        return self.spark.read.schema(self.SCHEMA).parquet(self.path).dropDuplicates(["query", "metrics", "batch", "metric"])


def run_to_end(writer: DataStreamWriter) -> None:
    """Reads all that there is now, and stops."""
    writer.trigger(availableNow=True).start().awaitTermination()


def arriving(parts: list[DataFrame], path: str, start: Callable[[DataFrame], DataStreamWriter]) -> None:
    """Runs a writer over a table that arrives in parts, started again for each from its checkpoint. State
    is dealt over no more partitions than there are cores (the number is fixed by the first start)."""
    spark, schema = parts[0].sparkSession, parts[0].schema
    many = spark.conf.get("spark.sql.shuffle.partitions")
    for part in parts:
        part.write.mode("append").parquet(f"{path}/in")
        spark.conf.set("spark.sql.shuffle.partitions", str(min(int(many), max(8, spark.sparkContext.defaultParallelism))))
        try:
            run_to_end(start(spark.readStream.schema(schema).parquet(f"{path}/in")).option("checkpointLocation", f"{path}/checkpoint"))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", many)
