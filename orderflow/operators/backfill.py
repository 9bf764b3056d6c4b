"""Back-fill of a live feed from bulk sources, with a ledger of recorded and filled gaps.

A store is a folder: the logs that are there (one folder a cycle), and what each cycle recorded as missing
and has filled. A cycle compares the store with the bulk sources that are configured, appends what is
missing, and writes both parts of the ledger; all its writes go to folders of its own number, so a cycle
that is repeated after a failure replaces itself. Decoding and folds read the store's distinct logs: a
cycle that brings nothing new leaves them as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow.operators import ranges, reconcile, sinks

_RANGES = T.StructType([T.StructField("feed", T.StringType()), T.StructField("from_block", T.LongType()), T.StructField("to_block", T.LongType())])


def block_ranges(rows: DataFrame, feed: str) -> DataFrame:
    """The blocks of the rows as merged ranges of a feed."""
    blocks = rows.select(F.lit(feed).alias("feed"), F.col("block_number").alias("from_block"), F.col("block_number").alias("to_block")).distinct()
    return ranges.merge(blocks)


class Store:
    """Logs with a `content_id`, below `path`."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, feed: str = "live"):
        self.spark, self.path, self.schema, self.feed = spark, path, schema, feed

    def _part(self, name: str, schema: T.StructType = _RANGES) -> DataFrame:
        return sinks.stored(self.spark, f"{self.path}/{name}", schema)

    def add(self, logs: DataFrame, cycle: int = 0) -> None:
        """Rows from the feed itself (cycle 0), or from a back-fill."""
        logs.select(self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/logs/batch={cycle}")

    def logs(self) -> DataFrame:
        """Each log once: rows without a content id as they are, of the others the one that came first."""
        rows = self._part("logs", self.schema)
        rest = [f for f in self.schema.fieldNames() if f != "content_id"]
        known = rows.where("content_id is not null").groupBy("content_id").agg(F.min(F.struct("batch", *rest)).alias("r")).select("content_id", *[f"r.{c}" for c in rest])
        return known.unionByName(rows.where("content_id is null").drop("batch")).select(self.schema.fieldNames())

    def run_cycle(self, cycle: int, *sources: DataFrame, known: DataFrame | None = None) -> None:
        """Compares, fills and records. `known` is what is known to exist where that is more than the
        configured sources can give; what they can't stays an open gap."""
        # Logs without a content id cannot be compared, and are never missing.
        known_ids = lambda until: self._part("logs", self.schema).where(F.col("content_id").isNotNull() & (F.col("batch") <= until)).select("content_id")
        rest = [f for f in self.schema.fieldNames() if f != "content_id"]
        # What is missing first, by ids alone; only of these rows one for each id is chosen, of the first source that has it.
        offered = reduce(DataFrame.unionByName, [s.select(self.schema.fieldNames()).where("content_id is not null").withColumn("__rank", F.lit(i)) for i, s in enumerate(sources)])
        missing = reconcile.missing(offered, known_ids(cycle - 1)).groupBy("content_id").agg(F.min(F.struct("__rank", *rest)).alias("r")).select("content_id", *[f"r.{c}" for c in rest])
        missing.select(self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/logs/batch={cycle}")
        came = self.spark.read.schema(self.schema).parquet(f"{self.path}/logs/batch={cycle}").select("block_number").distinct()
        if known is None:
            wanted, filled = came, came
        else:
            # What no configured source could give. A block is filled when nothing of it is missing any more.
            at = f"{self.path}/left/batch={cycle}"
            reconcile.missing(known.where("content_id is not null").select("content_id", "block_number"), known_ids(cycle)).select("block_number").distinct().write.mode("overwrite").parquet(at)
            left = self.spark.read.schema(came.schema).parquet(at)
            wanted, filled = came.unionByName(left), came.join(left, "block_number", "left_anti")
        block_ranges(wanted, self.feed).write.mode("overwrite").parquet(f"{self.path}/recorded/batch={cycle}")
        block_ranges(filled, self.feed).write.mode("overwrite").parquet(f"{self.path}/filled/batch={cycle}")

    def recorded(self, until: int | None = None) -> DataFrame:
        """Ranges with the first cycle that recorded them."""
        return self._until("recorded", until)

    def filled(self, until: int | None = None) -> DataFrame:
        return self._until("filled", until)

    def _until(self, name: str, until: int | None) -> DataFrame:
        rows = self._part(name)
        return rows if until is None else rows.where(F.col("batch") <= until)

    def open_gaps(self, until: int | None = None) -> DataFrame:
        """What was recorded up to a cycle (the last), and is not filled yet."""
        # A block that was filled in one cycle and is missing in a later one is open again.
        rows = self.recorded(until).select("feed", F.explode(F.sequence("from_block", "to_block")).alias("block"), "batch").groupBy("feed", "block").agg(F.max("batch").alias("seen"))
        filled = self.filled(until).select("feed", F.explode(F.sequence("from_block", "to_block")).alias("block"), "batch").groupBy("feed", "block").agg(F.max("batch").alias("done"))
        open_ = rows.join(filled, ["feed", "block"], "left").where("done is null or done < seen")
        return ranges.merge(open_.select("feed", F.col("block").alias("from_block"), F.col("block").alias("to_block")))
