"""Reconciliation of a live feed with bulk sources, and table maintenance by keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orderflow.functions.scalars import amount_of


def union_sources(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Both sources by content id, the primary's row preferred. The choice is an aggregate that merges
    partially before the shuffle."""
    both = primary.withColumn("rank", F.lit(0)).unionByName(secondary.withColumn("rank", F.lit(1)))
    rest = [c for c in primary.columns if c != "content_id"]
    return both.groupBy("content_id").agg(F.min(F.struct("rank", *rest)).alias("r")).select("content_id", *[f"r.{c}" for c in rest])


def missing(bulk: DataFrame, live: DataFrame) -> DataFrame:
    return bulk.join(live.select("content_id"), "content_id", "left_anti")


def missing_by_type(bulk: DataFrame, live: DataFrame) -> DataFrame:
    return missing(bulk, live).groupBy("event_type").agg(F.count("*").alias("missing"))


def ids_in_range(live: DataFrame, start: int, end: int) -> DataFrame:
    return live.where(F.col("block_number").between(start, end)).select("content_id").distinct()


def report(primary: DataFrame, secondary: DataFrame, live: DataFrame, start: int, end: int) -> DataFrame:
    """One row: live, bulk and missing rows of the window, and whether an alert is due."""
    inside = F.col("block_number").between(start, end)
    bulk = union_sources(primary.where(inside), secondary.where(inside)).select("content_id", F.lit(1).alias("in_bulk"))
    seen = live.where(inside).select("content_id").distinct().select("content_id", F.lit(1).alias("in_live"))
    both = bulk.join(seen, "content_id", "full_outer")
    return both.agg(F.count("in_live").alias("live_count"), F.count("in_bulk").alias("bulk_count"), F.count_if(F.col("in_live").isNull()).alias("missing_count")).select(F.lit(start).cast("bigint").alias("from_block"), F.lit(end).cast("bigint").alias("to_block"), "live_count", "bulk_count", "missing_count", (F.col("missing_count") > 0).alias("alert"))


def window_bounds(start: int, latest: int, batch: int) -> tuple[int, int] | None:
    """The next stretch to verify, the head left out; none before a start is known or without new blocks."""
    return None if start == 0 or latest <= start else (start, start + min(batch, latest - start) - 1)


def before_first_live(bulk: DataFrame, first_block: int, first_index: int) -> DataFrame:
    """Bulk rows needed before the first live row."""
    return bulk.where((F.col("block_number") < first_block) | ((F.col("block_number") == first_block) & (F.col("log_index") < first_index)))


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in rows.columns if c not in keys]).select(rows.columns)


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows to append: keys not there yet, and of the new rows with one key one."""
    return new.dropDuplicates(keys).join(existing.select(keys), keys, "left_anti").select(existing.columns)


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], update_columns: list[str]) -> DataFrame:
    """Insert new keys; of known keys replace the named columns only. Updates have one row a key."""
    here = target.withColumn("__t", F.lit(True)).alias("t")
    both = here.join(updates.alias("u"), keys, "full_outer")
    value = lambda c: F.when(F.col("t.__t") & F.lit(c not in update_columns), F.col(f"t.{c}")).otherwise(F.coalesce(F.col(f"u.{c}"), F.col(f"t.{c}")))
    return both.select(*[F.col(k) if k in keys else value(k).alias(k) for k in target.columns])


def add_amounts(existing: DataFrame, deltas: DataFrame, keys: list[str], amounts: list[str]) -> DataFrame:
    both = existing.select(*keys, *amounts).unionByName(deltas.select(*keys, *amounts))
    return both.groupBy(*keys).agg(*[F.try_sum(amount_of(a)).alias(a) for a in amounts])


def newest(rows: DataFrame, channel: str | list[str], order: list[Column], most: int) -> DataFrame:
    """The newest `most` rows of each channel."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(channel).orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def envelope(rows: DataFrame, channels: Column, payload: list[str], source: str, time: Column) -> DataFrame:
    """One message for each row and channel, the payload as JSON."""
    return rows.select(F.explode(channels).alias("channel"), F.to_json(F.struct(*payload)).alias("data"), F.lit(source).alias("source"), time.alias("timestamp"))
