"""Block-range algebra by gaps and islands, one axis for each feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def split(bounds: DataFrame, step: int) -> DataFrame:
    """(feed, from_block, to_block) cut into batches of at most `step` blocks."""
    starts = F.explode(F.sequence("from_block", "to_block", F.lit(step))).alias("start")
    return bounds.where("from_block <= to_block").select("feed", "to_block", starts).select("feed", F.col("start").alias("from_block"), F.least(F.col("start") + step - 1, F.col("to_block")).alias("to_block"))


def _islands(ranges: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("from_block", "to_block")
    reach = F.max("to_block").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("new", F.when(F.col("from_block") <= reach + 1, 0).otherwise(1))
    numbered = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*keys, "island").agg(F.min("from_block").alias("from_block"), F.max("to_block").alias("to_block")).drop("island")


def merge(ranges: DataFrame, bucket_blocks: int = 1 << 20) -> DataFrame:
    """Overlapping or adjacent ranges joined. First within buckets of the axis, so that one long axis is
    many tasks; then the few islands that are left, by feed."""
    rows = ranges.select("feed", "from_block", "to_block").where("from_block <= to_block").withColumn("bucket", F.floor(F.col("from_block") / bucket_blocks))
    return _islands(_islands(rows, ["feed", "bucket"]).drop("bucket"), ["feed"])


def gaps(ranges: DataFrame, start: int, target: int) -> DataFrame:
    """What is missing in [start, target], the tail included; a feed without ranges isn't listed."""
    merged = merge(ranges).where((F.col("to_block") >= start) & (F.col("from_block") <= target))
    feeds = ranges.select("feed").distinct()
    ends = feeds.select("feed", F.lit(target + 1).cast("bigint").alias("from_block"), F.lit(target + 1).cast("bigint").alias("to_block"))
    order = Window.partitionBy("feed").orderBy("from_block")
    rows = merged.unionByName(ends).withColumn("gap_from", F.greatest(F.coalesce(F.lag("to_block").over(order) + 1, F.lit(start).cast("bigint")), F.lit(start).cast("bigint")))
    return rows.where("gap_from < from_block").select("feed", F.col("gap_from").alias("from_block"), (F.col("from_block") - 1).alias("to_block"))


def subtract(ranges: DataFrame, taken: DataFrame, start: int, target: int, bucket_blocks: int = 1 << 20) -> DataFrame:
    """What `ranges` hold in [start, target] and `taken` do not. Feeds of `taken` alone have nothing left.

    One sweep over the ends of both: how many ranges of each cover the blocks from an end to the next one.
    The counts run within buckets of the axis, from what the buckets before leave open."""
    ends = lambda rows, own, other: rows.where("from_block <= to_block").select("feed", F.explode(F.array(F.struct(F.col("from_block").alias("at"), F.lit(own).alias("own"), F.lit(other).alias("other")), F.struct((F.col("to_block") + 1).alias("at"), F.lit(-own).alias("own"), F.lit(-other).alias("other")))).alias("e")).select("feed", "e.*")
    rows = ends(ranges, 1, 0).unionByName(ends(taken, 0, 1)).withColumn("bucket", F.floor(F.col("at") / bucket_blocks))
    axis = Window.partitionBy("feed").orderBy("bucket")
    before = axis.rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy("feed", "bucket").agg(F.sum("own").alias("o"), F.sum("other").alias("t"), F.min("at").alias("first"))
    open_ = buckets.select("feed", "bucket", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("o", "t")], F.lead("first").over(axis).alias("after"))
    order = Window.partitionBy("feed", "bucket").orderBy("at")
    here = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = rows.select("feed", "bucket", "at", F.sum("own").over(here).alias("own"), F.sum("other").over(here).alias("other"), F.lead("at").over(order).alias("next")).join(open_, ["feed", "bucket"])
    left = swept.where("own + o0 > 0 and other + t0 = 0").select("feed", F.greatest("at", F.lit(start)).cast("bigint").alias("from_block"), F.least(F.coalesce("next", "after") - 1, F.lit(target)).cast("bigint").alias("to_block"))
    return merge(left)


def complete(ranges: DataFrame, start: int, target: int) -> DataFrame:
    """Whether a feed's ranges are one island, and that covers [start, target]."""
    return merge(ranges).groupBy("feed").agg(((F.count("*") == 1) & (F.min("from_block") <= start) & (F.max("to_block") >= target)).alias("complete"))


def contiguous_end(ranges: DataFrame, start: int) -> DataFrame:
    """The end of a feed's first island if that begins at `start` or before, else start - 1 (not below 0)."""
    first = merge(ranges).groupBy("feed").agg(F.min(F.struct("from_block", "to_block")).alias("i"))
    return first.select("feed", F.when(F.col("i.from_block") <= start, F.col("i.to_block")).otherwise(F.lit(max(0, start - 1))).cast("bigint").alias("contiguous_end"))


def block_gaps(blocks: DataFrame, bucket_blocks: int = 1 << 16) -> DataFrame:
    """Missing blocks between consecutive blocks of a feed: (feed, after_block, next_block, missed). The
    next block is sought within buckets of the axis, then between the edges of a feed's buckets alone."""
    rows = blocks.select("feed", "block", F.floor(F.col("block") / bucket_blocks).alias("bucket")).distinct()
    inside = rows.select("feed", F.col("block").alias("after_block"), F.lead("block").over(Window.partitionBy("feed", "bucket").orderBy("block")).alias("next_block"))
    edges = rows.groupBy("feed", "bucket").agg(F.min("block").alias("first"), F.max("block").alias("after_block"))
    between = edges.select("feed", "after_block", F.lead("first").over(Window.partitionBy("feed").orderBy("bucket")).alias("next_block"))
    return inside.unionByName(between).where("next_block - after_block > 1").withColumn("missed", F.col("next_block") - F.col("after_block") - 1)
