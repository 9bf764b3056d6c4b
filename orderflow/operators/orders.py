"""Order lifecycle by segments, the book, histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orderflow.functions.scalars import amount_of, ident, is_active, sat_sub, status

_UP_TO = (Window.unboundedPreceding, Window.currentRow)


def lifecycle(events: DataFrame) -> DataFrame:
    """The order's state after each event. A placement starts a segment and resets the order; events
    before the first placement are dropped. Windows are by order, so no order is global."""
    by_order = Window.partitionBy("pool_id", "order_id").orderBy("seq").rowsBetween(*_UP_TO)
    own = Window.partitionBy("pool_id", "order_id", "segment").orderBy("seq").rowsBetween(*_UP_TO)
    placed = F.col("kind") == "PLACED"
    rows = events.withColumn("segment", F.sum(placed.cast("bigint")).over(by_order)).where("segment > 0")
    kept = {c: F.last(F.when(placed, F.col(c)), ignorenulls=True).over(own) for c in ("user_addr", "side", "price", "quantity", "expiry", "is_market_order")}
    filled = F.coalesce(F.last(F.when(F.col("kind") == "UPDATED", F.col("filled")), ignorenulls=True).over(own), F.lit(0).cast("bigint"))
    now = F.when(placed, "OPEN").when(F.col("kind") == "UPDATED", status(F.col("status_code"))).otherwise("CANCELLED")
    return rows.select("seq", "pool_id", "order_id", "kind", "ts", "segment", *[v.alias(k) for k, v in kept.items()], filled.alias("filled"), now.alias("status")).withColumn("remaining", sat_sub(F.col("quantity"), F.col("filled")))


def latest(events: DataFrame) -> DataFrame:
    """Each order's last state, by an aggregate that merges partially before the shuffle."""
    rows = lifecycle(events)
    rest = [c for c in rows.columns if c not in ("pool_id", "order_id")]
    return rows.groupBy("pool_id", "order_id").agg(*[F.max_by(c, "seq").alias(c) for c in rest])


def history(events: DataFrame) -> DataFrame:
    """One row for each order event, typed by what it did."""
    kind = F.when(F.col("kind") == "PLACED", "Placed").when(F.col("kind") == "CANCELLED", "Cancelled").when(F.col("status") == "FILLED", "Filled").when(F.col("status") == "PARTIALLY_FILLED", "PartiallyFilled").otherwise("Updated")
    return lifecycle(events).select(ident("pool_id", "order_id", "seq").alias("id"), "seq", "pool_id", "order_id", "user_addr", "ts", kind.alias("event"), "filled", "status")


def book(orders: DataFrame, depth: int | None = None, as_of: int | None = None) -> DataFrame:
    """Price levels of active orders, best first; `depth` levels of each side of each pool."""
    rows = orders.where(is_active(F.col("status")))
    if as_of is not None:
        rows = rows.where(F.col("expiry") > as_of)
    levels = rows.groupBy("pool_id", "side", "price").agg(F.try_sum(amount_of("remaining")).alias("quantity"), F.count("*").alias("orders"))
    best_first = F.when(F.col("side") == "BUY", -F.col("price")).otherwise(F.col("price"))
    ranked = levels.withColumn("level", F.row_number().over(Window.partitionBy("pool_id", "side").orderBy(best_first)))
    return ranked if depth is None else ranked.where(F.col("level") <= depth)


def active_count(orders: DataFrame) -> DataFrame:
    return orders.where(is_active(F.col("status"))).groupBy("pool_id").agg(F.count("*").alias("active_orders"))
