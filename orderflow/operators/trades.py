"""Trades: idempotent insert, candle input, candles of all intervals, fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow.functions.scalars import AMOUNT, INTERVALS, amount_of, bucket_open, ident, seq_of


def dedup(trades: DataFrame) -> DataFrame:
    """One row for each (tx_hash, log_index). Replays are exact copies, so partial aggregation merges
    them before the shuffle; should copies differ, the one of least order is kept whole."""
    rest = [c for c in trades.columns if c not in ("tx_hash", "log_index")]
    return trades.groupBy("tx_hash", "log_index").agg(F.min(F.struct("block_number", *[c for c in rest if c != "block_number"])).alias("t")).select("tx_hash", "log_index", "t.*").select(trades.columns)


def _wide(rows: DataFrame, *columns: str) -> bool:
    """Whether some of the columns are amounts of 38 digits, whose arithmetic can leave their type."""
    return any(isinstance(rows.schema[c].dataType, T.DecimalType) for c in columns)


def _quote(trades: DataFrame) -> Column:
    return F.try_multiply(amount_of("price"), amount_of("quantity")) if _wide(trades, "price", "quantity") else F.col("price") * F.col("quantity")


def unfit(trades: DataFrame) -> DataFrame:
    """Trades whose quote value needs more than 38 digits; they are in no candle."""
    return trades.where(_quote(trades).isNull()) if _wide(trades, "price", "quantity") else trades.limit(0)


def candle_input(trades: DataFrame) -> DataFrame:
    """Trades with price and quantity other than 0, with quote value and taker side."""
    fits = trades.where("price <> 0 and quantity <> 0")
    fits = fits.where(_quote(trades).isNotNull()) if _wide(trades, "price", "quantity") else fits
    return fits.select("chain_id", "pool_id", "ts", "price", F.col("quantity").alias("base_quantity"), _quote(trades).alias("quote_value"), (F.col("taker_side") == "BUY").alias("is_taker_buy"), seq_of(F.col("block_number"), F.col("log_index")).alias("seq"))


_SUMS = ("volume", "quote_volume", "count", "taker_buy_base_volume", "taker_buy_quote_volume")


def partial_bars(trades: DataFrame, **opens: Column) -> DataFrame:
    """Bars of some trades, with what is needed to compose them: the keys of first and last trade, exact sums."""
    taker = lambda c: F.sum(F.when(F.col("is_taker_buy"), F.col(c)).otherwise(0))
    if _wide(trades, "base_quantity", "quote_value"):
        amounts = {c: amount_of(c) for c in ("base_quantity", "quote_value")}
        sums = [F.try_sum(a).alias(n) for n, a in zip(("volume", "quote_volume"), amounts.values(), strict=True)]
        taker = lambda c: F.try_sum(F.when(F.col("is_taker_buy"), amounts[c]).otherwise(F.lit(0).cast(AMOUNT)))
    else:
        sums = [F.sum("base_quantity").alias("volume"), F.sum("quote_value").alias("quote_volume")]
    return trades.groupBy("chain_id", "pool_id", *[v.alias(k) for k, v in opens.items()]).agg(
        F.min("seq").alias("k0"), F.max("seq").alias("k1"), F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"),
        *sums, F.count("*").alias("count"), taker("base_quantity").alias("taker_buy_base_volume"), taker("quote_value").alias("taker_buy_quote_volume"),
    )


def rolled(finer: DataFrame) -> DataFrame:
    """Partial bars of the same bucket as one. A sum that left 38 digits stays null."""
    total = lambda c: F.when(F.count_if(F.col(c).isNull()) == 0, F.try_sum(c)) if _wide(finer, c) else F.sum(c)
    return finer.groupBy("chain_id", "pool_id", "interval", "open_time").agg(
        F.min("k0").alias("k0"), F.max("k1").alias("k1"), F.min_by("open", "k0").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "k1").alias("close"), *[total(c).alias(c) for c in _SUMS]
    )


def vwap(quote: Column, volume: Column) -> Column:
    return F.when(volume > 0, quote.cast("double") / volume.cast("double")).otherwise(F.lit(0.0))


def finished(bars: DataFrame) -> DataFrame:
    number = lambda c: F.col(c).cast("double").alias(c)
    seconds = F.element_at(F.create_map(*[F.lit(x) for pair in INTERVALS.items() for x in pair]), F.col("interval"))
    return bars.select(ident("chain_id", "pool_id", "open_time").alias("id"), "chain_id", "pool_id", "interval", "open_time", (F.col("open_time") + seconds).alias("close_time"), *map(number, ("open", "high", "low", "close", "volume", "quote_volume")), F.lit(0.0).alias("volume_usd"), F.col("count").cast("bigint").alias("count"), number("taker_buy_base_volume"), number("taker_buy_quote_volume"), vwap(F.col("quote_volume"), F.col("volume")).alias("average"))


def candles(trades: DataFrame, interval: str) -> DataFrame:
    """Bars of one interval straight from raw trades."""
    return finished(partial_bars(candle_input(dedup(trades)), open_time=bucket_open(F.col("ts"), INTERVALS[interval])).withColumn("interval", F.lit(interval)))


def candles_all(trades: DataFrame) -> DataFrame:
    """All nine intervals from one pass: minute bars, cut where a month begins (it is not a multiple of a
    minute), then each of them once for every interval. The sums are exact, so the levels compose."""
    minutes = partial_bars(candle_input(dedup(trades)), minute=bucket_open(F.col("ts"), INTERVALS["1m"]), month=bucket_open(F.col("ts"), INTERVALS["1M"]))
    opens = [F.struct(F.lit(name).alias("interval"), (F.col("month") if name == "1M" else bucket_open(F.col("minute"), seconds)).alias("open_time")) for name, seconds in INTERVALS.items()]
    return finished(rolled(minutes.withColumn("o", F.explode(F.array(*opens))).withColumns({"interval": F.col("o.interval"), "open_time": F.col("o.open_time")})))


def merge_candles(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of bars: open kept, high and low widened, the rest replaced."""
    keys = ["id", "interval"]
    pick = {"open": lambda o, n: F.coalesce(o, n), "high": lambda o, n: F.greatest(o, n), "low": lambda o, n: F.least(o, n)}
    both = old.alias("o").join(new.alias("n"), keys, "full_outer")
    columns = [pick.get(c, lambda o, n: F.coalesce(n, o))(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) for c in old.columns if c not in keys]
    return both.select(*keys, *columns).select(old.columns)


def fills(trades: DataFrame) -> DataFrame:
    """Two rows for each match: one for the buy and one for the sell order."""
    sides = F.explode(F.array(F.struct(F.col("buy_order_id").alias("order_id"), F.lit("BUY").alias("side")), F.struct(F.col("sell_order_id").alias("order_id"), F.lit("SELL").alias("side"))))
    return dedup(trades).select("chain_id", "pool_id", "tx_hash", "log_index", "ts", "price", "quantity", sides.alias("f")).select(ident("tx_hash", "log_index", "f.side").alias("id"), "chain_id", "pool_id", "ts", "price", "quantity", "f.order_id", "f.side")


def filled_value(trades: DataFrame) -> DataFrame:
    """The quote value of an order's fills; null, for the quarantine, where it leaves 38 digits."""
    value = F.try_multiply(amount_of("price"), amount_of("quantity"))
    total = F.when(F.count_if(value.isNull()) == 0, F.try_sum(value))
    return fills(trades).groupBy("pool_id", "order_id").agg(total.alias("total_filled_value"), F.count("*").alias("fills"))
