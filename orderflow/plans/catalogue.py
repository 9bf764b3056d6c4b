"""The registered queries of the order-flow operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.functions.scalars import INTERVALS, amount_of, bucket_open, ident, hex_of, interval_dim, is_active, seq_of, status, uint64
from orderflow.operators import balances, decode, orders, ranges, reconcile, sinks, trades
from orderflow.sources.fixtures import view

Query = Callable[[SparkSession, str], DataFrame]
_Q: dict[str, Query] = {}


def _query(name: str) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _Q[name] = f
        return f

    return put


def _text(df: DataFrame, *amounts: str) -> DataFrame:
    """Amounts as decimal text, as results give numbers of any width."""
    return df.withColumns({a: F.col(a).cast("string") for a in amounts})


def _simple(name: str, source: str, f: Callable[[DataFrame], DataFrame]) -> None:
    _Q[name] = lambda spark, d: f(view(spark, d, source))


# Scans

_Q["s2_new_pool_logs"] = lambda s, d: view(s, d, "raw_matched").join(view(s, d, "pools").where("ts >= 1700000004").select(F.col("order_book").alias("address")), "address", "left_semi").select("address", "block_number", "log_index")
_simple("s6_pool_restore", "pools", lambda p: p.where("chain_id = 1 and order_book rlike '^ob_[0-9a-f]+$'").select("pool_id", "order_book"))
_simple("s8_trades_in_range", "trades", lambda t: trades.dedup(t.where("pool_id = 'pool_3' and quantity >= 10 and quantity < 50")).select("tx_hash", "log_index", "ts", "price", "quantity"))


# Decoding and joins


def _matched(spark: SparkSession, d: str) -> DataFrame:
    return decode.decode(view(spark, d, "raw_matched"), "OrderMatched")


@_query("d4_order_matched")
def _(s, d):
    return _matched(s, d).select("address", "block_number", "log_index", "tx_hash", "buy_order_id", "sell_order_id", "side", "timestamp", *[F.col(c).cast("string").alias(c) for c in ("execution_price", "taker_limit_price", "executed_quantity")], "overflow")


_simple("d14_relevant", "raw_matched", lambda r: r.where(F.col("address").isin("ob_0", "ob_7")).select("address", "log_index"))
_Q["d15_relevant_by_class"] = lambda s, d: decode.relevant(view(s, d, "raw_matched"), view(s, d, "pools"), manager="pm", balances="bm", signatures={k: k for k in decode.EVENTS}).select("address", "event_type", "log_index")
_simple("d16_event_label", "balance_events", lambda b: b.select("seq", decode.label(F.col("kind"), {"Deposit": "DEPOSIT", "Lock": "LOCK", "Unlock": "UNLOCK"}).alias("event_type")))
_simple("d17_content_id", "raw_matched", lambda r: r.select("log_index", decode.content_id(F.col("tx_hash"), F.col("address"), [F.col(f"topic{i}") for i in range(4)], F.col("data")).alias("content_id")))
_simple("d18_position_id", "raw_matched", lambda r: r.select(ident("tx_hash", "log_index").alias("id")))
_simple("d19_enums", "order_events", lambda o: o.select("seq", status(F.col("filled") % 9).alias("status")))
_simple("d21_candle_input", "trades", lambda t: trades.candle_input(trades.dedup(t)).select("pool_id", "ts", "price", "base_quantity", "quote_value", "is_taker_buy"))
_simple("d22_in_bucket", "trades", lambda t: trades.dedup(t).select("log_index", ((F.col("ts") >= bucket_open(F.col("ts"), 3600)) & (F.col("ts") < bucket_open(F.col("ts"), 3600) + 1800)).alias("first_half")))
_Q["j1_event_pool"] = lambda s, d: decode.with_pool(_matched(s, d), view(s, d, "pools")).select("pool_id", "address", "log_index", "buy_order_id")
_Q["j1_unknown_books"] = lambda s, d: decode.unknown_books(_matched(s, d), view(s, d, "pools")).select("address", "log_index")
_Q["j2_pool_row"] = lambda s, d: decode.with_pool(_matched(s, d), view(s, d, "pools")).select("log_index", "pool_id", "base_currency", "quote_currency", "base_decimals")
_Q["j3_known_books"] = lambda s, d: view(s, d, "raw_matched").join(view(s, d, "pools").select(F.col("order_book").alias("address")), "address", "left_semi").select("address", "log_index")
_Q["a9_event_counts"] = lambda s, d: decode.event_counts(view(s, d, "bulk_a"), F.floor(F.col("block_number") / 5000), ["click", "view", "purchase", "signup", "error"])


# Trades and candles

_simple("f7_trade_dedup", "trades", lambda t: trades.dedup(t).select("tx_hash", "log_index", "pool_id", "ts", "price", "quantity", "taker_side", "taker"))
_simple("a1_candles_1m", "trades", lambda t: trades.candles(t, "1m"))
_simple("a1_candles_1mo", "trades", lambda t: trades.candles(t, "1M"))
_simple("a2_candles_all", "trades", trades.candles_all)
_simple("a3_buckets", "trades", lambda t: trades.dedup(t).select("log_index", *[bucket_open(F.col("ts"), v).alias(f"open_{i}") for i, v in enumerate(INTERVALS.values())]))
_simple("a4_vwap", "trades", lambda t: trades.candle_input(trades.dedup(t)).groupBy("pool_id").agg(trades.vwap(F.sum("quote_value"), F.sum("base_quantity")).alias("vwap")))
_simple("a7_pool_trades", "trades", lambda t: trades.dedup(t).groupBy("pool_id").agg(F.count("*").alias("trades")))
_simple("a12_fills", "trades", trades.fills)
_simple("a13_filled_value", "trades", lambda t: _text(trades.filled_value(t), "total_filled_value"))


@_query("a15_ticker")
def _(s, d):
    t = trades.dedup(view(s, d, "trades"))
    last = t.groupBy("pool_id").agg(F.max("ts").alias("last_ts"))
    day = t.join(last, "pool_id").where("ts > last_ts - 86400").withColumn("seq", seq_of(F.col("block_number"), F.col("log_index")))
    stats = day.groupBy("pool_id").agg(F.max_by("price", "seq").alias("last_price"), F.min_by("price", "seq").alias("first_price"), F.try_sum(amount_of("quantity")).cast("string").alias("volume_24h"))
    active = orders.latest(view(s, d, "order_events")).where(is_active(F.col("status")))
    best = active.groupBy("pool_id").agg(F.max(F.when(F.col("side") == "BUY", F.col("price"))).alias("best_bid"), F.min(F.when(F.col("side") == "SELL", F.col("price"))).alias("best_ask"))
    return stats.join(best, "pool_id", "left").select("pool_id", "best_bid", "best_ask", "last_price", "volume_24h", (F.col("last_price") - F.col("first_price")).alias("change_24h"))


@_query("a16_pool_stats")
def _(s, d):
    t = trades.dedup(view(s, d, "trades")).groupBy("pool_id").agg(F.count("*").alias("total_trades"), F.max_by("price", seq_of(F.col("block_number"), F.col("log_index"))).alias("last_price"))
    o = orders.latest(view(s, d, "order_events")).groupBy("pool_id").agg(F.count("*").alias("total_orders"))
    return t.join(o, "pool_id", "full_outer").join(_Q["a15_ticker"](s, d).select("pool_id", "volume_24h"), "pool_id", "left")


@_query("g6_candle_merge")
def _(s, d):
    t = trades.dedup(view(s, d, "trades"))
    return trades.merge_candles(trades.candles(t.where("log_index % 3 <> 0"), "1h"), trades.candles(t.where("log_index % 3 = 0"), "1h")).select("id", "open", "high", "low", "close", "volume", "count")


def _candles(s, d):
    return trades.candles_all(view(s, d, "trades"))


_Q["t11_candles_recent"] = lambda s, d: trades.candles(view(s, d, "trades").where("pool_id = 'pool_1'"), "1m").orderBy(F.desc("open_time")).limit(100).select("open_time", "open", "high", "low", "close", "volume")
_Q["t12_candle_latest"] = lambda s, d: trades.candles(view(s, d, "trades"), "1d").groupBy("pool_id").agg(F.max("open_time").alias("open_time"), F.max_by("close", "open_time").alias("close"))
_simple("t7_recent_trades", "trades", lambda t: reconcile.newest(trades.dedup(t), "pool_id", [F.desc("ts"), F.desc("log_index")], 20).select("pool_id", "tx_hash", "log_index", "ts", "price"))
_simple("t8_recent_fills", "trades", lambda t: trades.fills(t.where("pool_id = 'pool_4'")).orderBy(F.desc("ts"), "id").limit(100).select("id", "order_id", "side", "price"))
_simple("t9_taker_trades", "trades", lambda t: reconcile.newest(trades.dedup(t), "taker", [F.desc("ts"), F.desc("log_index")], 5).select("taker", "log_index", "ts", "price"))

# Orders

_ORDER = ("pool_id", "order_id", "user_addr", "side", "price", "quantity", "filled", "remaining", "status")
_simple("f1_order_lifecycle", "order_events", lambda o: orders.lifecycle(o).select("seq", *_ORDER))
_simple("f2_order_latest", "order_events", lambda o: orders.latest(o).select(*_ORDER, "is_market_order", "expiry"))
_simple("f9_event_typing", "order_events", lambda o: orders.history(o).groupBy("event").agg(F.count("*").alias("n")))
_simple("f10_order_history", "order_events", lambda o: orders.history(o).select("id", "seq", "user_addr", "event", "filled", "status"))
_simple("j4_update_with_state", "order_events", lambda o: orders.lifecycle(o).where("kind <> 'PLACED'").select("seq", "kind", "user_addr", "side", "price", "quantity", "expiry"))
_simple("d20_active", "order_events", lambda o: orders.latest(o).select("pool_id", "order_id", is_active(F.col("status")).alias("active")))
_simple("a5_book_depth", "order_events", lambda o: _text(orders.book(orders.latest(o)), "quantity"))
_simple("t1_top_levels", "order_events", lambda o: _text(orders.book(orders.latest(o), depth=5), "quantity"))
_simple("a6_active_orders", "order_events", lambda o: orders.active_count(orders.latest(o)))
_simple("t2_open_side", "order_events", lambda o: orders.latest(o).where("pool_id = 'pool_1' and side = 'SELL' and status = 'OPEN'").orderBy("price", "order_id").limit(50).select("order_id", "price", "remaining"))
_simple("t3_pool_orders", "order_events", lambda o: orders.latest(o).where("pool_id = 'pool_2'").orderBy(F.desc("ts"), "order_id").limit(100).select("order_id", "ts", "status"))
_simple("t4_user_orders", "order_events", lambda o: orders.latest(o).where("user_addr = 'u_7' and status = 'CANCELLED'").orderBy(F.desc("ts"), "order_id").limit(100).select("order_id", "ts", "price"))
_simple("t5_user_active", "order_events", lambda o: orders.latest(o).where(is_active(F.col("status"))).select("user_addr", "pool_id", "order_id", "status"))
_simple("p4_order", "order_events", lambda o: orders.latest(o).where("pool_id = 'pool_1' and order_id = 1").select(*_ORDER))
_Q["p7_orderbook_side"] = lambda s, d: _text(orders.book(orders.latest(view(s, d, "order_events")), depth=50).where("pool_id = 'pool_5' and side = 'BUY'").select("level", "price", "quantity", "orders"), "quantity")

# Balances

_BALANCE = ("available", "locked", "total")

_simple("f3_deltas", "balance_events", lambda b: _text(balances.deltas(b), "d_available", "d_locked"))
_simple("f4_balance_fold", "balance_events", lambda b: _text(balances.final(balances.deltas(b)), *_BALANCE))
_simple("f4_balance_running", "balance_events", lambda b: _text(balances.running(balances.deltas(b)).select("seq", "sub", "user", "token_id", "available", "locked"), *_BALANCE[:2]))
_simple("f5_balance_changed", "balance_events", lambda b: _text(balances.changed(balances.deltas(b)).select("seq", "user", "token_id", "available", "locked"), *_BALANCE[:2]))
_simple("f6_total", "balance_events", lambda b: balances.final(balances.deltas(b)).groupBy("token_id").agg(F.try_sum("total").cast("string").alias("total")))
_simple("a14_tokens_held", "balance_events", lambda b: balances.deltas(b).groupBy("user").agg(F.countDistinct("token_id").alias("tokens")))
_simple("j7_user_balances", "balance_events", lambda b: _text(balances.final(balances.deltas(b).where("user = 'u_11'")), *_BALANCE))
_simple("g7_add_amounts", "balance_events", lambda b: _text(reconcile.add_amounts(balances.deltas(b).where("seq % 2 = 0"), balances.deltas(b).where("seq % 2 = 1"), ["user", "token_id"], ["d_available", "d_locked"]), "d_available", "d_locked"))
_Q["f11_users"] = lambda s, d: view(s, d, "order_events").select(F.col("user_addr").alias("user"), "ts").unionByName(balances.deltas(view(s, d, "balance_events")).select("user", "ts")).groupBy("user").agg(F.min("ts").alias("created_at"))
_Q["t13_users_page"] = lambda s, d: _Q["f11_users"](s, d).orderBy("created_at", "user").offset(20).limit(10)
_Q["p10_user"] = lambda s, d: _Q["f11_users"](s, d).where("user = 'u_3'")

# Pools

_simple("f8_pool_latest", "pools", lambda p: reconcile.keep_last(p.unionByName(p.withColumn("ts", F.col("ts") + 10).withColumn("quote_currency", F.lit("tok_z")).where("pool_id <> 'pool_0'")), ["pool_id"], "ts").select("pool_id", "order_book", "quote_currency", "ts"))
_simple("t13_pools_page", "pools", lambda p: p.orderBy("pool_id").offset(2).limit(3).select("pool_id", "order_book"))
_simple("t14_pools_newest", "pools", lambda p: p.where("chain_id = 1").orderBy(F.desc("ts"), "pool_id").select("pool_id", "ts"))
_simple("p3_pool_by_book", "pools", lambda p: p.where("order_book = 'ob_4'").select("pool_id", "order_book", "base_currency"))
_Q["g5_pool_upsert"] = lambda s, d: reconcile.upsert(view(s, d, "pools").select("pool_id", "base_currency", "quote_currency"), view(s, d, "pools").where("ts % 2 = 0").select(F.when(F.col("pool_id") == "pool_2", "pool_9").otherwise(F.col("pool_id")).alias("pool_id"), F.lit("tok_new").alias("base_currency"), F.lit("tok_u").alias("quote_currency")), ["pool_id"], ["quote_currency"])


# Ranges

_simple("r1_split", "ranges", lambda r: ranges.split(r, 4))
_simple("r2_merge", "ranges", ranges.merge)
_simple("r5_contiguous_end", "ranges", lambda r: ranges.contiguous_end(r, 25))
_simple("r6_block_gaps", "ranges", lambda r: ranges.block_gaps(r.select("feed", (F.col("from_block") / 10).cast("bigint").alias("block"))))

# Bounds from the data.


def _last_block(r: DataFrame) -> int:
    return r.agg(F.coalesce(F.max("to_block"), F.lit(-1))).first()[0]


def _filled_by(r: DataFrame, provider: str) -> DataFrame:
    """What a back-fill from one provider adds to every feed. The names of the feeds are sent to the tasks,
    never the ranges, which grow with the log."""
    return ranges.merge(r.where(F.col("feed") == provider)).drop("feed").join(F.broadcast(r.select("feed").distinct()), F.lit(True)).select("feed", "from_block", "to_block")


@_query("r8_before_live")
def _(s, d):
    live = view(s, d, "live")
    middle = live.agg(F.floor((F.min("block_number") + F.max("block_number")) / 2)).first()[0]
    first = live.where(F.col("block_number") >= middle).agg(F.min(F.struct("block_number", "log_index"))).first()[0]
    return reconcile.before_first_live(view(s, d, "bulk_a"), *first).select("content_id", "block_number", "log_index")


_simple("t6_history", "order_events", lambda o: reconcile.newest(orders.history(o), ["pool_id", "order_id"], [F.desc("ts"), F.desc("seq")], 100).select("pool_id", "order_id", "id", "ts", "event"))
_simple("t10_candles_range", "trades", lambda t: trades.candles(t, "1h").select("pool_id", "open_time", "open", "close", "volume"))
_simple("r3_gaps", "ranges", lambda r: ranges.gaps(r, 500, _last_block(r)))
_simple("r7_open_gaps", "ranges", lambda r: (lambda last: ranges.subtract(ranges.gaps(r, 0, last), _filled_by(r, "feed_0"), 0, last))(_last_block(r)))
_simple("r4_complete", "ranges", lambda r: (lambda last: ranges.complete(r.unionByName(r.where("feed = 'feed_1'").select(F.lit(0).cast("bigint").alias("from_block"), F.lit(last).cast("bigint").alias("to_block"), "feed").distinct()), 500, last))(_last_block(r)))

# Reconciliation and maintenance


def _bulk(s, d):
    return reconcile.union_sources(view(s, d, "bulk_a"), view(s, d, "bulk_b"))


_Q["g1_union_sources"] = lambda s, d: _bulk(s, d).select("content_id", "log_index", "block_number", "source")
_Q["j6_missing"] = lambda s, d: reconcile.missing(_bulk(s, d), view(s, d, "live")).select("content_id", "event_type", "log_index")
_Q["a11_missing_by_type"] = lambda s, d: reconcile.missing_by_type(_bulk(s, d), view(s, d, "live"))
_Q["v6_alerts"] = lambda s, d: reconcile.missing_by_type(_bulk(s, d), view(s, d, "live")).where("missing > 180")
_Q["v3_back_fill"] = lambda s, d: view(s, d, "live").unionByName(reconcile.missing(_bulk(s, d), view(s, d, "live")).select("content_id", "log_index", "block_number", "event_type")).groupBy("event_type").agg(F.count("*").alias("rows"))


def _bounds(s, d):
    lo, hi = view(s, d, "bulk_a").agg(F.min("block_number"), F.max("block_number")).first()
    return reconcile.window_bounds(lo, hi, 60000)


_Q["v2_report"] = lambda s, d: reconcile.report(view(s, d, "bulk_a"), view(s, d, "bulk_b"), view(s, d, "live"), *_bounds(s, d))
_Q["g2_ids_in_range"] = lambda s, d: reconcile.ids_in_range(view(s, d, "live"), *_bounds(s, d))
_simple("v5_buffer_stats", "live", lambda v: v.agg(F.countDistinct("block_number").alias("blocks"), F.countDistinct("content_id").alias("ids"), F.min("block_number").alias("first_block"), F.max("block_number").alias("last_block")))
_simple("g3_keep_last", "order_events", lambda o: reconcile.keep_last(o.select("pool_id", "order_id", "seq", "kind", "price"), ["pool_id", "order_id"], "seq"))
_Q["g4_insert_ignore"] = lambda s, d: (lambda t: reconcile.insert_ignore(t.where("log_index % 4 = 0"), t.where("log_index % 6 = 0"), ["tx_hash", "log_index"]).select("tx_hash", "log_index", "price"))(trades.dedup(view(s, d, "trades")))
_simple("g14_progress", "live", lambda v: v.groupBy().agg(F.max("block_number").alias("last_block"), F.countDistinct("block_number").alias("blocks_processed")))
_Q["a8_table_counts"] = lambda s, d: trades.dedup(view(s, d, "trades")).agg(F.count("*").alias("n")).select(F.lit("trades").alias("table"), "n").unionByName(orders.latest(view(s, d, "order_events")).agg(F.count("*").alias("n")).select(F.lit("orders").alias("table"), "n")).unionByName(view(s, d, "pools").agg(F.count("*").alias("n")).select(F.lit("pools").alias("table"), "n"))
_simple("a10_pipeline_stats", "bulk_a", lambda b: b.agg(F.countDistinct("block_number").alias("blocks"), F.count("*").alias("events"), F.count_if(F.col("event_type") == "signup").alias("signups"), F.count_if(F.col("event_type") == "purchase").alias("purchases")))

# Fan-out


def _messages(s, d):
    """Orders to 3 channels, trades to 2, balances and candles to 1 each."""
    text = lambda *names: [F.col(n).cast("string").alias(n) for n in names]
    o = view(s, d, "order_events")
    placed = orders.lifecycle(o).select("seq", "side", "price", "quantity")
    order = orders.history(o).join(placed, "seq").select(F.regexp_replace(F.lower("event"), "^partially", "partially_").alias("type"), "pool_id", "order_id", "side", *text("price", "quantity", "filled"), "status", F.col("user_addr").alias("user"), F.col("ts").alias("timestamp"))
    trade = trades.dedup(view(s, d, "trades")).select("pool_id", *text("price", "quantity"), F.col("taker_side").alias("side"), F.col("ts").alias("timestamp"), "tx_hash", "log_index", "buy_order_id", "sell_order_id", F.col("taker").alias("taker_address"))
    balance = balances.running(balances.deltas(view(s, d, "balance_events"))).select("user", F.col("token_id").alias("currency"), F.col("available").cast("string").alias("amount"), F.col("locked").cast("string").alias("locked_amount"), F.lower("change").alias("event_type"), F.col("ts").alias("timestamp"))
    # The bars of whole prices and quantities are whole numbers, which read alike in any engine's JSON.
    candle = _candles(s, d).select("pool_id", "interval", "open_time", "close_time", *[F.col(c).cast("bigint").alias(c) for c in ("open", "high", "low", "close", "volume", "quote_volume")], "count")
    name = lambda *parts: F.concat_ws(":", *[F.lit(p[1:]) if p.startswith("'") else F.col(p) for p in parts])
    channels = [
        (order, [("'orderbook", "pool_id"), ("'user", "user", "'orders"), ("'user", "user", "'orders", "pool_id")], "timestamp"),
        (trade, [("'trades", "pool_id"), ("'user", "taker_address", "'trades", "pool_id")], "timestamp"),
        (balance, [("'user", "user", "'balance")], "timestamp"),
        (candle, [("'candles", "interval", "pool_id")], "close_time"),
    ]
    out = None
    for rows, to, time in channels:
        sent = reconcile.envelope(rows, F.array(*[name(*c) for c in to]), rows.columns, "indexer", F.col(time) * 1000)
        out = sent if out is None else out.unionByName(sent)
    return out


_Q["g11_channels"] = lambda s, d: _messages(s, d).groupBy("channel").agg(F.count("*").alias("messages"))
_Q["g12_envelope"] = _messages
_Q["g13_trim"] = lambda s, d: reconcile.newest(_messages(s, d), "channel", [F.desc("timestamp"), F.desc("data")], 10)
_simple("x1_ids", "trades", lambda t: trades.dedup(t).select("log_index", ident("chain_id", "pool_id", "buy_order_id").alias("order_key"), ident("tx_hash", "log_index").alias("trade_key")))
_simple("x4_try_numbers", "raw_matched", lambda r: r.select("log_index", uint64(F.col("topic2")).alias("number"), F.coalesce(F.col("topic0").try_cast("bigint"), F.lit(-1)).alias("bad")))
_Q["x5_intervals"] = lambda s, d: trades.candles_all(view(s, d, "trades")).select("interval").distinct().join(interval_dim(s), "interval").select("interval", "seconds")


# Every event type, miniblocks, progress and single reads

_SIGNATURES = {name: name for name in decode.EVENTS}
_simple("d1_routed", "raw_all", lambda r: r.select("address", "log_index", decode.label(F.col("topic0"), _SIGNATURES).alias("event_type")).where("event_type <> 'Unknown'"))
_simple("d13_unknown", "raw_all", lambda r: r.where(decode.label(F.col("topic0"), _SIGNATURES) == "Unknown").select("address", "log_index", "topic0"))


def _decoded(event: str) -> Callable[[DataFrame], DataFrame]:
    numbers = [c for c, (_, kind) in decode.EVENTS[event].items() if kind == "u256"]
    rest = [c for c in decode.EVENTS[event] if c not in numbers]
    return lambda r: decode.decode_all(r, _SIGNATURES)[event].select("address", "block_number", "log_index", "tx_hash", *rest, *[F.col(c).cast("string").alias(c) for c in numbers], "overflow")


for _number, _event in zip((2, 3, 5, 6, 7, 8, 9, 10, 11, 12), ("PoolCreated", "OrderPlaced", "UpdateOrder", "OrderCancelled", "Deposit", "Withdrawal", "Lock", "Unlock", "TransferFrom", "TransferLockedFrom"), strict=True):
    _simple(f"d{_number}_" + "".join(f"_{c.lower()}" if c.isupper() else c for c in _event).lstrip("_"), "raw_all", _decoded(_event))

_simple("d16_event_labels", "raw_all", lambda r: r.select("log_index", decode.label(F.col("topic0"), _SIGNATURES).alias("event_type")))
_Q["d15_all_classes"] = lambda s, d: decode.relevant(view(s, d, "raw_all"), view(s, d, "pools"), manager="pm", balances="bm", signatures=_SIGNATURES).select("address", "event_type", "log_index")
_simple("s3_book_logs", "raw_all", lambda r: (lambda last: r.where(F.col("block_number").between(last[0], last[1]) & F.col("topic0").isin(*decode.BOOK_EVENTS)))(r.agg(F.min("block_number"), F.floor((F.min("block_number") + F.max("block_number")) / 2)).first()).select("address", "topic0", "block_number", "log_index"))
_simple("s5_miniblocks", "miniblocks", lambda m: decode.miniblocks(m).groupBy("block_number").agg(F.count("*").alias("miniblocks"), F.sum("tx_count").alias("tx_count"), F.sum("log_count").alias("log_count"), F.count("_corrupt_record").alias("corrupt")))
_simple("s5_miniblock_logs", "miniblocks", lambda m: decode.miniblock_logs(decode.miniblocks(m)).select("block_number", "tx", "i", "address", "log_index"))


def _progress(s, d):
    """What a first run over the bulk source leaves, then what the live feed adds."""
    half = view(s, d, "bulk_a").groupBy().agg(F.floor((F.min("block_number") + F.max("block_number")) / 2).alias("block")).select(F.lit("bulk").alias("name"), "block")
    return sinks.advanced(half, view(s, d, "live").groupBy("event_type").agg(F.max("block_number").alias("block")).select(F.col("event_type").alias("name"), "block"))


_Q["s7_resume"] = lambda s, d: sinks.resume(view(s, d, "bulk_a"), _progress(s, d), "bulk").select("content_id", "block_number", "log_index")
_Q["g14_only_forward"] = lambda s, d: sinks.advanced(_progress(s, d), _progress(s, d).select("name", (F.col("block") - 1000).alias("block")))
_Q["v4_verified"] = lambda s, d: sinks.verified(_progress(s, d), _bulk(s, d).groupBy("source").agg(F.max("block_number").alias("block")).select("source", "block", F.lit(True).alias("ok")), "verified")
_Q["v6_alerts_all"] = lambda s, d: reconcile.missing_by_type(_bulk(s, d), view(s, d, "live")).where("missing > 0")


@_query("a17_rows_written")
def _(s, d):
    """Rows that one flush of the whole log writes to each table."""
    made = {
        "orders": reconcile.keep_last(view(s, d, "order_events").select("pool_id", "order_id", "seq"), ["pool_id", "order_id"], "seq"),
        "trades": view(s, d, "trades").dropDuplicates(["tx_hash", "log_index"]).select("log_index"),
        "balances": reconcile.keep_last(balances.deltas(view(s, d, "balance_events")).select("user", "token_id", "seq"), ["user", "token_id"], "seq"),
        "pools": view(s, d, "pools").select("pool_id"),
        "candles": _candles(s, d).select("id"),
    }
    out = None
    for name, rows in made.items():
        one = rows.groupBy().agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


_simple("p1_pool", "pools", lambda p: p.where("pool_id = 'pool_3'").select("pool_id", "order_book", "base_currency", "quote_currency", "base_decimals", "quote_decimals"))


@_query("p12_stats")
def _(s, d):
    """One row of totals, the last block and whether the live feed lags behind the bulk source."""
    t = trades.dedup(view(s, d, "trades")).agg(F.count("*").alias("total_trades"))
    o = orders.latest(view(s, d, "order_events")).agg(F.count("*").alias("total_orders"), F.count_if(is_active(F.col("status"))).alias("active_orders"))
    p = view(s, d, "pools").agg(F.count("*").alias("total_pools"))
    b = view(s, d, "live").agg(F.max("block_number").alias("last_block"))
    bulk = view(s, d, "bulk_a").agg(F.max("block_number").alias("bulk_block"))
    one = lambda a, b: a.join(F.broadcast(b), F.lit(True))
    return one(one(one(one(t, o), p), b), bulk).select("total_trades", "total_orders", "active_orders", "total_pools", "last_block", (F.col("last_block") < F.col("bulk_block")).alias("is_syncing"))


_simple("p13_balance", "balance_events", lambda b: _text(balances.final(balances.deltas(b).where("user = 'u_5' and token_id = 'tok_1'")), *_BALANCE))
_simple("p13_trade", "trades", lambda t: trades.dedup(t.where("tx_hash = 'tx_40'")).select(ident("tx_hash", "log_index").alias("id"), "pool_id", "ts", "price", "quantity"))
_simple("p13_candles_of_pool", "trades", lambda t: trades.candles(t.where("pool_id = 'pool_6'"), "4h").select("id", "open_time", "open", "high", "low", "close", "volume", "count"))
_simple("p13_currencies", "pools", lambda p: p.select(F.explode(F.array("base_currency", "quote_currency")).alias("currency")).groupBy("currency").agg(F.count("*").alias("pools")))
_simple("x2_hex", "raw_matched", lambda r: r.select("log_index", hex_of(F.col("tx_hash")).alias("tx_hex")))
_simple("x6_amount_text", "balance_events", lambda b: balances.final(balances.deltas(b)).select("user", "token_id", *[F.col(c).cast("string").alias(c) for c in ("available", "locked", "total")]))


def queries() -> dict[str, Query]:
    return dict(_Q)
