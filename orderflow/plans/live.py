"""Queries of stored layouts, keyed state, live feeds, back-fill and wide amounts, with the same results in
DuckDB SQL. A stream is run to its end over a table that arrives in parts, started again between them."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.functions.scalars import bucket_open, ident, seq_of
from orderflow.operators import backfill, balances, decode, sinks, trades
from orderflow.plans import oracle
from orderflow.sources import tables
from orderflow.sources.fixtures import duck, view
from orderflow.streaming import jobs, live, state


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir (in tests: the warehouse)."""
    conf = spark.conf
    return f"{(conf.get('spark.checkpoint.dir', None) or conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _middle(rows: DataFrame, column: str) -> int:
    """Half-way between the least and the largest value."""
    return rows.agg(F.coalesce(F.floor((F.min(column) + F.max(column)) / 2), F.lit(0))).first()[0]


def _halves(rows: DataFrame, column: str = "ts") -> list[DataFrame]:
    middle = _middle(rows, column)
    return [rows.where(F.col(column) <= middle), rows.where(F.col(column) > middle)]


def _text(df: DataFrame, *amounts: str) -> DataFrame:
    return df.withColumns({a: F.col(a).cast("string") for a in amounts})


# Stored layouts


def _stored_logs(s: SparkSession, d: str) -> tuple[str, int, int]:
    logs, path = view(s, d, "raw_matched"), scratch(s, "logs")
    tables.write_logs(logs, path)
    low, high = logs.agg(F.coalesce(F.min("block_number"), F.lit(0)), F.coalesce(F.max("block_number"), F.lit(0))).first()
    return path, low, high


def s1_log_scan(s: SparkSession, d: str) -> DataFrame:
    """All blocks of two books from the table by block bucket."""
    path, low, high = _stored_logs(s, d)
    return tables.scan_logs(s, path, low, high, ["ob_1", "ob_2"], ["OrderMatched"]).select("address", "block_number", "log_index", "tx_hash")


def s1_log_scan_range(s: SparkSession, d: str) -> DataFrame:
    """The blocks from the middle on, of all books: buckets before are not read."""
    path, low, high = _stored_logs(s, d)
    return tables.scan_logs(s, path, (low + high) // 2, high).select("address", "block_number", "log_index", "tx_hash")


def _stored_candles(s: SparkSession, d: str) -> str:
    path = scratch(s, "candles")
    tables.write_candles(trades.candles_all(view(s, d, "trades")), path)
    return path


def g9_candles_by_interval(s: SparkSession, d: str) -> DataFrame:
    """Bars written by interval and period, and what each interval's folder holds."""
    return s.read.parquet(_stored_candles(s, d)).groupBy("interval").agg(F.count("*").alias("rows"))


def t10_candles_window(s: SparkSession, d: str) -> DataFrame:
    """Minute bars of the second half of the time of all trades, from their folders alone."""
    start = _middle(view(s, d, "trades"), "ts")
    return tables.read_candles(s, _stored_candles(s, d), "1m", start=start).select("pool_id", "open_time", "open", "close", "volume")


# Live feeds


def s4_live_logs(s: SparkSession, d: str) -> DataFrame:
    """Log files, some lines of them cut off, routed to tables: the keys of what each table holds."""
    path = scratch(s, "live-logs")
    lines = live.log_lines(view(s, d, "raw_wide")).withColumn("value", F.when(F.get_json_object("value", "$.log_index").cast("bigint") % 50 == 7, F.expr("substring(value, 1, length(value) - 20)")).otherwise(F.col("value")))
    number = F.regexp_extract("value", r'"block_number":(\d+)', 1).cast("bigint")
    for half in _halves(lines.withColumn("block", number), "block"):
        half.select("value").write.mode("append").text(f"{path}/in")
        live.run_to_end(live.follow_logs(s, f"{path}/in", f"{path}/out", decode.SIGNATURES))
    read = lambda name: s.read.parquet(f"{path}/out/{name}")
    out = read("quarantine").select(F.concat(F.lit("quarantine:"), "reason").alias("table"), F.when(F.col("reason") == "corrupt", F.regexp_extract("raw", r'"block_number":(\d+)', 1)).otherwise(F.col("id")).alias("id"))
    for name in ("pools", "orders", "trades", "balances"):
        out = out.unionByName(read(name).select(F.lit(name).alias("table"), ident("tx_hash", "log_index").alias("id")))
    return out.unionByName(read("progress").groupBy("name").agg(F.max("block").cast("string").alias("id")).select(F.lit("progress").alias("table"), "id"))


def g8_table_sinks(s: SparkSession, d: str) -> DataFrame:
    """Tables that a stream of trades keeps, compacted between its parts: trades by block bucket, each once,
    and the last price of a pool."""
    path, rows = scratch(s, "tables"), view(s, d, "trades")
    made = {
        "trades": sinks.Table(lambda t: t.select(ident("tx_hash", "log_index").alias("id"), F.col("price").cast("string").alias("value"), F.floor(F.col("block_number") / tables.BUCKET_BLOCKS).alias("block_bucket")), ["id"], by=["block_bucket"], fixed=True),
        "last_price": sinks.Table(lambda t: t.select(F.col("pool_id").alias("id"), F.col("price").cast("string").alias("value"), seq_of(F.col("block_number"), F.col("log_index")).alias("seq")), ["id"], order="seq"),
    }
    kinds = {name: table.rows(rows).schema for name, table in made.items()}
    for half in _halves(rows):
        live.arriving([half], path, lambda stream: stream.writeStream.foreachBatch(sinks.write_tables(f"{path}/out", made)))
        for name, table in made.items():
            sinks.compact(s, f"{path}/out", name, table, kinds[name])
    now = {name: sinks.current(s, f"{path}/out", name, table, kinds[name]).select(F.lit(name).alias("table"), "id", "value") for name, table in made.items()}
    return now["trades"].unionByName(now["last_price"])


def w1_live_bars(s: SparkSession, d: str) -> DataFrame:
    """Hourly bars from the updates of a stream: of each bar its last version."""
    rows = state.drained(_halves(trades.dedup(view(s, d, "trades"))), lambda t: jobs.candles(t, 3600), scratch(s, "live-bars"))
    now = state.last_version(rows.select("pool_id", "open_time", "open", "high", "low", "close", "volume", "count", "batch"), ["pool_id", "open_time"])
    return now.withColumns({c: F.col(c).cast("double") for c in ("open", "high", "low", "close", "volume")})


def w6_stream_dedup(s: SparkSession, d: str) -> DataFrame:
    """Trades of a stream without their replays."""
    rows = state.drained(_halves(view(s, d, "trades")), jobs.dedup, scratch(s, "deduped"), "append")
    return rows.select("tx_hash", "log_index", "pool_id", "ts", "price", "quantity")


def a9_event_types(s: SparkSession, d: str) -> DataFrame:
    """Counts of the event types by batches of blocks, with their summary."""
    logs = view(s, d, "raw_wide").withColumn("event_type", decode.label(F.col("topic0"), decode.SIGNATURES))
    return decode.event_counts(logs, F.floor(F.col("block_number") / tables.BUCKET_BLOCKS), list(decode.EVENTS))


def w2_late_bars(s: SparkSession, d: str) -> DataFrame:
    """Hourly bars when trades of 90 and more come with the second half, later than the grace."""
    rows, path = view(s, d, "trades"), scratch(s, "late-bars")
    late = F.col("quantity") >= 90
    early = F.col("ts") <= _middle(rows, "ts")
    bars = live.Bars(s, f"{path}/bars", "1h", rows.schema)
    live.arriving([rows.where(early & ~late), rows.where(~early | late)], path, lambda stream: stream.writeStream.foreachBatch(bars))
    return bars.current()


def w4_order_state(s: SparkSession, d: str) -> DataFrame:
    """The order lifecycle from keyed state, the stream stopped and started in the middle."""
    found = state.last_version(state.drained(_halves(view(s, d, "order_events")), state.order_fold, scratch(s, "orders")), ["pool_id", "order_id", "seq"])
    return _text(found.select("seq", "pool_id", "order_id", "user_addr", "side", "price", "quantity", "filled", "remaining", "status", "segment"), "price", "quantity", "filled", "remaining")


def w5_balance_state(s: SparkSession, d: str) -> DataFrame:
    """Running balances from keyed state."""
    found = state.last_version(state.drained(_halves(balances.deltas(view(s, d, "balance_events"))), state.balance_fold, scratch(s, "balances")), ["user", "token_id", "seq", "sub"])
    return _text(found.select("seq", "sub", "user", "token_id", "available", "locked", "total"), "available", "locked", "total")


#: The bursts of the fixture's trades are slower than a feed's: 10 minutes quiet, 50 minutes at most.
QUIET, CAP = 600_000, 3_000_000


def w7_debounced(s: SparkSession, d: str) -> DataFrame:
    """The last price of each burst of a pool's trades; a message long after them brings the watermark."""
    t = trades.dedup(view(s, d, "trades")).select(F.col("pool_id").alias("channel"), F.col("log_index").alias("seq"), (F.col("ts") * 1000).alias("event_ms"), F.col("price").cast("string").alias("data"))
    end = t.groupBy().agg((F.max("event_ms") + 10 * CAP).alias("event_ms")).where("event_ms is not null").select(F.lit("end").alias("channel"), F.lit(0).cast("bigint").alias("seq"), "event_ms", F.lit("").alias("data"))
    return state.drained([*_halves(t, "event_ms"), end], lambda e: state.debounced(e, QUIET, CAP), scratch(s, "debounced"), "append").drop("batch")


def w8_current_bars(s: SparkSession, d: str) -> DataFrame:
    """The bar that is open now of each pool, from a stream's updates."""
    rows = state.drained(_halves(trades.dedup(view(s, d, "trades"))), lambda t: jobs.candles(t, 86400), scratch(s, "current-bars"))
    now = state.last_version(rows.select("pool_id", "open_time", "open", "close", "count", "batch"), ["pool_id", "open_time"])
    newest = now.groupBy("pool_id").agg(F.max_by(F.struct("open_time", "open", "close", "count"), "open_time").alias("b")).select("pool_id", "b.*")
    return newest.withColumns({c: F.col(c).cast("double") for c in ("open", "close")})


_KINDS = ["click", "view", "purchase", "signup", "error"]


def w9_feed_metrics(s: SparkSession, d: str) -> DataFrame:
    """Counts and the last block that a feed's batches told to a listener while they ran."""
    path = scratch(s, "metrics")
    listener = live.MetricsTable(s, f"{path}/metrics")
    s.streams.addListener(listener)
    try:
        def start(stream: DataFrame):
            return live.observed(stream, "feed", _KINDS).writeStream.foreachBatch(lambda frame, number: frame.write.mode("overwrite").parquet(f"{path}/out/batch={number}"))

        for part in _halves(view(s, d, "bulk_a"), "block_number"):
            live.arriving([part], path, start)
            listener.ended.wait(60)
    finally:
        s.streams.removeListener(listener)
    told = listener.read()
    return told.groupBy("metric").agg(F.when(F.col("metric") == "last_block", F.max("value")).otherwise(F.sum("value")).alias("value"))


# Back-fill


def _back_filled(s: SparkSession, d: str) -> backfill.Store:
    """A feed with holes after three cycles: the second source is not there in the first one."""
    path = scratch(s, "back-fill")
    logs = view(s, d, "raw_matched").withColumn("content_id", decode.content_id(F.col("tx_hash"), F.col("address"), [F.col(f"topic{i}") for i in range(4)], F.col("data")))
    # The same log of one transaction and contract may come twice; the position tells these apart. Ids are kept as
    # bytes: no column compresses worse.
    logs = logs.withColumn("content_id", F.unhex(F.sha2(F.concat_ws("~", "content_id", "log_index"), 256)))
    # Which feeds have a log is found once and stored with it.
    feeds = {"live": 0, "bulk_a": 0, "bulk_b": 1_000_000}
    seen = reduce(DataFrame.unionByName, [view(s, d, n).select((F.col("log_index") - shift).alias("log_index"), *[F.lit(n == m).alias(f"in_{m}") for m in feeds]) for n, shift in feeds.items()])
    seen = seen.groupBy("log_index").agg(*[F.bool_or(f"in_{m}").alias(f"in_{m}") for m in feeds])
    logs.join(seen, "log_index").select(*logs.columns, *[f"in_{m}" for m in feeds]).write.parquet(f"{path}/feeds")
    live_, a, b = (s.read.parquet(f"{path}/feeds").where(f"in_{m}").select(logs.columns) for m in feeds)
    store = backfill.Store(s, f"{path}/store", logs.schema)
    store.add(live_)
    ids = ["content_id", "block_number"]
    store.run_cycle(1, a, known=a.select(ids).unionByName(b.select(ids)))
    store.run_cycle(2, a, b)
    store.run_cycle(3, a, b)
    return store


def v3_refolded(s: SparkSession, d: str) -> DataFrame:
    """Hourly bars of the known books, decoded and folded from the back-filled store."""
    logs = _back_filled(s, d).logs()
    t = decode.with_pool(decode.decode(logs, "OrderMatched"), view(s, d, "pools"))
    t = t.select("chain_id", "pool_id", "tx_hash", "log_index", "block_number", F.col("timestamp").alias("ts"), F.col("execution_price").cast("bigint").alias("price"), F.col("executed_quantity").cast("bigint").alias("quantity"), F.col("side").alias("taker_side"))
    return trades.candles(t, "1h").select("pool_id", "open_time", "open", "high", "low", "close", "volume", "count")


def r7_gap_ledger(s: SparkSession, d: str) -> DataFrame:
    """The gaps that are open after each cycle, and those that each cycle has filled."""
    store = _back_filled(s, d)
    out = store.filled().select(F.lit("filled").alias("part"), F.col("batch").alias("cycle"), "from_block", "to_block")
    for cycle in (1, 2, 3):
        out = out.unionByName(store.open_gaps(cycle).select(F.lit("open").alias("part"), F.lit(cycle).cast("bigint").alias("cycle"), "from_block", "to_block"))
    return out


# Wide amounts


def _wide_logs(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "wide-logs")
    tables.write_logs(view(s, d, "raw_wide"), path)
    return s.read.parquet(path).drop("block_bucket")


def d1_signatures(s: SparkSession, d: str) -> DataFrame:
    """Logs labelled by their signature hashes."""
    return view(s, d, "raw_wide").select("address", "log_index", decode.label(F.col("topic0"), decode.SIGNATURES).alias("event_type"))


def n1_wide_amounts(s: SparkSession, d: str) -> DataFrame:
    """Amounts and prices beyond 64 bits of all event types that have them."""
    raw, out = _wide_logs(s, d), None
    for event, field in (("OrderPlaced", "price"), ("OrderMatched", "execution_price"), *[(e, "amount") for e in decode.BALANCE_EVENTS]):
        rows = decode.decode_all(raw, decode.SIGNATURES)[event].select("log_index", F.lit(event).alias("event_type"), F.col(field).cast("string").alias("amount"), "overflow")
        out = rows if out is None else out.unionByName(rows)
    return out


def n2_wide_balances(s: SparkSession, d: str) -> DataFrame:
    """Balances folded from logs with amounts beyond 64 bits."""
    return _text(balances.final(balances.deltas(decode.balance_events(_wide_logs(s, d)))), "available", "locked", "total")


def n3_quarantine(s: SparkSession, d: str) -> DataFrame:
    """All that does not fit: logs, and balances that would leave 38 digits."""
    raw, path = view(s, d, "raw_wide"), scratch(s, "may-overflow")
    changes = balances.deltas(decode.balance_events(raw))
    # Found once and stored: the fold reads its changes more than once.
    balances.may_overflow(changes).write.parquet(path)
    left = balances.overflowed(balances.running(changes.join(s.read.parquet(path), ["user", "token_id"], "left_semi"))).select(F.lit("balance").alias("event_type"), F.col("seq").alias("log_index"), F.lit("").alias("data"))
    return decode.lost(raw).select("event_type", "log_index", "data").unionByName(left)


def n4_wide_bars(s: SparkSession, d: str) -> DataFrame:
    """Daily bars of matches whose prices are beyond 64 bits, as exact numbers."""
    found = decode.with_pool(decode.decode(_wide_logs(s, d).where(F.col("topic0") == decode.SIGNATURES["OrderMatched"]), "OrderMatched").where("not overflow"), view(s, d, "pools"))
    t = found.select("chain_id", "pool_id", "tx_hash", "log_index", "block_number", F.col("timestamp").alias("ts"), F.col("execution_price").alias("price"), F.col("executed_quantity").alias("quantity"), F.col("side").alias("taker_side"))
    bars = trades.partial_bars(trades.candle_input(trades.dedup(t)), open_time=bucket_open(F.col("ts"), 86400))
    names = ("open", "high", "low", "close", "volume", "quote_volume", "taker_buy_base_volume", "taker_buy_quote_volume")
    return _text(bars.select("pool_id", "open_time", *names, "count"), *names)


_ALL = (n4_wide_bars, g8_table_sinks, w1_live_bars, w6_stream_dedup, a9_event_types, s1_log_scan, s1_log_scan_range, g9_candles_by_interval, t10_candles_window, s4_live_logs, w2_late_bars, w4_order_state, w5_balance_state, w7_debounced, w8_current_bars, w9_feed_metrics, v3_refolded, r7_gap_ledger, d1_signatures, n1_wide_amounts, n2_wide_balances, n3_quarantine)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


# SQL


def oracle_sql() -> dict[str, str]:
    raw, o = duck("raw_matched"), oracle
    named = "list_extract([" + ", ".join(f"'{t}'" for t in oracle._TYPES) + "], cast(t + 1 as int))"
    wide = "cast(w6 as hugeint) * 18446744073709551616::hugeint"
    amount = f"case when log_index % 97 = 0 then null else cast({wide} as varchar) end"
    addr = lambda c: f"'0x' || lpad(lower(hex({c})), 40, '0')"
    token = "'0x' || lpad(lower(hex(w2)), 64, '0')"
    fits = f"wd as (select block_number * 1048576 + log_index as seq, {addr('w1')} as u1, {addr('w2')} as u2, {addr('w3')} as u3, {token} as token_id, {wide} as a, cast(k as hugeint) as fee, t from ev where t between 5 and 10 and log_index % 97 <> 0)"
    moves = """dl as (select seq, 0 as sub, u1 as "user", token_id, case t when 5 then a when 6 then -a when 7 then -a else a end as x, case t when 7 then a when 8 then -a else 0 end as y from wd where t between 5 and 8
 union all select seq, 0, u2, token_id, a, -a from wd where t = 10
 union all select seq, case t when 9 then 0 else 1 end, u2, token_id, -a, 0 from wd where t in (9, 10)
 union all select seq, case t when 9 then 1 else 2 end, u3, token_id, greatest(0::hugeint, a - fee), 0 from wd where t in (9, 10)),
fin as (select "user", token_id, list_reduce(list(x order by seq, sub), lambda p, q: greatest(0::hugeint, p + q), 0::hugeint) as available, list_reduce(list(y order by seq, sub), lambda p, q: greatest(0::hugeint, p + q), 0::hugeint) as locked from dl group by all)"""
    text = lambda *c: ", ".join(f"cast({x} as varchar) as {x}" for x in c)
    both = duck("raw_matched", "live", "bulk_a", "bulk_b")
    has = lambda name, shift=0: f"log_index in (select log_index - {shift} from fx_{name})"
    kept = f"({has('live')} or {has('bulk_a')} or {has('bulk_b', 1000000)})"
    sec = "cast(floor(epoch(events.ts)) as bigint)"
    return {
        "s1_log_scan": f"{raw} select address, block_number, log_index, tx_hash from fx_raw_matched where address in ('ob_1', 'ob_2')",
        "s1_log_scan_range": f"{raw} select address, block_number, log_index, tx_hash from fx_raw_matched where block_number >= (select (min(block_number) + max(block_number)) // 2 from fx_raw_matched)",
        "g8_table_sinks": o._trades("select 'trades' as \"table\", tx_hash || '_' || log_index as id, cast(price as varchar) as value from t union all select 'last_price', pool_id, cast(arg_max(price, block_number * 1048576 + log_index) as varchar) from t group by pool_id"),
        "w1_live_bars": o._candles("select pool_id, open_time, open, high, low, close, volume, count from bars", "interval = '1h'"),
        "w6_stream_dedup": o._trades("select tx_hash, log_index, pool_id, ts, price, quantity from t"),
        "a9_event_types": f"with {o._EV}, x as (select block_number // 10000 as batch, {named} as e from ev), c as (select batch, count(*) as total, " + ", ".join(f"count(*) filter (e = '{k}') as \"{k}\"" for k in o._TYPES) + " from x group by 1) select *, coalesce(nullif(concat_ws(' ', " + ", ".join(f"case when \"{k}\" > 0 then '{k}:' || \"{k}\" end" for k in o._TYPES) + "), ''), 'none') as summary from c",
        "g9_candles_by_interval": o._candles("select interval, count(*) as rows from bars group by 1"),
        "t10_candles_window": o._candles("select pool_id, open_time, open, close, volume from bars where open_time >= (select (min(ts) + max(ts)) // 2 from t)", "interval = '1m'"),
        "s4_live_logs": f"""with {o._EV}, x as (select *, log_index % 50 = 7 as cut, t in (1, 2, 5, 6, 7, 8, 9, 10) and log_index % 97 = 0 as lost from ev)
select case when cut then 'quarantine:corrupt' when t = 11 then 'quarantine:unknown' when lost then 'quarantine:overflow' when t = 0 then 'pools' when t in (1, 3, 4) then 'orders' when t = 2 then 'trades' else 'balances' end as "table", case when cut then cast(block_number as varchar) else tx_hash || '_' || log_index end as id from x
union all select 'progress', cast(max(block_number) as varchar) from x where not cut""",
        "w2_late_bars": o._candles("select * from bars", "interval = '1h'"),
        "w4_order_state": o._orders(f"select seq, pool_id, order_id, user_addr, side, {text('price', 'quantity', 'filled', 'remaining')}, status, cast(segment as bigint) as segment from life"),
        "w5_balance_state": o._balances(f"select seq, sub, \"user\", token_id, {text('available', 'locked')}, cast(available + locked as varchar) as total from run"),
        "w7_debounced": f"""{duck('trades')}, {o._T}, e as (select pool_id as channel, log_index, ts * 1000 as ms, cast(price as varchar) as data, row_number() over (partition by pool_id order by ts, log_index) as k from t),
b as (select channel, k, ms as first, ms as last, 1 as burst from e where k = 1
 union all select e.channel, e.k, case when e.ms < least(b.last + {QUIET}, b.first + {CAP}) then b.first else e.ms end, e.ms, case when e.ms < least(b.last + {QUIET}, b.first + {CAP}) then b.burst else b.burst + 1 end from b join e on e.channel = b.channel and e.k = b.k + 1)
select channel, min(first) as first_ms, least(max(last) + {QUIET}, min(first) + {CAP}) as sent_ms, arg_max(data, k) as data, count(*) as events from b join e using (channel, k) group by channel, burst""",
        "w8_current_bars": o._candles("select pool_id, open_time, open, close, count from bars qualify row_number() over (partition by pool_id order by open_time desc) = 1", "interval = '1d'"),
        "w9_feed_metrics": f"{duck('bulk_a')} select 'events' as metric, count(*) as value from fx_bulk_a union all select 'last_block', max(block_number) from fx_bulk_a" + "".join(f" union all select '{k}', count(*) filter (event_type = '{k}') from fx_bulk_a" for k in _KINDS),
        "v3_refolded": f"""{both}, {duck('pools').removeprefix('with recursive ')}, src as (select * from fx_raw_matched where {kept}),
ci as (select 1 as chain_id, pool_id, {sec} as ts, cast(round(value * 100) as bigint) as price, cast(json_extract_string(props, '$.k') as bigint) as q, cast(round(value * 100) as bigint) * cast(json_extract_string(props, '$.k') as bigint) as qv, event_id % 2 = 0 as tb, {sec} // 12 * 1048576 + event_id as seq from events join src on event_id = log_index join fx_pools on order_book = address where cast(json_extract_string(props, '$.k') as bigint) <> 0 and round(value * 100) <> 0),
{o._IV}, {o._bars('ci', 'bars', iv="interval = '1h'")} select pool_id, open_time, open, high, low, close, volume, count from bars""",
        "r7_gap_ledger": f"""{both}, x as (select block_number, {has('live')} as l, {has('bulk_a')} as a, {has('bulk_b', 1000000)} as b from fx_raw_matched),
y as (select block_number, bool_or(not l and a) as in_a, bool_or(not l and not a and b) as in_b from x group by 1),
z as (select 'filled' as part, 1 as cycle, block_number from y where in_a and not in_b union all select 'filled', 2, block_number from y where in_b union all select 'open', 1, block_number from y where in_b)
select part, cast(cycle as bigint) as cycle, min(block_number) as from_block, max(block_number) as to_block from (select *, block_number - row_number() over (partition by part, cycle order by block_number) as g from z) group by part, cycle, g""",
        "d1_signatures": f"with {o._EV} select address, log_index, coalesce({named}, 'Unknown') as event_type from ev",
        "n1_wide_amounts": f"with {o._EV} select log_index, {named} as event_type, {amount} as amount, log_index % 97 = 0 as overflow from ev where t in (1, 2, 5, 6, 7, 8, 9, 10)",
        "n2_wide_balances": f"with {o._EV}, {fits}, {moves} select \"user\", token_id, {text('available', 'locked')}, cast(available + locked as varchar) as total from fin",
        "n4_wide_bars": f"""{duck('pools')}, {o._EV}, m as (select pool_id, sec - sec % 86400 as open_time, {wide} as p, k as q, {wide} * k as v, case when w4 = 0 then k else 0 end as tq, case when w4 = 0 then {wide} * k else 0 end as tv, block_number * 1048576 + log_index as s from ev join fx_pools on order_book = address where t = 2 and log_index % 97 <> 0 and k <> 0 and w6 <> 0)
select pool_id, open_time, cast(arg_min(p, s) as varchar) as open, cast(max(p) as varchar) as high, cast(min(p) as varchar) as low, cast(arg_max(p, s) as varchar) as close, cast(sum(q) as varchar) as volume, cast(sum(v) as varchar) as quote_volume, cast(sum(tq) as varchar) as taker_buy_base_volume, cast(sum(tv) as varchar) as taker_buy_quote_volume, count(*) as count from m group by pool_id, open_time""",
        "n3_quarantine": f"{duck('raw_wide')}, {o._EV} select {named} as event_type, ev.log_index, data from ev join fx_raw_wide r on r.log_index = ev.log_index where t in (1, 2, 5, 6, 7, 8, 9, 10) and ev.log_index % 97 = 0",
    }
