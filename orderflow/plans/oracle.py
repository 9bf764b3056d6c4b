"""The same results in DuckDB SQL. Folds are written another way where one exists: final balances as a
list fold, islands by self-contained steps, books from windows."""

from __future__ import annotations

from orderflow.sources.fixtures import duck

_T = "t as (select distinct * from fx_trades)"
_IN = "ci as (select chain_id, pool_id, ts, price, quantity as q, price * quantity as qv, taker_side = 'BUY' as tb, block_number * 1048576 + log_index as seq, log_index from t where price <> 0 and quantity <> 0)"
_IV = "iv(interval, s) as (values ('1m', 60), ('5m', 300), ('15m', 900), ('1h', 3600), ('2h', 7200), ('4h', 14400), ('1d', 86400), ('1w', 604800), ('1M', 2629746))"


def _bars(source: str, name: str, where: str = "true", iv: str = "true") -> str:
    return f"""{name} as (select cast(chain_id as varchar) || '_' || pool_id || '_' || o as id, chain_id, pool_id, interval, o as open_time, o + s as close_time,
 cast(arg_min(price, seq) as double) as open, cast(max(price) as double) as high, cast(min(price) as double) as low, cast(arg_max(price, seq) as double) as close,
 cast(sum(q) as double) as volume, cast(sum(qv) as double) as quote_volume, 0.0::double as volume_usd, count(*) as count,
 cast(sum(case when tb then q else 0 end) as double) as taker_buy_base_volume, cast(sum(case when tb then qv else 0 end) as double) as taker_buy_quote_volume,
 cast(sum(qv) as double) / cast(sum(q) as double) as average
 from (select *, ts - ts % s as o from {source}, iv where {where} and {iv}) group by chain_id, pool_id, interval, o, s)"""


def _candles(select: str, iv: str = "true", more: str = "") -> str:
    return f"{duck('trades')}, {_T}, {_IN}, {_IV}, {_bars('ci', 'bars', iv=iv)}{more} {select}"


def _trades(select: str) -> str:
    return f"{duck('trades')}, {_T} {select}"


_STATUS = "case status_code when 1 then 'OPEN' when 2 then 'PARTIALLY_FILLED' when 3 then 'FILLED' when 4 then 'CANCELLED' when 5 then 'EXPIRED' else 'NONE' end"
_LIFE = f"""sg as (select *, sum(case when kind = 'PLACED' then 1 else 0 end) over (partition by pool_id, order_id order by seq rows unbounded preceding) as g from fx_order_events),
pl as (select pool_id, order_id, g, user_addr, side, price, quantity, expiry, is_market_order from sg where kind = 'PLACED'),
up as (select a.seq, a.pool_id, a.order_id, a.g, (select arg_max(b.filled, b.seq) from sg b where b.pool_id = a.pool_id and b.order_id = a.order_id and b.g = a.g and b.kind = 'UPDATED' and b.seq <= a.seq) as f, a.kind, a.ts, {_STATUS} as us from sg a where g > 0),
life as (select seq, pool_id, order_id, kind, ts, g as segment, user_addr, side, price, quantity, expiry, is_market_order, coalesce(f, 0) as filled, case kind when 'PLACED' then 'OPEN' when 'UPDATED' then us else 'CANCELLED' end as status, greatest(0, quantity - coalesce(f, 0)) as remaining
 from up join pl using (pool_id, order_id, g)),
lat as (select * from life qualify row_number() over (partition by pool_id, order_id order by seq desc) = 1),
hist as (select pool_id || '_' || order_id || '_' || seq as id, *, case when kind = 'PLACED' then 'Placed' when kind = 'CANCELLED' then 'Cancelled' when status = 'FILLED' then 'Filled' when status = 'PARTIALLY_FILLED' then 'PartiallyFilled' else 'Updated' end as event from life),
lev as (select pool_id, side, price, cast(sum(remaining) as bigint) as quantity, count(*) as orders from lat where status in ('OPEN', 'PARTIALLY_FILLED') group by all),
book as (select *, row_number() over (partition by pool_id, side order by case when side = 'BUY' then -price else price end) as level from lev)"""


def _orders(select: str) -> str:
    return f"{duck('order_events')}, {_LIFE} {select}"


_DELTAS = """dl as (
 select seq, 0 as sub, user_addr as "user", token_id, ts, kind as change, case kind when 'DEPOSIT' then amount when 'WITHDRAWAL' then -amount when 'LOCK' then -amount else amount end as d_available, case kind when 'LOCK' then amount when 'UNLOCK' then -amount else 0 end as d_locked from fx_balance_events where kind in ('DEPOSIT', 'WITHDRAWAL', 'LOCK', 'UNLOCK')
 union all select seq, 0, user_addr, token_id, ts, 'UNLOCK', amount, -amount from fx_balance_events where kind = 'TRANSFER_LOCKED_FROM'
 union all select seq, case kind when 'TRANSFER_FROM' then 0 else 1 end, user_addr, token_id, ts, 'TRANSFER_OUT', -amount, 0 from fx_balance_events where kind like 'TRANSFER%'
 union all select seq, case kind when 'TRANSFER_FROM' then 1 else 2 end, receiver, token_id, ts, 'TRANSFER_IN', greatest(0, amount - fee_amount), 0 from fx_balance_events where kind like 'TRANSFER%'),
fin as (select "user", token_id, cast(list_reduce(list(d_available order by seq, sub), lambda a, x: greatest(0, a + x), 0::bigint) as bigint) as available, cast(list_reduce(list(d_locked order by seq, sub), lambda a, x: greatest(0, a + x), 0::bigint) as bigint) as locked from dl group by all),
rs as (select *, sum(d_available) over w as sa, sum(d_locked) over w as sl from dl window w as (partition by "user", token_id order by seq, sub rows unbounded preceding)),
run as (select seq, sub, "user", token_id, cast(sa - least(0, min(sa) over w) as bigint) as available, cast(sl - least(0, min(sl) over w) as bigint) as locked from rs window w as (partition by "user", token_id order by seq, sub rows unbounded preceding))"""


def _balances(select: str) -> str:
    return f"{duck('balance_events')}, {_DELTAS} {select}"


_MERGE = """cover as (select feed, unnest(range(from_block, to_block + 1)) as b from fx_ranges),
pts as (select distinct feed, b from cover),
isl as (select feed, min(b) as from_block, max(b) as to_block from (select feed, b, b - row_number() over (partition by feed order by b) as g from pts) group by feed, g)"""


def _ranges(select: str, more: str = "") -> str:
    return f"{duck('ranges')}, {_MERGE}{more} {select}"


def _gaps(start: int) -> str:
    """Gaps from `start` to the last block of any feed, from running maxima."""
    return f""", last as (select max(to_block) as t from fx_ranges),
ends as (select feed, from_block, max(to_block) over (partition by feed order by from_block, to_block rows between unbounded preceding and 1 preceding) as reach from fx_ranges
 union all select feed, t + 1, max(to_block) from fx_ranges, last group by feed, t),
gap as (select feed, greatest(coalesce(reach + 1, {start}), {start}) as from_block, from_block - 1 as to_block from ends where greatest(coalesce(reach + 1, {start}), {start}) < from_block)"""


_BULK = "bulk as (select * from fx_bulk_a union all select * from fx_bulk_b where content_id not in (select content_id from fx_bulk_a)), mis as (select * from bulk where content_id not in (select content_id from fx_live))"
_WIN = "win as (select min(block_number) as lo, min(block_number) + least(60000, max(block_number) - min(block_number)) - 1 as hi from fx_bulk_a)"


def _recon(select: str) -> str:
    return f"{duck('bulk_a', 'bulk_b', 'live')}, {_BULK}, {_WIN} {select}"


_MATCHED = "select address, block_number, log_index, tx_hash, (event_id * 7) % 2500 as buy_order_id, (event_id * 11) % 2500 as sell_order_id, case when event_id % 2 = 0 then 'BUY' else 'SELL' end as side, block_ts as \"timestamp\", cast(price as varchar) as execution_price, cast(price + 5 as varchar) as taker_limit_price, cast(k as varchar) as executed_quantity, false as overflow from m"
_M = "m as (select 'ob_' || (user_id % 8) as address, cast(floor(epoch(ts)) as bigint) // 12 as block_number, event_id as log_index, event_id, 'tx_' || (event_id // 4) as tx_hash, cast(floor(epoch(ts)) as bigint) as block_ts, cast(round(value * 100) as bigint) as price, cast(json_extract_string(props, '$.k') as bigint) as k from events)"
def _sent(source: str, channels: str, time: str, **payload: str) -> str:
    fields = ", ".join(f"'{k}', {v}" for k, v in payload.items())
    return f"select unnest([{channels}]) as channel, cast(json_object({fields}) as varchar) as data, 'indexer' as source, {time} * 1000 as \"timestamp\" from {source}"


_WHOLE = lambda *names: {n: f"cast({n} as bigint)" for n in names}
_TEXT = lambda *names: {n: f"cast({n} as varchar)" for n in names}
_MSG = "msg as (" + " union all ".join([
    _sent("hist", "'orderbook:' || pool_id, 'user:' || user_addr || ':orders', 'user:' || user_addr || ':orders:' || pool_id", "ts", type="case event when 'PartiallyFilled' then 'partially_filled' else lower(event) end", pool_id="pool_id", order_id="order_id", side="side", **_TEXT("price", "quantity", "filled"), status="status", user="user_addr", timestamp="ts"),
    _sent("t", "'trades:' || pool_id, 'user:' || taker || ':trades:' || pool_id", "ts", pool_id="pool_id", **_TEXT("price", "quantity"), side="taker_side", timestamp="ts", tx_hash="tx_hash", log_index="log_index", buy_order_id="buy_order_id", sell_order_id="sell_order_id", taker_address="taker"),
    _sent("(select run.*, dl.ts, dl.change from run join dl using (seq, sub, \"user\", token_id))", "'user:' || \"user\" || ':balance'", "ts", user='"user"', currency="token_id", amount="cast(available as varchar)", locked_amount="cast(locked as varchar)", event_type="lower(change)", timestamp="ts"),
    _sent("bars", "'candles:' || interval || ':' || pool_id", "close_time", pool_id="pool_id", interval="interval", open_time="open_time", close_time="close_time", **_WHOLE("open", "high", "low", "close", "volume", "quote_volume"), count="count"),
]) + ")"


def _messages(select: str) -> str:
    return f"{duck('trades', 'order_events', 'balance_events')}, {_T}, {_IN}, {_IV}, {_bars('ci', 'bars')}, {_LIFE}, {_DELTAS}, {_MSG} {select}"


_USERS = "us as (select \"user\", min(ts) as created_at from (select user_addr as \"user\", ts from fx_order_events union all select \"user\", ts from dl) group by 1)"


_EV = "ev as (select event_id as log_index, 'tx_' || (event_id // 4) as tx_hash, cast(floor(epoch(ts)) as bigint) as sec, cast(floor(epoch(ts)) as bigint) // 12 as block_number, user_id as w1, (event_id * 7) % 2500 as w2, (event_id * 11) % 2500 as w3, event_id % 2 as w4, cast(round(value * 100) as bigint) as w6, cast(json_extract_string(props, '$.k') as bigint) as k, event_id % 12 as t, case when event_id % 12 in (0, 11) then 'pm' when event_id % 12 >= 5 then 'bm' else 'ob_' || (user_id % 8) end as address from events)"
_TYPES = ["PoolCreated", "OrderPlaced", "OrderMatched", "UpdateOrder", "OrderCancelled", "Deposit", "Withdrawal", "Lock", "Unlock", "TransferFrom", "TransferLockedFrom"]


def _event_types() -> dict[str, str]:
    """What each event type's fields are, from the numbers that the logs' words were made of."""
    addr, word = (lambda c: f"'0x' || lpad(lower(hex({c})), 40, '0')"), (lambda c: f"'0x' || lpad(lower(hex({c})), 64, '0')")
    status = lambda c: f"coalesce(list_extract(['NONE', 'OPEN', 'PARTIALLY_FILLED', 'FILLED', 'CANCELLED', 'EXPIRED'], cast({c} % 7 + 1 as int)), 'NONE')"
    amount = f"{addr('w1')} as \"user\", {word('w2')} as id, cast(w6 as varchar) as amount"
    moved = f"{addr('w1')} as operator, {addr('w2')} as sender, {addr('w3')} as receiver, {word('w2')} as id, cast(w6 as varchar) as amount, cast(k as varchar) as fee_amount"
    fields = {
        "d2_pool_created": (0, f"{word('w1')} as pool_id, {addr('w1')} as order_book, {addr('w2')} as base_currency, {addr('w3')} as quote_currency"),
        "d3_order_placed": (1, f"w1 as order_id, {addr('w2')} as \"user\", case w4 when 1 then 'SELL' else 'BUY' end as side, cast(w6 as varchar) as price, cast(k as varchar) as quantity, sec as expiry, w4 <> 0 as is_market_order, {status('k')} as status"),
        "d5_update_order": (3, f"w1 as order_id, sec as \"timestamp\", cast(k as varchar) as filled, {status('k')} as status"),
        "d6_order_cancelled": (4, f"w1 as order_id, {addr('w2')} as \"user\", sec as \"timestamp\", 'CANCELLED' as status"),
        "d7_deposit": (5, amount), "d8_withdrawal": (6, amount), "d9_lock": (7, amount), "d10_unlock": (8, amount),
        "d11_transfer_from": (9, moved), "d12_transfer_locked_from": (10, moved),
    }
    named = "list_extract([" + ", ".join(f"'{t}'" for t in _TYPES) + "], cast(t + 1 as int))"
    known = "address in (select order_book from fx_pools)"
    mini = f"{duck('miniblocks')}, ok as (select cast(floor(epoch(ts)) as bigint) // 12 as block_number, event_id, user_id, event_id % 50 = 7 as bad from events)"
    return {name: f"with {_EV} select address, block_number, log_index, tx_hash, {f}, false as overflow from ev where t = {t}" for name, (t, f) in fields.items()} | {
        "d1_routed": f"with {_EV} select address, log_index, {named} as event_type from ev where t < 11",
        "d13_unknown": f"with {_EV} select address, log_index, 'CurrencyAdded' as topic0 from ev where t = 11",
        "d16_event_labels": f"with {_EV} select log_index, coalesce({named}, 'Unknown') as event_type from ev",
        "d15_all_classes": f"{duck('pools')}, {_EV} select address, {named} as event_type, log_index from ev where t in (0, 5, 6, 7, 8, 9, 10) or (t in (1, 2, 3, 4) and {known})",
        "s3_book_logs": f"with {_EV} select address, {named} as topic0, block_number, log_index from ev where t in (1, 2, 3, 4) and block_number <= (select (min(block_number) + max(block_number)) // 2 from ev)",
        "s5_miniblocks": f"{mini} select case when bad then null else block_number end as block_number, count(*) as miniblocks, cast(sum(case when bad then null else 1 end) as bigint) as tx_count, cast(sum(case when bad then null else 2 end) as bigint) as log_count, count(*) filter (bad) as corrupt from ok group by 1",
        "s5_miniblock_logs": f"{mini} select block_number, 0 as tx, i, case i when 0 then 'ob_' || (user_id % 8) else 'bm' end as address, event_id + i as log_index from ok, (values (0), (1)) v(i) where not bad",
    }


def _reads() -> dict[str, str]:
    progress = "half as (select (min(block_number) + max(block_number)) // 2 as b from fx_bulk_a), pr as (select 'bulk' as name, b as block from half union all select event_type, max(block_number) from fx_live group by 1)"
    return {
        "s7_resume": f"{duck('bulk_a', 'live')}, {progress} select content_id, block_number, log_index from fx_bulk_a, half where block_number > b",
        "g14_only_forward": f"{duck('bulk_a', 'live')}, {progress} select * from pr",
        "v4_verified": f"{duck('bulk_a', 'bulk_b', 'live')}, {progress} select * from pr union all select 'verified', least((select max(block_number) from fx_bulk_a), (select max(block_number) from bulk_rest)) from (select 1)".replace(" select * from pr", ", bulk_rest as (select * from fx_bulk_b where content_id not in (select content_id from fx_bulk_a)) select * from pr"),
        "v6_alerts_all": _recon("select event_type, count(*) as missing from mis group by 1"),
        "a17_rows_written": f"{duck('trades', 'order_events', 'balance_events', 'pools')}, {_T}, {_IN}, {_IV}, {_bars('ci', 'bars')}, {_DELTAS} select 'orders' as \"table\", count(distinct pool_id || '~' || order_id) as rows from fx_order_events union all select 'trades', count(*) from t union all select 'balances', count(distinct \"user\" || '~' || token_id) from dl union all select 'pools', count(*) from fx_pools union all select 'candles', count(*) from bars",
        "p1_pool": f"{duck('pools')} select pool_id, order_book, base_currency, quote_currency, base_decimals, quote_decimals from fx_pools where pool_id = 'pool_3'",
        "p12_stats": f"{duck('trades', 'order_events', 'pools', 'live', 'bulk_a')}, {_T}, {_LIFE} select (select count(*) from t) as total_trades, (select count(*) from lat) as total_orders, (select count(*) from lat where status in ('OPEN', 'PARTIALLY_FILLED')) as active_orders, (select count(*) from fx_pools) as total_pools, (select max(block_number) from fx_live) as last_block, (select max(block_number) from fx_live) < (select max(block_number) from fx_bulk_a) as is_syncing",
        "p13_balance": _balances("select \"user\", token_id, cast(available as varchar) as available, cast(locked as varchar) as locked, cast(available + locked as varchar) as total from fin where \"user\" = 'u_5' and token_id = 'tok_1'"),
        "p13_trade": _trades("select tx_hash || '_' || log_index as id, pool_id, ts, price, quantity from t where tx_hash = 'tx_40'"),
        "p13_candles_of_pool": _candles("select id, open_time, open, high, low, close, volume, count from bars where pool_id = 'pool_6'", "interval = '4h'"),
        "p13_currencies": f"{duck('pools')} select currency, count(*) as pools from (select unnest([base_currency, quote_currency]) as currency from fx_pools) group by 1",
        "x2_hex": f"{duck('raw_matched')} select log_index, '0x' || lower(hex(tx_hash)) as tx_hex from fx_raw_matched",
        "x6_amount_text": _balances("select \"user\", token_id, cast(available as varchar) as available, cast(locked as varchar) as locked, cast(available + locked as varchar) as total from fin"),
    }


def oracle_sql() -> dict[str, str]:
    raw, pools = duck("raw_matched"), duck("pools")
    both = duck("raw_matched", "pools")
    users = f"{duck('order_events', 'balance_events')}, {_DELTAS}, {_USERS}"
    order = "pool_id, order_id, user_addr, side, price, quantity, filled, remaining, status"
    return {
        "s2_new_pool_logs": f"{both} select address, block_number, log_index from fx_raw_matched where address in (select order_book from fx_pools where ts >= 1700000004)",
        "s6_pool_restore": f"{pools} select pool_id, order_book from fx_pools where regexp_full_match(order_book, 'ob_[0-9a-f]+')",
        "s8_trades_in_range": _trades("select tx_hash, log_index, ts, price, quantity from t where pool_id = 'pool_3' and quantity >= 10 and quantity < 50"),
        "d4_order_matched": f"with {_M} {_MATCHED}",
        "d14_relevant": f"{raw} select address, log_index from fx_raw_matched where address in ('ob_0', 'ob_7')",
        "d15_relevant_by_class": f"{both} select address, topic0 as event_type, log_index from fx_raw_matched where address in (select order_book from fx_pools)",
        "d16_event_label": f"{duck('balance_events')} select seq, case kind when 'DEPOSIT' then 'Deposit' when 'LOCK' then 'Lock' when 'UNLOCK' then 'Unlock' else 'Unknown' end as event_type from fx_balance_events",
        "d17_content_id": f"{raw} select log_index, sha256(tx_hash || '~' || address || '~' || topic0 || topic1 || topic2 || topic3 || '~' || data) as content_id from fx_raw_matched",
        "d18_position_id": f"{raw} select tx_hash || '_' || log_index as id from fx_raw_matched",
        "d19_enums": f"{duck('order_events')} select seq, coalesce(list_extract(['NONE', 'OPEN', 'PARTIALLY_FILLED', 'FILLED', 'CANCELLED', 'EXPIRED'], cast(filled % 9 + 1 as int)), 'NONE') as status from fx_order_events",
        "d21_candle_input": f"{duck('trades')}, {_T}, {_IN} select pool_id, ts, price, q as base_quantity, qv as quote_value, tb as is_taker_buy from ci",
        "d22_in_bucket": _trades("select log_index, ts % 3600 < 1800 as first_half from t"),
        "j1_event_pool": f"{pools}, {_M} select pool_id, address, log_index, (event_id * 7) % 2500 as buy_order_id from m join fx_pools on address = order_book",
        "j1_unknown_books": f"{pools}, {_M} select address, log_index from m where address not in (select order_book from fx_pools)",
        "j2_pool_row": f"{pools}, {_M} select log_index, pool_id, base_currency, quote_currency, base_decimals from m join fx_pools on address = order_book",
        "j3_known_books": f"{pools}, {_M} select address, log_index from m where address in (select order_book from fx_pools)",
        "a9_event_counts": f"{duck('bulk_a')}, c as (select block_number // 5000 as batch, count(*) as total, " + ", ".join(f'count(*) filter (event_type = \'{k}\') as "{k}"' for k in ("click", "view", "purchase", "signup", "error")) + " from fx_bulk_a group by 1) select *, coalesce(nullif(concat_ws(' ', " + ", ".join(f"case when \"{k}\" > 0 then '{k}:' || \"{k}\" end" for k in ("click", "view", "purchase", "signup", "error")) + "), ''), 'none') as summary from c",
        "f7_trade_dedup": _trades("select tx_hash, log_index, pool_id, ts, price, quantity, taker_side, taker from t"),
        "a1_candles_1m": _candles("select * from bars", "interval = '1m'"),
        "a1_candles_1mo": _candles("select * from bars", "interval = '1M'"),
        "a2_candles_all": _candles("select * from bars"),
        "a3_buckets": _trades("select log_index, " + ", ".join(f"ts - ts % {s} as open_{i}" for i, s in enumerate((60, 300, 900, 3600, 7200, 14400, 86400, 604800, 2629746))) + " from t"),
        "a4_vwap": f"{duck('trades')}, {_T}, {_IN} select pool_id, cast(sum(qv) as double) / cast(sum(q) as double) as vwap from ci group by 1",
        "a7_pool_trades": _trades("select pool_id, count(*) as trades from t group by 1"),
        "a12_fills": _trades("select tx_hash || '_' || log_index || '_BUY' as id, chain_id, pool_id, ts, price, quantity, buy_order_id as order_id, 'BUY' as side from t union all select tx_hash || '_' || log_index || '_SELL', chain_id, pool_id, ts, price, quantity, sell_order_id, 'SELL' from t"),
        "a13_filled_value": _trades("select pool_id, order_id, cast(sum(price::hugeint * quantity) as varchar) as total_filled_value, count(*) as fills from (select pool_id, buy_order_id as order_id, price, quantity from t union all select pool_id, sell_order_id, price, quantity from t) group by all"),
        "a15_ticker": f"{duck('trades', 'order_events')}, {_T}, {_LIFE}, day as (select *, block_number * 1048576 + log_index as q from t join (select pool_id, max(ts) as m from t group by 1) using (pool_id) where ts > m - 86400), st as (select pool_id, arg_max(price, q) as last_price, arg_min(price, q) as first_price, cast(sum(quantity) as varchar) as volume_24h from day group by 1), bs as (select pool_id, max(price) filter (side = 'BUY') as best_bid, min(price) filter (side = 'SELL') as best_ask from lat where status in ('OPEN', 'PARTIALLY_FILLED') group by 1) select pool_id, best_bid, best_ask, last_price, volume_24h, last_price - first_price as change_24h from st left join bs using (pool_id)",
        "g6_candle_merge": f"{duck('trades')}, {_T}, {_IN}, {_IV}, {_bars('ci', 'a', where='log_index % 3 <> 0', iv="interval = '1h'")}, {_bars('ci', 'b', where='log_index % 3 = 0', iv="interval = '1h'")} select id, coalesce(a.open, b.open) as open, greatest(a.high, b.high) as high, least(a.low, b.low) as low, coalesce(b.close, a.close) as close, coalesce(b.volume, a.volume) as volume, coalesce(b.count, a.count) as count from a full join b using (id)",
        "t11_candles_recent": _candles("select open_time, open, high, low, close, volume from bars where pool_id = 'pool_1' order by open_time desc limit 100", "interval = '1m'"),
        "t12_candle_latest": _candles("select pool_id, max(open_time) as open_time, arg_max(close, open_time) as close from bars group by 1", "interval = '1d'"),
        "t7_recent_trades": _trades("select pool_id, tx_hash, log_index, ts, price from t qualify row_number() over (partition by pool_id order by ts desc, log_index desc) <= 20"),
        "t8_recent_fills": _trades("select id, order_id, side, price from (select tx_hash || '_' || log_index || '_BUY' as id, ts, price, buy_order_id as order_id, 'BUY' as side from t where pool_id = 'pool_4' union all select tx_hash || '_' || log_index || '_SELL', ts, price, sell_order_id, 'SELL' from t where pool_id = 'pool_4') order by ts desc, id limit 100"),
        "t9_taker_trades": _trades("select taker, log_index, ts, price from t qualify row_number() over (partition by taker order by ts desc, log_index desc) <= 5"),
        "f1_order_lifecycle": _orders(f"select seq, {order} from life"),
        "f2_order_latest": _orders(f"select {order}, is_market_order, expiry from lat"),
        "f9_event_typing": _orders("select event, count(*) as n from hist group by 1"),
        "f10_order_history": _orders("select id, seq, user_addr, event, filled, status from hist"),
        "j4_update_with_state": _orders("select seq, kind, user_addr, side, price, quantity, expiry from life where kind <> 'PLACED'"),
        "d20_active": _orders("select pool_id, order_id, status in ('OPEN', 'PARTIALLY_FILLED') as active from lat"),
        "a5_book_depth": _orders("select * replace (cast(quantity as varchar) as quantity) from book"),
        "t1_top_levels": _orders("select * replace (cast(quantity as varchar) as quantity) from book where level <= 5"),
        "a6_active_orders": _orders("select pool_id, count(*) as active_orders from lat where status in ('OPEN', 'PARTIALLY_FILLED') group by 1"),
        "t2_open_side": _orders("select order_id, price, remaining from lat where pool_id = 'pool_1' and side = 'SELL' and status = 'OPEN' order by price, order_id limit 50"),
        "t3_pool_orders": _orders("select order_id, ts, status from lat where pool_id = 'pool_2' order by ts desc, order_id limit 100"),
        "t4_user_orders": _orders("select order_id, ts, price from lat where user_addr = 'u_7' and status = 'CANCELLED' order by ts desc, order_id limit 100"),
        "t5_user_active": _orders("select user_addr, pool_id, order_id, status from lat where status in ('OPEN', 'PARTIALLY_FILLED')"),
        "p4_order": _orders(f"select {order} from lat where pool_id = 'pool_1' and order_id = 1"),
        "p7_orderbook_side": _orders("select level, price, cast(quantity as varchar) as quantity, orders from book where pool_id = 'pool_5' and side = 'BUY' and level <= 50"),
        "f3_deltas": _balances("select seq, sub, \"user\", token_id, ts, change, cast(d_available as varchar) as d_available, cast(d_locked as varchar) as d_locked from dl"),
        "f4_balance_fold": _balances("select \"user\", token_id, cast(available as varchar) as available, cast(locked as varchar) as locked, cast(available + locked as varchar) as total from fin"),
        "f4_balance_running": _balances("select seq, sub, \"user\", token_id, cast(available as varchar) as available, cast(locked as varchar) as locked from run"),
        "f5_balance_changed": _balances('select seq, "user", token_id, cast(available as varchar) as available, cast(locked as varchar) as locked from run qualify row_number() over (partition by seq, "user", token_id order by sub desc) = 1'),
        "f6_total": _balances("select token_id, cast(sum(available + locked) as varchar) as total from fin group by 1"),
        "a14_tokens_held": _balances('select "user", count(distinct token_id) as tokens from dl group by 1'),
        "j7_user_balances": _balances("select \"user\", token_id, cast(available as varchar) as available, cast(locked as varchar) as locked, cast(available + locked as varchar) as total from fin where \"user\" = 'u_11'"),
        "g7_add_amounts": _balances('select "user", token_id, cast(sum(d_available) as varchar) as d_available, cast(sum(d_locked) as varchar) as d_locked from dl group by all'),
        "f11_users": f"{users} select * from us",
        "t13_users_page": f'{users} select * from us order by created_at, "user" limit 10 offset 20',
        "p10_user": f"{users} select * from us where \"user\" = 'u_3'",
        "f8_pool_latest": f"{pools} select pool_id, order_book, case when pool_id = 'pool_0' then quote_currency else 'tok_z' end as quote_currency, ts + case when pool_id = 'pool_0' then 0 else 10 end as ts from fx_pools",
        "t13_pools_page": f"{pools} select pool_id, order_book from fx_pools order by pool_id limit 3 offset 2",
        "t14_pools_newest": f"{pools} select pool_id, ts from fx_pools order by ts desc",
        "p3_pool_by_book": f"{pools} select pool_id, order_book, base_currency from fx_pools where order_book = 'ob_4'",
        "g5_pool_upsert": f"{pools}, u as (select case when pool_id = 'pool_2' then 'pool_9' else pool_id end as pool_id, 'tok_new' as base_currency, 'tok_u' as quote_currency from fx_pools where ts % 2 = 0) select pool_id, coalesce(p.base_currency, u.base_currency) as base_currency, coalesce(u.quote_currency, p.quote_currency) as quote_currency from fx_pools p full join u using (pool_id)",
        "r1_split": f"{duck('ranges')} select feed, s as from_block, least(s + 3, to_block) as to_block from (select feed, to_block, unnest(range(from_block, to_block + 1, 4)) as s from fx_ranges)",
        "r2_merge": _ranges("select feed, from_block, to_block from isl"),
        "r5_contiguous_end": _ranges("select feed, cast(case when min(from_block) <= 25 then arg_min(to_block, from_block) else 24 end as bigint) as contiguous_end from isl group by 1"),
        "r6_block_gaps": f"{duck('ranges')} select * from (select feed, b as after_block, lead(b) over (partition by feed order by b) as next_block, lead(b) over (partition by feed order by b) - b - 1 as missed from (select distinct feed, from_block // 10 as b from fx_ranges)) where missed > 0",
        "t6_history": _orders("select pool_id, order_id, id, ts, event from hist qualify row_number() over (partition by pool_id, order_id order by ts desc, seq desc) <= 100"),
        "t10_candles_range": _candles("select pool_id, open_time, open, close, volume from bars", "interval = '1h'"),
        "r3_gaps": f"{duck('ranges')}{_gaps(500)} select feed, from_block, to_block from gap",
        "r4_complete": f"{duck('ranges')}, own as (select feed, from_block, to_block from fx_ranges union all select 'feed_1', 0, max(to_block) from fx_ranges), mk as (select *, case when from_block <= 1 + max(to_block) over (partition by feed order by from_block, to_block rows between unbounded preceding and 1 preceding) then 0 else 1 end as n from own) select feed, sum(n) = 1 and min(from_block) <= 500 and max(to_block) >= (select max(to_block) from fx_ranges) as complete from mk group by feed",
        "r7_open_gaps": _ranges("select feed, from_block, to_block from gap", """, last as (select max(to_block) as t from fx_ranges),
need as (select feed, unnest(range(0, t + 1)) as b from (select distinct feed from fx_ranges), last),
miss as (select feed, b from need where (feed, b) not in (select (feed, b) from pts) and b not in (select b from pts where feed = 'feed_0')),
gap as (select feed, min(b) as from_block, max(b) as to_block from (select feed, b, b - row_number() over (partition by feed order by b) as g from miss) group by feed, g)"""),
        "r8_before_live": f"{duck('bulk_a', 'live')}, f as (select min((block_number, log_index)) as r from fx_live where block_number >= (select floor((min(block_number) + max(block_number)) / 2) from fx_live)) select content_id, block_number, log_index from fx_bulk_a, f where (block_number, log_index) < r",
        "g1_union_sources": _recon("select content_id, log_index, block_number, source from bulk"),
        "j6_missing": _recon("select content_id, event_type, log_index from mis"),
        "a11_missing_by_type": _recon("select event_type, count(*) as missing from mis group by 1"),
        "v6_alerts": _recon("select event_type, count(*) as missing from mis group by 1 having count(*) > 180"),
        "v3_back_fill": _recon("select event_type, count(*) as rows from (select event_type from fx_live union all select event_type from mis) group by 1"),
        "v2_report": _recon("select lo as from_block, hi as to_block, (select count(distinct content_id) from fx_live where block_number between lo and hi) as live_count, (select count(*) from bulk where block_number between lo and hi) as bulk_count, (select count(*) from mis where block_number between lo and hi) as missing_count, (select count(*) from mis where block_number between lo and hi) > 0 as alert from win"),
        "g2_ids_in_range": _recon("select distinct content_id from fx_live, win where block_number between lo and hi"),
        "v5_buffer_stats": f"{duck('live')} select count(distinct block_number) as blocks, count(distinct content_id) as ids, min(block_number) as first_block, max(block_number) as last_block from fx_live",
        "g3_keep_last": f"{duck('order_events')} select pool_id, order_id, seq, kind, price from fx_order_events qualify row_number() over (partition by pool_id, order_id order by seq desc) = 1",
        "g4_insert_ignore": _trades("select tx_hash, log_index, price from t where log_index % 6 = 0 and log_index % 4 <> 0"),
        "g14_progress": f"{duck('live')} select max(block_number) as last_block, count(distinct block_number) as blocks_processed from fx_live",
        "a8_table_counts": f"{duck('trades', 'order_events', 'pools')}, {_T}, {_LIFE} select 'trades' as \"table\", count(*) as n from t union all select 'orders', count(*) from lat union all select 'pools', count(*) from fx_pools",
        "a10_pipeline_stats": f"{duck('bulk_a')} select count(distinct block_number) as blocks, count(*) as events, count(*) filter (event_type = 'signup') as signups, count(*) filter (event_type = 'purchase') as purchases from fx_bulk_a",
        "g11_channels": _messages("select channel, count(*) as messages from msg group by 1"),
        "g12_envelope": _messages("select * from msg"),
        "g13_trim": _messages("select * from msg qualify row_number() over (partition by channel order by \"timestamp\" desc, data desc) <= 10"),
        "a16_pool_stats": f"{duck('trades', 'order_events')}, {_T}, {_LIFE} select pool_id, total_trades, last_price, total_orders, volume_24h from (select pool_id, count(*) as total_trades, arg_max(price, block_number * 1048576 + log_index) as last_price from t group by 1) full join (select pool_id, count(*) as total_orders from lat group by 1) using (pool_id) left join (select pool_id, cast(sum(quantity) as varchar) as volume_24h from t join (select pool_id, max(ts) as m from t group by 1) using (pool_id) where ts > m - 86400 group by 1) using (pool_id)",
        "x1_ids": _trades("select log_index, '1_' || pool_id || '_' || buy_order_id as order_key, tx_hash || '_' || log_index as trade_key from t"),
        "x4_try_numbers": f"with {_M} select log_index, (event_id * 7) % 2500 as number, cast(-1 as bigint) as bad from m",
        **_event_types(),
        **_reads(),
        "x5_intervals": f"{duck('trades')}, {_IV} select interval, cast(s as bigint) as seconds from iv where (select count(*) from fx_trades) > 0",
    }
