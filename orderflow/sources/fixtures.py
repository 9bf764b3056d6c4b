"""Views over the driver's tables with the record schemas of the operators, in Spark SQL and DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orderflow.operators import decode

_SPARK = {"SEC": "unix_seconds(cast(ts as timestamp))", "K": "cast(get_json_object(props, '$.k') as bigint)", "DIV": "div", "SHA": "sha2({}, 256)"}
_DUCK = {"SEC": "cast(floor(epoch(ts)) as bigint)", "K": "cast(json_extract_string(props, '$.k') as bigint)", "DIV": "//", "SHA": "sha256({})"}

_TRADE = "select 1 as chain_id, 'pool_' || (user_id % 8) as pool_id, 'tx_' || (event_id {DIV} 4) as tx_hash, event_id as log_index, {SEC} {DIV} 12 as block_number, {SEC} as ts, cast(round(value * 100) as bigint) as price, {K} as quantity, case when event_id % 2 = 0 then 'BUY' else 'SELL' end as taker_side, 'u_' || user_id as taker, (event_id * 7) % 2500 as buy_order_id, (event_id * 11) % 2500 as sell_order_id from events"

VIEWS = {
    "trades": _TRADE + " union all " + _TRADE + " where event_id % 10 = 0",
    "order_events": "select event_id as seq, 'pool_' || ((event_id % 2500) % 8) as pool_id, event_id % 2500 as order_id, 'u_' || user_id as user_addr, case event_type when 'signup' then 'PLACED' when 'view' then 'UPDATED' else 'CANCELLED' end as kind, case when (event_id {DIV} 3) % 2 = 0 then 'BUY' else 'SELL' end as side, cast(round(value * 100) as bigint) as price, 100 + {K} as quantity, {K} as filled, case when {K} >= 90 then 3 else 2 end as status_code, {SEC} as ts, {SEC} + 86400 as expiry, {K} % 5 = 0 as is_market_order from events where event_type in ('signup', 'view', 'error')",
    "balance_events": "select event_id as seq, 'u_' || user_id as user_addr, 'u_' || ((user_id * 7 + 1) % 150) as receiver, 'tok_' || (event_id % 3) as token_id, cast(round(value * 100) as bigint) as amount, cast(round(value * 100) as bigint) {DIV} 100 as fee_amount, {SEC} as ts, case when event_type = 'click' then 'DEPOSIT' when event_type = 'view' then 'WITHDRAWAL' when event_type = 'error' then 'LOCK' when event_type = 'purchase' then 'UNLOCK' when event_id % 2 = 0 then 'TRANSFER_FROM' else 'TRANSFER_LOCKED_FROM' end as kind from events",
    "pools": "select 'pool_' || n_nationkey as pool_id, 1 as chain_id, 'ob_' || n_nationkey as order_book, 'tok_' || (n_nationkey % 3) as base_currency, 'tok_q' as quote_currency, 18 as base_decimals, 18 as quote_decimals, 1700000000 + n_nationkey as ts from nation where n_nationkey < 7",
    "ranges": "select event_id * 10 as from_block, event_id * 10 + 9 + ({K} % 15) as to_block, 'feed_' || (user_id % 4) as feed from events where event_type <> 'error'",
    "bulk_a": "select {SHA} as content_id, event_id as log_index, {SEC} {DIV} 12 as block_number, event_type, 'a' as source from events where event_id % 13 <> 5",
    "bulk_b": "select {SHA} as content_id, event_id + 1000000 as log_index, {SEC} {DIV} 12 as block_number, event_type, 'b' as source from events where event_id % 7 <> 0",
    "live": "select {SHA} as content_id, event_id as log_index, {SEC} {DIV} 12 as block_number, event_type from events where event_id % 11 <> 3",
    "raw_matched": "select 'ob_' || (user_id % 8) as address, 'OrderMatched' as topic0, {W1} as topic1, {W2} as topic2, {W3} as topic3, '0x' || {W4} || {W5} || {W6} || {W7} || {W8} as data, {SEC} {DIV} 12 as block_number, event_id as log_index, 'tx_' || (event_id {DIV} 4) as tx_hash from events",
    # Logs of every event type in turn, one type that has no decoder, and JSON miniblocks with one receipt of one log each.
    "raw_all": "select case when event_id % 12 in (0, 11) then 'pm' when event_id % 12 >= 5 then 'bm' else 'ob_' || (user_id % 8) end as address, case event_id % 12 when 0 then 'PoolCreated' when 1 then 'OrderPlaced' when 2 then 'OrderMatched' when 3 then 'UpdateOrder' when 4 then 'OrderCancelled' when 5 then 'Deposit' when 6 then 'Withdrawal' when 7 then 'Lock' when 8 then 'Unlock' when 9 then 'TransferFrom' when 10 then 'TransferLockedFrom' else 'CurrencyAdded' end as topic0, {W1} as topic1, {W2} as topic2, case when event_id % 12 = 1 then {W4} else {W3} end as topic3, '0x' || case event_id % 12 when 0 then {W1} || {W2} || {W3} when 1 then {W6} || {W8} || {W5} || {W4} || {W9} when 2 then {W4} || {W5} || {W6} || {W7} || {W8} when 3 then {W5} || {W8} || {W9} when 4 then {W5} || {W9} when 9 then {W2} || {W6} || {W8} when 10 then {W2} || {W6} || {W8} else {W6} end as data, {SEC} {DIV} 12 as block_number, event_id as log_index, 'tx_' || (event_id {DIV} 4) as tx_hash from events",
    "miniblocks": "select chr(123) || '\"block_number\":' || ({SEC} {DIV} 12) || ',\"index\":' || (event_id % 5) || case when event_id % 50 = 7 then ',\"receipts\":[' else ',\"transactions\":[\"tx_' || event_id || '\"],\"receipts\":[' || chr(123) || '\"logs\":[' || chr(123) || '\"address\":\"ob_' || (user_id % 8) || '\",\"log_index\":' || event_id || chr(125) || ',' || chr(123) || '\"address\":\"bm\",\"log_index\":' || (event_id + 1) || chr(125) || ']' || chr(125) || ',' || chr(123) || '\"logs\":[]' || chr(125) || ']' || chr(125) end as value from events",
}
# The same logs with their signatures, and amounts of 2^64 times as much; now and then the largest uint128.
VIEWS["raw_wide"] = VIEWS["raw_all"].replace("{W6}", "{WIDE}")
for _name, _hash in decode.SIGNATURES.items():
    VIEWS["raw_wide"] = VIEWS["raw_wide"].replace(f"'{_name}'", f"'{_hash}'")
_WIDE = "case when event_id % 97 = 0 then lpad('ffffffffffffffffffffffffffffffff', 64, '0') else lpad(lower(hex(cast(round(value * 100) as bigint))) || '0000000000000000', 64, '0') end"
_WORDS = {"W1": "user_id", "W2": "(event_id * 7) % 2500", "W3": "(event_id * 11) % 2500", "W4": "event_id % 2", "W5": "{SEC}", "W6": "cast(round(value * 100) as bigint)", "W7": "cast(round(value * 100) as bigint) + 5", "W8": "{K}", "W9": "{K} % 7"}


def _expand(name: str, engine: dict[str, str]) -> str:
    tokens = engine | {"SHA": engine["SHA"].format("'tx_' || event_id || '|' || event_type")}
    words = {k: f"lpad(lower(hex({v})), 64, '0')" for k, v in _WORDS.items()}
    text = VIEWS[name].replace("{WIDE}", _WIDE)
    for k, v in words.items():
        text = text.replace(f"{{{k}}}", v)
    for k, v in tokens.items():
        text = text.replace(f"{{{k}}}", v)
    return text


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view. Times are read as UTC, which needs the session's time zone to be UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    source = "nation" if name == "pools" else "events"
    return spark.sql(_expand(name, _SPARK).replace(f"from {source}", "from {source}"), source=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def duck(*names: str) -> str:
    """The views as common table expressions for DuckDB."""
    return "with recursive " + ",\n".join(f"fx_{n} as ({_expand(n, _DUCK)})" for n in names)
