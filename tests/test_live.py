"""Keyed state, late trades, live logs, metrics, back-fill, layouts, wide amounts and hot accounts."""

import json
import random
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from orderflow.functions.scalars import MOST, sat_add, uint64, uint256
from orderflow.operators import backfill, balances, decode, orders, reconcile, trades
from orderflow.plans import live as live_queries
from orderflow.sources import tables
from orderflow.sources.fixtures import view
from orderflow.streaming import live, state

D = "/root/testdata/sf0.001"


def rows_of(df, columns=None):
    columns = columns or sorted(df.columns)
    text = lambda v: "" if v is None else str(v)
    return sorted(tuple(text(r[c]) for c in columns) for r in df.collect())


# Keyed state


def test_state_gives_the_rows_of_the_batch_folds(spark, tmp_path):
    """Parts are shuffled within the grace, some events come twice, and the stream starts anew between them."""
    cases = [
        (view(spark, D, "order_events").withColumns({"order_id": F.col("seq") % 37, "pool_id": F.lit("p")}), state.order_fold, ["seq"], orders.lifecycle),
        (balances.deltas(view(spark, D, "balance_events")), state.balance_fold, ["user", "token_id", "seq", "sub"], balances.running),
    ]
    for k, (rows, job, keys, batch) in enumerate(cases):
        low, high = rows.agg(F.min("ts"), F.max("ts")).first()
        # Every fourth event comes in the part after its own, which is within a grace of that length.
        part = F.floor((F.col("ts") - low) / ((high - low) / 3 + 1)) + F.when(F.col("seq") % 4 == 0, 1).otherwise(0)
        parts = [rows.where(part == i) for i in range(4)]
        parts[2] = parts[2].unionByName(parts[1].where("seq % 5 = 0"))
        found = state.drained(parts, lambda e, job=job, span=high - low: job(e, f"{span} seconds"), str(tmp_path / f"s{k}"))
        assert found.groupBy(*keys).count().where("count > 1").count() > 0  # rows after a late event are given again
        got, want = state.last_version(found, keys), batch(rows)
        columns = sorted(set(got.columns) & set(want.columns))
        assert {"ts", "seq"} < set(columns) and rows_of(got, columns) == rows_of(want, columns)


class Handle:
    """A key's state as a processor sees it."""

    def __init__(self):
        self.value = None

    getValueState = lambda self, *_: self
    exists = lambda self: self.value is not None
    get = lambda self: self.value

    def update(self, value):
        self.value = value


def test_a_hot_account_is_bounded_in_state(spark):
    schema = balances.deltas(view(spark, D, "balance_events")).withColumn("event_ms", F.lit(0).cast("bigint")).schema
    fold = state.KeyedFold(state._balance_step, (Decimal(0), Decimal(0)), schema, schema, ["seq", "sub"], ["seq", "sub", "user", "token_id", "ts", "change", "available", "locked", "total"])
    handle, most = Handle(), 0
    fold.init(handle)
    for batch in range(50):
        rows = [{"seq": s, "sub": 0, "user": "u", "token_id": "t", "ts": s, "change": "DEPOSIT", "d_available": Decimal(1), "d_locked": Decimal(0), "event_ms": s * 1000} for s in range(batch * 100, batch * 100 + 100)]
        mark = type("Timers", (), {"getCurrentWatermarkInMs": lambda self, b=batch: (b * 100 - 200) * 1000})()
        out = list(fold.handleInputRows(("u", "t"), iter(rows), mark))
        most = max(most, len(handle.value[-1]))
    assert int(out[-1]["available"]) == 5000 and most <= 301


def plain_debounce(events, quiet, cap):
    out, held = [], {}
    for channel, seq, ms, data in sorted(events, key=lambda e: (e[2], e[1])):
        for k, (first, last, n, value) in list(held.items()):
            if min(last + quiet, first + cap) <= ms:
                out.append((k, first, min(last + quiet, first + cap), value, n))
                del held[k]
        first, _, n, _ = held.get(channel, (ms, ms, 0, None))
        held[channel] = (first, ms, n + 1, data)
    return sorted(out)


def test_debounce_is_exact(spark, tmp_path):
    rnd, events, t = random.Random(3), [], 10**12
    for i in range(400):
        t += rnd.choice([5, 30, 60, 60, 90, 99, 100, 101, 300])
        events.append((rnd.choice("aaaab"), i, t, f"d{i}"))
    mixed = [e for i in range(0, 400, 5) for e in rnd.sample(events[i : i + 5], 5)]
    mixed.append(("end", 999, t + 10**7, ""))
    made = lambda rows: spark.createDataFrame(rows, "channel string, seq bigint, event_ms bigint, data string")
    got = state.drained([made(mixed[:200]), made(mixed[200:400]), made(mixed[400:])], lambda e: state.debounced(e, 100, 500, "2 seconds"), str(tmp_path / "d"), "append")
    want = plain_debounce(mixed, 100, 500)
    assert sorted(tuple(r[c] for c in ("channel", "first_ms", "sent_ms", "data", "events")) for r in got.collect()) == want
    assert any(sent - first == 500 for _, first, sent, _, _ in want) and any(n == 1 for *_, n in want)


# Live feeds


def test_late_bars(spark, tmp_path):
    rows = view(spark, D, "trades")
    bars = live.Bars(spark, str(tmp_path / "bars"), "1h", rows.schema)
    middle = rows.agg(F.expr("percentile(ts, 0.5)")).first()[0]
    first, second = rows.where(f"ts <= {middle} and quantity < 80"), rows.where(f"ts > {middle} or quantity >= 80")
    for number, batch in enumerate([first, second, first.limit(0)]):
        bars(batch, number)
    bars(second, 1)  # a batch that is repeated replaces itself
    want = trades.candles(rows, "1h")
    assert rows_of(bars.current()) == rows_of(want)
    remade = spark.read.parquet(str(tmp_path / "bars" / "whole" / "batch=1")).count()
    late = second.where(f"ts <= {middle} - 3600").select("pool_id", F.floor(F.col("ts") / 3600)).distinct().count()
    assert 0 < remade <= late + 8 < want.count()


def test_live_logs(spark, tmp_path):
    sig = decode.SIGNATURES
    word = lambda n: f"{n:064x}"
    log = lambda i, *topics, data="0x": json.dumps({"address": "a", "topics": list(topics), "data": data, "block_number": i, "tx_hash": f"t{i}", "log_index": i})
    lines = [log(1, sig["Deposit"], word(5), word(6), data="0x" + word(10 * 10**18)), log(2, sig["Deposit"], word(5), word(6), data="0x" + word(2**128 - 1)), log(3, "0xdead"), log(4), "{not json", log(5, sig["Lock"], word(5), word(6), data="0x" + word(10**38 - 1)), log(1, sig["Deposit"], word(5), word(6), data="0x" + word(10 * 10**18))]
    for k, part in enumerate([lines[:4], lines[4:]]):
        spark.createDataFrame([(x,) for x in part], "value string").coalesce(1).write.mode("append").text(str(tmp_path / "in"))
        live.run_to_end(live.follow_logs(spark, str(tmp_path / "in"), str(tmp_path / "out"), sig))
        assert k or spark.read.parquet(str(tmp_path / "out" / "balances")).count() == 1
    read = lambda name: spark.read.parquet(str(tmp_path / "out" / name))
    assert sorted((r.log_index, r.event_type, r.amount) for r in read("balances").collect()) == [(1, "Deposit", str(10**19)), (5, "Lock", "9" * 38)]
    assert sorted((r.reason, r.id if r.reason != "corrupt" else r.raw) for r in read("quarantine").collect()) == [("corrupt", "{not json"), ("overflow", "t2_2"), ("unknown", "t3_3"), ("unknown", "t4_4")]
    assert read("progress").agg(F.max("block")).first()[0] == 5


# Back-fill


def test_back_fill_ends(spark, tmp_path):
    schema = "content_id string, block_number bigint, log_index bigint"
    made = lambda *n: spark.createDataFrame([(None if i == 0 else f"c{i}", i // 2, i) for i in n], schema)
    store = backfill.Store(spark, str(tmp_path / "s"), made(0).schema)
    store.add(made(0, 1, 2, 7))
    whole = made(*range(12))
    store.run_cycle(1, made(1, 3, 4, 8), known=whole)
    blocks = lambda df: sorted((r.from_block, r.to_block) for r in df.collect())
    assert blocks(store.open_gaps()) == [(2, 5)] and sorted(r.log_index for r in store.logs().collect()) == [0, 1, 2, 3, 4, 7, 8]
    store.run_cycle(2, made(5), whole)
    before = rows_of(store.logs())
    store.run_cycle(3, whole)
    store.run_cycle(3, whole)
    assert rows_of(store.logs()) == before and len(before) == 12 and store.open_gaps().count() == 0
    assert blocks(store.filled(1)) == [(1, 1)] and blocks(store.open_gaps(1)) == [(2, 5)] and store.recorded().where("batch = 3").count() == 0


# Layouts


def test_readers_prune(spark, tmp_path):
    logs = view(spark, D, "raw_matched")
    tables.write_logs(logs, str(tmp_path / "logs"))
    low, high = logs.agg(F.min("block_number"), F.max("block_number")).first()
    part = tables.scan_logs(spark, str(tmp_path / "logs"), low, low + 15_000, ["ob_1"])
    assert rows_of(part) == rows_of(logs.where(f"block_number <= {low} + 15000 and address = 'ob_1'")) != []
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(block_bucket" in plan
    assert rows_of(tables.scan_logs(spark, str(tmp_path / "logs"), low, high)) == rows_of(logs)
    bars = trades.candles_all(view(spark, D, "trades"))
    tables.write_candles(bars, str(tmp_path / "bars"))
    start = bars.where("interval = '1m'").agg(F.expr("percentile_disc(0.5) within group (order by open_time)")).first()[0]
    got = tables.read_candles(spark, str(tmp_path / "bars"), "1m", pool="pool_1", start=start, end=start + 86400 * 5)
    assert rows_of(got) == rows_of(bars.where(f"interval = '1m' and pool_id = 'pool_1' and open_time >= {start} and open_time < {start} + 432000")) != []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(interval" in plan and "period" in plan.split("PartitionFilters")[1].split("]")[0]
    assert [r.open_time for r in tables.read_candles(spark, str(tmp_path / "bars"), "1h", pool="pool_1", limit=3, newest=True).collect()] == [r.open_time for r in bars.where("interval = '1h' and pool_id = 'pool_1'").orderBy(F.desc("open_time")).limit(3).collect()]


# Amounts

EVENT = "seq bigint, user_addr string, receiver string, token_id string, amount decimal(38,0), fee_amount decimal(38,0), ts bigint, kind string"


def test_a_hot_account_is_folded_in_chunks(spark):
    rnd = random.Random(8)
    kinds = ["DEPOSIT", "WITHDRAWAL", "LOCK", "UNLOCK", "TRANSFER_FROM", "TRANSFER_LOCKED_FROM"]
    # `hot` has half of all events.
    rows = [(i, "hot" if i % 2 else rnd.choice("abc"), rnd.choice(["hot", "a", "b"]), "t", Decimal(rnd.randrange(50) * 10**20), Decimal(rnd.randrange(3)), i, rnd.choice(kinds)) for i in range(0, 4000, 2) for i in (i * 7, i * 7 + 1)]
    changes = balances.deltas(spark.createDataFrame(rows, EVENT)).persist()
    width = balances.chunk_width(changes, rows=200)
    assert changes.groupBy("user", "token_id", F.floor(F.col("seq") / width)).count().agg(F.max("count")).first()[0] <= 400
    held, want = {}, {}
    for r in sorted(changes.collect(), key=lambda r: (r.seq, r.sub)):
        a, b = held.get(r.user, (0, 0))
        held[r.user] = (max(0, a + int(r.d_available)), max(0, b + int(r.d_locked)))
        want[r.seq, r.sub] = held[r.user]
    for chunk in (width, 3, None):
        got = balances.running(changes, chunk)
        assert {(r.seq, r.sub): (int(r.available), int(r.locked)) for r in got.collect()} == want
        last = {(r.seq, r.user): (int(r.available), int(r.locked)) for r in balances.changed(changes, chunk).collect()}
        assert last == {(r.seq, r.user): want[r.seq, r.sub] for r in sorted(changes.collect(), key=lambda r: (r.seq, r.sub))}
        assert {r.user: (int(r.available), int(r.locked)) for r in balances.final(changes, chunk).collect()} == held


def test_amounts_beyond_64_bits_and_38_digits(spark):
    row = lambda i, kind, amount, fee=0: (i, "a", "b", "t", amount, fee, i, kind)
    text = EVENT.replace("decimal(38,0)", "string")
    events = spark.createDataFrame([row(1, "DEPOSIT", str(10 * 10**18)), row(2, "DEPOSIT", str(2**128 - 1)), row(3, "TRANSFER_FROM", str(9 * 10**18), "1"), row(4, "TRANSFER_FROM", "5", str(2**200))], text)
    changes = balances.deltas(events)
    assert {r.user: int(r.total) for r in balances.final(changes).collect()} == {"a": 10**18, "b": 9 * 10**18 - 1}
    assert sorted(r.seq for r in balances.unfit(events).collect()) == [2, 4]
    # Sums that leave 38 digits are null from then on, in either chunking, and go to the quarantine.
    full = balances.deltas(spark.createDataFrame([row(i, "DEPOSIT", str(6 * 10**37)) for i in range(4)] + [(9, "z", "b", "t", "7", "0", 9, "DEPOSIT")], text))
    for chunk in (1, 2, 100):
        assert sorted((r.user, r.seq) for r in balances.overflowed(balances.running(full, chunk)).collect()) == [("a", 1), ("a", 2), ("a", 3)]
        assert {r.user: r.available for r in balances.final(full, chunk).collect()} == {"a": None, "z": 7}
    levels = spark.createDataFrame([("p", "BUY", 1, Decimal(10**37 * 9), "OPEN", 0)] * 2 + [("p", "BUY", 2, Decimal(10**19 * 9), "OPEN", 0)] * 2, "pool_id string, side string, price bigint, remaining decimal(38,0), status string, expiry bigint")
    assert {r.price: r.quantity for r in orders.book(levels).collect()} == {1: None, 2: Decimal(18 * 10**19)}
    added = reconcile.add_amounts(*[spark.createDataFrame([("k", 2**62)], "k string, v bigint")] * 2, ["k"], ["v"])
    assert int(added.first().v) == 2**63
    t = spark.createDataFrame([(1, "p", "x", i, 1, 1, 10**12, 10**12, "BUY", 1, 2) for i in range(2)], "chain_id int, pool_id string, tx_hash string, log_index bigint, block_number bigint, ts bigint, price bigint, quantity bigint, taker_side string, buy_order_id bigint, sell_order_id bigint")
    assert {int(r.total_filled_value) for r in trades.filled_value(t).collect()} == {2 * 10**24}
    wide = t.withColumns({"price": F.col("price").cast("decimal(38,0)") * 10**12, "quantity": F.when(F.col("log_index") == 1, F.lit("9" * 38).cast("decimal(38,0)")).otherwise(F.col("quantity").cast("decimal(38,0)"))})
    (bar,) = trades.candles_all(wide).where("interval = '1h'").collect()  # the second trade's value does not fit
    assert (bar["count"], bar.quote_volume, bar.average) == (1, 1e36, 1e24) and [r.log_index for r in trades.unfit(wide).collect()] == [1] and trades.unfit(t).count() == 0
    total = spark.range(1).select(sat_add(F.lit(str(MOST)), F.lit("5")).alias("a"), sat_add(F.lit("2"), F.lit("5")).alias("b")).first()
    assert (int(total.a), int(total.b)) == (MOST, 7)


def test_words_that_are_cut(spark):
    words = [f"{2**63 - 1:064x}", f"{2**63:064x}", f"{10**38:064x}", f"{5:064x}"[:-3], "", f"{7:064X}"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(uint64(F.col("w")).alias("a"), uint256(F.col("w")).alias("b")).collect()
    assert [(r.a, None if r.b is None else int(r.b)) for r in got] == [(2**63 - 1, 2**63 - 1), (None, 2**63), (None, None), (None, None), (None, None), (7, 7)]


def keccak256(data):
    """Keccak-256 with the original padding, from its definition."""
    mask = (1 << 64) - 1
    turn = lambda v, n: ((v << n) | (v >> (64 - n))) & mask if n else v
    constants, register = [], 1
    for _ in range(24):
        constants.append(0)
        for j in range(7):
            constants[-1] |= (register & 1) << ((1 << j) - 1)
            register = (register << 1) ^ (0x171 if register & 0x80 else 0)
    a, rate = [[0] * 5 for _ in range(5)], 136
    padded = bytearray(data + b"\x01" + b"\0" * (-(len(data) + 1) % rate))
    padded[-1] |= 0x80
    for at in range(0, len(padded), rate):
        for i in range(rate // 8):
            a[i % 5][i // 5] ^= int.from_bytes(padded[at + 8 * i : at + 8 * i + 8], "little")
        for c in constants:
            p = [x[0] ^ x[1] ^ x[2] ^ x[3] ^ x[4] for x in a]
            a = [[v ^ p[x - 1] ^ turn(p[(x + 1) % 5], 1) for v in a[x]] for x in range(5)]
            b, x, y, held = [row[:] for row in a], 1, 0, a[1][0]
            for t in range(24):
                x, y = y, (2 * x + 3 * y) % 5
                held, b[x][y] = a[x][y], turn(held, (t + 1) * (t + 2) // 2 % 64)
            a = [[b[x][y] ^ (~b[(x + 1) % 5][y] & mask & b[(x + 2) % 5][y]) for y in range(5)] for x in range(5)]
            a[0][0] ^= c
    return b"".join(a[x][0].to_bytes(8, "little") for x in range(4)).hex()


def test_signatures():
    assert keccak256(b"") == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert keccak256(b"Transfer(address,address,uint256)") == "ddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
    moved, amount = "address,address,address,uint256,uint256,uint256", "address,uint256,uint256"
    types = {"PoolCreated": "bytes32,address,address,address", "OrderPlaced": "uint48,address,uint8,uint128,uint128,uint48,bool,uint8", "OrderMatched": "address,uint48,uint48,uint8,uint48,uint128,uint128,uint128", "UpdateOrder": "uint48,uint48,uint128,uint8", "OrderCancelled": "uint48,address,uint48,uint8", "TransferFrom": moved, "TransferLockedFrom": moved}
    assert decode.SIGNATURES == {e: f"0x{keccak256(f'{e}({types.get(e, amount)})'.encode())}" for e in decode.EVENTS}


#: Their jobs are tested above and with the other streams; run whole, they take long.
STREAMS = {"w1_live_bars", "w2_late_bars", "w4_order_state", "w5_balance_state", "w6_stream_dedup", "w7_debounced", "w8_current_bars", "s4_live_logs", "g8_table_sinks"}


def test_every_query_has_sql():
    assert set(live_queries.queries()) == set(live_queries.oracle_sql()) > STREAMS


@pytest.mark.parametrize("name", sorted(set(live_queries.queries()) - STREAMS))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "nation"):
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    got, want = live_queries.queries()[name](spark, D), con.sql(live_queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    text = lambda v: "" if v is None else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    place = [want.columns.index(c) for c in columns]
    assert sorted(tuple(text(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(text(r[i]) for i in place) for r in want.fetchall())
