"""Micro-fixtures, one for each quirk of the semantics, and folds against a sequential fold."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from orderflow.functions.scalars import uint256
from orderflow.operators import balances, decode, orders, ranges, reconcile, trades
from orderflow.plans import catalogue, oracle
from orderflow.sources.fixtures import view

D = "/root/testdata/sf0.001"
EVENT = "seq bigint, user_addr string, receiver string, token_id string, amount bigint, fee_amount bigint, ts bigint, kind string"


def _final(spark, rows):
    frame = spark.createDataFrame([(i, u, r, "t", a, f, i, k) for i, (k, u, r, a, f) in enumerate(rows)], EVENT)
    return {r["user"]: (r["available"], r["locked"]) for r in balances.final(balances.deltas(frame), chunk=2).collect()}


def test_balances_clamp_and_transfers(spark):
    assert _final(spark, [("DEPOSIT", "a", "b", 5, 0), ("WITHDRAWAL", "a", "b", 7, 0), ("DEPOSIT", "a", "b", 3, 0)]) == {"a": (3, 0)}
    assert _final(spark, [("DEPOSIT", "a", "b", 12, 0), ("LOCK", "a", "b", 2, 0), ("UNLOCK", "a", "b", 5, 0)]) == {"a": (15, 0)}
    assert _final(spark, [("DEPOSIT", "a", "a", 4, 0), ("TRANSFER_FROM", "a", "a", 10, 1)]) == {"a": (9, 0)}
    assert _final(spark, [("TRANSFER_FROM", "a", "b", 1, 3)]) == {"a": (0, 0), "b": (0, 0)}


@pytest.mark.parametrize("seed", range(3))
def test_balances_against_sequential_fold(spark, seed):
    rnd = random.Random(seed)
    kinds = ["DEPOSIT", "WITHDRAWAL", "LOCK", "UNLOCK", "TRANSFER_FROM", "TRANSFER_LOCKED_FROM"]
    rows = [(rnd.choice(kinds), rnd.choice("abc"), rnd.choice("abc"), rnd.randrange(20), rnd.randrange(3)) for _ in range(300)]
    want: dict = {}

    def step(user, available, locked):
        a, b = want.get(user, (0, 0))
        want[user] = (max(0, a + available), max(0, b + locked))

    for kind, user, receiver, amount, fee in rows:
        if kind == "DEPOSIT":
            step(user, amount, 0)
        elif kind == "WITHDRAWAL":
            step(user, -amount, 0)
        elif kind == "LOCK":
            step(user, -amount, amount)
        elif kind == "UNLOCK":
            step(user, amount, -amount)
        else:
            if kind == "TRANSFER_LOCKED_FROM":
                step(user, amount, -amount)
            step(user, -amount, 0)
            step(receiver, max(0, amount - fee), 0)
    assert _final(spark, rows) == want


def test_order_lifecycle(spark):
    schema = "seq bigint, pool_id string, order_id bigint, user_addr string, kind string, side string, price bigint, quantity bigint, filled bigint, status_code int, ts bigint, expiry bigint, is_market_order boolean"
    rows = [(1, 1, "UPDATED", 0, 3, 2), (2, 1, "PLACED", 10, 0, 1), (3, 1, "UPDATED", 0, 4, 2), (4, 1, "PLACED", 7, 0, 1), (5, 2, "PLACED", 10, 0, 1), (6, 2, "UPDATED", 0, 12, 3), (7, 3, "PLACED", 5, 0, 1), (8, 3, "CANCELLED", 0, 0, 4), (9, 3, "UPDATED", 0, 2, 2), (10, 4, "UPDATED", 0, 2, 2), (11, 5, "PLACED", 5, 0, 1), (12, 5, "UPDATED", 0, 1, 42)]
    for pool in ("p", "q"):  # the same ids in two pools both survive
        frame = spark.createDataFrame([(s, p, o, "u", k, "BUY", 1, q, f, c, s, 0, False) for p in ("p", "q") for s, o, k, q, f, c in rows], schema)
        got = {r.order_id: (r.filled, r.remaining, r.status) for r in orders.latest(frame).where(F.col("pool_id") == pool).collect()}
        assert got == {1: (0, 7, "OPEN"), 2: (12, 0, "FILLED"), 3: (2, 3, "PARTIALLY_FILLED"), 5: (1, 4, "NONE")}


def test_candles(spark):
    schema = "chain_id int, pool_id string, tx_hash string, log_index bigint, block_number bigint, ts bigint, price bigint, quantity bigint, taker_side string"
    rows = [(1, "p", "b", 2, 2, 1704067260 + 5, 7, 1, "BUY"), (1, "p", "a", 1, 1, 1704067260, 5, 2, "SELL"), (1, "p", "a", 1, 1, 1704067260, 5, 2, "SELL"), (1, "p", "c", 3, 3, 1704067270, 0, 9, "BUY"), (1, "p", "d", 4, 4, 1704067270, 9, 0, "BUY")]
    frame = spark.createDataFrame(rows, schema)
    (bar,) = trades.candles(frame, "1m").collect()
    assert (bar.open, bar.close, bar.volume, bar["count"], bar.taker_buy_base_volume) == (5.0, 7.0, 3.0, 2, 1.0)
    (month,) = trades.candles(frame, "1M").collect()
    assert month.open_time == 1704067260 // 2629746 * 2629746 == 1701445662
    assert trades.candles(frame.limit(0), "1m").count() == 0


def test_ranges(spark):
    made = lambda rows: spark.createDataFrame([("f", a, b) for a, b in rows], "feed string, from_block bigint, to_block bigint")
    got = lambda df: sorted((r.from_block, r.to_block) for r in df.collect())
    # The published test ranges of a range tracker.
    three = [(0, 100), (200, 300), (500, 600)]
    assert got(ranges.gaps(made(three), 0, 1000)) == [(101, 199), (301, 499), (601, 1000)]
    assert got(ranges.gaps(made([*three, (101, 199)]), 0, 1000)) == [(301, 499), (601, 1000)]
    assert ranges.complete(made([(0, 50), (40, 80), (81, 100)]), 0, 100).first().complete
    end = lambda rows, start: ranges.contiguous_end(made(rows), start).first().contiguous_end
    assert [end(three, s) for s in (0, 100, 150, 250, 700)] == [100] * 5 and (end([(10, 20)], 5), end([(10, 20)], 0)) == (4, 0)
    whole = lambda rows, start, target: ranges.complete(made(rows), start, target).first().complete
    assert not whole(three, 0, 100) and not whole([(0, 100), (200, 300)], 0, 100) and not whole([(1, 100)], 0, 100) and not whole([(0, 99)], 0, 100)
    assert got(ranges.subtract(made([(10, 20), (30, 40)]), made([(15, 17), (38, 99), (0, 10)]), 0, 50)) == [(11, 14), (18, 20), (30, 37)]
    assert got(ranges.subtract(made([(0, 50)]), made([(60, 70)]), 0, 50)) == [(0, 50)] and got(ranges.subtract(made([(0, 50)]), made([(0, 50)]), 0, 50)) == []
    assert got(ranges.merge(made([(0, 50), (40, 80), (81, 100)]), bucket_blocks=30)) == [(0, 100)]


def test_words_round_trip(spark):
    values = [0, 1, 2**64, 10**38 - 1, 2**128 - 1]
    got = spark.createDataFrame([(f"{v:064x}",) for v in values], "w string").select(uint256(F.col("w")).alias("v")).collect()
    assert [r.v if r.v is None else int(r.v) for r in got] == [0, 1, 2**64, 10**38 - 1, None]


@pytest.mark.parametrize("event", sorted(decode.EVENTS))
def test_decode_every_event(spark, event):
    fields = decode.EVENTS[event]
    number = {at: 100 + i for i, (at, _) in enumerate(fields.values())}
    data = "0x" + "".join(f"{number.get(i, 0):064x}" for i in range(8))
    row = {f"topic{i}": f"{number.get(f'topic{i}', 0):064x}" for i in (1, 2, 3)} | {"topic0": event, "address": "x", "block_number": 1, "log_index": 2, "tx_hash": "h", "data": data}
    out = decode.decode(spark.createDataFrame([row]), event).first()
    assert not out.overflow
    for name, (at, kind) in fields.items():
        want = {"u64": number[at], "u256": number[at], "address": f"0x{number[at]:040x}", "hex": f"0x{number[at]:064x}", "side": "BUY", "status": "NONE", "bool": True, "cancelled": "CANCELLED"}[kind]
        assert out[name] == want


def test_queries_against_sql(spark):
    con = duckdb.connect()
    for t in ("events", "nation"):
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    known, sql = catalogue.queries(), oracle.oracle_sql()
    assert set(known) == set(sql)
    text = lambda v: "" if v is None else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    for name in known:
        frame, want = known[name](spark, D), con.sql(sql[name])
        columns = sorted(frame.columns)
        assert columns == sorted(want.columns), name
        place = [want.columns.index(c) for c in columns]
        a = sorted(tuple(text(v) for v in r) for r in frame.select(*[F.col(f"`{c}`") for c in columns]).collect())
        b = sorted(tuple(text(r[i]) for i in place) for r in want.fetchall())
        assert a == b, name


def test_ranges_reach_the_end(spark):
    d = "/root/testdata/sf0.01"
    last = view(spark, d, "ranges").agg(F.max("to_block")).first()[0]
    for name in ("r3_gaps", "r7_open_gaps"):
        assert catalogue.queries()[name](spark, d).agg(F.max("to_block")).first()[0] == last


def test_window_leaves_the_head_out():
    assert [reconcile.window_bounds(*x) for x in ((0, 9, 5), (5, 5, 10), (5, 4, 10), (5, 6, 10), (5, 15, 100), (5, 100, 10))] == [None, None, None, (5, 5), (5, 14), (5, 14)]


def test_fan_out_reaches_every_kind_of_channel(spark):
    sent = {r.channel: r.messages for r in catalogue.queries()["g11_channels"](spark, D).collect()}
    many = lambda pattern: sum(n for c, n in sent.items() if re.fullmatch(pattern, c))
    rows = lambda name: catalogue.queries()[name](spark, D).count()
    assert many("orderbook:.*") == many("user:[^:]*:orders") == many("user:[^:]*:orders:.*") == rows("f10_order_history") > 0
    assert many("trades:.*") == many("user:[^:]*:trades:.*") == rows("f7_trade_dedup")
    assert (many("user:[^:]*:balance"), many("candles:.*:.*")) == (rows("f4_balance_running"), rows("a2_candles_all"))
    assert "volume_24h" in catalogue.queries()["a16_pool_stats"](spark, D).columns
