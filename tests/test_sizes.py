"""What larger tables bring: keys beyond those of the small ones, and steps that may not grow faster than their input."""

import random
import shutil
import time

import duckdb
import pytest

from orderflow.operators import backfill, balances, decode, ranges
from orderflow.plans import catalogue, live, oracle
from orderflow.sources.fixtures import view
from orderflow.streaming import state

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shifted(tmp_path_factory):
    """The events with ids from 2^20 on."""
    at = tmp_path_factory.mktemp("shifted")
    duckdb.execute(f"copy (select * replace (event_id + 1048576 as event_id) from '{D}/events.parquet') to '{at}/events.parquet' (format parquet)")
    shutil.copy(f"{D}/nation.parquet", at)
    return str(at)


def same_as_sql(got, d, sql):
    con = duckdb.connect()
    for t in ("events", "nation"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    columns = sorted(got.columns)
    named = ", ".join(f'"{c}"' for c in columns)
    text = lambda v: "" if v is None else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    want = con.execute(f"select {named} from ({sql})").fetchall()
    assert sorted(tuple(text(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(map(text, r)) for r in want)


def test_bars_are_split_by_log_index_beyond_20_bits(spark, shifted):
    same_as_sql(catalogue.queries()["g6_candle_merge"](spark, shifted), shifted, oracle.oracle_sql()["g6_candle_merge"])


def test_open_gaps_send_the_feeds_alone(spark):
    plan = catalogue.queries()["r7_open_gaps"](spark, D)._jdf.queryExecution().sparkPlan().toString()
    sent = [line for line in plan.split("\n") if "BroadcastNestedLoopJoin" in line]
    assert sent and all("BuildRight" in line for line in sent)
    # The right side of each such join, which is sent, has the names of the feeds.
    lines = plan.split("\n")
    for at in (k for k, line in enumerate(lines) if "BroadcastNestedLoopJoin" in line):
        depth = next(c for c, x in enumerate(lines[at]) if x.isalpha() or x == "*")
        right = next(line for line in lines[at + 1 :] if line[depth : depth + 2] == "+-")
        assert "from_block" not in right and "feed" in right, right


def test_subtraction_over_many_buckets(spark):
    pick = random.Random(5)
    made = lambda n, most: [(f"f{pick.randrange(3)}", a := pick.randrange(200), a + pick.randrange(most)) for _ in range(n)]
    for own, taken in ((made(40, 30), made(15, 12)), (made(6, 90), made(40, 4)), ([("f0", 0, 199)], []), ([("f0", 3, 9)], [("f1", 0, 99)])):
        frame = lambda rows: spark.createDataFrame(rows, "feed string, from_block bigint, to_block bigint")
        got = ranges.subtract(frame(own), frame(taken), 10, 180, bucket_blocks=7).collect()
        cover = lambda rows: {(f, b) for f, a, z in rows for b in range(a, z + 1)}
        want = {(f, b) for f, b in cover(own) - cover(taken) if 10 <= b <= 180}
        assert cover(got) == want
        assert len(got) == sum((f, b - 1) not in want for f, b in want)


def test_back_fill_cycle_replaces_itself_and_sorts_what_is_missing_alone(spark, tmp_path):
    made = lambda *n: spark.createDataFrame([(f"c{i}", i // 2, i) for i in n], "content_id string, block_number bigint, log_index bigint")
    store = backfill.Store(spark, str(tmp_path / "s"), made(0).schema)
    store.add(made(*range(0, 40, 2)))
    known = made(*range(40)).select("content_id", "block_number")
    ranges_of = lambda rows: sorted((r.batch, r.from_block, r.to_block) for r in rows.collect())
    for _ in range(2):
        store.run_cycle(1, made(*range(0, 40, 3)), known=known)
        store.run_cycle(2, made(*range(0, 40, 3)), made(*range(40)))
    assert sorted(r.log_index for r in store.logs().collect()) == list(range(40))
    assert ranges_of(store.filled()) == [(1, b, b) for b in (1, 4, 7, 10, 13, 16, 19)] + [(2, a, b) for a, b in ((0, 0), (2, 3), (5, 6), (8, 9), (11, 12), (14, 15), (17, 18))]
    assert sorted((r.from_block, r.to_block) for r in store.open_gaps(1).collect()) == [(0, 0), (2, 3), (5, 6), (8, 9), (11, 12), (14, 15), (17, 18)]
    assert store.open_gaps().count() == 0


def test_debounce_takes_many_waiting_events_of_a_channel():
    """300,000 events of one channel that the watermark closes at once: no step may move all that wait."""

    class Held:
        def __init__(self):
            self.value = None

        exists, get = lambda self: self.value is not None, lambda self: self.value
        clear = lambda self: setattr(self, "value", None)
        update = lambda self, value: setattr(self, "value", value)
        listTimers, registerTimer, deleteTimer = lambda self: [], lambda self, t: None, lambda self, t: None

    job, many = state.Debounce(100, 500), 300_000
    job.held = job.handle = Held()
    events = [(i * 40 + (i // 50) * 1000, i, str(i)) for i in range(many)]
    assert list(job._advance(("c",), events, -1)) == []
    began = time.process_time()
    rows = list(job._advance(("c",), [], events[-1][0] + 10_000))
    assert time.process_time() - began < 5
    assert sum(r.events for r in rows) == many and [r.first_ms for r in rows] == sorted(r.first_ms for r in rows) and job.held.value is None


def test_quarantine_scans_the_logs_once_for_the_fold(spark):
    plan = decode.balance_events(view(spark, D, "raw_wide"))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1


def test_quarantine_folds_the_accounts_that_may_overflow(spark, tmp_path):
    # Deposits of 5.4e18 * 2^64 to one account of user 1, in log order; user 2 gets one of them.
    days = [(1, 5 + 7500 * k, f"2024-01-0{k + 1}") for k in range(4)] + [(2, 5, "2024-01-01")]
    rows = ", ".join(f"({i}, timestamp '{day}', {user}, 'click', 5.4e16::double, '{{\"k\": 3}}')" for user, i, day in days)
    duckdb.execute(f"copy (select * from (values {rows}) v(event_id, ts, user_id, event_type, value, props)) to '{tmp_path}/events.parquet' (format parquet)")
    got = live.n3_quarantine(spark, str(tmp_path)).collect()
    day = lambda k: (1704067200 + 86400 * k) // 12 * 2**20
    assert sorted(tuple(r) for r in got) == [("balance", day(k) + 5 + 7500 * k, "") for k in (1, 2, 3)]
    pick = random.Random(3)
    amounts = [str(pick.choice((1, -1)) * pick.randrange(10 ** pick.choice((20, 37, 38)))) for _ in range(600)]
    made = [(k, 0, f"u{k % 60}", "t", 0, "c", a, b) for k, (a, b) in enumerate(zip(amounts[::2], amounts[1::2], strict=True))]
    changes = spark.createDataFrame(made, "seq bigint, sub int, user string, token_id string, ts bigint, change string, d_available string, d_locked string")
    changes = changes.selectExpr("seq", "sub", "user", "token_id", "ts", "change", "cast(d_available as decimal(38,0)) as d_available", "cast(d_locked as decimal(38,0)) as d_locked")
    found = lambda rows: sorted((r.user, r.seq) for r in balances.overflowed(balances.running(rows, 40)).collect())
    some = balances.may_overflow(changes)
    assert found(changes) == found(changes.join(some, ["user", "token_id"], "left_semi")) != []
    assert 0 < some.count() < 60
