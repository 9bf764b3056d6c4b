"""Folds with keyed state: orders, balances and debounced events of a live feed.

A key's state is its fold up to the watermark and the events since then, in log order. New events are
put in their places among these, and the rows from the first new one on are given out (again, where they
follow it): a reader keeps the last version of each row. So results are exact for any arrival order
within the grace, and a key holds no more events than the grace brings. Rows later than that are dropped
by Spark and are for a sink that keeps its own watermark (`live.Bars`). Repeated events count once.

State is kept by Spark's RocksDB store and recovered from the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from operator import itemgetter
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from orderflow.functions.scalars import MAX_DECIMAL, STATUS
from orderflow.streaming.live import arriving

GRACE = "1 hour"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_keyed_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


Step = Callable[[tuple, dict], tuple[tuple, tuple | None]]


class KeyedFold(StatefulProcessor):
    """`step` takes the state and an event and gives the new state and the row after it (none: no row)."""

    def __init__(self, step: Step, start: tuple, state: T.StructType, events: T.StructType, order: list[str], made: list[str]):
        self.step, self.start, self.order, self.names, self.made = step, start, order, events.fieldNames(), made
        self.schema = T.StructType([*state.fields, *[T.StructField(f"last_{o}", T.LongType()) for o in order], T.StructField("pending", T.ArrayType(events))])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("fold", self.schema)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        k, n, names = len(self.start), len(self.order), self.names
        # Events are tuples of `names`: a key may hold many.
        place, row = itemgetter(*[names.index(o) for o in self.order], names.index(self.order[0])), Row(*self.made)
        at, ms, mark = None, names.index("event_ms"), timerValues.getCurrentWatermarkInMs()
        value = self.held.get()
        state, last, pending = (tuple(value[:k]), tuple(value[k : k + n]), value[k + n]) if value else (self.start, (-1,) * n, [])
        held = {place(e): e for e in map(tuple, pending or [])}
        first, done = None, (*last, last[0])
        for r in rows:
            at = at or itemgetter(*(map(r.__fields__.index, names) if isinstance(r, Row) else names))
            e = at(r)
            p = place(e)
            if p > done and p not in held:
                held[p] = e
                first = p if first is None or p < first else first
        keep, folded, closed, step = [], state, True, self.step
        for p in sorted(held):
            e = held[p]
            # The part up to the watermark becomes the state; what comes after the first later event stays an event.
            closed = closed and e[ms] <= mark
            if not closed:
                keep.append(e)
                if first is None:
                    continue
            folded, out = step(folded, dict(zip(names, e, strict=True)))
            if closed:
                state, last = folded, p[:n]
            if out is not None and first is not None and p >= first:
                yield row(*out)
        self.held.update((*state, *last, keep))

    def close(self) -> None:
        pass


def fold(events: DataFrame, keys: list[str], order: list[str], step: Step, start: tuple, state: T.StructType, out: T.StructType, grace: str = GRACE) -> DataFrame:
    """The rows of a keyed fold over a stream with `ts` in seconds."""
    use_keyed_state(events.sparkSession)
    timed = events.withColumn("event_time", F.timestamp_seconds("ts")).withColumn("event_ms", F.col("ts") * 1000).withWatermark("event_time", grace)
    schema = T.StructType([f for f in timed.schema.fields if f.name != "event_time"])
    return timed.groupBy(*keys).transformWithState(KeyedFold(step, start, state, schema, order, out.fieldNames()), out, "Update", "EventTime")


# Orders

_PLACED = ("user_addr", "side", "price", "quantity", "expiry", "is_market_order")


def _order_step(state: tuple, event: dict) -> tuple[tuple, tuple | None]:
    segment, filled, status, *placed = state
    if event["kind"] == "PLACED":
        segment, filled, status, placed = segment + 1, 0, "OPEN", [event[c] for c in _PLACED]
    elif segment == 0:
        return state, None
    elif event["kind"] == "UPDATED":
        code = event["status_code"]
        filled = event["filled"] if event["filled"] is not None else filled
        status = STATUS[code] if code is not None and 0 <= code < len(STATUS) else STATUS[0]
    else:
        status = "CANCELLED"
    quantity = placed[_PLACED.index("quantity")]
    remaining = None if quantity is None else max(0, int(quantity) - int(filled))
    whole = lambda v: None if v is None else int(v)
    row = (event["seq"], event["pool_id"], event["order_id"], event["kind"], event["ts"], segment, *[_amount(v) if c in ("price", "quantity") else v for c, v in zip(_PLACED, placed, strict=True)], _amount(filled), status, _amount(remaining))
    return (segment, whole(filled), status, *placed), row


_LIMIT = 10**MAX_DECIMAL


def _amount(value: Any) -> Decimal | None:
    return None if value is None or abs(whole := int(value)) >= _LIMIT else Decimal(whole)


def order_fold(events: DataFrame, grace: str = GRACE) -> DataFrame:
    """What `orders.lifecycle` gives, from a stream of order events."""
    kinds = {f.name: f.dataType for f in events.schema.fields}
    amount = T.DecimalType(MAX_DECIMAL, 0)
    placed = [T.StructField(c, kinds[c]) for c in _PLACED]
    state = T.StructType([T.StructField("segment", T.LongType()), T.StructField("filled_now", kinds["filled"]), T.StructField("status", T.StringType()), *placed])
    of = lambda c: T.StructField(c, amount if c in ("price", "quantity", "filled", "remaining") else kinds.get(c, T.StringType()))
    out = T.StructType([*map(of, ("seq", "pool_id", "order_id", "kind", "ts")), T.StructField("segment", T.LongType()), *map(of, _PLACED), *map(of, ("filled",)), T.StructField("status", T.StringType()), of("remaining")])
    return fold(events, ["pool_id", "order_id"], ["seq"], _order_step, (0, 0, "NONE", *[None] * len(_PLACED)), state, out, grace)


# Balances


def _balance_step(state: tuple, change: dict) -> tuple[tuple, tuple]:
    """The clamp pair after a change; what leaves 38 digits is null from then on, as in the batch fold."""
    after = [None if held is None or change[d] is None else _amount(max(0, int(held) + int(change[d]))) for held, d in zip(state, ("d_available", "d_locked"), strict=True)]
    total = None if None in after else _amount(int(after[0]) + int(after[1]))
    return tuple(after), (change["seq"], change["sub"], change["user"], change["token_id"], change["ts"], change["change"], *after, total)


def balance_fold(changes: DataFrame, grace: str = GRACE) -> DataFrame:
    """What `balances.running` gives, from a stream of signed changes."""
    state = T.StructType([T.StructField(c, T.DecimalType(MAX_DECIMAL, 0)) for c in ("available", "locked")])
    kinds = {f.name: f.dataType for f in changes.schema.fields}
    out = T.StructType([*[T.StructField(c, kinds[c]) for c in ("seq", "sub", "user", "token_id", "ts", "change")], *state.fields, T.StructField("total", T.DecimalType(MAX_DECIMAL, 0))])
    return fold(changes, ["user", "token_id"], ["seq", "sub"], _balance_step, (Decimal(0), Decimal(0)), state, out, grace)


# Debounce


class Debounce(StatefulProcessor):
    """A burst of a key ends `quiet` after its last event or `cap` after its first, whichever is earlier;
    an event at that time begins the next one. Events wait for the watermark, so that arrival order doesn't
    matter; a burst is given out when the watermark reaches its end. Two timers a key: quiet and cap."""

    def __init__(self, quiet: int, cap: int):
        self.quiet, self.cap = quiet, cap
        pending = T.ArrayType(T.StructType([T.StructField("ms", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("data", T.StringType())]))
        self.schema = T.StructType([T.StructField(c, t) for c, t in (("first", T.LongType()), ("last", T.LongType()), ("events", T.LongType()), ("data", T.StringType()), ("pending", pending))])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("burst", self.schema)

    def _advance(self, key: Any, new: list[tuple], mark: int) -> Iterator[Row]:
        first, last, events, data, pending = self.held.get() or (None, None, 0, None, [])
        waiting, at = sorted({*map(tuple, pending or []), *new}), 0
        timers = set(self.handle.listTimers())
        while True:
            due = at < len(waiting) and waiting[at][0] <= mark
            if first is not None and (end := min(last + self.quiet, first + self.cap)) <= (waiting[at][0] if due else mark):
                yield Row(channel=key[0], first_ms=first, sent_ms=end, data=data, events=events)
                first, last, events, data = None, None, 0, None
            elif due:
                ms, _, value = waiting[at]
                first, last, events, data, at = ms if first is None else first, ms, events + 1, value, at + 1
            else:
                break
        waiting = waiting[at:]
        wanted = {last + self.quiet, first + self.cap} if first is not None else {waiting[0][0]} if waiting else set()
        for t in timers - wanted:
            self.handle.deleteTimer(t)
        for t in wanted - timers:
            self.handle.registerTimer(t)
        if first is None and not waiting:
            self.held.clear()
        else:
            self.held.update((first, last, events, data, waiting))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        yield from self._advance(key, [(r["event_ms"], r["seq"], r["data"]) for r in rows], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def debounced(events: DataFrame, quiet_ms: int = 100, cap_ms: int = 500, grace: str = GRACE) -> DataFrame:
    """channel, first_ms, sent_ms, data, events: the latest of each burst of (channel, seq, event_ms, data)."""
    use_keyed_state(events.sparkSession)
    kind = events.schema["channel"].dataType
    timed = events.withColumn("event_time", F.timestamp_millis("event_ms")).withWatermark("event_time", grace)
    out = T.StructType([T.StructField("channel", kind), T.StructField("first_ms", T.LongType()), T.StructField("sent_ms", T.LongType()), T.StructField("data", T.StringType()), T.StructField("events", T.LongType())])
    return timed.groupBy("channel").transformWithState(Debounce(quiet_ms, cap_ms), out, "Append", "EventTime")


# Drained runs


def drained(parts: list[DataFrame], job: Callable[[DataFrame], DataFrame], path: str, mode: str = "update") -> DataFrame:
    """The rows that a job gave out, with the number of their `batch`, over a table that arrives in parts:
    the query is started again from its checkpoint for each part, and stopped when it has read all of it."""
    spark, made = parts[0].sparkSession, []

    def keep(frame: DataFrame, number: int) -> None:
        frame.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    def start(stream: DataFrame) -> DataStreamWriter:
        rows = job(stream)
        made[:] = [*rows.schema.fields, T.StructField("batch", T.LongType())]
        return rows.writeStream.foreachBatch(keep).outputMode(mode)

    arriving(parts, path, start)
    return spark.read.schema(T.StructType(made)).parquet(f"{path}/out")


def last_version(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each row the version of the last batch."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, *[f"r.{c}" for c in rest])
