"""Balances clamped at zero: signed deltas, the running fold, and final balances in chunks.

A sum clamped at 0 after each step is the plain running sum minus its running minimum where that is
negative (reflection), so the fold is a window. Clamps also compose: a chunk of an account's events is
described by its sum and its least prefix sum. So both the final and the running balances are made in two
levels: windows within (account, chunk), then over the few summaries of an account, whose result is the
balance that each of its chunks starts from. No task holds more of a hot account than a chunk.

Amounts are DECIMAL(38,0). Sums that would leave 38 digits are null (`overflowed` finds them), not errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from orderflow.functions.scalars import AMOUNT, amount_of, sat_sub


def deltas(events: DataFrame) -> DataFrame:
    """One row for each signed change, in the order (seq, sub). A transfer moves the amount out of the
    sender and the amount less the fee (not below 0) into the receiver; a locked one unlocks first. Events
    whose amounts don't fit are left out whole; `unfit` has them."""
    amount, zero = amount_of("amount"), F.lit(0).cast(AMOUNT)

    def row(sub: int, user: str, kind: str, available: Column, locked: Column) -> Column:
        return F.struct(F.lit(sub).alias("sub"), F.col(user).alias("user"), F.lit(kind).alias("change"), available.alias("d_available"), locked.alias("d_locked"))

    net = sat_sub(amount, amount_of("fee_amount"))
    out, into = lambda sub: row(sub, "user_addr", "TRANSFER_OUT", -amount, zero), lambda sub: row(sub, "receiver", "TRANSFER_IN", net, zero)
    unlock = row(0, "user_addr", "UNLOCK", amount, -amount)
    kinds = {
        "DEPOSIT": [row(0, "user_addr", "DEPOSIT", amount, zero)], "WITHDRAWAL": [row(0, "user_addr", "WITHDRAWAL", -amount, zero)],
        "LOCK": [row(0, "user_addr", "LOCK", -amount, amount)], "UNLOCK": [unlock],
        "TRANSFER_FROM": [out(0), into(1)], "TRANSFER_LOCKED_FROM": [unlock, out(1), into(2)],
    }
    chosen = None
    for kind, rows in kinds.items():
        chosen = F.when(F.col("kind") == kind, F.array(*rows)) if chosen is None else chosen.when(F.col("kind") == kind, F.array(*rows))
    return events.where(~_is_unfit()).select("seq", "token_id", "ts", F.explode(chosen).alias("d")).select("seq", "d.sub", "d.user", "token_id", "ts", "d.change", "d.d_available", "d.d_locked")


def _is_unfit() -> Column:
    return amount_of("amount").isNull() | (F.col("kind").like("TRANSFER%") & amount_of("fee_amount").isNull())


def unfit(events: DataFrame) -> DataFrame:
    """Events whose amounts are missing or do not fit 38 digits."""
    return events.where(_is_unfit())


_ACCOUNT = ("user", "token_id")
_PAIRS = (("a", "available"), ("l", "locked"))
#: Changes of all accounts in the stretch of the log that a chunk covers, on average.
CHUNK_ROWS = 1 << 18


def chunk_width(changes: DataFrame, rows: int = CHUNK_ROWS) -> int:
    """How much of `seq` a chunk covers so that it has about `rows` changes, whatever `seq` counts."""
    low, high, many = changes.agg(F.min("seq"), F.max("seq"), F.count("*")).first()
    return 1 if not many else max(1, -(-(int(high) - int(low) + 1) * rows // many))


def _up_to_here(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("seq", "sub").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _chunked(changes: DataFrame, chunk: int | None) -> DataFrame:
    """Running sums sa and sl within (account, chunk), and their running minima ma and ml."""
    w = _up_to_here(*_ACCOUNT, "chunk")
    rows = changes.withColumn("chunk", F.floor(F.col("seq") / (chunk or chunk_width(changes))))
    rows = rows.withColumns({f"s{k}": F.try_sum(f"d_{name}").over(w) for k, name in _PAIRS})
    return rows.withColumns({f"m{k}": F.min(f"s{k}").over(w) for k, _ in _PAIRS})


def _summaries(rows: DataFrame) -> DataFrame:
    """Of each chunk its sums and least prefix sums, and those of all that is before it in its account."""
    chunks = rows.groupBy(*_ACCOUNT, "chunk").agg(*[F.try_sum(f"d_{name}").alias(k) for k, name in _PAIRS], *[F.min(f"s{k}").alias(f"m{k}") for k, _ in _PAIRS])
    before = Window.partitionBy(*_ACCOUNT).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy(*_ACCOUNT).orderBy("chunk")) == 1
    zero = F.lit(0).cast(AMOUNT)
    lost = lambda k: F.count_if(F.col(k).isNull()).over(before) > 0  # noqa: E731  what left 38 digits stays null
    placed = chunks.withColumns({f"p{k}": F.when(first, zero).when(~lost(k), F.try_sum(k).over(before)) for k, _ in _PAIRS})
    return placed.withColumns({f"b{k}": F.try_add(f"p{k}", f"m{k}") for k, _ in _PAIRS}).withColumns({f"low_{k}": F.least(zero, F.coalesce(F.min(f"b{k}").over(before), zero)) for k, _ in _PAIRS})


def running(changes: DataFrame, chunk: int | None = None) -> DataFrame:
    """Available and locked after each change; `last` says whether it is the event's last of its account.
    `chunk` is the stretch of `seq` of a chunk (from the data)."""
    rows = _chunked(changes, chunk)
    after = F.lead("seq").over(Window.partitionBy(*_ACCOUNT, "chunk").orderBy("seq", "sub"))
    rows = rows.withColumn("last", F.coalesce(after != F.col("seq"), F.lit(True)))
    starts = _summaries(rows).select(*_ACCOUNT, "chunk", *[F.try_subtract(f"p{k}", f"low_{k}").alias(f"start_{k}") for k, _ in _PAIRS])
    both = rows.join(starts, [*_ACCOUNT, "chunk"])
    # From the balance at the chunk's start: start + sum - least(0, start + least sum so far).
    fold = {name: F.try_subtract(F.try_add(f"start_{k}", f"s{k}"), F.least(F.lit(0).cast(AMOUNT), F.try_add(f"start_{k}", f"m{k}"))).cast(AMOUNT) for k, name in _PAIRS}
    return both.withColumns(fold).select(*changes.columns, *fold, F.try_add("available", "locked").alias("total"), "last")


def changed(changes: DataFrame, chunk: int | None = None) -> DataFrame:
    """The balance after each event and affected user: of an event's changes the last."""
    return running(changes, chunk).where("last").select("seq", "user", "token_id", "ts", "available", "locked", "total")


def final(changes: DataFrame, chunk: int | None = None) -> DataFrame:
    """Each account's balance, from the summaries of its chunks alone."""
    zero = F.lit(0).cast(AMOUNT)
    folded = _summaries(_chunked(changes, chunk)).groupBy(*_ACCOUNT).agg(*[F.when(F.count_if(F.col(k).isNull()) == 0, F.try_subtract(F.try_sum(k), F.least(zero, F.min(f"b{k}")))).cast(AMOUNT).alias(name) for k, name in _PAIRS])
    return folded.withColumn("total", F.try_add("available", "locked"))


def overflowed(rows: DataFrame) -> DataFrame:
    """The running or final balances that left 38 digits, for the quarantine."""
    return rows.where("available is null or locked is null or total is null")


def may_overflow(changes: DataFrame) -> DataFrame:
    """The accounts whose balances may leave 38 digits. Whatever the order, no sum, prefix or balance of an
    account is beyond the sum of its changes' sizes, so an account where this fits needs no fold."""
    sizes = changes.groupBy(*_ACCOUNT).agg(*[F.try_sum(F.abs(f"d_{name}")).alias(k) for k, name in _PAIRS], F.count_if(F.col("d_available").isNull() | F.col("d_locked").isNull()).alias("none"))
    return sizes.where(F.try_add("a", "l").isNull() | (F.col("none") > 0)).select(*_ACCOUNT)
