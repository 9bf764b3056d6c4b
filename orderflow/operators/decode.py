"""Decoding of contract logs: labels, relevance, fields by word slices, quarantine, content ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.functions.scalars import address, fits_uint64, fits_uint256, seq_of, side, status, uint64, uint256, word

#: Fields of each event. "topic1" to "topic3" are indexed, numbers are words of the data.
EVENTS: dict[str, dict[str, tuple[str | int, str]]] = {
    "PoolCreated": {"pool_id": ("topic1", "hex"), "order_book": (0, "address"), "base_currency": (1, "address"), "quote_currency": (2, "address")},
    "OrderPlaced": {"order_id": ("topic1", "u64"), "user": ("topic2", "address"), "side": ("topic3", "side"), "price": (0, "u256"), "quantity": (1, "u256"), "expiry": (2, "u64"), "is_market_order": (3, "bool"), "status": (4, "status")},
    "OrderMatched": {"user": ("topic1", "address"), "buy_order_id": ("topic2", "u64"), "sell_order_id": ("topic3", "u64"), "side": (0, "side"), "timestamp": (1, "u64"), "execution_price": (2, "u256"), "taker_limit_price": (3, "u256"), "executed_quantity": (4, "u256")},
    "UpdateOrder": {"order_id": ("topic1", "u64"), "timestamp": (0, "u64"), "filled": (1, "u256"), "status": (2, "status")},
    "OrderCancelled": {"order_id": ("topic1", "u64"), "user": ("topic2", "address"), "timestamp": (0, "u64"), "status": (1, "cancelled")},
    "Deposit": {"user": ("topic1", "address"), "id": ("topic2", "hex"), "amount": (0, "u256")},
    "Withdrawal": {"user": ("topic1", "address"), "id": ("topic2", "hex"), "amount": (0, "u256")},
    "Lock": {"user": ("topic1", "address"), "id": ("topic2", "hex"), "amount": (0, "u256")},
    "Unlock": {"user": ("topic1", "address"), "id": ("topic2", "hex"), "amount": (0, "u256")},
    "TransferFrom": {"operator": ("topic1", "address"), "sender": ("topic2", "address"), "receiver": ("topic3", "address"), "id": (0, "hex"), "amount": (1, "u256"), "fee_amount": (2, "u256")},
    "TransferLockedFrom": {"operator": ("topic1", "address"), "sender": ("topic2", "address"), "receiver": ("topic3", "address"), "id": (0, "hex"), "amount": (1, "u256"), "fee_amount": (2, "u256")},
}
#: The signature hashes (topic0) of the event types, Keccak-256 of the name and its types.
SIGNATURES = {
    "PoolCreated": "0x16354016da33c4b63f03b12074e60a0dba0444a0d8747d270e457e24948fbf48",  # (bytes32,address,address,address)
    "OrderPlaced": "0x02aaa47b12d5a781ede380495aa581865620e47a9f66f4a0994c6851d10d8cd8",  # (uint48,address,uint8,uint128,uint128,uint48,bool,uint8)
    "OrderMatched": "0x696ae023f8379481f3fa1bcccfdf43e7b011cc653c41740cfcc3a88399c6a988",  # (address,uint48,uint48,uint8,uint48,uint128,uint128,uint128)
    "UpdateOrder": "0x6132ef723352ead2794cfeb3d6fd77f28406351ca9105824620bfa20a293311c",  # (uint48,uint48,uint128,uint8)
    "OrderCancelled": "0xde2f01881fb16526ccd6699288e88797f971c7eb5bd62a58366211f13974e873",  # (uint48,address,uint48,uint8)
    "Deposit": "0x90890809c654f11d6e72a28fa60149770a0d11ec6c92319d6ceb2bb0a4ea1a15",  # (address,uint256,uint256)
    "Withdrawal": "0xdf273cb619d95419a9cd0ec88123a0538c85064229baa6363788f743fff90deb",  # (address,uint256,uint256)
    "Lock": "0x49eaf4942f1237055eb4cfa5f31c9dfe50d5b4ade01e021f7de8be2fbbde557b",  # (address,uint256,uint256)
    "Unlock": "0xf7870c5b224cbc19873599e46ccfc7103934650509b1af0c3ce90138377c2004",  # (address,uint256,uint256)
    "TransferFrom": "0x1fdea0eeac8b19cdb663673f0c9dc339b9dbfb548cb208ba918336d1c2781be1",  # (address,address,address,uint256,uint256,uint256)
    "TransferLockedFrom": "0x37661204feb3d240437202c38d4bc90dd9a7717367f4733cc755f0c0f13d939c",  # (address,address,address,uint256,uint256,uint256)
}
POOL_EVENTS = ("PoolCreated",)
BALANCE_EVENTS = ("Deposit", "Withdrawal", "Lock", "Unlock", "TransferFrom", "TransferLockedFrom")
BOOK_EVENTS = ("OrderPlaced", "OrderMatched", "UpdateOrder", "OrderCancelled")


def label(topic0: Column, signatures: dict[str, str]) -> Column:
    """Event name of a signature hash; `signatures` maps names to hashes."""
    pairs = [x for name, h in signatures.items() for x in (F.lit(h), F.lit(name))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), topic0), F.lit("Unknown"))


def relevant(logs: DataFrame, pools: DataFrame, *, manager: str, balances: str, signatures: dict[str, str]) -> DataFrame:
    """Pool events of the manager, balance events of the balance contract, book events of known books."""
    named = logs.withColumn("event_type", label(F.col("topic0"), signatures))
    own = named.where((F.col("event_type").isin(*POOL_EVENTS) & (F.col("address") == manager)) | (F.col("event_type").isin(*BALANCE_EVENTS) & (F.col("address") == balances)))
    book = named.where(F.col("event_type").isin(*BOOK_EVENTS)).join(pools.select(F.col("order_book").alias("address")).distinct(), "address", "left_semi")
    return own.unionByName(book.select(own.columns))


_KEYS = ["address", "block_number", "log_index", "tx_hash", "data"]
_FITS = {"u64": fits_uint64, "u256": fits_uint256}
_MAKE = {"u64": uint64, "u256": uint256, "address": address, "hex": lambda x: F.concat(F.lit("0x"), x), "side": lambda x: side(uint64(x)), "status": lambda x: status(uint64(x)), "bool": lambda x: uint64(x) != 0, "cancelled": lambda x: F.lit("CANCELLED")}


def _word(at: str | int) -> Column:
    """Topics are bare words; data words follow "0x"."""
    return F.lpad(F.regexp_replace(F.col(at), "^0x", ""), 64, "0") if isinstance(at, str) else word(F.col("data"), at)


def _overflows(numbers: list[tuple[str, Column]]) -> Column:
    """Whether one of the words (kind, word) that are there does not fit its kind."""
    out = F.lit(False)
    for kind, w in numbers:
        out = out | (~_FITS[kind](w) & (w != ""))
    return out


def decode(logs: DataFrame, event: str) -> DataFrame:
    """The event's fields beside the log's keys. A number that does not fit stays null, and `overflow`
    says so (the raw data is kept for the quarantine). Words are cut first; `overflow` is told from their
    digits, so that a filter by it does not make the numbers."""
    fields = EVENTS[event]
    cut = logs.select(*_KEYS, *[_word(at).alias(f"__{name}") for name, (at, _) in fields.items()])
    overflow = _overflows([(kind, F.col(f"__{name}")) for name, (_, kind) in fields.items() if kind in _FITS])
    return cut.select(*_KEYS, *[_MAKE[kind](F.col(f"__{name}")).alias(name) for name, (_, kind) in fields.items()], overflow.alias("overflow"))


def decode_all(logs: DataFrame, signatures: dict[str, str]) -> dict[str, DataFrame]:
    """A frame for each event type, from logs whose topic0 is its signature; logs without a topic or with
    another one are in none of them."""
    return {event: decode(logs.where(F.col("topic0") == h), event) for event, h in signatures.items() if event in EVENTS}


def _once(rows: DataFrame) -> DataFrame:
    """The same rows, whose columns are made once: else a filter by a computed column makes it again for each
    time that it is looked at."""
    return rows.select(F.explode(F.array(F.struct(*rows.columns))).alias("row")).select("row.*")


def balance_events(logs: DataFrame, signatures: dict[str, str] = SIGNATURES) -> DataFrame:
    """The balance events of the logs as `balances.deltas` takes them, in one scan; what does not fit is
    left out (`lost` has it)."""
    kind = {signatures[e]: "".join(f"_{c}" if c.isupper() else c.upper() for c in e).lstrip("_") for e in BALANCE_EVENTS}

    def cut(*names: str) -> Column:
        """The word of each event's field that has one of the names; null where it has none."""
        out = F.lit(None).cast("string")
        for event in BALANCE_EVENTS:
            at = next((EVENTS[event][n][0] for n in names if n in EVENTS[event]), None)
            if at is not None:
                out = F.when(F.col("topic0") == signatures[event], _word(at)).otherwise(out)
        return out

    moved = F.col("topic0").isin(*[signatures[e] for e in BALANCE_EVENTS if "fee_amount" in EVENTS[e]])
    words = {"user": ("user", "sender"), "receiver": ("receiver",), "id": ("id",), "amount": ("amount",), "fee": ("fee_amount",)}
    named = [f"topic{i}" for i in range(4)]
    rows = _once(logs.where(F.col("topic0").isin(*kind)).select(*named, "block_number", "log_index", "data"))
    rows = _once(rows.select("topic0", "block_number", "log_index", *[cut(*names).alias(f"__{w}") for w, names in words.items()]))
    amount, fee = ("u256", F.col("__amount")), ("u256", F.col("__fee"))
    fits = ~F.when(moved, _overflows([amount, fee])).otherwise(_overflows([amount]))
    return _once(rows.where(fits).select(
        seq_of(F.col("block_number"), F.col("log_index")).alias("seq"), _MAKE["address"](F.col("__user")).alias("user_addr"), _MAKE["address"](F.col("__receiver")).alias("receiver"), _MAKE["hex"](F.col("__id")).alias("token_id"),
        _MAKE["u256"](amount[1]).alias("amount"), _MAKE["u256"](fee[1]).alias("fee_amount"), F.col("block_number").alias("ts"), F.try_element_at(F.create_map(*[F.lit(x) for pair in kind.items() for x in pair]), F.col("topic0")).alias("kind"),
    ))


def lost(logs: DataFrame, signatures: dict[str, str] = SIGNATURES) -> DataFrame:
    """The logs of all event types with a number that does not fit, with their raw data, in one scan."""
    logs = _once(logs.select(*_KEYS, *[f"topic{i}" for i in range(4)]))
    numbers: dict[tuple, list[str]] = {}
    for event, signature in signatures.items():
        for at, kind in EVENTS[event].values():
            if kind in _FITS:
                numbers.setdefault((kind, at), []).append(signature)
    bad = F.lit(False)
    for (kind, at), having in numbers.items():
        bad = bad | (F.col("topic0").isin(*having) & _overflows([(kind, _word(at))]))
    return logs.where(bad).select(*_KEYS, label(F.col("topic0"), signatures).alias("event_type"))


def quarantine(decoded: DataFrame) -> DataFrame:
    return decoded.where("overflow").select("address", "block_number", "log_index", "tx_hash", "data")


def with_pool(events: DataFrame, pools: DataFrame) -> DataFrame:
    """The events of known books with all columns of their pool."""
    return events.join(pools.withColumnRenamed("order_book", "address"), "address")


def unknown_books(events: DataFrame, pools: DataFrame) -> DataFrame:
    return events.join(pools.select(F.col("order_book").alias("address")), "address", "left_anti")


def content_id(tx: Column, addr: Column, topics: list[Column], data: Column) -> Column:
    """Equal for equal logs whatever their position; null without a transaction hash."""
    return F.when(tx.isNotNull(), F.sha2(F.concat_ws("~", tx, addr, F.concat(*[F.coalesce(t, F.lit("")) for t in topics]), data), 256))


def event_counts(logs: DataFrame, batch: Column, kinds: list[str]) -> DataFrame:
    """Counts by type and batch, and their short summary."""
    counts = [F.count_if(F.col("event_type") == k).cast("bigint").alias(k) for k in kinds]
    rows = logs.groupBy(batch.alias("batch")).agg(F.count("*").alias("total"), *counts)
    parts = F.concat_ws(" ", *[F.when(F.col(k) > 0, F.concat(F.lit(f"{k}:"), F.col(k).cast("string"))) for k in kinds])
    return rows.withColumn("summary", F.when(parts == "", "none").otherwise(parts))


MINIBLOCK = "block_number bigint, index int, transactions array<string>, receipts array<struct<logs: array<struct<address: string, log_index: bigint>>>>"


def miniblocks(lines: DataFrame, schema: str = MINIBLOCK) -> DataFrame:
    """JSON lines (`value`) as miniblocks with their numbers of transactions and logs. A line that is no
    such object is kept in `_corrupt_record`, the fields being null."""
    row = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    parsed = lines.select(row.alias("b")).select("b.*")
    logs = F.aggregate(F.transform("receipts", lambda r: F.coalesce(F.size(r["logs"]), F.lit(0))), F.lit(0), lambda a, n: a + n)
    return parsed.withColumn("tx_count", F.when(F.col("_corrupt_record").isNull(), F.coalesce(F.size("transactions"), F.lit(0)))).withColumn("log_count", F.when(F.col("_corrupt_record").isNull(), F.coalesce(logs, F.lit(0))))


def miniblock_logs(blocks: DataFrame) -> DataFrame:
    """Nested miniblocks (block_number, receipts array<struct<logs>>) to one row for each log."""
    return blocks.select("block_number", F.posexplode("receipts").alias("tx", "r")).select("block_number", "tx", F.posexplode("r.logs").alias("i", "log")).select("block_number", "tx", "i", "log.*")
