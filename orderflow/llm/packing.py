"""Token-id output: best-fit-decreasing packing into rows of fixed length.

Each text's ids (public tokenizer, one end-of-text id after each document) are cut into full rows and
a rest, so overlong documents are split without loss. The rests of a shard are packed longest first,
each into the fullest row that still holds it: a segment tree over free capacities finds that row in
log(row length) steps. A packed row holds the id matrix row (padded), the cumulative segment lengths,
the positions, which restart at 0 with each segment, and where each segment comes from.

Documents are dealt to shards by a hash of id and text, as many shards as the text's bytes ask for
(SHARD_BYTES each), so a shard is bounded and the result is the same for any partitioning; a hot id
is spread by its texts. Ids are shuffled as two or four bytes each, texts are not.

Defined results: a null or empty text has no ids, and no row unless an end id is asked for; a null
doc_id is kept as null; repeated rows are packed one by one; an empty table gives no rows; ties in
length are settled by the order of hash and id; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from orderflow.llm.common import as_bytes, map_arrow

ROW = 2048
SHARD_BYTES = 8 << 20
#: The vocabulary's free id serves as the end of a text and as padding.
END = 50256


class BestFit:
    """A segment tree over free capacities 0..row: which hold an open bin, and which bins."""

    def __init__(self, row: int):
        self.size = 1 << row.bit_length()
        self.tree = np.zeros(2 * self.size, dtype=bool).tolist()
        self.bins: list[list[int]] = [[] for _ in range(row + 1)]

    def _set(self, capacity: int) -> None:
        i = capacity + self.size
        self.tree[i] = bool(self.bins[capacity])
        while i > 1:
            i >>= 1
            self.tree[i] = self.tree[2 * i] or self.tree[2 * i + 1]

    def add(self, capacity: int, which: int) -> None:
        self.bins[capacity].append(which)
        if len(self.bins[capacity]) == 1:
            self._set(capacity)

    def take(self, need: int) -> tuple[int, int] | None:
        """The bin of least capacity that is at least `need`, the oldest use of it last in, first out."""
        i = need + self.size
        if not self.tree[i]:
            while i > 1 and not (i % 2 == 0 and self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        capacity = i - self.size
        which = self.bins[capacity].pop()
        if not self.bins[capacity]:
            self._set(capacity)
        return capacity, which


def best_fit_decreasing(lengths: np.ndarray, row: int) -> list[list[int]]:
    """Bins of places in `lengths`; every length is at most `row`."""
    fit, bins = BestFit(row), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if n == 0:
            continue
        got = fit.take(n)
        if got is None:
            got = (row, len(bins))
            bins.append([])
        capacity, which = got
        bins[which].append(i)
        if capacity > n:
            fit.add(capacity - n, which)
    return bins


def _width(ranks: dict[bytes, int]) -> str:
    return "<u2" if max(ranks.values(), default=0) < 1 << 16 else "<u4"


def token_ids(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, id_col: str, text_col: str, shards: int) -> DataFrame:
    """shard, order, doc_id and the ids as little-endian bytes (two each where the vocabulary allows)."""
    frame = docs.select(F.col(id_col).alias("doc_id"), as_bytes(text_col).alias("t")).withColumn("order", F.xxhash64("doc_id", "t"))
    # Equal rows are told apart by where they stand, else a long run of them would be one shard.
    frame = frame.select(F.pmod(F.xxhash64("order", F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard"), "order", "doc_id", "t")
    schema = T.StructType([*frame.schema.fields[:3], T.StructField("ids", T.BinaryType())])
    shared, width = docs.sparkSession.sparkContext.broadcast(ranks), _width(ranks)
    made: list = []

    def run(batch: pa.RecordBatch) -> dict:
        if not made:
            import tiktoken

            made.append(tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={}))
        ids = [np.array(made[0].encode_ordinary(t.as_buffer().to_pybytes().decode("utf-8", "replace")), dtype=width).tobytes() for t in batch.column(3)]
        return {"shard": batch.column(0), "order": batch.column(1), "doc_id": batch.column(2), "ids": pa.array(ids, pa.binary())}

    return map_arrow(frame, run, schema)


def pack(docs: DataFrame, *, ranks: dict[bytes, int], pattern: str, row: int = ROW, end: int | None = END, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each packed row: shard, row_no, n_tokens, ids (4-byte little-endian, padded),
    cu_seqlens, positions (4-byte), segments (doc_id, first token in the document, length)."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    shards = max(1, -(-int(total) // shard_bytes))
    id_type, width = docs.schema[id_col].dataType, _width(ranks)
    schema = T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("row_no", T.IntegerType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("ids", T.BinaryType()),
        T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())), T.StructField("positions", T.BinaryType()),
        T.StructField("segments", T.ArrayType(T.StructType([T.StructField("doc_id", id_type), T.StructField("first", T.IntegerType()), T.StructField("length", T.IntegerType())]))),
    ])

    def work(shard: pa.Table) -> Iterator[list]:
        whole = [np.frombuffer(x.as_buffer(), dtype=width).astype(np.int32) for x in shard["ids"].combine_chunks()]
        if end is not None:
            whole = [np.append(x, np.int32(end)) for x in whole]
        names = shard["doc_id"].to_pylist()
        rest = np.array([len(x) % row for x in whole], dtype=np.int64)
        full = [[(i, a, row)] for i, x in enumerate(whole) for a in range(0, len(x) - len(x) % row, row)]
        mixed = [[(i, len(whole[i]) - int(rest[i]), int(rest[i])) for i in own] for own in best_fit_decreasing(rest, row)]
        number = shard["shard"][0].as_py()
        for k, parts in enumerate([*full, *mixed]):
            ids = np.concatenate([whole[i][a : a + n] for i, a, n in parts])
            used = len(ids)
            ids = np.concatenate([ids, np.full(row - used, 0 if end is None else end, np.int32)]).astype("<i4")
            positions = np.concatenate([*(np.arange(n, dtype="<i4") for _, _, n in parts), np.arange(row - used, dtype="<i4")])
            yield [number, k, used, ids.tobytes(), np.concatenate([[0], np.cumsum([n for *_, n in parts])]).tolist(), positions.tobytes(), [{"doc_id": names[i], "first": a, "length": n} for i, a, n in parts]]

    arrow_schema = pa.schema([("shard", pa.int32()), ("row_no", pa.int32()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("positions", pa.binary()), ("segments", pa.list_(pa.struct([("doc_id", to_arrow_type(id_type)), ("first", pa.int32()), ("length", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards one after the other; rows come sorted by shard."""

        def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows: list[list] = []
            for r in work(pa.Table.from_batches(held)):
                rows.append(r)
                if len(rows) == 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow_schema, strict=True)], schema=arrow_schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow_schema, strict=True)], schema=arrow_schema)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                shard = batch.column(0).to_numpy()
                if held and held[0].column(0)[0].as_py() != shard[0]:
                    yield from packed(held)
                    held = []
                n = int(np.searchsorted(shard, shard[0], side="right"))
                held.append(batch.slice(0, n))
                batch = batch.slice(n)
        if held:
            yield from packed(held)

    ids = token_ids(docs, ranks, pattern, id_col=id_col, text_col=text_col, shards=shards)
    return ids.repartition("shard").sortWithinPartitions("shard", "order", "doc_id").mapInArrow(run, schema)


def unpack(packed: DataFrame) -> DataFrame:
    """doc_id, first and the ids of each segment: the packed rows' own inverse."""
    # Four bytes, lowest first, as two hex digits each.
    digits = lambda i, k: F.substring("h", 8 * (F.col("at") + i) + 2 * k + 1, F.lit(2))
    ids = F.transform(F.sequence(F.lit(0), F.col("s.length") - 1), lambda i: F.conv(F.concat(*[digits(i, k) for k in (3, 2, 1, 0)]), 16, 10).cast("int"))
    parts = packed.select("ids", F.explode(F.arrays_zip(F.slice("cu_seqlens", F.lit(1), F.size("segments")).alias("at"), F.col("segments").alias("s"))).alias("p"))
    return parts.select(F.hex("ids").alias("h"), F.col("p.at").alias("at"), F.col("p.s").alias("s")).select("s.doc_id", "s.first", ids.alias("ids"))
