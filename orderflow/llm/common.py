"""What the operators share: table access, Arrow batches of bounded size, byte-level words."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The word class `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after lower-casing A-Z: digits, a-z, and every
#: byte of a character from U+0080 on. In UTF-8 that is a class of single bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = True
IS_WORD[128:] = True

#: Rows and bytes of one Arrow batch, the same for all operators. Texts may be long: the bytes keep a batch small.
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """The settings are read when a job runs, so they cannot differ from one operator to the next."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with files in the folder that the cluster names in spark.checkpoint.dir.

    Only where that is unset, as in tests, a folder of this session's warehouse is taken."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        conf = df.sparkSession.conf
        at = conf.get("spark.checkpoint.dir", None) or conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        sc.setCheckpointDir(at)
    return df.checkpoint()


def free_name(df: DataFrame, name: str) -> str:
    """`name`, underscored until the frame has no such column (names compare without case)."""
    return new_name(df.columns, name)


def new_name(keep: list[str], name: str) -> str:
    """The name of an output column: underscored where a kept column has it."""
    taken = {c.lower() for c in keep}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """Applies `fn` to each Arrow batch; `fn` returns the output columns in the schema's order. Columns go
    by their places, so their names may be any, with dots too."""
    bounded_batches(df.sparkSession)
    names = schema.fieldNames()
    places = [f"c{i}" for i in range(len(names))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                columns = out.columns if isinstance(out, pa.RecordBatch) else [out[n] for n in names]
                yield pa.RecordBatch.from_arrays(columns, names=places)

    numbered = T.StructType([T.StructField(c, f.dataType) for c, f in zip(places, schema.fields, strict=True)])
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, numbered).toDF(*names)


def as_bytes(text: str | F.Column = "text") -> F.Column:
    """The text's UTF-8 bytes; null counts as the empty text."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(col.cast("binary"), F.lit(b""))


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without a copy, and the rows' offsets in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of all words, and the place of each row's first word."""
    low = LOWER[raw]
    flags = IS_WORD[low]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    starts = flags.copy()
    starts[1:] &= ~flags[:-1]
    starts[inner] = flags[inner]
    ends = flags.copy()
    ends[:-1] &= ~flags[1:]
    ends[inner - 1] = flags[inner - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return low, s, e, np.searchsorted(s, offsets)


_MUL = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _MUL), ("down", _INV)):
            steps = np.full(max(n, 1 << 20), base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """A 64-bit polynomial hash of each word, from running sums over about `step` bytes at a time."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + step, side="right")))
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = _powers(b - a + 1)
        sums = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(_BYTE[low[a:b]] * up[: b - a], out=sums[1:])
        h = (sums[ends[i:j] - a] - sums[starts[i:j] - a]) * down[starts[i:j] - a]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out[i:j] = h ^ (h >> np.uint64(32))
        i = j
    return out


def equal_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the stretches of n bytes at a and at b are equal, one by one; eight bytes at a time."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    same, going, k = np.ones(len(a), bool), np.arange(len(a)), 0
    while len(going):
        x = eight[a[going] + k] ^ eight[b[going] + k]
        x <<= ((8 - np.minimum(n[going] - k, 8)) * 8).astype(np.uint64)
        same[going[x != 0]] = False
        k += 8
        going = going[(x == 0) & (n[going] > k)]
    return same


def batches_of_rows(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of at most `most` bytes each, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir (in tests: the warehouse)."""
    conf = spark.conf
    return f"{(conf.get('spark.checkpoint.dir', None) or conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The frame written as a table to the shared folder and read again, and the table's path. Its size is
    known to the planner, so that a join broadcasts it only below spark.sql.autoBroadcastJoinThreshold."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, *paths: str) -> None:
    """Removes what a run has written, on whatever store it is."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
