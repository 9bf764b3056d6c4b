"""Table sinks: several tables from one batch, several outputs, rows written, and progress.

A sink is called with a batch and its number. Tables are Parquet folders with one folder a batch, so a
batch that is repeated after a failure replaces itself; readers drop the batch column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow.operators.reconcile import insert_ignore, keep_last

Sink = Callable[[DataFrame, int], None]


@dataclass(frozen=True)
class Table:
    """How a table is made from a batch: its rows, its keys, the order in which the last row of a key
    stays (none: the first insert stays), and the columns that it is stored by. `fixed` says that all rows
    of a key have the same values in these columns (such as a block bucket), so that known keys are sought
    in the folders that a batch touches alone."""

    rows: Callable[[DataFrame], DataFrame]
    keys: list[str]
    order: str | None = None
    by: list[str] = field(default_factory=list)
    fixed: bool = False


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all batches; none before the first."""
    try:
        return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    except Exception as error:  # a folder that isn't there yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("batch", T.LongType())]))


def write_tables(path: str, tables: dict[str, Table], counts: Callable[[dict[str, int]], None] | None = None) -> Sink:
    """A foreachBatch sink: each table's rows of the batch, one a key, are appended to its folder; tables
    with an order keep every batch's last rows (`current` reads them), the others ignore known keys.
    `counts` gets the rows written to each table."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.persist()
        written = {}
        for name, table in tables.items():
            rows = table.rows(batch)
            if table.order:
                rows = keep_last(rows, table.keys, table.order)
            else:
                known = stored(batch.sparkSession, f"{path}/{name}", rows.schema).where(F.col("batch") < number).drop("batch")
                for column in table.by if table.fixed else ():
                    here = [r[0] for r in rows.select(column).distinct().collect()]
                    known = known.where(F.col(column).isin(here))
                rows = insert_ignore(known, rows, table.keys)
            rows.write.mode("overwrite").partitionBy(*table.by).parquet(f"{path}/{name}/batch={number}")
            written[name] = batch.sparkSession.read.schema(rows.schema).parquet(f"{path}/{name}/batch={number}").count()
        batch.unpersist()
        if counts:
            counts(written)

    return sink


def compact(spark: SparkSession, path: str, name: str, table: Table, schema: T.StructType) -> None:
    """Puts a table's batches but for the newest, which a stream may repeat, into one with the number of the
    last of them. The rows are written beside them first and change places when they are complete; a change
    that a failure cut short is ended by the next call. No batch may be written meanwhile."""
    at = f"{path}/{name}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(at).getFileSystem(spark._jsc.hadoopConfiguration())
    listed = lambda: [s.getPath().getName() for s in files.listStatus(hadoop(at))] if files.exists(hadoop(at)) else []

    def change() -> None:
        for made in (n for n in listed() if n.startswith("_compact-")):
            last = int(made.removeprefix("_compact-"))
            if files.exists(hadoop(f"{at}/{made}/_SUCCESS")):
                for old in listed():
                    if old.startswith("batch=") and int(old.removeprefix("batch=")) <= last:
                        files.delete(hadoop(f"{at}/{old}"), True)
                files.rename(hadoop(f"{at}/{made}"), hadoop(f"{at}/batch={last}"))
            else:
                files.delete(hadoop(f"{at}/{made}"), True)

    change()
    batches = sorted(int(n.removeprefix("batch=")) for n in listed() if n.startswith("batch="))
    if len(batches) > 2:
        last = batches[-2]
        _latest(stored(spark, at, schema).where(F.col("batch") <= last).drop("batch"), table).write.partitionBy(*table.by).parquet(f"{at}/_compact-{last}")
        change()


def _latest(rows: DataFrame, table: Table) -> DataFrame:
    return keep_last(rows, table.keys, table.order) if table.order else rows


def current(spark: SparkSession, path: str, name: str, table: Table, schema: T.StructType) -> DataFrame:
    """A table's rows: of each key the last one by the table's order."""
    return _latest(stored(spark, f"{path}/{name}", schema).drop("batch"), table)


def fan_out(*sinks: Sink) -> Sink:
    """One batch to several sinks, read once."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.persist()
        for one in sinks:
            one(batch, number)
        batch.unpersist()

    return sink


# Progress

PROGRESS = "name string, block bigint"


def advanced(progress: DataFrame, seen: DataFrame) -> DataFrame:
    """(name, block) after new blocks: it only goes forward, and names are added."""
    return progress.unionByName(seen).where("name is not null and block is not null").groupBy("name").agg(F.max("block").alias("block"))


def verified(progress: DataFrame, sources: DataFrame, name: str) -> DataFrame:
    """The watermark `name` after a check of several sources (source, block, ok): it advances to the least
    block that all of them reached, and only if none failed."""
    done = sources.agg(F.count("*").alias("n"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("failed"), F.min("block").alias("block"))
    return advanced(progress, done.where("n > 0 and failed = 0").select(F.lit(name).alias("name"), "block"))


def resume(rows: DataFrame, progress: DataFrame, name: str, block: str = "block_number") -> DataFrame:
    """What comes after the stored block; everything where none, or 0, is stored."""
    at = progress.where((F.col("name") == name) & (F.col("block") > 0)).agg(F.max("block").alias("__at"))
    return rows.join(F.broadcast(at), F.col("__at").isNull() | (F.col(block) > F.col("__at"))).drop("__at")
