"""Table sinks, progress, and the parts of a stream that are written."""

import importlib
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from orderflow.operators import decode, sinks, trades
from orderflow.sources.fixtures import view
from orderflow.streaming import jobs

D = "/root/testdata/sf0.001"
TABLES = {
    "trades": sinks.Table(lambda t: t.select("tx_hash", "log_index", "pool_id", "price"), ["tx_hash", "log_index"]),
    "last_price": sinks.Table(lambda t: t.select("pool_id", "price", F.struct("block_number", "log_index").alias("at")), ["pool_id"], order="at"),
    "candles": sinks.Table(lambda t: trades.candles(t, "1d").select("id", "interval", "count"), ["id"], by=["interval"]),
}


def _read(spark, path, name):
    schema = spark.read.parquet(f"{path}/{name}").drop("batch").schema
    return sinks.current(spark, path, name, TABLES[name], schema)


def test_write_tables(spark, tmp_path):
    rows, path, counts = view(spark, D, "trades"), str(tmp_path / "out"), []
    parts = [rows.where("log_index % 3 <> 0"), rows.where("log_index % 3 <> 1")]
    sink = sinks.write_tables(path, TABLES, counts.append)
    for number, part in enumerate(parts):
        sink(part, number)
    sink(parts[1], 1)  # a batch that is repeated replaces itself
    assert counts[1] == counts[2] and sum(c["trades"] for c in counts[:2]) == trades.dedup(rows).count()
    assert sorted(_read(spark, path, "trades").select("tx_hash", "log_index").collect()) == sorted(trades.dedup(rows).select("tx_hash", "log_index").collect())
    want = {r.pool_id: r.price for r in rows.groupBy("pool_id").agg(F.max_by("price", F.struct("block_number", "log_index")).alias("price")).collect()}
    assert {r.pool_id: r.price for r in _read(spark, path, "last_price").collect()} == want
    assert list((tmp_path / "out" / "candles" / "batch=0").glob("interval=1d"))


def test_compaction(spark, tmp_path):
    rows, path = view(spark, D, "trades"), str(tmp_path / "out")
    sink = sinks.write_tables(path, TABLES)
    for number in range(3):
        sink(rows.where(f"log_index % 3 = {number} or log_index % 7 = 0"), number)
    read = lambda: {name: sorted(map(str, _read(spark, path, name).drop("batch").collect())) for name in TABLES}
    batches = lambda name: sorted(p.name for p in (tmp_path / "out" / name).glob("batch=*"))
    schemas = {name: spark.read.parquet(f"{path}/{name}").drop("batch").schema for name in TABLES}
    before = read()
    for name, table in TABLES.items():
        sinks.compact(spark, path, name, table, schemas[name])
        assert batches(name) == ["batch=1", "batch=2"]
    assert read() == before
    sink(rows.where("log_index % 3 = 2 or log_index % 7 = 0"), 2)  # the newest batch may be repeated
    assert read() == before
    # Changes that were cut short: one before its rows were complete, one before the batches were gone.
    for complete in (False, True):
        for name, table in TABLES.items():
            half = sinks._latest(sinks.stored(spark, f"{path}/{name}", schemas[name]).where("batch <= 1").drop("batch"), table)
            half.write.partitionBy(*table.by).parquet(f"{path}/{name}/_compact-1")
            if not complete:
                (tmp_path / "out" / name / "_compact-1" / "_SUCCESS").unlink()
            sinks.compact(spark, path, name, table, schemas[name])
            assert batches(name) == ["batch=1", "batch=2"]
        assert read() == before


def test_stream_to_several_sinks(spark, tmp_path):
    rows = view(spark, D, "trades")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    seen: list[int] = []
    sink = sinks.fan_out(sinks.write_tables(str(tmp_path / "out"), {"trades": TABLES["trades"]}), lambda batch, _: seen.append(batch.count()))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sum(seen) == rows.count() and len(seen) == 3
    assert _read(spark, str(tmp_path / "out"), "trades").count() == trades.dedup(rows).count()


def test_progress(spark):
    made = lambda *rows: spark.createDataFrame(rows, sinks.PROGRESS)
    got = lambda df: dict(df.collect())
    assert got(sinks.advanced(made(("a", 5), ("b", 7)), made(("a", 9), ("b", 3), ("c", 1), (None, 4)))) == {"a": 9, "b": 7, "c": 1}
    checked = lambda *rows: spark.createDataFrame(rows, "source string, block bigint, ok boolean")
    assert got(sinks.verified(made(("v", 5)), checked(("x", 9, True), ("y", 8, True)), "v")) == {"v": 8}
    assert got(sinks.verified(made(("v", 5)), checked(("x", 9, True), ("y", 8, False)), "v")) == {"v": 5}
    assert got(sinks.verified(made(("v", 5)), checked(("x", 3, True)), "v")) == {"v": 5}
    assert got(sinks.verified(made(("v", 5)), checked(("x", 9, True)).limit(0), "v")) == {"v": 5}
    blocks = spark.range(10).select(F.col("id").alias("block_number"))
    assert sinks.resume(blocks, made(("a", 6)), "a").count() == 3
    assert sinks.resume(blocks, made(("a", 0)), "a").count() == sinks.resume(blocks, made(("a", 6)), "b").count() == 10


def test_miniblocks(spark):
    lines = [json.dumps({"block_number": 1, "transactions": ["a", "b"], "receipts": [{"logs": [{"address": "x", "log_index": 1}, {"address": "y", "log_index": 2}]}, {"logs": []}, {}]}), '{"block_number": 2, "rec', json.dumps({"block_number": 3})]
    rows = decode.miniblocks(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [(r.block_number, r.tx_count, r.log_count, r._corrupt_record) for r in rows.collect()] == [(1, 2, 2, None), (None, None, None, lines[1]), (3, 0, 0, None)]
    assert [(r.block_number, r.tx, r.i, r.address) for r in decode.miniblock_logs(rows).collect()] == [(1, 0, 0, "x"), (1, 0, 1, "y")]


def test_closed_bars_of_a_stream_with_replays(spark, tmp_path):
    rows = view(spark, D, "trades").orderBy("ts")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    bars = jobs.candles(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 3600, repeated=True)
    bars.writeStream.format("memory").queryName("closed_bars").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    key = lambda r: (r.pool_id, r.open_time, float(r.open), float(r.high), float(r.low), float(r.close), float(r.volume), r["count"], float(r.taker_buy_base_volume), float(r.average))
    got = set(map(key, spark.table("closed_bars").collect()))
    assert got and got <= set(map(key, trades.candles(rows, "1h").collect()))


def test_entry_without_optional_modules(monkeypatch):
    plain = importlib.import_module

    def without(name):
        if name in ("orderflow.llm.entries", "corpus_pipeline"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return plain(name)

    monkeypatch.setattr(importlib, "import_module", without)
    known = entry.queries()
    assert set(known) == set(entry.oracle_sql()) and not any(n.startswith("op") for n in known)

    def broken(name):
        raise ModuleNotFoundError("No module named 'missing'", name="missing")

    monkeypatch.setattr(importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        entry.queries()
