"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from orderflow.operators import balances, orders, trades
from orderflow.sources.fixtures import view
from orderflow.streaming import jobs

D = "/root/testdata/sf0.001"


def _stream(spark, frame, path, parts=3):
    for i in range(parts):
        frame.where(F.pmod(F.xxhash64(*frame.columns), F.lit(parts)) == i).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def _run(df, name, mode, at):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(at)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_live_candles_equal_batch(spark, tmp_path):
    rows = trades.dedup(view(spark, D, "trades"))
    rows.write.parquet(str(tmp_path / "in"))
    got = _run(jobs.candles(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 3600), "live_candles", "complete", tmp_path / "cp")
    key = lambda r: (r.pool_id, r.open_time, float(r.open), float(r.high), float(r.low), float(r.close), float(r.volume), r["count"])
    assert sorted(map(key, got.collect())) == sorted(map(key, trades.candles(rows, "1h").collect()))


def test_stream_dedup(spark, tmp_path):
    rows = view(spark, D, "trades")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = _run(jobs.dedup(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))), "deduped", "append", tmp_path / "cp")
    assert got.count() == trades.dedup(rows).count() < rows.count()


def test_refolding_is_exact_for_late_rows(spark, tmp_path):
    cases = [
        (view(spark, D, "order_events"), ["pool_id", "order_id"], orders.latest),
        (balances.deltas(view(spark, D, "balance_events")), ["user", "token_id"], balances.final),
    ]
    for i, (rows, keys, fold) in enumerate(cases):
        state: dict = {}

        def write(frame, number, state=state, keys=keys):
            state.update({tuple(r[k] for k in keys): r for r in frame.collect()})

        writer = jobs.refolding(_stream(spark, rows, tmp_path / f"in{i}"), keys, str(tmp_path / f"log{i}"), fold, write)
        writer.option("checkpointLocation", str(tmp_path / f"cp{i}")).trigger(availableNow=True).start().awaitTermination()
        assert state == {tuple(r[k] for k in keys): r for r in fold(rows).collect()}
