from datetime import datetime, timedelta

from pyspark.sql import functions as F

from blockloom.operators import blocks as B
from blockloom.operators import track as T
from blockloom.streaming.stateful import sliding_volatility, synchronise, track_dirty

T0 = datetime(2024, 1, 1)
OPS = "device long, seq long, ts timestamp_ntz, op string, offset long, length int"
LOG = [("TRACK", 0, 40960), ("W", 10, 9000), ("SYNC", 0, 0), ("W", 10, 10), ("R", 0, 8000), ("W", 5000, 10), ("SYNC", 0, 0), ("W", 20000, 9000)]


def touched(spark, path):
    log = spark.createDataFrame([(k % 2, 10 * k + j, T0 + timedelta(minutes=10 * k + j), *r) for k in range(3) for j, r in enumerate(LOG)], OPS)
    rows = T.spread_syncs(B.touches(log, 40960, 4096).select("device", "block_no", "seq", "op", "ts"), log)
    for k in range(3):
        rows.where(F.col("seq").between(10 * k, 10 * k + 9)).coalesce(1).write.mode("append").parquet(path)
    return rows, log


def run(query, name, tmp_path, mode="append"):
    q = query.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
    q.awaitTermination(120)


def test_stream_equals_batch(spark, tmp_path):
    path = str(tmp_path / "log")
    rows, log = touched(spark, path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    run(track_dirty(stream), "dirty", tmp_path)
    got = {(r.device, r.block_no): r.n for r in spark.table("dirty").groupBy("device", "block_no").agg(F.count("*").alias("n")).collect()}
    want = {(r.device, r.block_no): r.n_emitted for r in T.dirty_fold(log, 40960, 4096, 4).where("n_emitted > 0").collect()}
    assert got == want and got


def test_windows_drop_late_rows(spark, tmp_path):
    path = str(tmp_path / "log")
    rows, _ = touched(spark, path)
    run(sliding_volatility(spark.readStream.schema(rows.schema).parquet(path), "10 minutes", "5 minutes", "1 minute"), "windows", tmp_path)
    assert spark.table("windows").where("n > 0").count() > 0


def test_synchronised_table(spark, tmp_path):
    path = str(tmp_path / "log")
    rows, _ = touched(spark, path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path).where("op = 'W'")
    copy = lambda blocks: blocks.withColumn("hash", F.concat_ws("-", "device", "block_no")).withColumn("ok", F.col("block_no") != 2)
    q = synchronise(stream, str(tmp_path / "status"), copy, str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = max(int(p.name[1:]) for p in (tmp_path / "status").iterdir())
    status = {(r.device, r.block_no): r for r in spark.read.parquet(str(tmp_path / "status" / f"v{last}")).collect()}
    assert {k for k in status} == {(r.device, r.block_no) for r in rows.where("op = 'W'").select("device", "block_no").distinct().collect()}
    assert all(r.is_set == (r.block_no != 2) for r in status.values())
