"""The streamed reports against their batch counterparts."""

import datetime as dt

from pyspark.sql import functions as F

from thornbill.streaming import traces as streams

SCHEMA = "trace_id string, path string, total_ms double, asked_at timestamp"
DAY = dt.datetime(2025, 1, 1)


def files(spark, tmp_path, *batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def run(df, mode, tmp_path):
    seen = []
    query = df.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda b, e: seen.append([tuple(r) for r in b.collect()])).start()
    query.awaitTermination()
    return seen


def test_last_entries(spark, tmp_path):
    one = [(f"t{i}", "a", float(i), DAY + dt.timedelta(hours=i)) for i in range(5)] + [("n", None, 1.0, DAY), ("m", "a", 1.0, None)]
    two = [("t1", "a", 1.0, DAY + dt.timedelta(hours=1)), ("late", "a", 9.0, DAY + dt.timedelta(hours=3)), ("b1", "b", None, DAY)]
    seen = run(streams.last_entries(files(spark, tmp_path, one, two), 3), "update", tmp_path)
    last = {}
    for batch in seen:
        for path in {r[0] for r in batch}:
            last[path] = [r[1] for r in sorted(batch, key=lambda r: (r[2], r[1]), reverse=True) if r[0] == path]
    assert last == {"a": ["t4", "t3", "late"], "b": ["b1"]}


def test_windows_and_watermark(spark, tmp_path):
    rows = [("x", "a", 1.0, DAY), ("y", "a", None, DAY + dt.timedelta(hours=5)), ("z", "b", 2.0, DAY + dt.timedelta(days=1)), ("w", "b", 2.0, None)]
    seen = run(streams.windows(files(spark, tmp_path, rows)), "complete", tmp_path)
    got = {(r[0].day, r[1]): r[2:] for r in seen[-1]}
    assert got == {(1, "a"): (2, 1.0), (2, "b"): (1, 2.0)}
    late = streams.windows(spark.createDataFrame(rows, SCHEMA), late="1 hour")
    assert late.agg(F.sum("n")).first()[0] == 3
