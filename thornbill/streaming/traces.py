"""Traces as a stream: event-time windows, and the last entries of every path."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from thornbill import config as C
from thornbill.tables import ensure_checkpoint_dir, is_folder, table, written


def read_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 8) -> DataFrame:
    """The traces as a file stream, a few files at a time."""
    schema = table(spark, sf_dir, "traces").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet")
    return source.parquet(f"{sf_dir}/traces.parquet" if is_folder(spark, f"{sf_dir}/traces.parquet") else f"{sf_dir}/traces.parque[t]")


def windows(traces: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """``window_start, path, n, total`` by event time, an entry delivered twice counted once. With ``late``, a watermark lets a
    window close and drop later entries, and bounds what is remembered; without, every entry counts however late it is, and
    all trace_ids are remembered."""
    if late:
        traces = traces.withWatermark("asked_at", late)
    traces = traces.dropDuplicatesWithinWatermark(["trace_id"]) if late and traces.isStreaming else traces.dropDuplicates(["trace_id"])
    w = traces.where("asked_at is not null").groupBy(F.window("asked_at", width).alias("w"), "path")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("total_ms", F.lit(0.0))).alias("total")).select(F.col("w.start").alias("window_start"), "path", "n", "total")


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All traces run through the stream once, the last state of every window written to the shared folder and read again."""
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    written(spark, base)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/result")

    query = windows(read_stream(spark, sf_dir)).writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/result").select("window_start", "path", "n", F.round("total", 3).alias("total"))


def last_entries(traces: DataFrame, n: int = C.RING, key: str = "path") -> DataFrame:
    """``key, trace_id, asked_at, total_ms``: of a stream, after every trigger, the ``n`` latest entries of each key that got
    new ones (ties to the greater trace_id). An entry delivered twice counts once. The state of a key never exceeds ``n``
    entries; entries without a key or time are left out."""
    out = f"`{key}` string, trace_id string, asked_at timestamp, total_ms double"
    held = "trace_id array<string>, asked_at array<timestamp>, total_ms array<double>"

    def update(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame({"trace_id": [], "asked_at": [], "total_ms": []})
        if state.exists:
            ids, times, ms = state.get
            kept = pd.DataFrame({"trace_id": list(ids), "asked_at": pd.to_datetime(list(times)), "total_ms": list(ms)})
        for batch in batches:
            new = batch[["trace_id", "asked_at", "total_ms"]]
            kept = new if kept.empty else pd.concat([kept, new])
            kept = kept.drop_duplicates("trace_id").sort_values(["asked_at", "trace_id"], ascending=False).head(n)
        state.update((kept["trace_id"].tolist(), [t.to_pydatetime() for t in kept["asked_at"]], kept["total_ms"].tolist()))
        yield kept.assign(**{key: group[0]})[[key, "trace_id", "asked_at", "total_ms"]]

    def latest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each key the last ``n`` of one task, so that no key has more than that from each in the shuffle."""
        kept = None
        for batch in batches:
            kept = batch if kept is None else pd.concat([kept, batch])
            kept = kept.drop_duplicates([key, "trace_id"]).sort_values(["asked_at", "trace_id"], ascending=False).groupby(key).head(n)
        if kept is not None:
            yield kept

    rows = traces.where(F.col(key).isNotNull() & F.col("asked_at").isNotNull()).select(key, "trace_id", "asked_at", "total_ms")
    rows = rows.mapInPandas(latest, f"`{key}` string, trace_id string, asked_at timestamp, total_ms double")
    return rows.groupBy(key).applyInPandasWithState(update, out, held, "update", GroupStateTimeout.NoTimeout)
