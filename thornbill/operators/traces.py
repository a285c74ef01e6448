"""Reports over traces: exact nearest-rank percentiles, counts, and the last entries."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thornbill import config as C
from thornbill.tables import durable


def ranked(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """``groups, value, rank, times, n``: every distinct value of a group, its first place (from 0), how many places it holds and
    the group's size, exact at any size.

    Equal values are counted first, with map-side combining, so no value is hot. Distinct values are sorted by range over
    group and value, so a hot group is spread over many tasks; a range's places start behind those of the group's earlier
    ranges, of which only counts are gathered. Null values have no place.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = groups or []
    d = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("times"))
    d = durable(d.repartitionByRange(parts, *keys, value).withColumn("_part", F.spark_partition_id()))
    counts = d.groupBy("_part", *keys).agg(F.sum("times").alias("_c"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_part", *keys, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_offset"), F.sum("_c").over(W.partitionBy(*keys)).alias("n"))
    on = (F.col("d._part") == F.col("o._part")) & F.lit(True)
    for k in keys:
        on = on & F.col(f"d.{k}").eqNullSafe(F.col(f"o.{k}"))
    d = d.withColumn("_row", F.coalesce(F.sum("times").over(W.partitionBy("_part", *keys).orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    joined = d.alias("d").join(offsets.alias("o"), on)
    return joined.select(*(F.col(f"d.{k}").alias(k) for k in keys), F.col(f"d.{value}").alias(value), (F.col("_offset") + F.col("_row")).alias("rank"), "times", "n")


def _holds(place: Column) -> Column:
    """Whether a row of :func:`ranked` holds a place."""
    return (F.col("rank") <= place) & (place < F.col("rank") + F.col("times"))


def percentiles(df: DataFrame, value: str, groups: list[str] | None = None, points: tuple[float, ...] = C.PERCENTILES) -> DataFrame:
    """``groups, p50, …, n, mean``: of each group, the value at the rank p·(n-1) rounded half to even, and the mean to 2 places.
    Groups without a value, and an empty table, have no row."""
    keys = groups or []
    r = ranked(df, keys, value)
    at = {p: F.bround(F.lit(float(p)) * (F.col("n") - 1), 0).cast("long") for p in points}
    wanted = r.where(functools.reduce(lambda x, y: x | y, [_holds(a) for a in at.values()]))
    out = wanted.groupBy(*keys).agg(*(F.round(F.max(F.when(_holds(a), F.col(value))), 6).alias(f"p{round(p * 100)}") for p, a in at.items()))
    means = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg(value), 2).alias("mean"))
    if not keys:
        return out.crossJoin(F.broadcast(means)).where("n > 0")  # one row each
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return out.alias("a").join(means.alias("b"), on).select("a.*", "b.n", "b.mean")


def quantiles(df: DataFrame, value: str, groups: list[str]) -> DataFrame:
    """``groups, n, min, p10, p50, p90, max`` at the ranks n//10, n//2 and int(0.9·n) of each group."""
    r = ranked(df, groups, value)
    n = F.col("n")
    at = {"min": F.lit(0), "p10": F.floor(n / 10), "p50": F.floor(n / 2), "p90": F.floor(n * F.lit(0.9)), "max": n - 1}
    return r.groupBy(*groups).agg(F.first("n").alias("n"), *(F.round(F.max(F.when(_holds(a), F.col(value))), 6).alias(f"{k}_value") for k, a in at.items()))


def last_entries(traces: DataFrame, n: int = C.RING, by: str = "asked_at", key: str = "trace_id") -> DataFrame:
    """The ``n`` latest entries, ties to the greater key; each task keeps its own best before they meet."""
    return traces.where(F.col(by).isNotNull()).orderBy(F.col(by).desc(), F.col(key).desc()).limit(n)


def path_counts(traces: DataFrame) -> DataFrame:
    """``path, n, refused``."""
    return traces.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("refused").isNotNull()).alias("refused"))


def stage_waterfall(traces: DataFrame) -> DataFrame:
    """``stage, n, mean_ms, mean_width``: of each stage, its entries, mean time and mean bar width in per cent of the budget."""
    from thornbill.functions.text import bar_width

    s = traces.where("budget_ms > 0").select("budget_ms", F.explode("timings").alias("t")).select("budget_ms", "t.stage", "t.ms").where("stage is not null and ms is not null")
    return s.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ms"), 3).alias("mean_ms"), F.round(F.avg(bar_width(F.col("ms"), F.col("budget_ms"))), 3).alias("mean_width"))
