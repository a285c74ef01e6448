"""Sinks: corpus, evaluation and score files, reports, and index snapshots."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, append: bool = False) -> None:
    """One JSON object a line, UTF-8, nulls kept."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def append_scores(df: DataFrame, path: str | None) -> None:
    """Appends ``confidence`` to 4 places and the first 80 characters of ``text``; nothing where no path is set."""
    if path:
        write_json(df.withColumn("confidence", F.bround("confidence", 4)).withColumn("text", F.substring("text", 1, 80)), path, append=True)


def markdown(df: DataFrame, title: str) -> str:
    """A small report table; at most 1,000 rows are shown."""
    rows = df.limit(1000).collect()
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)]) + "\n"


def save_snapshot(tables: dict[str, DataFrame], path: str, meta: dict | None = None) -> None:
    """Every table of an index as parquet, and what describes it. Vectors travel in their rows."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
    described = {"tables": {k: df.columns for k, df in tables.items()}} | (meta or {})
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(described, ensure_ascii=False),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_snapshot(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """The tables of a snapshot and its description."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return {k: spark.read.parquet(f"{path}/{k}") for k in meta["tables"]}, meta


def write_report(text: str, path: str) -> None:
    Path(path).write_text(text)
