"""Long stretches of text that stand verbatim in more than one document.

A window of ``length`` characters is treated as a paragraph whose shingles are all its stretches of ``length // 2``
characters, and its MinHash is the shingle of least hash: one band of one row, which for identical paragraphs collides
always, so that recall is 1. Neighbouring windows mostly share their least shingle; such a run of windows is a segment.
Segments that collide are verified exactly, first as a whole and, where a group holds different segments, window by
window. No pairs are formed: each group is reduced to its smallest and largest document with map-side combining.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thornbill.llm.hashing import Rolling, code_points, window_minima
from thornbill.tables import durable, table

#: Windows handled at once; longer texts go through in blocks, so memory stays bounded.
BLOCK = 1 << 21


def segments_of(text: str, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``mark, whole, first, last`` of each segment of a text: the hash of its least shingle, the hash of all its
    characters, and its first and last window start."""
    points = code_points(text)
    windows = len(points) - length + 1
    if windows < 1:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    shingle = length // 2
    width = length - shingle + 1
    rolling = Rolling(points)
    marks, wholes, firsts, lasts = [], [], [], []
    for base in range(0, windows, BLOCK):
        count = min(BLOCK, windows - base)
        at = np.arange(base, base + count + width - 1)
        hashes = rolling.of(at, at + shingle)
        place = np.arange(len(at), dtype=np.uint64)
        least = window_minima((hashes >> np.uint64(24) << np.uint64(24)) | place, width) & np.uint64((1 << 24) - 1)
        new = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        first, last = base + new, base + np.r_[new[1:] - 1, count - 1]
        marks.append(hashes[least[new].astype(np.int64)])
        wholes.append(rolling.of(first, last + length))
        firsts.append(first)
        lasts.append(last)
    return tuple(map(np.concatenate, (marks, wholes, firsts, lasts)))


def _segments(docs: DataFrame, length: int) -> DataFrame:
    """``doc, mark, whole, first, last`` of every segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in (batch.slice(i, 500) for i in range(0, len(batch), 500)):
                ids, parts = [], []
                for doc, text in zip(chunk.column(0).to_pylist(), chunk.column(1).to_pylist()):
                    found = segments_of(text, length)
                    if len(found[0]):
                        ids.append(np.full(len(found[0]), doc, np.int64))
                        parts.append(found)
                if parts:
                    mark, whole, first, last = (np.concatenate(x) for x in zip(*parts))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(mark.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["doc", "mark", "whole", "first", "last"])

    return docs.mapInArrow(run, "doc long, mark long, whole long, first int, last int")


def _windows(docs: DataFrame, length: int) -> DataFrame:
    """``doc, high, mark, hash, start`` of every window of the segments listed in the column ``parts`` of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rolling = Rolling(code_points(row["text"]))
                for i in range(0, len(row["parts"]), 2000):
                    part = row["parts"][i : i + 2000]
                    counts = np.array([p["last"] - p["first"] + 1 for p in part])
                    start = np.concatenate([np.arange(p["first"], p["last"] + 1) for p in part])
                    mark = np.repeat(np.array([p["mark"] for p in part], np.int64), counts)
                    high = np.repeat(np.array([p["high"] for p in part], np.int64), counts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), row["doc"], np.int64)), pa.array(high), pa.array(mark), pa.array(rolling.of(start, start + length).view(np.int64)), pa.array(start.astype(np.int32))], names=["doc", "high", "mark", "hash", "start"])

    return docs.mapInArrow(run, "doc long, high long, mark long, hash long, start int")


def shared_windows(docs: DataFrame, length: int = 200) -> DataFrame:
    """``doc, first, last``: runs of starts of windows of ``length`` characters that stand in another document too.

    ``docs`` has ``doc long, text string``; null texts and texts shorter than ``length`` have no windows. A stretch that
    is repeated only within one document doesn't count.
    """
    if length < 2:
        raise ValueError("length must be at least 2")
    docs = docs.select(F.col("doc").cast("long"), "text").where(F.length("text") >= length)
    segments = durable(_segments(docs, length))
    # Most marks stand in one document only: they are counted out by the mark alone, and only the rest goes further.
    marks = segments.groupBy("mark").agg(F.min("doc").alias("l"), F.max("doc").alias("h"), (F.min("whole") != F.max("whole")).alias("mixed"))
    marks = durable(marks.where("l <> h").select("mark", "mixed"))
    common = durable(segments.join(marks, "mark"))
    wholes = common.groupBy("mark", "whole").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    seen = durable(common.join(wholes, ["mark", "whole"]).where("mixed or low <> high"))
    entire = seen.where("low <> high").select("doc", "first", "last")
    # Of each distinct segment in a group with several, the least document's windows stand for all that have it, with the
    # greatest document beside them; a segment that several have is shared as a whole already.
    unsure = seen.where("mixed and doc = low").groupBy("doc").agg(F.collect_list(F.struct("mark", "first", "last", "high")).alias("parts"))
    windows = durable(_windows(docs.join(unsure, "doc").select("doc", "text", "parts"), length))
    known = windows.groupBy("mark", "hash").agg(F.min("doc").alias("low"), F.max("high").alias("high")).where("low <> high").select("mark", "hash")
    single = windows.where("doc = high").join(known, ["mark", "hash"], "left_semi").select("doc", F.col("start").alias("first"), F.col("start").alias("last"))
    return entire.unionByName(single)


def shared_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """``doc, span_start, span_end``: the longest runs of characters covered by shared windows; runs that touch are one."""
    runs = shared_windows(docs, length).select("doc", F.col("first").cast("long").alias("a"), (F.col("last") + length).cast("long").alias("b"))
    order = W.partitionBy("doc").orderBy("a", "b")
    runs = runs.withColumn("reach", F.max("b").over(order.rowsBetween(W.unboundedPreceding, -1)))
    runs = runs.withColumn("island", F.sum(F.when(F.col("a") <= F.col("reach"), 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("doc", "island").agg(F.min("a").alias("span_start"), F.max("b").alias("span_end")).drop("island")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, span_start, span_end`` of every stretch of at least 200 characters that another document has too."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    return shared_spans(docs).withColumnRenamed("doc", "doc_id")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_shared, n_all``: of every document, the characters that lie in shared stretches, and all its
    characters (0 for a null text)."""
    found = p8_found(spark, sf_dir).groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("n_shared"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_all"))
    return docs.join(found, "doc_id", "left").select("doc_id", F.coalesce("n_shared", F.lit(0)).alias("n_shared"), "n_all")


_FOUND = """
with w as (select doc_id, s, substring(text, s + 1, 200) g from (select doc_id, text, unnest(range(length(text) - 199)) s from documents where length(text) >= 200)),
shared as (select g from w group by g having count(distinct doc_id) > 1),
starts as (select doc_id, s from w where g in (select g from shared)),
marked as (select doc_id, s, case when s <= lag(s) over (partition by doc_id order by s) + 200 then 0 else 1 end new from starts),
runs as (select doc_id, s, sum(new) over (partition by doc_id order by s) r from marked),
found as (select doc_id, min(s) span_start, max(s) + 200 span_end from runs group by doc_id, r)
"""
ORACLES = {
    "p8_found": _FOUND + "select doc_id, span_start, span_end from found",
    "p8_shares": _FOUND + "select d.doc_id, coalesce(sum(span_end - span_start), 0)::bigint n_shared, coalesce(any_value(length(text)), 0)::bigint n_all from documents d left join found f on f.doc_id = d.doc_id group by d.doc_id",
}
QUERIES = {"p8_found": p8_found, "p8_shares": p8_shares}
