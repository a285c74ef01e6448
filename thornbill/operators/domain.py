"""Centroids of a corpus and the gate that refuses questions far from all of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thornbill import config as C
from thornbill.functions import vectors as V


def seed_centroids(rows: DataFrame, k: int = C.CENTROIDS, rid: str = "rid") -> DataFrame:
    """``cid, vec``: the normalised vectors of the ``k`` smallest ids (fewer rows give fewer centroids)."""
    first = rows.where(F.col("vec").isNotNull()).orderBy(rid).limit(k).collect()  # k rows
    spark = rows.sparkSession
    out = []
    for i, r in enumerate(first):
        v = np.array(r["vec"], np.float64)
        n = float(np.sqrt((v * v).sum()))
        out.append((i, (v / n if n > 0 else v).tolist()))
    return spark.createDataFrame(out, "cid int, vec array<double>")


def assign(rows: DataFrame, centroids: DataFrame, rid: str = "rid") -> DataFrame:
    """``rid, cid``: every row's nearest centroid by dot product, the first on ties (after rounding to 9 places)."""
    ids, matrix = _collected(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _unit(V._matrix(batch.column(1), matrix.shape[1]))
            best = np.round(m @ matrix.T, 9).argmax(1) if len(m) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids[best].astype(np.int32))], names=[rid, "cid"])

    return rows.where(F.col("vec").isNotNull()).select(F.col(rid), "vec").mapInArrow(run, f"`{rid}` {rows.schema[rid].dataType.simpleString()}, cid int")


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(n > 0, n, 1)


def _collected(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The centroids, k rows by construction."""
    rows = centroids.orderBy("cid").collect()
    return np.array([r["cid"] for r in rows], np.int32), np.array([r["vec"] for r in rows], np.float64).reshape(len(rows), -1 if rows else 1)


def _step(rows: DataFrame, ids: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centroids after one step and the rows of each. Sums are added up within tasks and then for each centroid and
    dimension, as many rows as the centroids have numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(matrix), matrix.shape[1] + 1))  # the last column counts
        for batch in batches:
            m = _unit(V._matrix(batch.column(0), matrix.shape[1]))
            if len(m):
                best = np.round(m @ matrix.T, 9).argmax(1)
                np.add.at(sums, best, np.c_[m, np.ones(len(m))])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], names=["at", "v"])

    parts = rows.where(F.col("vec").isNotNull()).select("vec").mapInArrow(run, "at long, v double")
    total = np.zeros((len(matrix), matrix.shape[1] + 1))
    for r in parts.groupBy("at").agg(F.sum("v").alias("v")).collect():
        total.flat[r.at] = r.v
    n = total[:, -1].astype(np.int64)
    means = total[:, :-1] / np.maximum(n, 1)[:, None]
    return np.where(n[:, None] > 0, _unit(means), matrix), n


def step(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """``cid, vec, n``: one step: assign, average, normalise; a centroid without rows stays as it was."""
    ids, matrix = _collected(centroids)
    after, n = _step(rows, ids, matrix) if len(ids) else (matrix, [])
    return rows.sparkSession.createDataFrame([(int(i), v.tolist(), int(k)) for i, v, k in zip(ids, after, n)], "cid int, vec array<double>, n long")


def fit(rows: DataFrame, k: int = C.CENTROIDS, steps: int = C.KMEANS_STEPS, rid: str = "rid") -> DataFrame:
    """``cid, vec`` after ``steps`` steps from the smallest ids. Only sums of the centroids come to the driver."""
    ids, matrix = _collected(seed_centroids(rows, k, rid))
    for _ in range(steps if len(ids) else 0):
        matrix, _n = _step(rows, ids, matrix)
    return rows.sparkSession.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, matrix)], "cid int, vec array<double>")


def off_topic(queries: DataFrame, centroids: DataFrame, tau: float = C.DOMAIN_TAU) -> DataFrame:
    """``qid, similarity, off_topic``: the greatest dot product with a centroid, and whether it is below ``tau``."""
    _, matrix = _collected(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _unit(V._matrix(batch.column(1), matrix.shape[1] if matrix.size else 1))
            best = np.round((m @ matrix.T).max(1), 9) if len(m) and matrix.size else np.zeros(len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best), pa.array(best < tau)], names=["qid", "similarity", "off_topic"])

    return queries.select("qid", "vec").mapInArrow(run, f"qid {queries.schema['qid'].dataType.simpleString()}, similarity double, off_topic boolean")
