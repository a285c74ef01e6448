"""Vectors: the default embedder, normalisation, dot products, and exact nearest-neighbour search by blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from hashlib import md5

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from thornbill.config import DIMENSIONS

#: An embedder turns a list of texts into a matrix with a row for each; rows need not be normalised.
Embedder = Callable[[list], np.ndarray]
_WORD = regex.compile(r"[\p{L}\p{N}_]+")
#: Query vectors that travel with the code at once; more queries go through in blocks.
QUERY_BLOCK = 4096
#: Pairs of a row and a query that are scored at once.
PAIRS = 1 << 20


@lru_cache(maxsize=200_000)
def _slot(term: str, dimensions: int) -> tuple[int, int]:
    h = int(md5(term.encode()).hexdigest()[:7], 16)
    return h % dimensions, 1 if h // dimensions % 2 == 0 else -1


def hash_embedder(dimensions: int = DIMENSIONS) -> Embedder:
    """Signed feature hashing of the lexical tokens; whole numbers, so that cosines are the same in every engine."""

    def embed(texts: list) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.int32)
        for row, text in zip(out, texts):
            for term in _WORD.findall(text or ""):
                bucket, sign = _slot(term.lower(), dimensions)
                row[bucket] += sign
        return out

    return embed


def embed(df: DataFrame, text: str, embedder: Embedder | None = None, to: str = "vec") -> DataFrame:
    """``df`` with a column of vectors (array<double>); null and blank texts get the embedder's vector of an empty text."""
    embedder = embedder or hash_embedder()
    schema = T.StructType([*df.schema.fields, T.StructField(to, T.ArrayType(T.DoubleType()))])
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = np.asarray(embedder(batch.column(place).to_pylist()), np.float64).reshape(len(batch), -1)
            ends = np.arange(len(batch) + 1, dtype=np.int32) * vectors.shape[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(vectors.ravel()))], names=[*batch.schema.names, to])

    return df.mapInArrow(run, schema)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors; 0 if either is null or all zeros."""
    squares = dot(a, a) * dot(b, b)
    return F.coalesce(F.when(squares > 0, dot(a, b) / F.sqrt(squares)), F.lit(0.0))


def normalise(v: Column) -> Column:
    """A vector of length one; zeros stay zeros."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm > 0, norm).otherwise(1.0))


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, width or 1))


def _short(m: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Rows of length one in single precision, enough to tell what can't be among the best; zeros stay zeros."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(m / np.sqrt(squares)[:, None], posinf=0, neginf=0).astype(np.float32)


def _cosines(m: np.ndarray, squares: np.ndarray, q: np.ndarray, lengths: np.ndarray, row: np.ndarray, query: np.ndarray) -> np.ndarray:
    """The exact cosines of some pairs of rows and queries, 0 where either is all zeros."""
    out = np.zeros(len(row))
    for i in range(0, len(row), 1 << 16):
        r, c = row[i : i + (1 << 16)], query[i : i + (1 << 16)]
        both = squares[r] * lengths[c]
        np.divide(np.einsum("ij,ij->i", m[r], q[c]), np.sqrt(both), out=out[i : i + (1 << 16)], where=both > 0)
    return out


class Best:
    """The ``k`` best rows of each of ``queries`` queries over many batches, by score rounded to 9 places, in which ties go to the
    smaller id. What can't reach the last one held of its query is dropped at once, the rest is sorted when it has become as
    much again. Scores below ``least`` aren't taken."""

    def __init__(self, k: int, queries: int, least: float = -np.inf) -> None:
        self.k, self.least, self.floor = k, least, np.full(queries, -np.inf)
        self.names: list[np.ndarray] = []  # ids of rows, by number
        self.rows = self.waiting = 0
        self.parts: list[tuple] = []  # row numbers, queries, scores, rounded scores

    def add(self, ids: np.ndarray, score: np.ndarray, exact: Callable | None = None) -> None:
        """A batch: the ids of its rows, and their scores (rows by queries). Scores that are right to 1e-5 only have a function
        that gives the exact ones of some pairs, from their rows and queries."""
        least = np.maximum(self.floor - (1e-8 if exact is None else 2e-5), self.least)
        near = score >= least.astype(score.dtype)
        of = exact or (lambda row, query: score[row, query])
        crowded = np.flatnonzero(np.count_nonzero(near, axis=0) > self.k)
        if len(crowded):
            by_id = np.argsort(ids, kind="stable")
            order = np.round(of(*(x.ravel() for x in np.meshgrid(by_id, crowded, indexing="ij"))), 9).reshape(len(ids), -1)
            order[~near[np.ix_(by_id, crowded)]] = -np.inf
            near[:, crowded] = False
            near[by_id[np.argsort(-order, axis=0, kind="stable")[: self.k]], crowded] = True
        row, query = np.nonzero(near)
        value = of(row, query)
        order = np.round(value, 9)
        keep = order >= self.floor[query]
        if keep.any():
            self.parts.append((row[keep] + self.rows, query[keep], value[keep], order[keep]))
            self.names.append(ids)
            self.rows += len(ids)
            self.waiting += int(keep.sum())
            if self.waiting > self.k * len(self.floor) or self.rows > 500_000:
                self._sort()

    def _sort(self) -> None:
        row, query, value, order = (np.concatenate(x) for x in zip(*self.parts))
        used, row = np.unique(row, return_inverse=True)
        names = np.concatenate(self.names)[used]
        by_name = np.argsort(names, kind="stable")
        place = np.empty(len(names), np.int64)
        place[by_name] = np.arange(len(names))
        at = np.lexsort((place[row], -order, query))
        row, query, value, order = row[at], query[at], value[at], order[at]
        first = np.searchsorted(query, np.arange(len(self.floor)))
        keep = np.arange(len(query)) - first[query] < self.k
        row, query, value, order = row[keep], query[keep], value[keep], order[keep]
        full = np.bincount(query, minlength=len(self.floor)) == self.k
        last = np.searchsorted(query, np.arange(len(self.floor)), "right") - 1
        self.floor[full] = order[last[full]]
        used, row = np.unique(row, return_inverse=True)
        self.names, self.parts, self.rows, self.waiting = [names[used]], [(row, query, value, order)], len(used), 0

    def held(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, numbers of their queries and scores."""
        if not self.parts:
            return np.empty(0, object), np.empty(0, np.int64), np.empty(0)
        self._sort()
        row, query, value, _ = self.parts[0]
        return self.names[0][row], query, value


def together(rows: DataFrame) -> DataFrame:
    """``rows`` in at most two tasks a core, without a shuffle, so that few tasks give a list for each query."""
    return rows.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)


def nearest(queries: DataFrame, rows: DataFrame, k: int, qid: str = "qid", qvec: str = "vec", rid: str = "rid", vec: str = "vec", by: str | None = None) -> DataFrame:
    """``qid, rid, score`` (and ``by``): the ``k`` rows of highest cosine for every query, for each value of ``by`` apart.

    Exact: every row is compared with every query, by matrix products over Arrow batches, and each task keeps only its best
    ``k`` of a query, whatever it reads. Queries travel with the code in blocks of QUERY_BLOCK; rows are never collected. Ties
    go to the smaller ``rid`` after rounding to 9 places. Rows and queries without a vector have no hits.
    """
    from pyspark.sql import Window as W

    queries = queries.where(F.col(qvec).isNotNull()).select(qid, qvec)
    rows = rows.where(F.col(vec).isNotNull()).select(F.col(rid), F.col(vec).alias("_vec"), *([F.col(by)] if by else [F.lit("").alias("_by")]))
    rows = together(rows)
    keys = {f.name: f.dataType.simpleString() for f in (queries.schema[qid], rows.schema[rid], rows.schema[by or "_by"])}
    names = [qid, rid, by or "_by", "score"]
    qtype = to_arrow_type(queries.schema[qid].dataType)
    parts: list[DataFrame] = []
    total = queries.count()
    blocks = max(1, -(-total // QUERY_BLOCK))
    for block in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64(qid), F.lit(blocks)) == block).collect() if total else []
        if not mine:
            continue
        ids = np.array([r[0] for r in mine])
        q = np.array([r[1] for r in mine], np.float64)
        lengths = (q * q).sum(1)
        short = _short(q, lengths)

        def run(batches: Iterator[pa.RecordBatch], ids=ids, q=q, lengths=lengths, short=short) -> Iterator[pa.RecordBatch]:
            best: dict[object, Best] = {}
            types = None
            step = max(64, PAIRS // len(ids))
            for batch in batches:
                types = batch.schema.types
                for i in range(0, len(batch), step):
                    part = batch.slice(i, step)
                    m = _matrix(part.column(1))
                    squares = (m * m).sum(1)
                    score = _short(m, squares) @ short.T
                    group = np.array(part.column(2).to_pylist(), dtype=object)
                    row_ids = np.array(part.column(0).to_pylist(), dtype=object)
                    for g in set(group):
                        at = np.flatnonzero(group == g)
                        best.setdefault(g, Best(k, len(ids))).add(row_ids[at], score[at] if len(at) < len(group) else score, partial(_cosines, m[at], squares[at], q, lengths))
            for g, b in best.items():
                held, cols, score = b.held()
                yield pa.RecordBatch.from_arrays([pa.array(ids[cols].tolist(), qtype), pa.array(held.tolist(), types[0]), pa.array([g] * len(cols), types[2]), pa.array(score)], names=names)

        parts.append(rows.mapInArrow(run, f"`{qid}` {keys[qid]}, `{rid}` {keys[rid]}, `{names[2]}` {keys[names[2]]}, score double"))
    if not parts:
        return queries.select(qid).join(rows.select(rid, names[2]), F.lit(False)).withColumn("score", F.lit(0.0)).drop(*([] if by else ["_by"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = W.partitionBy(qid, names[2]).orderBy(F.round("score", 9).desc(), rid)
    out = out.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")
    return out if by else out.drop("_by")
