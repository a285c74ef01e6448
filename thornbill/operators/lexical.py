"""BM25 over chunks (``chunk_id, text``): statistics, postings and top-k."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from thornbill import config as C
from thornbill.functions import vectors as V
from thornbill.functions.text import WORD, tokens
from thornbill.tables import durable


def lengths(chunks: DataFrame) -> DataFrame:
    """``chunk_id, dl``: tokens of every chunk, none included."""
    return chunks.select("chunk_id", F.coalesce(F.regexp_count("text", F.lit(f"{WORD}+")), F.lit(0)).alias("dl"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """``n, avgdl``: one row; an average of 0 counts as 1 where it divides."""
    return lengths(chunks).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl") / F.greatest(F.count(F.lit(1)), F.lit(1)), F.lit(0.0)).alias("avgdl"))


def postings(chunks: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """``chunk_id, term, tf, dl``; with ``terms``, only of these, before anything is shuffled."""
    t = chunks.select("chunk_id", tokens(F.col("text")).alias("t")).select("chunk_id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    if terms is not None:
        t = t.join(terms.select("term").distinct(), "term", "left_semi")
    return t.groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def idf(posting: DataFrame, n: int) -> DataFrame:
    """``term, df, idf`` of postings of ``n`` chunks."""
    d = posting.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return d.select("term", "df", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


@dataclass
class Lexicon:
    """What lexical search reads: ``postings`` (``term, chunk_id, tf, dl``), ``terms`` (``term, df, idf``), the number of chunks
    and their mean length."""

    postings: DataFrame
    terms: DataFrame
    n: int
    avgdl: float


def lexicon(chunks: DataFrame, only: DataFrame | None = None) -> Lexicon:
    """The lexicon of ``chunks``, of the terms of ``only`` where given. Postings are ordered by term and chunk, a frequent term
    over several files, so that a search reads little but its own terms."""
    p = postings(chunks, only).select("term", "chunk_id", "tf", "dl")
    if only is None:
        p = p.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id")
    p = durable(p)
    n, avgdl = corpus_stats(chunks).first()  # one row
    return Lexicon(p, durable(idf(p, n)), n, avgdl)


def query_terms(queries: DataFrame) -> DataFrame:
    """``qid, term, m``: the distinct terms of every query and how often it has each."""
    return queries.select("qid", F.explode(tokens(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("m"))


def _weight(lex: Lexicon, k1: float, b: float) -> Column:
    """What one posting adds to the score of a query that has its term ``m`` times."""
    return F.col("m") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / (lex.avgdl or 1.0)))


def score(queries: DataFrame, chunks: DataFrame | Lexicon, k1: float = C.BM25_K1, b: float = C.BM25_B) -> DataFrame:
    """``qid, chunk_id, score`` of every query and chunk that share a term; repeated query terms count repeatedly."""
    q = query_terms(queries)
    lex = chunks if isinstance(chunks, Lexicon) else lexicon(chunks, q)
    w = q.join(lex.terms, "term").join(lex.postings, "term")
    return w.groupBy("qid", "chunk_id").agg(F.sum(_weight(lex, k1, b)).alias("score"))


def best(queries: DataFrame, chunks: DataFrame | Lexicon, k: int, k1: float = C.BM25_K1, b: float = C.BM25_B) -> DataFrame:
    """The ``k`` best of :func:`score` for every query, exactly, without scoring every chunk that has a frequent term.

    No posting adds more than ``m * idf * (k1 + 1)``. The rarest terms of a query give a first list, whose k-th score is a
    floor; the terms whose most together stays below the floor can't lift a chunk over it alone. So only chunks that have
    another term are candidates, those that can't reach the floor any more are dropped, and the frequent terms are looked
    up for the rest. Without a lexicon, all chunks are scanned (:func:`scan`).
    """
    if not isinstance(chunks, Lexicon):
        return top(scan(queries, chunks, k, k1, b), k)
    q, lex = query_terms(queries), chunks
    t = durable(q.join(lex.terms, "term").withColumn("most", F.col("m") * F.col("idf") * (k1 + 1)))  # a row a query and term
    rare_first = W.partitionBy("qid").orderBy("df", "term").rowsBetween(W.unboundedPreceding, -1)
    rare = t.withColumn("before", F.coalesce(F.sum("df").over(rare_first), F.lit(0))).where(F.col("before") < 2 * k)
    weight = _weight(lex, k1, b)
    first = rare.join(lex.postings, "term").groupBy("qid", "chunk_id").agg(F.sum(weight).alias("s"))
    kth = first.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.col("s").desc()))).where(F.col("r") <= k)
    floor = kth.groupBy("qid").agg(F.when(F.count(F.lit(1)) == k, F.min("s") - 1e-7).otherwise(0.0).alias("floor"))
    small_first = W.partitionBy("qid").orderBy("most", "term").rowsBetween(W.unboundedPreceding, W.currentRow)
    t = durable(t.join(floor, "qid").withColumn("weak", F.sum("most").over(small_first) < F.col("floor")))
    rest = t.groupBy("qid").agg(F.first("floor").alias("floor"), F.coalesce(F.sum(F.when(F.col("weak"), F.col("most"))), F.lit(0.0)).alias("rest"))
    strong = t.where("not weak").join(lex.postings, "term").groupBy("qid", "chunk_id").agg(F.sum(weight).alias("s"))
    held = strong.join(rest, "qid").where("s + rest >= floor").select("qid", "chunk_id", "s")  # its exchange is used twice
    weak = held.select("qid", "chunk_id").join(t.where("weak").select("qid", "term", "m", "idf"), "qid").join(lex.postings, ["term", "chunk_id"])
    more = weak.select("qid", "chunk_id", weight.alias("s"))
    return top(held.unionByName(more).groupBy("qid", "chunk_id").agg(F.sum("s").alias("score")), k)


def _counts(tokens: pa.ListArray, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each row; then row, number and count of each of the ``terms`` that it has."""
    dl = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    term = pc.fill_null(pc.index_in(flat := tokens.flatten(), value_set=terms.cast(flat.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(dl)), dl)[term >= 0]
    at, tf = np.unique(row * max(1, len(terms)) + term[term >= 0], return_counts=True)
    return dl, at // max(1, len(terms)), at % max(1, len(terms)), tf


def scan(queries: DataFrame, chunks: DataFrame, k: int, k1: float = C.BM25_K1, b: float = C.BM25_B) -> DataFrame:
    """``qid, chunk_id, score``: the best ``k`` of every query in each task, by scanning the chunks (``chunk_id, text``, each id
    once) twice: for the statistics of the queries' terms, and to score. No posting is stored or shuffled. Queries travel with
    the code in blocks of ``V.QUERY_BLOCK``, their distinct terms all at once."""
    q = query_terms(queries)
    qtype, rtype = queries.schema["qid"].dataType, chunks.schema["chunk_id"].dataType
    asked = sorted((r.qid, r.term, r.m) for r in q.collect())
    if not asked:
        return q.select("qid").join(chunks.select("chunk_id"), F.lit(False)).withColumn("score", F.lit(0.0))
    terms = pa.array(sorted({t for _, t, _ in asked}), pa.string())
    number = {t: i for i, t in enumerate(terms.to_pylist())}
    rows = V.together(chunks.select("chunk_id", tokens(F.col("text")).alias("t")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            dl, _, term, _ = _counts(batch.column(0), terms)
            df += np.bincount(term, minlength=len(df))
            n, total = n + len(dl), total + int(dl.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-2, len(df))), pa.array(np.r_[n, total, df])], names=["at", "n"])

    found = {r.at: r.n for r in rows.select("t").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    n, total = found.get(-2, 0), found.get(-1, 0)
    df = np.array([found.get(i, 0) for i in range(len(terms))], np.float64)
    idf, avgdl = np.log(1 + (n - df + 0.5) / (df + 0.5)), total / max(1, n) or 1.0
    ids = sorted({x for x, _, _ in asked})
    out = None
    for start in range(0, len(ids), V.QUERY_BLOCK):
        mine = ids[start : start + V.QUERY_BLOCK]
        place = {x: i for i, x in enumerate(mine)}
        own = sorted((number[t], place[x], m) for x, t, m in asked if x in place)
        own_terms, starts, many = np.unique([t for t, _, _ in own], return_index=True, return_counts=True)
        column, times = np.array([c for _, c, _ in own]), np.array([m for _, _, m in own], np.float64)
        values = terms.take(pa.array(own_terms))

        def run(batches: Iterator[pa.RecordBatch], mine=mine, weights=idf[own_terms], values=values, starts=starts, many=many, column=column, times=times) -> Iterator[pa.RecordBatch]:
            best = V.Best(k, len(mine), np.nextafter(0.0, 1.0))
            step = max(64, V.PAIRS // len(mine))
            for batch in batches:
                for i in range(0, len(batch), step):
                    part = batch.slice(i, step)
                    dl, row, term, tf = _counts(part.column(1), values)
                    w = weights[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[row] / avgdl))
                    each = many[term]
                    at = np.repeat(starts[term] - np.cumsum(each) + each, each) + np.arange(each.sum())
                    cell = np.repeat(row, each) * len(mine) + column[at]
                    score = np.bincount(cell, np.repeat(w, each) * times[at], len(dl) * len(mine))
                    best.add(np.array(part.column(0).to_pylist(), dtype=object), score.astype(np.float64, copy=False).reshape(len(dl), len(mine)))  # counts of nothing are whole numbers
            held, at, score = best.held()
            yield pa.RecordBatch.from_arrays([pa.array([mine[x] for x in at], to_arrow_type(qtype)), pa.array(held.tolist(), to_arrow_type(rtype)), pa.array(score)], names=["qid", "chunk_id", "score"])

        part = rows.mapInArrow(run, f"qid {qtype.simpleString()}, chunk_id {rtype.simpleString()}, score double")
        out = part if out is None else out.unionByName(part)
    return out


def top(scores: DataFrame, k: int) -> DataFrame:
    """``qid, chunk_id, score, rank`` (from 0) of the ``k`` best, ties to the smaller chunk_id after rounding to 9 places."""
    w = W.partitionBy("qid").orderBy(F.round("score", 9).desc(), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def search(queries: DataFrame, chunks: DataFrame, k: int, strategies: tuple[str, ...] | None = None, lex: Lexicon | None = None) -> DataFrame:
    """The lexical top-k. A strategy filter applies after scoring, to six times as many hits, so fewer than ``k`` may be left;
    document frequencies stay those of all strategies."""
    if strategies is None:
        return best(queries, lex or chunks, k)
    many = best(queries, lex or chunks, k * C.LEXICAL_OVERFETCH)
    kept = many.join(chunks.where(F.col("strategy").isin(list(strategies))).select("chunk_id"), "chunk_id", "left_semi")
    return top(kept.drop("rank"), k)
