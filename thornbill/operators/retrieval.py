"""Hybrid retrieval of whole batches of queries: dense and lexical lists, fused, boosted, deduplicated and resolved."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thornbill import config as C
from thornbill.config import RetrieveOptions
from thornbill.functions import text as X
from thornbill.functions import vectors as V
from thornbill.operators import chunking, domain, lexical
from thornbill.sources import sinks
from thornbill.tables import among, durable

NO_RANK = 1_000_000


@dataclass
class Index:
    """``chunks`` with their vector in ``vec`` (parents excluded), ``parents`` (``chunk_id, passage_id, text``). A stored one
    also has its ``lexicon``, the vectors of its ``sentences`` (``passage_id, sent, svec``) and the ``centroids`` and the
    threshold ``tau`` of its gate."""

    chunks: DataFrame
    parents: DataFrame
    embedder: V.Embedder | None = None
    lexicon: lexical.Lexicon | None = None
    sentences: DataFrame | None = None
    centroids: DataFrame | None = None
    tau: float = C.DOMAIN_TAU


def build_index(passages: DataFrame, embedder: V.Embedder | None = None) -> Index:
    """Chunks of all strategies with vectors, and parents, from passages. Null and blank passages give neither."""
    return Index(V.embed(chunking.build_all(passages, embedder), "text", embedder), chunking.parents(passages), embedder)


def index_of(chunks: DataFrame, embedder: V.Embedder | None = None) -> Index:
    """An index over chunks that were cut elsewhere. Of several parents of a passage the last by chunk_id counts."""
    return Index(V.embed(chunks.where("strategy <> 'C3P'"), "text", embedder), chunks.where("strategy = 'C3P'").select("chunk_id", "passage_id", "text"), embedder)


def sentence_vectors(parents: DataFrame, embedder: V.Embedder | None = None) -> DataFrame:
    """``passage_id, sent, svec``: the vector of every distinct sentence of a passage."""
    s = parents.select("passage_id", F.explode(X.sentences(F.col("text"))).alias("sent")).distinct()
    return V.embed(s, "sent", embedder, "svec")


def upsert(index: Index, chunks: DataFrame) -> Index:
    """The index with ``chunks`` (of columns as cut, parents among them) in place of those that have the same chunk_id; of
    several new ones with one id the greatest text counts. Statistics, centroids and sentences are those of a new index."""
    rest = [c for c in chunks.columns if c != "chunk_id"]
    new = chunks.groupBy("chunk_id").agg(F.max_by(F.struct(*rest), "text").alias("c")).select("chunk_id", "c.*")
    added = index_of(new, index.embedder)
    gone = new.select("chunk_id")
    keep = lambda old, more: old.join(gone, "chunk_id", "left_anti").select(*old.columns).unionByName(more.select(*old.columns))
    return Index(keep(index.chunks, added.chunks), keep(index.parents, added.parents), index.embedder)


def save(index: Index, path: str, tau: float = C.DOMAIN_TAU, steps: int = C.KMEANS_STEPS) -> None:
    """Writes an index with all that searching and answering need: chunks and their vectors, parents, postings, terms,
    sentence vectors, centroids, and what describes them. Nothing is encoded again when it is loaded."""
    embedder = index.embedder
    sinks.save_snapshot({"chunks": index.chunks, "parents": index.parents}, path)
    spark = index.chunks.sparkSession
    chunks, parents = (spark.read.parquet(f"{path}/{k}") for k in ("chunks", "parents"))
    lex = index.lexicon or lexical.lexicon(chunks.select("chunk_id", "text"))
    centroids = index.centroids or domain.fit(chunks.select(F.col("chunk_id").alias("rid"), "vec"), steps=steps)
    sentences = index.sentences or sentence_vectors(parents, embedder)
    dim = chunks.where("vec is not null").select(F.size("vec")).limit(1).collect()
    sinks.save_snapshot({"postings": lex.postings, "terms": lex.terms, "sentences": sentences, "centroids": centroids}, f"{path}/parts", {"n": lex.n, "avgdl": lex.avgdl, "dim": dim[0][0] if dim else 0, "tau": tau})


def load(spark: SparkSession, path: str, embedder: V.Embedder | None = None) -> Index:
    """A saved index."""
    tables, _ = sinks.load_snapshot(spark, path)
    parts, meta = sinks.load_snapshot(spark, f"{path}/parts")
    lex = lexical.Lexicon(parts["postings"], parts["terms"], meta["n"], meta["avgdl"])
    return Index(tables["chunks"], tables["parents"], embedder, lex, parts["sentences"], parts["centroids"], meta["tau"])


def dense_search(queries: DataFrame, index: Index, k: int, strategies: tuple[str, ...] | None = None) -> DataFrame:
    """``qid, chunk_id, dense_score, dense_rank``; a strategy filter applies before the search."""
    chunks = index.chunks if strategies is None else index.chunks.where(F.col("strategy").isin(list(strategies)))
    hits = V.nearest(V.embed(queries, "query", index.embedder), chunks, k, rid="chunk_id")
    w = W.partitionBy("qid").orderBy(F.round("score", 9).desc(), "chunk_id")
    return hits.select("qid", "chunk_id", F.col("score").alias("dense_score"), (F.row_number().over(w) - 1).alias("dense_rank"))


def fuse(dense: DataFrame, lexical_hits: DataFrame | None, k: int = C.RRF_K) -> DataFrame:
    """``qid, chunk_id, fused, dense_score, dense_rank, lexical_rank``: reciprocal rank fusion of two lists of ranks from 0."""
    if lexical_hits is None:
        both = dense.withColumn("lexical_rank", F.lit(None).cast("int"))
    else:
        both = dense.join(lexical_hits.select("qid", "chunk_id", F.col("rank").alias("lexical_rank")), ["qid", "chunk_id"], "full_outer")
    part = lambda r: F.coalesce(1.0 / (k + 1 + F.col(r)), F.lit(0.0))
    return both.withColumn("fused", part("dense_rank") + part("lexical_rank")).withColumn("dense_score", F.coalesce("dense_score", F.lit(0.0)))


def fused_order() -> list[Column]:
    """Best first; ties in the order of the dense list, then of the lexical list."""
    return [F.col("fused").desc(), F.coalesce("dense_rank", NO_RANK + F.col("lexical_rank"))]


def boost(fused: DataFrame, queries: DataFrame, chunks: DataFrame, by: float) -> DataFrame:
    """Adds the chunk's ``passage_id, strategy, lang, parent_id, answers_passage``; hits in the query's language gain."""
    rows = chunks.select("chunk_id", "passage_id", "strategy", "lang", "parent_id", "answers_passage")
    return in_language(fused.join(rows, "chunk_id"), queries, by)


def in_language(hits: DataFrame, queries: DataFrame, by: float) -> DataFrame:
    """Hits in the query's language gain."""
    out = hits.join(queries.select("qid", F.col("lang").alias("qlang")), "qid")
    return out.withColumn("fused", F.when(F.col("qlang") == F.col("lang"), F.col("fused") * (1 + by)).otherwise(F.col("fused"))).drop("qlang")


def first_of_passage(hits: DataFrame, k: int) -> DataFrame:
    """The best hit of every passage, then the ``k`` best of a query with their rank from 1."""
    best = W.partitionBy("qid", "passage_id").orderBy(*fused_order())
    hits = hits.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    return hits.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(*fused_order()))).where(F.col("rank") <= k)


def resolve(hits: DataFrame, parents: DataFrame, few: bool = False) -> DataFrame:
    """A child becomes its parent, a question the parent of the passage that answers it, where there is one; anything else
    stays. ``strategy``, ``lang`` and ranks remain those of the chunk that matched. Of ``few`` hits, written before, only their
    parents are shuffled."""
    p = parents.select(F.col("chunk_id").alias("pid"), F.col("text").alias("ptext"))
    asked = hits.where("strategy = 'C5'").select(F.col("answers_passage").alias("passage_id"))
    if few:
        p, parents = among(p, "pid", hits.where("strategy = 'C3'").select("parent_id")), among(parents, "passage_id", asked)
    by_passage = parents.join(asked, "passage_id", "left_semi").groupBy("passage_id").agg(F.max_by(F.struct("chunk_id", "text"), "chunk_id").alias("q"))
    by_passage = by_passage.select(F.col("passage_id").alias("qp"), F.col("q.chunk_id").alias("qid_"), F.col("q.text").alias("qtext"))
    out = hits.join(p, (F.col("strategy") == "C3") & (F.col("parent_id") == F.col("pid")), "left")
    out = out.join(by_passage, (F.col("strategy") == "C5") & (F.col("answers_passage") == F.col("qp")), "left")
    out = out.withColumn("chunk_id", F.coalesce("pid", "qid_", "chunk_id")).withColumn("text", F.coalesce("ptext", "qtext", "text"))
    return out.drop("pid", "ptext", "qp", "qid_", "qtext")


def retrieve(queries: DataFrame, index: Index, options: RetrieveOptions = RetrieveOptions()) -> DataFrame:
    """``qid, rank, chunk_id, passage_id, text, strategy, lang, score, dense_score, dense_rank, lexical_rank``.

    ``queries`` has ``qid, query, lang``. A query that shares no term and has no vector still gets the dense list in order
    of ids; over an empty index there are no hits. The hits, a few rows a query, are written once, as answering reads them
    several times.
    """
    dense = dense_search(queries, index, options.pool, options.strategies)
    words = lexical.search(queries, index.chunks, options.pool, options.strategies, index.lexicon) if options.use_lexical else None
    # A pool a query, then its best: both are written, and of chunks and parents only what they name is shuffled.
    pool = durable(fuse(dense, words))
    best = durable(first_of_passage(boost(pool, queries, among(index.chunks, "chunk_id", pool.select("chunk_id")), options.lang_boost), options.top_k))
    texts = among(index.chunks.select("chunk_id", "text"), "chunk_id", best.select("chunk_id"))
    hits = resolve(durable(best.join(texts, "chunk_id")), index.parents, few=True)
    return durable(hits.select("qid", "rank", "chunk_id", "passage_id", "text", "strategy", "lang", F.col("fused").alias("score"), "dense_score", "dense_rank", "lexical_rank"))


def contexts(df: DataFrame, texts: str = "texts") -> DataFrame:
    """Hits made of given contexts (``qid``, array of texts): the i-th has the score 1/(i+1); blank ones are left out, but
    keep their place."""
    rows = df.select("qid", F.posexplode(texts).alias("i", "text")).where(F.trim("text") != "")
    return rows.select("qid", (F.col("i") + 1).alias("rank"), F.concat(F.lit("ctx-"), F.col("i").cast("string")).alias("chunk_id"), F.concat(F.lit("ctx-"), F.col("i").cast("string")).alias("passage_id"), "text", F.lit("C1").alias("strategy"), F.lit("en").alias("lang"), (1.0 / (F.col("i") + 1)).alias("score"), (1.0 / (F.col("i") + 1)).alias("dense_score"))
