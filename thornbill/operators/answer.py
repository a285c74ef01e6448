"""Extractive answers, grounding of generated ones, and the whole question pipeline as a batch."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thornbill import config as C
from thornbill.config import Floors, RetrieveOptions
from thornbill.functions import text as X
from thornbill.functions import vectors as V
from thornbill.operators import domain
from thornbill.operators.retrieval import Index, retrieve
from thornbill.tables import durable


def candidates(hits: DataFrame, most: int = C.MAX_CANDIDATES) -> DataFrame:
    """``qid, idx, sent, passage_id, hit_rank``: the first ``most`` sentences of 3 to 80 words, in order of hits and places."""
    s = hits.select("qid", F.col("rank").alias("hit_rank"), "passage_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sent"))
    s = s.where(F.size(X.words(F.col("sent"))).between(C.MIN_WORDS, C.MAX_WORDS))
    s = s.withColumn("idx", F.row_number().over(W.partitionBy("qid").orderBy("hit_rank", "pos")) - 1)
    return s.where(F.col("idx") < most).drop("pos")


def with_vectors(candidates: DataFrame, embedder: V.Embedder | None = None, known: DataFrame | None = None) -> DataFrame:
    """Candidates with the vector of their sentence in ``svec``: the known one of the same passage and text, and only where
    there is none a new one."""
    if known is None:
        return V.embed(candidates, "sent", embedder, "svec")
    found = candidates.join(known, ["passage_id", "sent"], "left").select(*candidates.columns, "svec")
    return found.where("svec is not null").unionByName(V.embed(found.where("svec is null").drop("svec"), "sent", embedder, "svec"))


def extract(queries: DataFrame, hits: DataFrame, embedder: V.Embedder | None = None, known: DataFrame | None = None) -> DataFrame:
    """``qid, answer, confidence, passage_id, excerpt``: the best sentence by cosine, overlap and intent, with at most one more
    of its passage that scores nearly as well, in their order in the text. Ties go to the later candidate. Queries without
    any candidate have no row. Vectors of sentences that are ``known`` (``passage_id, sent, svec``) aren't made again."""
    c = with_vectors(candidates(hits), embedder, known)
    q = V.embed(queries.select("qid", "query"), "query", embedder, "qvec").withColumn("qtokens", X.tokens(F.col("query")))
    score = 0.70 * V.cosine(F.col("qvec"), F.col("svec")) + 0.30 * X.overlap(F.col("qtokens"), F.col("sent")) + X.intent_bonus(F.col("query"), F.col("sent"))
    s = c.join(q, "qid").select("qid", "idx", "sent", "passage_id", "hit_rank", F.round(score, 9).alias("score"))
    order = W.partitionBy("qid").orderBy(F.col("score").desc(), F.col("idx").desc())
    s = s.withColumn("n", F.row_number().over(order)).withColumn("best", F.first("score").over(order)).withColumn("best_passage", F.first("passage_id").over(order)).withColumn("best_hit", F.first("hit_rank").over(order))
    s = s.where((F.col("n") == 1) | (F.col("passage_id") == F.col("best_passage")) & (F.col("score") > F.round(F.col("best") * C.SECOND_SENTENCE, 9)))
    s = s.withColumn("m", F.row_number().over(order)).where(F.col("m") <= C.MAX_SENTENCES)
    a = s.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "sent"))), lambda x: x["sent"]), " ").alias("answer"), F.first("best").alias("confidence"), F.first("best_passage").alias("passage_id"), F.first("best_hit").alias("best_hit"))
    texts = hits.select("qid", F.col("rank").alias("best_hit"), F.substring("text", 1, C.EXCERPT).alias("excerpt"))
    return a.join(texts, ["qid", "best_hit"]).select("qid", "answer", "confidence", "passage_id", "excerpt")


def grounded(answers: DataFrame, contexts: DataFrame, embedder: V.Embedder | None = None, floor: float = C.GROUNDED_FLOOR) -> DataFrame:
    """``qid, kept, dropped, text, accepted``: the answer's sentences that some context supports.

    ``answers`` has ``qid, answer``, ``contexts`` ``qid, text``. An answer is accepted if any sentence is kept and no more
    are dropped than kept. Without contexts all sentences are dropped; a blank answer has no row.
    """
    s = V.embed(answers.select("qid", F.posexplode(X.sentences(F.col("answer"))).alias("pos", "sent")), "sent", embedder, "svec")
    c = V.embed(contexts.select("qid", "text"), "text", embedder, "cvec").select("qid", "cvec")
    best = s.join(c, "qid", "left").groupBy("qid", "pos", "sent").agg(F.round(F.max(V.cosine(F.col("svec"), F.col("cvec"))), 9).alias("best"))
    keep = F.col("best") >= floor
    kept = F.transform(F.sort_array(F.collect_list(F.when(keep, F.struct("pos", "sent")))), lambda x: x["sent"])
    g = best.groupBy("qid").agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped"), F.array_join(kept, " ").alias("text"))
    return g.withColumn("accepted", (F.col("kept") > 0) & (F.col("dropped") <= F.col("kept")))


def ask(asks: DataFrame, index: Index, centroids: DataFrame | None = None, options: RetrieveOptions = RetrieveOptions(), floors: Floors = Floors()) -> tuple[DataFrame, DataFrame]:
    """``(responses, hits)`` of a batch of questions (``qid, query, lang, stt_confidence, force_path``).

    Gates come in order: speech confidence, unsafe, contentless, off topic, retrieval floor, extractive floor or synthesis.
    Later stages see only questions that are still open. A response has ``path`` (extractive or refusal), ``refused`` (the
    reason), ``answer``, ``confidence``, ``passage_id`` and ``escalate`` (refused for its answer, though there were hits).
    Without a language the query's own is detected. Centroids not given are those of the index, if it has any.
    """
    centroids = index.centroids if centroids is None else centroids
    q = asks.withColumn("lang", F.coalesce("lang", X.detect_lang(F.col("query")))).withColumn("guard", X.check_input(F.col("query"), F.col("stt_confidence"), floors.stt))
    open_ = q.where("guard is null")
    if centroids is not None:
        off = domain.off_topic(V.embed(open_.select("qid", "query"), "query", index.embedder), centroids, floors.domain).where("off_topic").select("qid", F.lit(True).alias("off"))
        q = q.join(off, "qid", "left")
        open_ = q.where("guard is null and off is null")
    else:
        q = q.withColumn("off", F.lit(None).cast("boolean"))
    hits = retrieve(open_, index, options)
    top = hits.groupBy("qid").agg(F.round(F.max("dense_score"), 9).alias("top_score"))
    r = q.join(top, "qid", "left").join(extract(open_, hits, index.embedder, index.sentences), "qid", "left")
    weak = F.coalesce(F.col("top_score") < floors.retrieval, F.lit(True))
    forced = F.coalesce(F.col("force_path") == "generative", F.lit(False))
    synthesis = F.col("force_path").isNull() & X.needs_synthesis(F.col("query"), F.coalesce("confidence", F.lit(0.0)))
    poor = (F.coalesce("answer", F.lit("")) == "") | (F.coalesce("confidence", F.lit(0.0)) < floors.extractive) | forced | synthesis
    reason = F.coalesce(F.col("guard"), F.when(F.col("off"), "off_topic"), F.when(weak | poor, "no_grounding"))
    said = F.coalesce(*(F.when(reason == k, F.lit(v)) for k, v in C.REFUSAL_TEXT.items()))
    answered = reason.isNull()
    out = r.select(
        "qid", F.when(answered, "extractive").otherwise("refusal").alias("path"), reason.alias("refused"), F.when(answered, F.col("answer")).otherwise(said).alias("answer"),
        F.when(answered, F.col("confidence")).otherwise(0.0).alias("confidence"), F.when(answered, F.col("passage_id")).alias("passage_id"), "lang",
        (F.col("guard").isNull() & F.col("off").isNull() & ~weak & poor).alias("escalate"), F.coalesce("top_score", F.lit(0.0)).alias("top_score"), F.coalesce(F.col("confidence"), F.lit(0.0)).alias("extractive_score"),
    )
    return out, hits


# The stages of the pipeline in order; each refusal ends after one of them.
STAGES = ["guard_input", "lang_detect", "embed", "guard_domain", "retrieve", "extract"]


def ask_traced(asks: DataFrame, index: Index, options: RetrieveOptions = RetrieveOptions(), floors: Floors = Floors()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(responses, hits, traces)``: like :func:`ask`, with a trace for every question: ``qid, trace_id`` (12 random hexadecimal
    digits), ``query, lang, stt_confidence, timings`` (array of ``stage, ms``), ``total_ms, budget_ms, path, refused, asked_at``.

    A batch is measured, not a question: the time of a stage is the batch's by the driver's monotonic clock, shared out among
    the questions that came to it. The first three stages and the gate run in one pass, the time of which each has a quarter of.
    """
    began = time.perf_counter()
    first = durable(asks.select("qid", X.check_input(F.col("query"), F.col("stt_confidence"), floors.stt).alias("guard"), F.coalesce("lang", X.detect_lang(F.col("query"))).alias("lang")))
    guards = (time.perf_counter() - began) * 1000
    began = time.perf_counter()
    responses, hits = ask(asks, index, None, options, floors)
    searched = (time.perf_counter() - began) * 1000
    began = time.perf_counter()
    responses = durable(responses)
    answered = (time.perf_counter() - began) * 1000
    n = responses.agg(F.count(F.lit(1)), F.count_if(~F.coalesce(F.col("refused").isin("low_stt_confidence", "unsafe", "contentless", "off_topic"), F.lit(False)))).first()
    took = dict.fromkeys(STAGES[:4], guards / 4 / max(1, n[0])) | {"retrieve": searched / max(1, n[1]), "extract": answered / max(1, n[1])}
    weak = (F.col("refused") == "no_grounding") & (F.coalesce("top_score", F.lit(0.0)) < floors.retrieval)
    last = F.when(F.col("refused").isin("low_stt_confidence", "unsafe", "contentless"), 1).when(F.col("refused") == "off_topic", 4).when(weak, 5).otherwise(6)
    every = F.array(*(F.struct(F.lit(s).alias("stage"), F.lit(round(took[s], 3)).alias("ms")) for s in STAGES))
    t = responses.join(asks.select("qid", "query", "stt_confidence"), "qid").join(first.select("qid", F.col("lang").alias("said")), "qid")
    t = t.withColumn("timings", F.slice(every, F.lit(1), last)).withColumn("total_ms", F.round(F.aggregate("timings", F.lit(0.0), lambda s, x: s + x["ms"]), 3))
    traces = t.select("qid", F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12).alias("trace_id"), "query", F.coalesce("lang", "said").alias("lang"), "stt_confidence", "timings", "total_ms", F.col("total_ms").alias("budget_ms"), "path", "refused", F.current_timestamp().alias("asked_at"))
    return responses, hits, traces


def decide(queries: DataFrame, given: DataFrame, embedder: V.Embedder | None = None, floors: Floors = Floors()) -> DataFrame:
    """``qid, text, grounded, confidence, top_score``: answers from given contexts (hits as :func:`retrieval.contexts` makes
    them). Grounded is what has an answer and reaches both floors; anything else, a question without any context included,
    gets the refusal."""
    top = given.groupBy("qid").agg(F.max("score").alias("top_score"))
    r = queries.select("qid").join(top, "qid", "left").join(extract(queries, given, embedder), "qid", "left")
    grounded = (F.coalesce("answer", F.lit("")) != "") & (F.coalesce("top_score", F.lit(0.0)) >= floors.retrieval) & (F.coalesce("confidence", F.lit(0.0)) >= floors.extractive)
    return r.select("qid", F.when(grounded, F.col("answer")).otherwise(C.ADAPTER_REFUSAL).alias("text"), grounded.alias("grounded"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("top_score", F.lit(0.0)).alias("top_score"))


#: A generator turns prompts (``qid, prompt``) into texts (``qid, text, provider``).
Generator = Callable[[DataFrame], DataFrame]


def escalate(responses: DataFrame, queries: DataFrame, hits: DataFrame, generator: Generator | None = None, embedder: V.Embedder | None = None) -> DataFrame:
    """Responses in which escalated refusals are replaced by grounded, cited, generated answers; without a generator, or
    where its answer fails a check, the refusal stands."""
    if generator is None:
        return responses
    texts = hits.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("texts"))
    asked = responses.where("escalate").select("qid").join(queries.select("qid", "query"), "qid").join(texts, "qid")
    made = generator(asked.select("qid", X.prompt(F.col("query"), F.col("texts")).alias("prompt"))).where(X.cites(F.col("text")))
    good = grounded(made.select("qid", F.col("text").alias("answer")), hits, embedder).where("accepted").select("qid", F.col("text").alias("made"))
    r = responses.join(good, "qid", "left")
    new = F.col("made").isNotNull()
    return r.select("qid", F.when(new, "generative").otherwise(F.col("path")).alias("path"), F.when(~new, F.col("refused")).alias("refused"), F.when(new, F.col("made")).otherwise(F.col("answer")).alias("answer"), F.when(new, C.GENERATIVE_CONFIDENCE).otherwise(F.col("confidence")).alias("confidence"), "passage_id", "lang", (F.col("escalate") & ~new).alias("escalate"), "top_score", "extractive_score")
