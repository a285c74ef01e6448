"""Measuring retrieval and answering: recall, MRR, ablation arms, counters, calibration."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thornbill import config as C
from thornbill.functions import vectors as V
from thornbill.operators import answer, lexical, retrieval
from thornbill.operators import traces as T
from thornbill.operators.retrieval import Index
from thornbill.tables import among, durable


def gold_ranks(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """``qid, gold_rank``: the first rank (from 1) at which the gold passage was found, null for never."""
    found = queries.join(hits.select("qid", F.col("passage_id").alias("gold"), "rank"), ["qid", "gold"]).groupBy("qid").agg(F.min("rank").alias("gold_rank"))
    return queries.select("qid").join(found, "qid", "left")


def recall_mrr(ranks: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """``n, recall_at_5, mrr_at_10`` over all queries, those without a hit included."""
    r = F.col("gold_rank")
    return ranks.groupBy(*(groups or [])).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce((r <= 5).cast("double"), F.lit(0.0))), 6).alias("recall_at_5"), F.round(F.avg(F.coalesce(F.when(r <= 10, 1.0 / r), F.lit(0.0))), 6).alias("mrr_at_10"))


def ablation(queries: DataFrame, index: Index, arms: list = C.ARMS, top_k: int = 10, pool: int = C.POOL, timed: bool = False) -> DataFrame:
    """``arm, n, recall_at_5, mrr_at_10`` of every arm, and, where ``timed``, ``p50_ms``: the arm's part of the batch, for one
    query, by the driver's clock.

    The dense search keeps the best of every strategy once, of which each arm's list is a part, and the lexical search its
    longest list once; an arm only filters and ranks these again.
    """
    q = V.embed(queries, "query", index.embedder)
    near = durable(V.nearest(q, index.chunks, pool, rid="chunk_id", by="strategy"))
    # Each hit gets its columns once; an arm then needs no chunks. A lexical list is longer only for arms that filter it.
    rows = index.chunks.select("chunk_id", "passage_id", "lang", "parent_id", "answers_passage")
    dense = durable(near.join(among(rows, "chunk_id", near.select("chunk_id")), "chunk_id"))
    words = None
    if any(use for _, _, use in arms):
        words = durable(lexical.best(queries, index.lexicon or index.chunks, pool * (C.LEXICAL_OVERFETCH if any(use and only is not None for _, only, use in arms) else 1)))
        named = among(index.chunks.drop("text", "vec"), "chunk_id", words.select("chunk_id"))
        words = durable(words.join(named.select("chunk_id", "strategy"), "chunk_id"))
    out = None
    for name, strategies, use_lexical in arms:
        d = dense if strategies is None else dense.where(F.col("strategy").isin(strategies))
        w = W.partitionBy("qid").orderBy(F.round("score", 9).desc(), "chunk_id")
        d = d.withColumn("dense_rank", F.row_number().over(w) - 1).where(F.col("dense_rank") < pool).withColumnRenamed("score", "dense_score")
        lex = None
        if use_lexical:
            lex = lexical.top((words.where(F.col("rank") < pool) if strategies is None else words.where(F.col("strategy").isin(strategies))).drop("rank", "strategy"), pool)
        if lex is None:
            hits = retrieval.in_language(retrieval.fuse(d, None), queries, C.LANG_BOOST)
        else:
            pool_ = durable(retrieval.fuse(d.select("qid", "chunk_id", "dense_score", "dense_rank"), lex))
            hits = retrieval.boost(pool_, queries, among(index.chunks, "chunk_id", pool_.select("chunk_id")), C.LANG_BOOST)
        hits = retrieval.first_of_passage(hits, top_k)
        one = recall_mrr(gold_ranks(queries, hits).withColumn("arm", F.lit(name)), ["arm"])
        if timed:
            began = time.perf_counter()
            one = durable(one)
            one = one.withColumn("p50_ms", F.round(F.lit((time.perf_counter() - began) * 1000) / F.greatest("n", F.lit(1)), 3))
        out = one if out is None else out.unionByName(one)
    return out


def best_arm(arms: DataFrame, order: list = C.ARMS) -> DataFrame:
    """``arm, lift``: the arm of highest recall, on ties the first of ``order``, and its lift over the first arm of all."""
    place = F.array_position(F.array(*(F.lit(a[0]) for a in order)), F.col("arm"))
    base = F.coalesce(F.max(F.when(place == 1, F.col("recall_at_5"))), F.lit(0.0))
    return arms.agg(F.min_by("arm", F.struct(-F.col("recall_at_5"), place)).alias("arm"), F.round((F.max("recall_at_5") - base) / F.greatest(base, F.lit(1e-9)), 6).alias("lift"))


def bench_questions(evals: DataFrame, limit: int | None = None) -> DataFrame:
    """``qid, kind, query, lang, gold``: evaluation questions (the first ``limit`` by id, where given), and the fixed ones that are
    out of scope or unsafe, whose ids are negative."""
    e = evals.select("qid", F.lit("eval").alias("kind"), "query", "lang", "gold")
    e = e if limit is None else e.orderBy("qid").limit(limit)
    fixed = [(-1 - i, kind, q, None, None) for i, (kind, q) in enumerate([("oos", q) for q in C.OUT_OF_SCOPE] + [("unsafe", q) for q in C.UNSAFE_QUESTIONS])]
    return e.unionByName(evals.sparkSession.createDataFrame(fixed, "qid long, kind string, query string, lang string, gold string"))


def bench_rows(questions: DataFrame, index: Index) -> DataFrame:
    """``kind, lang, query, path, refused, budget_ms, gold_hit`` of every question, asked in one batch. The gold passage is hit
    if an answer cites it or it is among the hits; null where there is no gold or no answer."""
    asks = questions.select("qid", "query", "lang", F.lit(None).cast("double").alias("stt_confidence"), F.lit(None).cast("string").alias("force_path"))
    responses, hits, traces = answer.ask_traced(asks, index)
    found = hits.select("qid", F.col("passage_id").alias("gold")).distinct().withColumn("found", F.lit(True))
    r = responses.select("qid", "path", "refused", "passage_id").join(questions.select("qid", "kind", F.coalesce("lang", F.lit("")).alias("lang"), F.substring("query", 1, 60).alias("query"), "gold"), "qid")
    r = r.join(found, ["qid", "gold"], "left").join(traces.select("qid", "budget_ms"), "qid")
    hit = F.when((F.col("path") != "refusal") & F.col("gold").isNotNull(), F.coalesce("found", F.lit(False)) | F.coalesce(F.col("passage_id") == F.col("gold"), F.lit(False)))
    return r.select("kind", "lang", "query", "path", "refused", "budget_ms", hit.alias("gold_hit"))


def bench_report(rows: DataFrame) -> DataFrame:
    """``kind, lang, n, answered, gold_hits, refused`` of bench rows; languages apart for evaluation questions only."""
    lang = F.when(F.col("kind") == "eval", F.col("lang")).otherwise("").alias("lang")
    return rows.groupBy("kind", lang).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("path") != "refusal").alias("answered"), F.count_if(F.coalesce("gold_hit", F.lit(False))).alias("gold_hits"), F.count_if(F.col("path") == "refusal").alias("refused"))


def bench_markdown(rows: DataFrame) -> str:
    """The bench report as Markdown: latency of all questions and of each language, quality, and refusals by kind."""
    rows = durable(rows)
    whole, by_lang = T.percentiles(rows, "budget_ms").collect(), T.percentiles(rows.where("kind = 'eval'"), "budget_ms", ["lang"]).orderBy("lang").collect()
    line = lambda r: f"P50 {r.p50:.1f} · P70 {r.p70:.1f} · P90 {r.p90:.1f} · P95 {r.p95:.1f} · P100 {r.p100:.1f} ms (n={r.n})"
    sums = {r.kind: r for r in bench_report(rows).groupBy("kind").agg(*(F.sum(c).alias(c) for c in ("n", "answered", "gold_hits", "refused"))).collect()}
    get = lambda kind, c: sums[kind][c] if kind in sums else 0
    verdict = "PASS" if all(r.p100 < C.BUDGET_MS for r in whole) else "FAIL"
    out = ["# Bench report", "", "## Latency", "", *(f"- All: {line(r)}" for r in whole), *(f"- {r.lang}: {line(r)}" for r in by_lang), "", "## Quality", ""]
    out += [f"- Answered: {get('eval', 'answered')}/{get('eval', 'n')}", f"- Gold passage cited or found: {get('eval', 'gold_hits')}/{get('eval', 'answered')}", "", "## Refusals", ""]
    out += [f"- Out of scope: {get('oos', 'refused')}/{get('oos', 'n')}", f"- Unsafe: {get('unsafe', 'refused')}/{get('unsafe', 'n')}", "", *(f"- Mean {r.mean:.1f} ms, under {C.BUDGET_MS:.0f} ms at P100: {verdict}" for r in whole)]
    return "\n".join(out) + "\n"


def ablation_markdown(arms: DataFrame, order: list = C.ARMS) -> str:
    """The ablation as Markdown: arms in order, the best in bold, and its lift over the first. ``p50_ms`` is shown if given."""
    rows = {r.arm: r for r in arms.collect()}  # a row an arm
    top = best_arm(arms, order).first()
    cell = lambda r: f"{r.p50_ms:.1f} ms" if "p50_ms" in r.asDict() else ""
    bold = lambda r: f"**{r.recall_at_5:.3f}**" if r.arm == top.arm else f"{r.recall_at_5:.3f}"
    lines = [f"| {r.arm} | {bold(r)} | {r.mrr_at_10:.3f} | {cell(r)} |" for a in order if (r := rows.get(a[0]))]
    return "\n".join(["# Chunking ablation", "", "| Arm | Recall@5 | MRR@10 | p50 |", "|---|---|---|---|", *lines, "", f"Recall@5 of the best arm over the first: {100 * top.lift:+.0f} %"]) + "\n"


def bench_counters(rows: DataFrame, groups: list[str]) -> DataFrame:
    """``groups, n, answered, refused, answered_share, mean_ms, over_budget, verdict`` of trace-like rows."""
    slow = F.coalesce(F.max("total_ms"), F.lit(0.0))
    return rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("path") != "refusal").alias("answered"), F.count_if(F.col("path") == "refusal").alias("refused"), F.round(F.avg((F.col("path") != "refusal").cast("double")), 6).alias("answered_share"),
        F.round(F.avg("total_ms"), 4).alias("mean_ms"), F.count_if(F.col("total_ms") >= C.BUDGET_MS).alias("over_budget"), F.when(slow < C.BUDGET_MS, "PASS").otherwise("FAIL").alias("verdict"),
    )


def sweep(calib: DataFrame, signal: str, taus: list[float]) -> DataFrame:
    """``signal, tau, false_confidence, false_refusal``: shares of unanswerable rows at or above, and of answerable rows below
    each threshold, null where there are no such rows. One pass: the thresholds are an array in every row."""
    t = calib.select("answerable", F.col(signal).alias("s"), F.explode(F.array(*(F.lit(float(x)) for x in taus))).alias("tau"))
    share = lambda of, hit: F.round(F.avg(F.when(of, hit.cast("double"))), 6)
    yes: Column = F.col("answerable")
    return t.groupBy("tau").agg(share(~yes, F.col("s") >= F.col("tau")).alias("false_confidence"), share(yes, F.col("s") < F.col("tau")).alias("false_refusal")).withColumn("signal", F.lit(signal))
