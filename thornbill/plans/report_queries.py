"""Queries of traces, evaluation, calibration, harvesting and snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thornbill import config as K
from thornbill.functions import text as X
from thornbill.operators import answer, evaluate, retrieval
from thornbill.operators import traces as T
from thornbill.plans import fixed as L
from thornbill.plans import sql as Q
from thornbill.plans.retrieval_queries import _ASK, _EXTRACT, _HITS, _asked, _gated, _index
from thornbill.plans.text_queries import _contentless, _unsafe
from thornbill.sources import corpus, sinks
from thornbill.streaming import traces as streams
from thornbill.tables import durable, ensure_checkpoint_dir, table, written


def trace_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return T.percentiles(corpus.traces(spark, d), "total_ms")


def trace_percentiles_by_group(spark: SparkSession, d: str) -> DataFrame:
    return T.percentiles(corpus.traces(spark, d).withColumn("lang", X.base_lang(F.col("lang"))), "total_ms", ["lang", "path"])


def trace_ring_last_5000(spark: SparkSession, d: str) -> DataFrame:
    return T.last_entries(corpus.traces(spark, d)).select("trace_id", "path", "total_ms")


def recent_history(spark: SparkSession, d: str) -> DataFrame:
    """The eight latest questions that aren't blank."""
    return T.last_entries(corpus.traces(spark, d).where("trim(query) <> ''"), 8).select("trace_id", F.substring("query", 1, 60).alias("query"))


def path_counts(spark: SparkSession, d: str) -> DataFrame:
    return T.path_counts(corpus.traces(spark, d))


def stage_waterfall(spark: SparkSession, d: str) -> DataFrame:
    return T.stage_waterfall(corpus.traces(spark, d))


def bench_counters(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.bench_counters(corpus.traces(spark, d).withColumn("lang", X.base_lang(F.col("lang"))), ["lang"])


def corpus_lang_counts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.passages(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def index_health(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by strategy, and passages with and without a parent."""
    return corpus.chunk_table(spark, d).groupBy("strategy").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("passage_id").alias("passages"))


def recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    q, index = corpus.search_queries(spark, d), _index(spark, d)
    hits = retrieval.retrieve(q, index, K.RetrieveOptions(top_k=10))
    return evaluate.recall_mrr(evaluate.gold_ranks(q, hits))


def gold_hits(spark: SparkSession, d: str) -> DataFrame:
    """Rank of the gold passage among the ten hits of every question, 0 for none."""
    q, index = corpus.search_queries(spark, d), _index(spark, d)
    return evaluate.gold_ranks(q, retrieval.retrieve(q, index, K.RetrieveOptions(top_k=10))).select("qid", F.coalesce("gold_rank", F.lit(0)).alias("gold_rank"))


def ablation_arms(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.ablation(corpus.search_queries(spark, d), _index(spark, d))


def _calibration(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the question pipeline; a question with a gold passage counts as answerable."""
    r, q = _asked(spark, d)
    return r.join(q.select("qid", F.col("gold").isNotNull().alias("answerable")), "qid").select("qid", "answerable", "top_score", F.col("extractive_score").alias("conf"))


def calibration_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return T.quantiles(_calibration(spark, d), "top_score", ["answerable"])


def calibration_sweep(spark: SparkSession, d: str) -> DataFrame:
    c = durable(_calibration(spark, d))
    a = evaluate.sweep(c, "top_score", [0.55, 0.6, 0.65, 0.7, 0.75, 0.8])
    return a.unionByName(evaluate.sweep(c, "conf", [0.3, 0.4, 0.5, 0.6, 0.7]))


def trace_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """The calibration's quantile rule over all traces, by path."""
    return T.quantiles(corpus.traces(spark, d), "total_ms", ["path"])


def trace_sweep(spark: SparkSession, d: str) -> DataFrame:
    """The calibration's threshold sweep over all spoken traces: how the speech floor would split answered and refused ones."""
    t = corpus.traces(spark, d).where("stt_confidence is not null").select((F.col("path") != "refusal").alias("answerable"), "stt_confidence")
    return evaluate.sweep(t, "stt_confidence", [0.3, 0.4, 0.5, 0.55, 0.6, 0.7, 0.8, 0.9])


def corpus_harvest(spark: SparkSession, d: str) -> DataFrame:
    p, _ = corpus.harvest(corpus.source_rows(spark, d))
    return p.select("passage_id", F.md5("text").alias("digest"), "lang", F.coalesce(F.try_element_at("questions", F.lit(1)), F.lit("")).alias("question"))


def harvest_eval_rows(spark: SparkSession, d: str) -> DataFrame:
    _, e = corpus.harvest(corpus.source_rows(spark, d))
    return e


def anti_seen_ids(spark: SparkSession, d: str) -> DataFrame:
    """The first visit of every query_id, languages in order of their tags."""
    e = table(spark, d, "eval_set").select("query_id", "eval_id", "lang", "query")
    return corpus.first_visits(e, "query_id", ["lang", "eval_id"]).select("query_id", "eval_id", "lang")


def _given(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All questions with a gold passage, and that passage as their only context; at odd ids it is the second of two."""
    q = corpus.eval_queries(spark, d)
    p = corpus.passages(spark, d).select(F.col("passage_id").alias("gold"), "text")
    texts = F.when(F.col("qid") % 2 == 0, F.array("text")).otherwise(F.array(F.lit(" "), "text"))
    return q, retrieval.contexts(q.join(p, "gold").select("qid", texts.alias("texts")))


def adapter_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Answers from contexts that come with the question."""
    return answer.extract(*_given(spark, d)).select("qid", "answer", F.round("confidence", 6).alias("confidence"), "passage_id")


def adapter_decision(spark: SparkSession, d: str) -> DataFrame:
    """Which of these answers stand; questions without any context are refused too."""
    return answer.decide(*_given(spark, d)).select("qid", "text", "grounded", F.round("confidence", 6).alias("confidence"), F.round("top_score", 6).alias("top_score"))


def bench_report(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation, out-of-scope and unsafe questions asked in one batch: answered, gold passages hit, refused."""
    return evaluate.bench_report(evaluate.bench_rows(evaluate.bench_questions(corpus.search_queries(spark, d)), _gated(spark, d)))


def best_arm(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.best_arm(ablation_arms(spark, d))


def _folder(spark: SparkSession, name: str) -> str:
    path = f"{ensure_checkpoint_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    written(spark, path)
    return path


def json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Passages written as JSON and read again."""
    path = _folder(spark, "json")
    sinks.write_json(corpus.passages(spark, d), path)
    return corpus.read_corpus_json(spark, path).select("passage_id", F.md5("text").alias("digest"), "lang", F.size("questions").alias("n_questions"))


def eval_json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation rows written as JSON and read again, with those of a file that isn't there."""
    path = _folder(spark, "eval")
    sinks.write_json(table(spark, d, "eval_set").select("query_id", "query", "lang", "gold_passage_id", "gold_answer"), path)
    e = corpus.read_eval_json(spark, path).unionByName(corpus.read_eval_json(spark, f"{path}-none"))
    return e.groupBy("query_id", "lang").agg(F.count(F.lit(1)).alias("n"), F.count("gold_answer").alias("answers"), F.max(F.md5("query")).alias("digest"))


def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Latencies of all traces written as CSV and read again, by path."""
    path = _folder(spark, "csv")
    sinks.write_csv(corpus.traces(spark, d).select("path", F.round("total_ms", 3).alias("ms")), path)
    t = spark.read.option("header", True).schema("path string, ms double").csv(path)
    return t.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("ms"), 2).alias("ms"))


def score_log(spark: SparkSession, d: str) -> DataFrame:
    """Scores appended to a log twice and read again: lines by confidence."""
    path = _folder(spark, "log")
    pairs = table(spark, d, "eval_set").where("query is not null and gold_answer is not null")
    rows = pairs.select(F.col("gold_answer").alias("text"), X.overlap(X.tokens(F.col("query")), F.col("gold_answer")).alias("confidence"))
    sinks.append_scores(rows, path)
    sinks.append_scores(rows, path)
    return spark.read.schema("text string, confidence double").json(path).groupBy("confidence").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def language_files(spark: SparkSession, d: str) -> DataFrame:
    """A file for each of three languages."""
    found = corpus.locate_languages(table(spark, d, "passages"), ["en", "hi", "ta"], "lang")
    return found.select("lang", F.col("file").endswith(".parquet").alias("found"))


def column_scan(spark: SparkSession, d: str) -> DataFrame:
    """The first 256 rows of two columns: only these are read."""
    return corpus.sample(spark, f"{d}/passages.parquet", ["passage_id", "lang"], 256).agg(F.count(F.lit(1)).alias("n"))


def stream_trace_windows(spark: SparkSession, d: str) -> DataFrame:
    return streams.replay(spark, d)


_T = "t as (select trace_id, r.* from (select trace_id, min_by(struct_pack(query := query, lang := lang, stt_confidence := stt_confidence, timings := timings, total_ms := total_ms, budget_ms := budget_ms, path := path, refused := refused, asked_at := asked_at), (logged_at, asked_at)) r from traces group by trace_id))"
_P = lambda p: f"round(list_sort(list(total_ms))[round_even({p}::double * (count(*) - 1), 0)::int + 1], 6) p{round(p * 100)}"
_PCT = ", ".join(_P(p) for p in L.PERCENTILES) + ", count(*) n, round_even(avg(total_ms), 2) mean"
_QU = lambda v: f"count(*) n, round(list_sort(list({v}))[1], 6) min_value, round(list_sort(list({v}))[count(*) // 10 + 1], 6) p10_value, round(list_sort(list({v}))[count(*) // 2 + 1], 6) p50_value, round(list_sort(list({v}))[floor(count(*) * 0.9::double)::int + 1], 6) p90_value, round(list_sort(list({v}))[-1], 6) max_value"
_SRC = f"""{Q.P}, a as (select split_part(passage_id, '-', 1)::bigint query_id, split_part(passage_id, '-', 2) tag, case when split_part(passage_id, '-', 3) = 'g' then 1 else 0 end sel, text from p where regexp_matches(passage_id, '^[0-9]+-[a-z]+-[gd]$')),
e as (select query_id, min_by(query, eval_id) query, min_by(struct_pack(a := gold_answer), eval_id).a answer from eval_set group by query_id),
g as (select query_id, tag, min(text) filter (where sel = 1) gt, min(text) filter (where sel = 0) dt from a group by all having count(*) filter (where sel = 1) > 0),
h as (select g.*, e.query, e.answer, coalesce(query_id % 2 = 0 and coalesce(e.answer, '') <> '' and e.query is not null, false) held from g left join e using (query_id))"""
_GOLD = "with " + Q.RETRIEVE + ", gr as (select q.qid, min(rank) filter (where re.passage_id = q.gold and rank <= 10) r from q left join re using (qid) group by q.qid)"
_SCORED = f"{_HITS}, {_EXTRACT}, tp as (select qid, round(max(ds), 9) top from hits group by qid), cal as (select q.qid, q.gold is not null answerable, case when {_unsafe('q.query')} or {_contentless('q.query')} then 0.0 else coalesce(tp.top, 0.0) end top_score, coalesce(an.confidence, 0.0) conf from q left join tp using (qid) left join an using (qid))"


def _sweep(rel: str, signal: str, taus: list[float]) -> str:
    return f"select '{signal}' signal, tau, round(avg(case when not answerable then ({signal} >= tau)::int::double end), 6) false_confidence, round(avg(case when answerable then ({signal} < tau)::int::double end), 6) false_refusal from {rel}, (select unnest({taus}::double[]) tau) group by tau"


def _arm(name: str, strategies: list[str] | None, lexical: bool) -> str:
    only = "true" if strategies is None else "strategy in (" + ", ".join(f"'{s}'" for s in strategies) + ")"
    lex = f"(select qid, chunk_id, s, row_number() over (partition by qid order by round(s, 9) desc, chunk_id) - 1 rl from w6 where {only} {'and r0 < 40' if strategies is None else ''} qualify rl < 40)"
    if not lexical:
        lex = "(select qid, chunk_id, s, 0::bigint rl from w6 where false)"
    return f"""select '{name}' arm, count(*) n, round(avg(case when r <= 5 then 1.0::double else 0.0 end), 6) recall_at_5, round(avg(case when r <= 10 then 1.0::double / r else 0.0 end), 6) mrr_at_10 from (
select q0.qid, min(rank) filter (where z.passage_id = q0.gold and rank <= 10) r from q q0 left join (
 select *, row_number() over (partition by qid order by f desc, o) rank from (
  select fz.qid, i.passage_id, case when i.lang = q.lang then f * (1 + 0.15::double) else f end f, coalesce(dr, 1000000 + lr) o, row_number() over (partition by fz.qid, i.passage_id order by case when i.lang = q.lang then f * (1 + 0.15::double) else f end desc, coalesce(dr, 1000000 + lr)) n
  from (select qid, chunk_id, a.r dr, b.rl lr, coalesce(1.0::double / (61 + a.r), 0.0) + coalesce(1.0::double / (61 + b.rl), 0.0) f
   from (select qid, chunk_id, row_number() over (partition by qid order by round(s, 9) desc, chunk_id) - 1 r from sims where {only} qualify r < 40) a full join {lex} b using (qid, chunk_id)) fz join i using (chunk_id) join q on q.qid = fz.qid qualify n = 1)) z on z.qid = q0.qid group by q0.qid)"""


_ADAPTER = f"with {Q.P}, {Q.Q.replace('eval_id % 20 = 0 and ', '')}, hits as (select q.qid, case when q.qid % 2 = 0 then 1 else 2 end as rank, case when q.qid % 2 = 0 then 'ctx-0' else 'ctx-1' end passage_id, p.text from q join p on p.passage_id = q.gold), {Q.hashed('qv', 'q', 'qid', 'query')}, {_EXTRACT}"
_FIXED = ", ".join(f"({-1 - i}, '{q.replace(chr(39), chr(39) * 2)}', '{lang}', null)" for i, (q, lang) in enumerate(zip([*L.OUT_OF_SCOPE, *L.UNSAFE_QUESTIONS], ["en", "hi", "en", "en", "en", "hi", "en", "ta", "en", "en", "en", "en"])))
_BENCH = _ASK.replace(Q.Q, Q.Q[:-1] + f" union all select * from (values {_FIXED}) f(qid, query, lang, gold))")
ORACLES = {
    "trace_percentiles": f"with {_T} select {_PCT} from t where total_ms is not null having count(*) > 0",
    "trace_percentiles_by_group": f"with {_T} select {Q.lang('lang')} lang, path, {_PCT} from t where total_ms is not null group by 1, 2",
    "trace_ring_last_5000": f"with {_T} select trace_id, path, total_ms from t where asked_at is not null order by asked_at desc, trace_id desc limit 5000",
    "recent_history": f"with {_T} select trace_id, substr(query, 1, 60) query from t where trim(query) <> '' and asked_at is not null order by asked_at desc, trace_id desc limit 8",
    "path_counts": f"with {_T} select path, count(*) n, count(refused) refused from t group by path",
    "stage_waterfall": f"with {_T}, s as (select budget_ms, unnest(timings) x from t where budget_ms > 0) select x.stage stage, count(*) n, round(avg(x.ms), 3) mean_ms, round(avg(least(100.0::double, greatest(1.5::double, x.ms / budget_ms * 100))), 3) mean_width from s where x.stage is not null and x.ms is not null group by 1",
    "bench_counters": f"with {_T} select {Q.lang('lang')} lang, count(*) n, count(*) filter (where path <> 'refusal') answered, count(*) filter (where path = 'refusal') refused, round(avg((path <> 'refusal')::int::double), 6) answered_share, round(avg(total_ms), 4) mean_ms, count(*) filter (where total_ms >= 200) over_budget, case when coalesce(max(total_ms), 0) < 200 then 'PASS' else 'FAIL' end verdict from t group by 1",
    "corpus_lang_counts": f"with {Q.P} select lang, count(*) n from p group by lang",
    "index_health": f"with {Q.C} select strategy, count(*) chunks, count(distinct passage_id) passages from c group by strategy",
    "recall_mrr": f"{_GOLD} select count(*) n, round(avg(case when r <= 5 then 1.0::double else 0.0 end), 6) recall_at_5, round(avg(case when r <= 10 then 1.0::double / r else 0.0 end), 6) mrr_at_10 from gr",
    "gold_hits": f"{_GOLD} select qid, coalesce(r, 0) gold_rank from gr",
    "ablation_arms": f"with {Q.C}, {Q.Q}, {Q.DENSE}, {Q.BM25}, w6 as (select qid, chunk_id, s, i.strategy, row_number() over (partition by qid order by round(s, 9) desc, chunk_id) - 1 r0 from bm join i using (chunk_id) qualify r0 < 240) " + " union all ".join(_arm(*a) for a in L.ARMS),
    "calibration_quantiles": f"{_SCORED} select answerable, {_QU('top_score')} from cal group by answerable",
    "calibration_sweep": f"{_SCORED} {_sweep('cal', 'top_score', [0.55, 0.6, 0.65, 0.7, 0.75, 0.8])} union all {_sweep('cal', 'conf', [0.3, 0.4, 0.5, 0.6, 0.7])}",
    "trace_quantiles": f"with {_T} select path, {_QU('total_ms')} from t where total_ms is not null group by path",
    "trace_sweep": f"with {_T}, k as (select path <> 'refusal' answerable, stt_confidence from t where stt_confidence is not null) {_sweep('k', 'stt_confidence', [0.3, 0.4, 0.5, 0.55, 0.6, 0.7, 0.8, 0.9])}",
    "corpus_harvest": f"with {_SRC} select query_id || '-' || tag || '-g' passage_id, md5(gt) digest, tag lang, case when held or query is null then '' else query end question from h union all select query_id || '-' || tag || '-d', md5(dt), tag, '' from h where dt is not null",
    "harvest_eval_rows": f"with {_SRC} select query_id, query, tag lang, query_id || '-' || tag || '-g' gold_passage_id, answer gold_answer from h where held",
    "anti_seen_ids": "select query_id, min_by(eval_id, (lang, eval_id)) eval_id, min(lang) lang from eval_set group by query_id",
    "adapter_contexts": f"{_ADAPTER} select qid, answer, round(confidence, 6) confidence, passage_id from an",
    "adapter_decision": f"{_ADAPTER} select qid, case when g then answer else '{L.ADAPTER_REFUSAL.replace(chr(39), chr(39) * 2)}' end as text, g grounded, round(coalesce(confidence, 0.0), 6) confidence, round(coalesce(top, 0.0), 6) top_score from (select q.qid, answer, confidence, top, coalesce(answer <> '' and top >= 0.7::double and confidence >= 0.7::double, false) g from q left join an using (qid) left join (select qid, 1.0::double / max(rank) top from hits group by qid) using (qid))",
    "bench_report": f"""{_BENCH} select kind, case when kind = 'eval' then lang else '' end lang, count(*) n, count(*) filter (where refused is null) answered, count(*) filter (where hit) gold_hits, count(*) filter (where refused is not null) refused
from (select case when st2.qid >= 0 then 'eval' when st2.qid > -11 then 'oos' else 'unsafe' end kind, st2.lang, refused, refused is null and coalesce(st2.passage_id = q.gold or exists (select 1 from hits h where h.qid = st2.qid and h.passage_id = q.gold), false) hit from st2 join q on q.qid = st2.qid) group by 1, 2""",
    "best_arm": f"with {Q.C}, {Q.Q}, {Q.DENSE}, {Q.BM25}, w6 as (select qid, chunk_id, s, i.strategy, row_number() over (partition by qid order by round(s, 9) desc, chunk_id) - 1 r0 from bm join i using (chunk_id) qualify r0 < 240), arms as (" + " union all ".join(_arm(*a) for a in L.ARMS) + f"), o as (select *, list_position({[a[0] for a in L.ARMS]}, arm) place from arms) select min_by(arm, (-recall_at_5, place)) arm, round((max(recall_at_5) - max(recall_at_5) filter (where place = 1)) / greatest(max(recall_at_5) filter (where place = 1), 1e-9::double), 6) lift from o",
    "json_roundtrip": f"with {Q.P} select passage_id, md5(text) digest, lang, len(questions)::int n_questions from p",
    "eval_json_roundtrip": "select query_id, lang, count(*) n, count(gold_answer) answers, max(md5(query)) digest from eval_set group by query_id, lang",
    "csv_roundtrip": f"with {_T} select path, count(*) n, round(sum(round(total_ms, 3)), 2) ms from t group by path",
    "score_log": f"select confidence, 2 * count(*) n, (2 * sum(chars))::bigint chars from (select round_even({Q.overlap(Q.toks('query'), 'gold_answer')}, 4) confidence, length(substr(gold_answer, 1, 80)) chars from eval_set where query is not null and gold_answer is not null) group by confidence",
    "language_files": "select unnest(['en', 'hi', 'ta']) lang, true found",
    "column_scan": "select least(256, count(*)) n from passages",
    "stream_trace_windows": "with a as (select time_bucket(interval 1 day, asked_at) start, path, total_ms from (select trace_id, min(asked_at) asked_at, min(path) path, min(total_ms) total_ms from traces group by trace_id) where asked_at is not null) select start as window_start, path, count(*) n, round(sum(coalesce(total_ms, 0)), 3) total from a group by all",
}
QUERIES = {k: globals()[k] for k in ORACLES}
