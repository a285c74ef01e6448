"""Queries of the text functions and the chunkers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thornbill import config as K
from thornbill.functions import text as X
from thornbill.operators import chunking
from thornbill.plans import fixed as L
from thornbill.plans import sql as Q
from thornbill.sources import corpus
from thornbill.tables import WS, is_blank, table


def sentences_split(spark: SparkSession, d: str) -> DataFrame:
    return chunking.sentence_table(corpus.passages(spark, d)).select("passage_id", "pos", "sent")


def lexical_tokens(spark: SparkSession, d: str) -> DataFrame:
    p = corpus.passages(spark, d).select("passage_id", F.explode(X.tokens(F.col("text"))).alias("term"))
    return p.groupBy("passage_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def chunk_sliding(spark: SparkSession, d: str) -> DataFrame:
    return chunking.sliding(corpus.passages(spark, d)).select("chunk_id", "passage_id", "position", "text")


def chunk_sliding_small(spark: SparkSession, d: str) -> DataFrame:
    """Windows small enough that passages have several."""
    return chunking.sliding(corpus.passages(spark, d), window=24, overlap=6).select("chunk_id", "passage_id", "position", "text")


def chunk_parent_child(spark: SparkSession, d: str) -> DataFrame:
    p = corpus.passages(spark, d)
    return chunking.children(p).unionByName(chunking.parents(p)).select("chunk_id", "passage_id", "strategy", "position", "parent_id", F.col("char_span.start").alias("a"), F.col("char_span.end").alias("b"), "text")


def chunk_question_keys(spark: SparkSession, d: str) -> DataFrame:
    return chunking.questions(corpus.passages(spark, d)).select("chunk_id", "passage_id", "position", "answers_passage", "text")


def chunk_semantic(spark: SparkSession, d: str) -> DataFrame:
    return chunking.semantic(corpus.passages(spark, d)).select("chunk_id", "passage_id", "position", F.col("char_span.start").alias("a"), F.col("char_span.end").alias("b"), "text")


def char_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of the sentences in the raw text, by the running cursor."""
    return chunking.sentence_spans(corpus.passages(spark, d)).select("passage_id", "pos", F.col("start").alias("a"), F.col("end").alias("b"))


def chunk_union_counts(spark: SparkSession, d: str) -> DataFrame:
    return chunking.build_all(corpus.passages(spark, d)).groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def _asks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "traces").select("trace_id", "query", "stt_confidence", "logged_at").groupBy("trace_id").agg(F.min_by(F.struct("query", "stt_confidence"), F.struct("logged_at", "query")).alias("t")).select("trace_id", "t.*")


def guard_input(spark: SparkSession, d: str) -> DataFrame:
    return _asks(spark, d).select("trace_id", X.check_input(F.col("query"), F.col("stt_confidence")).alias("refused"))


def guard_contentless(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "eval_set")
    return e.select("eval_id", X.is_contentless(F.coalesce("gold_answer", F.lit(""))).alias("contentless"))


def guard_unsafe(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.is_unsafe(F.col("text")).alias("unsafe"))


def detect_lang(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.detect_lang(F.col("text")).alias("detected"))


def sanitize_context(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(X.sanitize(F.col("text"))).alias("digest"))


def needs_synthesis(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "traces").where("query is not null").select("query").distinct().select("query", X.needs_synthesis(F.col("query"), F.when(F.length("query") % 3 == 0, 0.1).otherwise(1.0)).alias("synthesis"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_set").where("query is not null and gold_answer is not null")


def intent_bonus(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("eval_id", X.intent_bonus(F.col("query"), F.col("gold_answer")).alias("bonus"))


def lexical_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("eval_id", F.round(X.overlap(X.tokens(F.col("query")), F.col("gold_answer")), 6).alias("overlap"))


def sentence_length_filter(spark: SparkSession, d: str) -> DataFrame:
    s = chunking.sentence_table(corpus.passages(spark, d)).where(F.size(X.words(F.col("sent"))).between(K.MIN_WORDS, K.MAX_WORDS))
    return s.groupBy("passage_id").agg(F.count(F.lit(1)).alias("n"))


def request_validation(spark: SparkSession, d: str) -> DataFrame:
    """Queries of 1 to 512 characters that aren't blank, counted by language."""
    t = corpus.traces(spark, d).where(F.col("query").isNotNull() & F.length("query").between(1, 512) & ~is_blank(F.col("query")))
    return t.groupBy(X.base_lang(F.col("lang")).alias("lang")).agg(F.count(F.lit(1)).alias("n"))


def language_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags of the language codes of chunks as a speech service gives them, by the fixed table, ``en`` by default."""
    c = corpus.chunk_table(spark, d).select("chunk_id", F.concat("lang", F.lit("-IN")).alias("code"))
    return c.groupBy("code", X.language_tag(F.col("code"), K.SPEECH_TAGS, "en").alias("tag")).agg(F.count(F.lit(1)).alias("n"))


def citation_filter(spark: SparkSession, d: str) -> DataFrame:
    """Which answers may be used as generated ones: every second has a citation, every third denies its context."""
    text = F.concat("gold_answer", F.when(F.col("eval_id") % 2 == 0, " [2]").otherwise(""), F.when(F.col("eval_id") % 3 == 0, " NOT_IN_CONTEXT").otherwise(""))
    return _pairs(spark, d).select("eval_id", X.cites(text).alias("usable"))


def generated_texts(spark: SparkSession, d: str) -> DataFrame:
    """Answers wrapped as a generator's JSON response and read from it again."""
    part = F.struct(F.array(F.struct(F.col("gold_answer").alias("text"))).alias("parts"))
    response = F.to_json(F.struct(F.array(F.struct(part.alias("content"))).alias("candidates")))
    return _pairs(spark, d).select("eval_id", F.md5(X.generated_text(response)).alias("digest"))


def speech_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Confidence from log-probabilities of words, for which the stage times stand in, over all traces."""
    t = corpus.traces(spark, d).select("trace_id", F.coalesce(F.transform("timings", lambda x: -x["ms"] / 1000), F.array().cast("array<double>")).alias("p"), "query")
    return t.select("trace_id", F.round(X.speech_confidence(F.col("p"), F.col("query")), 6).alias("confidence"))


def dataset_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags of dataset language codes, dealt out over the rows of passages; an unknown code has none."""
    codes = [*sorted(K.DATASET_TAGS), "xxx_None"]
    p = table(spark, d, "passages").select(F.element_at(F.array(*map(F.lit, codes)), (F.col("row_id") % len(codes) + 1).cast("int")).alias("code"))
    return p.groupBy("code", X.language_tag(F.col("code"), K.DATASET_TAGS).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


_ASKS = "a as (select trace_id, min_by(struct_pack(query := query, c := stt_confidence), (logged_at, query)) t from traces group by trace_id)"
_FILL = "[" + ", ".join(f"'{x}'" for x in L.FILLER) + "]"


def _contentless(x: str) -> str:
    whole = f"regexp_replace(lower(regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')), '^[!?.,। ]+|[!?.,। ]+$', '', 'g')"
    return f"({whole} = '' or list_contains({_FILL}, {whole}) or len({Q.toks(x)}) < 2 or len(list_filter({Q.toks(x)}, lambda t: not list_contains({_FILL}, t))) = 0)"


def _unsafe(x: str) -> str:
    return rf"regexp_matches({x}, '(?i)(^|{Q.OTHER})(kill\s+(myself|yourself)|suicide|make\s+a\s+bomb|child\s+porn)({Q.OTHER}|$)')"


_BLOCK = " ".join(f"when unicode(ch) between {lo} and {hi} then '{t}'" for t, lo, hi in L.SCRIPT_BLOCKS)
_TAGS = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in L.SPEECH_TAGS.items()) + "}"
_SEMANTIC = f"""with recursive {Q.P}, {Q.S}, {Q.hashed('sv', 's', 'passage_id, pos', 'sent')},
sim as (select s.passage_id, s.lang, s.pos, s.sent, coalesce(case when a.nn * b.nn > 0 then (select sum(x.v * y.v) from sv x join sv y on x.passage_id = s.passage_id and y.passage_id = s.passage_id and x.pos = s.pos - 1 and y.pos = s.pos and x.b = y.b)::double / sqrt(a.nn * b.nn) end, 0.0) c
  from s left join sv_n a on a.passage_id = s.passage_id and a.pos = s.pos - 1 left join sv_n b on b.passage_id = s.passage_id and b.pos = s.pos),
g as (select passage_id, pos, 0 as grp, 1 as n from sim where pos = 0
  union all select sim.passage_id, sim.pos, case when round(c, 9) < 0.62::double or n >= 6 then grp + 1 else grp end, case when round(c, 9) < 0.62::double or n >= 6 then 1 else n + 1 end from g join sim on sim.passage_id = g.passage_id and sim.pos = g.pos + 1),
c1 as (select passage_id, grp as position, string_agg(sent, ' ' order by pos) as text from g join s using (passage_id, pos) group by passage_id, grp)
"""


_SPANS = """w as (
  select s.passage_id, pos, case when instr(p.text, sent) > 0 then instr(p.text, sent) - 1 else 0 end a, case when instr(p.text, sent) > 0 then instr(p.text, sent) - 1 else 0 end + length(sent) b from s join p using (passage_id) where pos = 0
  union all select s.passage_id, s.pos, case when instr(substr(p.text, w.b + 1), s.sent) > 0 then w.b + instr(substr(p.text, w.b + 1), s.sent) - 1 else w.b end, case when instr(substr(p.text, w.b + 1), s.sent) > 0 then w.b + instr(substr(p.text, w.b + 1), s.sent) - 1 else w.b end + length(s.sent) from w join s on s.passage_id = w.passage_id and s.pos = w.pos + 1 join p on p.passage_id = s.passage_id)"""


def _sliding(window: int, step: int) -> str:
    return f"""with {Q.P}, t as (select passage_id, {Q.words('text')} w from p), k as (select passage_id, w, unnest(range(greatest(0, ceil((len(w) - {window}) / {step}.0))::int + 1)) as position from t where len(w) > 0)
select {Q.cid('passage_id', 'C2', 'position')} chunk_id, passage_id, position, array_to_string(w[position * {step} + 1 : position * {step} + {window}], ' ') as text from k"""


_CHILD = f"""n as (select passage_id, pos, sent, sum(length(sent) + 1) over (partition by passage_id order by pos)::bigint - length(sent) - 1 a from s),
c3 as (select passage_id, pos // 2 as position, string_agg(sent, ' ' order by pos) as text, min(a) a, max(a + length(sent)) b from n group by passage_id, pos // 2)"""
ORACLES = {
    "sentences_split": f"with {Q.P}, {Q.S} select passage_id, pos, sent from s",
    "lexical_tokens": f"with {Q.P}, t as (select passage_id, unnest({Q.toks('text')}) term from p) select passage_id, term, count(*) tf from t group by all",
    "chunk_sliding": _sliding(256, 192),
    "chunk_sliding_small": _sliding(24, 18),
    "chunk_parent_child": f"""with {Q.P}, {Q.S}, {_CHILD}
select {Q.cid('passage_id', 'C3', 'position')} chunk_id, passage_id, 'C3' strategy, position, {Q.cid('passage_id', 'C3P', '0')} parent_id, a, b, text from c3
union all select {Q.cid('passage_id', 'C3P', '0')}, passage_id, 'C3P', 0, null, 0, length({Q.clean('text')}), {Q.clean('text')} from p""",
    "chunk_question_keys": f"with {Q.P}, k as (select passage_id, unnest(questions) x, generate_subscripts(questions, 1) - 1 as position from p) select {Q.cid('passage_id', 'C5', 'position')} chunk_id, passage_id, position, passage_id answers_passage, {Q.clean('x')} as text from k where {Q.clean('x')} <> ''",
    "chunk_semantic": _SEMANTIC + f""", {_SPANS}, cs as (select passage_id, grp as position, min(a) a, max(b) b from g join w using (passage_id, pos) group by all)
select {Q.cid('passage_id', 'C1', 'position')} chunk_id, passage_id, position, a, b, text from c1 join cs using (passage_id, position)""",
    "char_spans": f"with recursive {Q.P}, {Q.S}, {_SPANS} select passage_id, pos, a, b from w",
    "chunk_union_counts": _SEMANTIC + f""", {_CHILD}, t as (select passage_id, {Q.words('text')} w from p), k as (select w, unnest(range(greatest(0, ceil((len(w) - 256) / 192.0))::int + 1)) as position from t where len(w) > 0), u as (select unnest(questions) x from p),
r as (select 'C1' strategy, text from c1 union all select 'C2', array_to_string(w[position * 192 + 1 : position * 192 + 256], ' ') from k union all select 'C3', text from c3 union all select 'C5', {Q.clean('x')} from u where {Q.clean('x')} <> '')
select strategy, count(*) n, sum(length(text))::bigint chars from r group by strategy""",
    "guard_input": f"with {_ASKS} select trace_id, case when t.c < 0.55 then 'low_stt_confidence' when {_unsafe('coalesce(t.query, $$$$)')} then 'unsafe' when {_contentless('coalesce(t.query, $$$$)')} then 'contentless' end refused from a",
    "guard_contentless": f"select eval_id, {_contentless('coalesce(gold_answer, $$$$)')} contentless from eval_set",
    "guard_unsafe": f"select doc_id, {_unsafe('text')} unsafe from documents where text is not null",
    "detect_lang": rf"""with ch as (select doc_id, unnest(string_split(text, '')) ch, generate_subscripts(string_split(text, ''), 1) k from documents where text is not null),
l as (select doc_id, k, case when unicode(ch) < 592 then 'latin' {_BLOCK} end b from ch where regexp_matches(ch, '^\p{{L}}')),
n as (select doc_id, b, count(*) n, min(k) first from l where b is not null group by all),
m as (select doc_id, coalesce(max(n) filter (where b = 'latin'), 0) latin, max_by(struct_pack(b := b, n := n), (n, -first)) filter (where b <> 'latin') best from n group by doc_id)
select d.doc_id, case when m.best.n >= m.latin then m.best.b else 'en' end detected from documents d left join m using (doc_id) where d.text is not null""",
    "sanitize_context": r"select doc_id, md5(regexp_replace(text, '(?i)(ignore\s+(all\s+)?previous\s+instructions|disregard\s+the\s+above|you\s+are\s+now\s+|system\s*:\s*)', '[redacted-instruction] ', 'g')) digest from documents where text is not null",
    "needs_synthesis": f"""select distinct query, ({' or '.join(f"contains(lower(query), '{x}')" for x in L.SYNTHESIS_CUES)}) or (len({Q.words('lower(query)')}) > 18 and ({' or '.join(f"contains(lower(query), '{x}')" for x in L.CONJUNCTIONS)})) or length(query) % 3 = 0 synthesis from traces where query is not null""",
    "intent_bonus": f"select eval_id, {Q.bonus('query', 'gold_answer')} bonus from eval_set where query is not null and gold_answer is not null",
    "lexical_overlap": f"select eval_id, round({Q.overlap(Q.toks('query'), 'gold_answer')}, 6) overlap from eval_set where query is not null and gold_answer is not null",
    "sentence_length_filter": f"with {Q.P}, {Q.S} select passage_id, count(*) n from s where len({Q.words('sent')}) between 3 and 80 group by passage_id",
    "request_validation": f"with a as (select trace_id, min_by(struct_pack(query := query, lang := lang), (logged_at, asked_at)) t from traces group by trace_id) select {Q.lang('t.lang')} lang, count(*) n from a where length(t.query) between 1 and 512 and {Q.not_blank('t.query')} group by all",
    "language_tags": f"with {Q.C}, k as (select lang || '-IN' code from c) select code, coalesce({_TAGS}[code], 'en') tag, count(*) n from k group by all",
}
_CODES = "[" + ", ".join(f"'{k}'" for k in [*sorted(L.DATASET_TAGS), "xxx_None"]) + "]"
ORACLES |= {
    "citation_filter": "select eval_id, eval_id % 3 <> 0 and not contains(gold_answer, 'NOT_IN_CONTEXT') and (eval_id % 2 = 0 or regexp_matches(gold_answer, '\\[[0-9]+\\]')) usable from eval_set where query is not null and gold_answer is not null",
    "generated_texts": "select eval_id, md5(gold_answer) digest from eval_set where query is not null and gold_answer is not null",
    "speech_confidence": "with t as (select trace_id, min_by(struct_pack(query := query, timings := timings), (logged_at, asked_at)) r from traces group by trace_id), k as (select trace_id, list_transform(coalesce(r.timings, []), lambda x: -x.ms / 1000) p, r.query from t) select trace_id, round(case when len(p) > 0 then least(1.0::double, list_sum(p) / len(p) + 1) when coalesce(query, '') <> '' then 1.0 else 0.0 end, 6) confidence from k",
    "dataset_tags": f"select code, {'map {' + ', '.join(f"'{k}': '{v}'" for k, v in L.DATASET_TAGS.items()) + '}'}[code] tag, count(*) n from (select {_CODES}[row_id % 15 + 1] code from passages) group by all",
}
QUERIES = {k: globals()[k] for k in ORACLES}
