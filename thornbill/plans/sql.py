"""SQL for DuckDB that several oracles share, written apart from the operators."""

from __future__ import annotations

from thornbill.tables import WS


def not_blank(x: str) -> str:
    return f"regexp_matches({x}, '[^{WS}]')"


def clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'))"


def sents(x: str) -> str:
    return f"list_filter(string_split(regexp_replace({clean(x)}, '([।॥.?!۔]) ', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


def toks(x: str) -> str:
    return rf"list_transform(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+'), lambda t: lower(t))"


def words(x: str) -> str:
    return f"list_filter(string_split({clean(x)}, ' '), lambda s: s <> '')"


def lang(x: str) -> str:
    return f"coalesce(lower(split_part({x}, '-', 1)), 'en')"


def cid(passage: str, strategy: str, index: str) -> str:
    return f"substr(sha256(concat_ws(':', {passage}, '{strategy}', ({index})::varchar)), 1, 16)"


#: p: one row a passage. s: its sentences.
P = f"""p as (select passage_id, r.text as text, {lang('r.lang')} lang, coalesce(r.questions, []) questions
  from (select passage_id, max_by(struct_pack(text := text, lang := lang, questions := questions), row_id) r from passages where text is not null and {not_blank('text')} group by passage_id))"""
S = f"""s as (select passage_id, lang, unnest({sents('text')}) sent, generate_subscripts({sents('text')}, 1) - 1 as pos from p)"""
#: c: the delivered chunks, once each. q: the query set of searches.
C = "c as (select chunk_id, min(passage_id) passage_id, min(text) as text, min(strategy) strategy, coalesce(max(lower(split_part(lang, '-', 1))), 'en') lang, min(parent_id) parent_id, min(answers_passage) answers_passage from chunks where text is not null group by chunk_id), i as (select * from c where strategy <> 'C3P')"
Q = f"q as (select eval_id as qid, query, lang, gold_passage_id gold from eval_set where eval_id % 20 = 0 and query is not null and {not_blank('query')})"


def hashed(name: str, of: str, keys: str, text: str) -> str:
    """``name``: keys, bucket, v of the signed feature hashes; ``name_n``: keys and the squared length."""
    return f"""{name}_t as (select {keys}, ('0x' || substr(md5(t), 1, 7))::bigint h from (select {keys}, unnest({toks(text)}) t from {of})),
{name} as (select {keys}, h % 64 b, sum(case when (h // 64) % 2 = 0 then 1 else -1 end) v from {name}_t group by all),
{name}_n as (select {keys}, sum(v * v)::double nn from {name} group by all)"""


#: Dense scores of all queries and indexed chunks.
DENSE = f"""{hashed('cv', 'i', 'chunk_id', 'text')}, {hashed('qv', 'q', 'qid', 'query')},
dots as (select qid, chunk_id, sum(qv.v * cv.v)::double d from qv join cv on qv.b = cv.b group by all),
sims as (select q.qid, i.chunk_id, i.strategy, coalesce(case when cn.nn * qn.nn > 0 then d.d / sqrt(cn.nn * qn.nn) end, 0.0) s
  from q cross join i left join dots d on d.qid = q.qid and d.chunk_id = i.chunk_id left join cv_n cn on cn.chunk_id = i.chunk_id left join qv_n qn on qn.qid = q.qid)"""
#: BM25 scores of all queries and indexed chunks that share a term.
BM25 = f"""ct as (select chunk_id, {toks('text')} t from i), st as (select count(*) n, sum(len(t)) / count(*) avgdl from ct),
tf as (select chunk_id, term, count(*) tf, any_value(dl) dl from (select chunk_id, len(t) dl, unnest(t) term from ct) group by chunk_id, term),
idf as (select term, count(*) df, ln(1 + (any_value(n) - count(*) + 0.5::double) / (count(*) + 0.5::double)) idf from tf, st group by term),
qt as (select qid, unnest({toks('query')}) term from q),
bm as (select qid, chunk_id, sum(idf * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl))) s from qt join tf using (term) join idf using (term), st group by qid, chunk_id)"""
DTOP = "dt as (select qid, chunk_id, s, row_number() over (partition by qid order by round(s, 9) desc, chunk_id) - 1 r from sims qualify r < 40)"
LTOP = "lt as (select qid, chunk_id, s, row_number() over (partition by qid order by round(s, 9) desc, chunk_id) - 1 r from bm qualify r < 40)"
FUSED = "fu as (select qid, chunk_id, coalesce(dt.s, 0.0) ds, dt.r dr, lt.r lr, coalesce(1.0::double / (61 + dt.r), 0.0) + coalesce(1.0::double / (61 + lt.r), 0.0) f from dt full join lt using (qid, chunk_id))"
HITS = """bo as (select fu.qid, fu.chunk_id, ds, dr, lr, i.passage_id, i.text, i.strategy, i.lang, i.parent_id, i.answers_passage, case when i.lang = q.lang then f * (1 + 0.15::double) else f end f from fu join i using (chunk_id) join q using (qid)),
fp as (select *, row_number() over (partition by qid, passage_id order by f desc, coalesce(dr, 1000000 + lr)) n from bo qualify n = 1),
rk as (select *, row_number() over (partition by qid order by f desc, coalesce(dr, 1000000 + lr)) rank from fp),
pa as (select passage_id, max(chunk_id) chunk_id, max_by(text, chunk_id) as text from c where strategy = 'C3P' group by passage_id),
re as (select rk.qid, rank, coalesce(c3.chunk_id, pa.chunk_id, rk.chunk_id) chunk_id, rk.passage_id, coalesce(c3.text, pa.text, rk.text) as text, rk.strategy, rk.lang, f, ds, dr, lr
  from rk left join c c3 on rk.strategy = 'C3' and c3.strategy = 'C3P' and c3.chunk_id = rk.parent_id left join pa on rk.strategy = 'C5' and pa.passage_id = rk.answers_passage)"""
RETRIEVE = ", ".join((C, Q, DENSE, BM25, DTOP, LTOP, FUSED, HITS))
WORD = r"[\p{L}\p{N}_]"
OTHER = r"[^\p{L}\p{N}_]"


def bonus(q: str, s: str) -> str:
    """The intent bonus. A trigger that ends in a combining mark only counts before a word character."""
    w, o, sp = WORD, OTHER, f"[{WS}]"

    def asks(*plain: str, marked: tuple[str, ...] = ()) -> str:
        rules = [f"regexp_matches({q}, '(?i)(^|{o})({'|'.join(plain)})({o}|$)')"]
        if marked:
            rules.append(f"regexp_matches({q}, '(?i)(^|{o})({'|'.join(marked)}){w}')")
        return "(" + " or ".join(rules) + ")"

    year = rf"regexp_matches({s}, '(^|{o})(1[5-9]\p{{Nd}}{{2}}|20\p{{Nd}}{{2}})({o}|$)')"
    money = rf"regexp_matches({s}, '[$₹€£]{sp}?\p{{Nd}}|(^|{o})\p{{Nd}}+([.,]\p{{Nd}}+)?{sp}?(crore|lakh|million|billion|percent|%)')"
    who = f"regexp_matches({s}, '(^|{o})[A-Z][a-z]+{sp}+[A-Z][a-z]+({o}|$)')"
    n = " + ".join(
        f"(case when {a} and {b} then 1 else 0 end)"
        for a, b in (
            (asks("when", "what year", "कब", marked=("எப்போது",)), year),
            (asks("how many", "how much", "कितन", marked=("எவ்வளவு",)), rf"regexp_matches({s}, '\p{{Nd}}')"),
            (asks("cost", "price", "salary", "कीमत", marked=("விலை",)), money),
            (asks("who", "कौन", marked=("किसने", "யார்")), who),
        )
    )
    return f"(case when {n} >= 2 then 0.16::double when {n} = 1 then 0.08::double else 0.0::double end)"


def overlap(qt: str, s: str) -> str:
    t = f"list_distinct({toks(s)})"
    return f"(case when len(list_distinct({qt})) > 0 and len({t}) > 0 then len(list_intersect(list_distinct({qt}), {t}))::double / len(list_distinct({qt})) else 0.0::double end)"
