"""Chunking, retrieval, answering, traces and evaluation on small fixtures."""

import glob
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thornbill.config import Floors, RetrieveOptions
from thornbill.functions import vectors as V
from thornbill.operators import answer, chunking, domain, evaluate, lexical, retrieval, traces
from thornbill.sources import corpus, sinks


def docs(spark, *texts):
    return spark.createDataFrame([(f"p{i}", t, "en", [], "x") for i, t in enumerate(texts)], "passage_id string, text string, lang string, questions array<string>, sent string")


@pytest.mark.parametrize("n, starts", [(1, [0]), (256, [0]), (257, [0, 192]), (448, [0, 192]), (449, [0, 192, 384]), (1000, [0, 192, 384, 576, 768])])
def test_sliding(spark, n, starts):
    rows = chunking.sliding(docs(spark, " ".join(f"w{i}" for i in range(n)))).orderBy("position").collect()
    assert [int(r.text.split()[0][1:]) for r in rows] == starts
    assert rows[-1].text.endswith(f"w{n - 1}")


def test_children_parents_and_blank(spark):
    d = docs(spark, "A b. C d. E f. G h. I j.", " ", None)
    rows = chunking.children(d).orderBy("position").collect()
    assert [r.text for r in rows] == ["A b. C d.", "E f. G h.", "I j."]
    assert [tuple(r.char_span) for r in rows] == [(0, 9), (10, 19), (20, 24)]
    parent = chunking.parents(d).collect()
    assert len(parent) == 1 and rows[0].parent_id == parent[0].chunk_id


def test_semantic_groups_are_capped(spark):
    d = docs(spark, " ".join(["Same words here."] * 8 + ["Other thing entirely now."]))
    rows = chunking.semantic(d).orderBy("position").collect()
    assert [r.text.count(".") for r in rows] == [6, 2, 1]


def test_questions_keep_their_place(spark):
    d = spark.createDataFrame([("p", "t", "en", ["a", " ", "b"])], corpus.PASSAGE_SCHEMA)
    assert [(r.position, r.text) for r in chunking.questions(d).orderBy("position").collect()] == [(0, "a"), (2, "b")]


def test_bm25_against_brute_force(spark):
    random.seed(1)
    texts = [" ".join(random.choices("abcdef", k=random.randint(1, 9))) for _ in range(30)] + [""]
    chunks = spark.createDataFrame([(f"c{i:02}", t) for i, t in enumerate(texts)], "chunk_id string, text string")
    query = "a b b z"
    got = {r.chunk_id: r.score for r in lexical.score(spark.createDataFrame([(1, query)], "qid int, query string"), chunks).collect()}
    n, avgdl = len(texts), sum(len(t.split()) for t in texts) / len(texts)
    for i, t in enumerate(texts):
        w = t.split()
        s = 0.0
        for term in query.split():
            if term in w:
                df = sum(term in x.split() for x in texts)
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * w.count(term) * 2.5 / (w.count(term) + 1.5 * (0.25 + 0.75 * len(w) / avgdl))
        assert got.get(f"c{i:02}", 0.0) == pytest.approx(s)


def test_fusion_of_two_firsts(spark):
    d = spark.createDataFrame([(1, "x", 0.9, 0)], "qid int, chunk_id string, dense_score double, dense_rank int")
    lex = spark.createDataFrame([(1, "x", 0), (1, "y", 1)], "qid int, chunk_id string, rank int")
    got = {r.chunk_id: r.fused for r in retrieval.fuse(d, lex).collect()}
    assert got == {"x": pytest.approx(2 / 61), "y": pytest.approx(1 / 62)}


def test_pipeline_on_the_demo(spark):
    index = retrieval.build_index(corpus.demo_corpus(spark))
    asks = spark.createDataFrame([(1, "when was the oldest mill built", "en", None, None), (2, "hi", None, None, None), (3, "when was the oldest mill built", "en", 0.2, None), (4, None, "en", None, None)], "qid int, query string, lang string, stt_confidence double, force_path string")
    out, hits = answer.ask(asks, index, floors=Floors(retrieval=0.2, extractive=0.3))
    r = {x.qid: x for x in out.collect()}
    assert r[1].path == "extractive" and "1704" in r[1].answer and r[1].passage_id == "demo-1"
    assert [r[i].refused for i in (2, 3, 4)] == ["contentless", "low_stt_confidence", "contentless"]
    h = hits.collect()
    assert len({(x.qid, x.passage_id) for x in h}) == len(h)
    assert all(x.score <= 2 / 61 * 1.15 + 1e-12 for x in h)

    def quote(prompts):
        return prompts.select("qid", F.lit("The oldest mill on this river was built in 1704 [1].").alias("text"), F.lit("stub").alias("provider"))

    forced = asks.where("qid = 1").withColumn("force_path", F.lit("generative"))
    refused, hits = answer.ask(forced, index, floors=Floors(retrieval=0.2))
    assert refused.first().escalate
    assert answer.escalate(refused, forced, hits, quote).first().path == "generative"
    assert answer.escalate(refused, forced, hits).first().path == "refusal"


def test_empty_index(spark):
    index = retrieval.build_index(docs(spark).limit(0))
    q = spark.createDataFrame([(1, "a b", "en")], "qid int, query string, lang string")
    assert retrieval.retrieve(q, index, RetrieveOptions()).count() == 0
    assert retrieval.retrieve(q.limit(0), index).count() == 0


def test_strategy_filters(spark):
    index = retrieval.build_index(corpus.demo_corpus(spark))
    q = spark.createDataFrame([(1, "oldest mill river", "en")], "qid int, query string, lang string")
    hits = retrieval.retrieve(q, index, RetrieveOptions(strategies=("C2",))).collect()
    assert hits and {h.strategy for h in hits} == {"C2"}


def test_groundedness_half(spark):
    a = spark.createDataFrame([(1, "The mill is old. Zebras dance."), (2, "Zebras dance.")], "qid int, answer string")
    c = spark.createDataFrame([(1, "the mill is old"), (2, "the mill is old")], "qid int, text string")
    got = {r.qid: (r.kept, r.dropped, r.text, r.accepted) for r in answer.grounded(a, c).collect()}
    assert got == {1: (1, 1, "The mill is old.", True), 2: (0, 1, "", False)}


def test_nearest_blocks_and_ties(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(30)] + [(99, None)], "rid int, vec array<double>")
    q = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], "qid int, vec array<double>")
    one = sorted(map(tuple, V.nearest(q, rows, 3).collect()))
    monkeypatch.setattr(V, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, V.nearest(q, rows, 3).collect())) == one
    assert [r[1] for r in one if r[0] == 0] == [0, 3, 6]


def test_kmeans_keeps_empty_centroids(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0])], "rid int, vec array<double>")
    c = domain.step(rows, domain.seed_centroids(rows, 3)).orderBy("cid").collect()
    assert [r.n for r in c] == [2, 0, 1] and c[1].vec == [1.0, 0.0]
    assert domain.assign(rows.limit(0), domain.seed_centroids(rows.limit(0))).count() == 0


@pytest.mark.parametrize("values, p50", [([1, 2, 3, 4], 3), ([5], 5)])
def test_percentile_rule(spark, values, p50):
    df = spark.createDataFrame([(float(v), "x") for v in values] + [(None, "x")], "v double, n string")
    r = traces.percentiles(df, "v").first()
    assert r.p50 == p50 and r.p100 == max(values) and r.n == len(values)


def test_percentiles_by_group_and_empty(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(101)] + [(None, 7.0)] * 3, "g string, v double")
    got = {r.g: (r.p50, r.p90, r.n) for r in traces.percentiles(df, "v", ["g"]).collect()}
    assert got == {"a": (50.0, 90.0, 101), None: (7.0, 7.0, 3)}
    assert traces.percentiles(df.limit(0), "v").count() == 0


def test_last_entries_ties(spark):
    df = spark.createDataFrame([(i, "t", 1) for i in range(3)] + [(9, None, 1)], "trace_id int, asked_at string, x int")
    assert [r.trace_id for r in traces.last_entries(df, 2).collect()] == [2, 1]


def test_recall_and_sweep(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 6), (3, None)], "qid int, gold_rank int")
    r = evaluate.recall_mrr(ranks).first()
    assert (r.n, r.recall_at_5, r.mrr_at_10) == (3, round(1 / 3, 6), round((1 + 1 / 6) / 3, 6))
    c = spark.createDataFrame([(True, 0.9), (True, 0.4), (False, 0.6)], "answerable boolean, s double")
    got = {x.tau: (x.false_confidence, x.false_refusal) for x in evaluate.sweep(c, "s", [0.5, 0.7]).collect()}
    assert got == {0.5: (1.0, 0.5), 0.7: (0.0, 0.5)}


def test_best_arm_and_post_filters(spark):
    from thornbill.functions import text as X

    arms = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.25)], "arm string, recall_at_5 double")
    order = [("c", None, False), ("b", None, False), ("a", None, False)]
    assert tuple(evaluate.best_arm(arms, order).first()) == ("b", 1.0)
    said = spark.createDataFrame([("Yes [1].",), ("Yes.",), ("NOT_IN_CONTEXT [1]",), (None,)], "t string")
    assert [r[0] for r in said.select(X.cites(F.col("t"))).collect()] == [True, False, False, None]


def test_contexts_keep_their_place(spark):
    df = spark.createDataFrame([(1, [" ", "a b c", "d"])], "qid int, texts array<string>")
    assert [(r.rank, r.score) for r in retrieval.contexts(df).orderBy("rank").collect()] == [(2, 0.5), (3, pytest.approx(1 / 3))]


def test_ranks_with_a_hot_group(spark):
    df = spark.createDataFrame([("hot", float(i % 7)) for i in range(700)] + [("x", 1.0), ("x", 3.0)], "g string, v double")
    got = traces.quantiles(df, "v", ["g"]).orderBy("g").collect()
    values = sorted(float(i % 7) for i in range(700))
    assert (got[0].n, got[0].p10_value, got[0].p50_value, got[0].p90_value) == (700, values[70], values[350], values[630])
    assert (got[1].min_value, got[1].max_value) == (1.0, 3.0)


def test_harvest_rules(spark):
    rows = [
        (2, "hin_Deva", "q", "a", ([0, 1, 1], ["d", "g", "x"])), (3, "tam_Taml", "q", "a", ([1], ["g"])),
        (4, "ben_Beng", "q", "a", ([0], ["d"])), (5, "hin_Deva", "q", None, ([1, 0], ["g", "d"])),
    ]
    src = spark.createDataFrame(rows, "query_id long, target_lang string, query string, answer string, passages struct<is_selected:array<int>,texts:array<string>>")
    p, e = corpus.harvest(src)
    got = {r.passage_id: (r.text, list(r.questions)) for r in p.collect()}
    assert got == {"2-hi-g": ("g", []), "2-hi-d": ("d", []), "3-ta-g": ("g", ["q"]), "5-hi-g": ("g", ["q"]), "5-hi-d": ("d", [])}
    assert [r.query_id for r in e.collect()] == [2]


def test_files(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"passage_id": 7, "text": "t"}, {"passage_id": "x", "text": null, "lang": "hi", "questions": ["q"]}]')
    got = [(r.passage_id, r.lang, list(r.questions)) for r in corpus.read_corpus_json(spark, str(tmp_path / "c.json")).collect()]
    assert got == [("7", "en", []), ("x", "hi", ["q"])]
    assert corpus.read_eval_json(spark, None).count() == 0
    demo = corpus.demo_corpus(spark)
    sinks.save_snapshot({"p": demo}, str(tmp_path / "s"), {"dim": 64})
    tables, meta = sinks.load_snapshot(spark, str(tmp_path / "s"))
    assert tables["p"].count() == 3 and meta["dim"] == 64
    sinks.write_csv(demo.select("passage_id", "lang"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["passage_id", "lang"]
    scores = demo.select("text", F.lit(0.123456).alias("confidence"))
    sinks.append_scores(scores, str(tmp_path / "log"))
    sinks.append_scores(scores, str(tmp_path / "log"))
    sinks.append_scores(scores, None)
    assert spark.read.json(str(tmp_path / "log")).count() == 6
    assert sinks.markdown(demo.select("passage_id"), "T").startswith("# T")
    demo.withColumnRenamed("lang", "target_lang").write.parquet(str(tmp_path / "langs"))
    assert corpus.locate_languages(spark.read.parquet(str(tmp_path / "langs")), ["hi"]).count() == 1
    with pytest.raises(ValueError):
        corpus.locate_languages(spark.read.parquet(str(tmp_path / "langs")), ["hi", "ta"])


def brute_corpus(rows, languages, n_rows, n_eval):
    """The rule of a corpus build, row by row."""
    seen, passages, evals = set(), [], []
    for no, lang in enumerate(languages):
        ps, ev = [], []
        for r in sorted((r for r in rows if r[1] == lang), key=lambda r: r[0]):
            if r[0] in seen:
                continue
            seen.add(r[0])
            sel = r[6][0]
            if 1 not in sel:
                continue
            g, d = sel.index(1), next((i for i, x in enumerate(sel) if not x), None)
            held = len(ev) < n_eval
            tag = {"hin_Deva": "hi"}.get(lang, lang)
            for wanted, query, said, texts, t, most in ((True, r[2], r[3], r[6][1], tag, n_rows), (no == 0, r[4], r[5], r[6][2], "en", 2 * n_rows)):
                if wanted and len(ps) < most:
                    ps.append((f"{r[0]}-{t}-g", texts[g], t, () if held or query is None else (query,)))
                    if d is not None:
                        ps.append((f"{r[0]}-{t}-d", texts[d], t, ()))
                    if len(ev) < n_eval and said:
                        ev.append((r[0], query, t, f"{r[0]}-{t}-g", said))
        passages += ps
        evals += ev
    return sorted(passages), sorted(evals)


@pytest.mark.parametrize("n_rows, n_eval", [(3, 2), (6, 5), (7, 0), (100, 100)])
def test_corpus_build_in_order(spark, n_rows, n_eval):
    r = random.Random(3)
    rows = []
    for lang in ("hin_Deva", "xx"):
        for q in r.sample(range(30), 18):
            n = r.randint(1, 3)
            sel = [r.choice([0, 0, 1]) for _ in range(n)]
            rows.append((q, lang, f"q{q}", r.choice([None, "", f"a{q}"]), f"e{q}", r.choice([None, f"b{q}"]), (sel, [f"{lang}{q}{i}" for i in range(n)], [f"en{q}{i}" for i in range(n)])))
    src = spark.createDataFrame(rows, "query_id long, target_lang string, query string, answer string, eng_query string, eng_answer string, passages struct<is_selected:array<int>,texts:array<string>,english:array<string>>")
    p, e = corpus.build_corpus(src, ["hin_Deva", "xx"], n_rows, n_eval)
    got = sorted((x.passage_id, x.text, x.lang, tuple(x.questions)) for x in p.collect()), sorted(map(tuple, e.collect()))
    assert got == brute_corpus(rows, ["hin_Deva", "xx"], n_rows, n_eval)


def test_pruned_search_is_exact(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.choices(words, weights=[40 // (i + 1) + 1 for i in range(40)], k=r.randint(1, 30))) for _ in range(400)] + ["", "w0 " * 50]
    chunks = spark.createDataFrame([(f"c{i:03}", t) for i, t in enumerate(texts)], "chunk_id string, text string")
    q = spark.createDataFrame([(i, " ".join(r.choices(words, k=r.randint(1, 6)))) for i in range(30)] + [(90, "nothing here"), (91, "")], "qid int, query string")
    lex = lexical.lexicon(chunks)
    for k in (1, 7):
        rows = lambda df: sorted((x.qid, x.rank, x.chunk_id, round(x.score, 8)) for x in df.collect())
        assert rows(lexical.best(q, lex, k)) == rows(lexical.top(lexical.score(q, chunks), k))
    assert lexical.best(q.limit(0), lex, 3).count() == 0 and lexical.best(q, lexical.lexicon(chunks.limit(0)), 3).count() == 0


def test_stored_index_and_known_sentences(spark, tmp_path):
    index = retrieval.build_index(corpus.demo_corpus(spark))
    retrieval.save(index, str(tmp_path / "i"), steps=2)
    back = retrieval.load(spark, str(tmp_path / "i"))
    q = spark.createDataFrame([(1, "when was the oldest mill built", "en")], "qid int, query string, lang string")
    hits = [sorted(map(tuple, retrieval.retrieve(q, i).collect())) for i in (index, back)]
    assert hits[0] == hits[1] and back.tau == index.tau and back.centroids.count() > 0
    made = []

    def counting(texts):
        made.extend(texts)
        return V.hash_embedder()(texts)

    c = answer.candidates(retrieval.retrieve(q, index))
    known = back.sentences.where("sent not like 'It still%'")
    got, new = (sorted((r.idx, tuple(r.svec)) for r in answer.with_vectors(c, None, k).collect()) for k in (known, None))
    assert got == new
    assert not answer.with_vectors(c, counting, back.sentences).where("svec is null").count()
    more = spark.createDataFrame([("new", "p9", "a quiet canal", "C2", "en", 0, None, None)], "chunk_id string, passage_id string, text string, strategy string, lang string, position int, parent_id string, answers_passage string")
    one = retrieval.upsert(retrieval.index_of(more), more.withColumn("text", F.lit("a loud canal")))
    assert [r.text for r in one.chunks.collect()] == ["a loud canal"]


def test_bench_run_and_reports(spark):
    index = retrieval.build_index(corpus.demo_corpus(spark))
    evals = spark.createDataFrame([(1, "when was the oldest mill built", "en", "demo-1"), (2, "how long does the ferry take", "en", "demo-3")], "qid long, query string, lang string, gold string")
    assert evaluate.bench_questions(evals, 1).where("kind = 'eval'").count() == 1
    rows = evaluate.bench_rows(evaluate.bench_questions(evals), index)
    got = {(r.kind, r.lang): (r.n, r.refused) for r in evaluate.bench_report(rows).collect()}
    assert got["unsafe", ""] == (2, 2) and got["oos", ""][0] == 10 and got["eval", "en"][0] == 2
    text = evaluate.bench_markdown(rows)
    assert "- Unsafe: 2/2" in text and "- en: P50" in text
    arms = spark.createDataFrame([("a", 2, 0.5, 0.4, 1.0), ("b", 2, 0.75, 0.5, 2.0)], "arm string, n int, recall_at_5 double, mrr_at_10 double, p50_ms double")
    text = evaluate.ablation_markdown(arms, [("a", None, False), ("b", None, True)])
    assert "| b | **0.750** | 0.500 | 2.0 ms |" in text and "+50 %" in text


def test_decision_floors(spark):
    q = spark.createDataFrame([(1, "when was the oldest mill built"), (2, "when was the oldest mill built"), (3, "x y")], "qid int, query string")
    text = "When was the oldest mill built."
    given = retrieval.contexts(spark.createDataFrame([(1, [text]), (2, [" ", text])], "qid int, texts array<string>"))
    got = {r.qid: (r.grounded, r.text) for r in answer.decide(q, given).collect()}
    refusal = "I don't have enough grounded context to answer that."
    assert got == {1: (True, text), 2: (False, refusal), 3: (False, refusal)}


def test_search_without_stored_postings(spark, monkeypatch):
    """Chunks are scanned for words: the list of all scores, ties included, with nothing written and queries in blocks."""
    texts = ["a b c", "a a b", "b", "", None, "c c c d", "a b c", "x y z"] * 5
    chunks = spark.createDataFrame([(f"c{i:02d}", t) for i, t in enumerate(texts)], "chunk_id string, text string").repartition(3)
    q = spark.createDataFrame([(1, "a b b"), (2, "d"), (3, "nothing here"), (4, "C x")], "qid int, query string")
    rows = lambda df: sorted((r.qid, r["rank"], r.chunk_id, round(r.score, 9)) for r in df.collect())
    want = {k: rows(lexical.top(lexical.score(q, chunks), k)) for k in (1, 3, 50)}
    monkeypatch.setattr(lexical, "durable", lambda df: pytest.fail("written"))
    monkeypatch.setattr(V, "QUERY_BLOCK", 2)
    for k, expected in want.items():
        assert rows(lexical.best(q, chunks, k)) == expected
    assert lexical.best(q.limit(0), chunks, 3).count() == 0 and lexical.best(q, chunks.limit(0), 3).count() == 0


def test_best_of_batches():
    """Kept over batches of any size: the best by rounded score, ties by id, also where most rows tie."""
    rng = np.random.default_rng(5)
    score = np.round(rng.random((900, 6)), 2)
    score[:, 4], score[:, 5] = 0.0, rng.random(900)
    ids = np.array([f"r{i}" for i in rng.permutation(900)], dtype=object)
    for k, step in ((1, 7), (5, 64), (40, 300), (1000, 900)):
        best = V.Best(k, 6)
        for i in range(0, 900, step):
            best.add(ids[i : i + step], score[i : i + step])
        held, query, value = best.held()
        for c in range(6):
            want = sorted((-round(s, 9), x) for s, x in zip(score[:, c], ids))[:k]
            assert sorted((-round(s, 9), x) for s, x in zip(value[query == c], held[query == c])) == want


def test_chunks_once_and_index_without_postings(spark, tmp_path, monkeypatch):
    """Only chunks delivered several times are shuffled; the queries' index has what is read of it alone."""
    from thornbill import tables
    from thornbill.plans.retrieval_queries import _index

    row = lambda i, p, t, lang, s="C1": (i, p, t, s, lang, 0, None, None)
    rows = [row("a", "p1", "one two", "en-IN"), row("b", "p1", "three", None), row("a", "p1", "one two", None), row("a", "p0", "other", "HI"), row(None, "p", "x", "en"), row("c", "p", None, "en"), row("d", "p1", "whole", "en", "C3P")]
    spark.createDataFrame(rows, "chunk_id string, passage_id string, text string, strategy string, lang string, position int, parent_id string, answers_passage string").write.parquet(str(tmp_path / "chunks.parquet"))
    want = sorted(map(str, corpus.chunk_table(spark, str(tmp_path)).collect()))
    assert len(want) == 3 and sorted(map(str, corpus.chunks_once(spark, str(tmp_path)).collect())) == want
    monkeypatch.setattr(corpus, "SENT", 0)
    assert sorted(map(str, corpus.chunks_once(spark, str(tmp_path)).collect())) == want
    index = _index(spark, str(tmp_path))
    assert (index.lexicon, index.sentences, index.centroids) == (None, None, None) and index.chunks.count() == 2
    few = tables.durable(index.chunks.select("chunk_id").limit(1))
    assert tables.among(index.chunks, "chunk_id", few).count() == 1
    monkeypatch.setattr(tables, "SENT", 0)
    assert tables.among(index.chunks, "chunk_id", few).count() == 2


def test_scores_in_single_precision_only_prune():
    """What is kept has exact cosines and the order by them, zeros and equal rows included."""
    rng = np.random.default_rng(7)
    m = rng.integers(-2, 3, (600, 16)).astype(float)
    m[:20], m[300:400] = 0, m[100:200]
    q = m[[0, 30, 150, 500]]
    lengths, ids = (q * q).sum(1), np.array([f"r{i}" for i in rng.permutation(600)], dtype=object)
    best = V.Best(25, 4)
    for i in range(0, 600, 70):
        x = m[i : i + 70]
        s = (x * x).sum(1)
        best.add(ids[i : i + 70], V._short(x, s) @ V._short(q, lengths).T, lambda row, query, x=x, s=s: V._cosines(x, s, q, lengths, row, query))
    held, query, value = best.held()
    for c in range(4):
        score = [a @ q[c] / math.sqrt((a @ a) * lengths[c]) if (a @ a) * lengths[c] > 0 else 0.0 for a in m]
        assert sorted((-round(v, 9), i) for v, i in zip(value[query == c], held[query == c])) == sorted((-round(v, 9), i) for v, i in zip(score, ids))[:25]


def test_ablation_asks_no_longer_list_than_its_arms(spark, monkeypatch):
    """The lexical list is lengthened only for an arm that filters it, and not made where no arm reads it."""
    index = retrieval.build_index(corpus.demo_corpus(spark))
    q = spark.createDataFrame([(1, "oldest mill built", "en", "demo-1")], "qid int, query string, lang string, gold string")
    asked, best = [], lexical.best
    monkeypatch.setattr(lexical, "best", lambda queries, chunks, k, *x: asked.append(k) or best(queries, chunks, k, *x))
    for arms in ([("a", ["C2"], False)], [("a", None, True)], [("a", ["C2"], True)]):
        r = evaluate.ablation(q, index, arms).first()
        assert (r.arm, r.n, r.recall_at_5, r.mrr_at_10) == ("a", 1, 1.0, 1.0)
    assert asked == [40, 240]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
@pytest.mark.parametrize("name", ["extract_answer", "recall_mrr", "prompt_build"])
def test_disk_of_searches(spark, tmp_path, name):
    """What a search stores and shuffles, the build of its index included, stays under four times the tables it reads."""
    from thornbill import tables
    from thornbill.plans.catalogue import QUERIES

    read = [f"/root/testdata/sf0.01/{t}.parquet" for t in ("chunks", "eval_set")]
    for f in read:
        os.symlink(f, tmp_path / os.path.basename(f))  # another path, so that the index is built here
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()

    before, had = shuffled(), len(tables._written.get(spark.sparkContext.applicationId, ()))
    rows = QUERIES[name](spark, str(tmp_path)).collect()
    new = [p.removeprefix("file:") for p in tables._written[spark.sparkContext.applicationId][had:]]
    stored = sum(os.path.getsize(f) for p in new for f in glob.glob(f"{p}/**/*.parquet", recursive=True))
    assert rows and stored
    assert shuffled() - before + stored < 4 * sum(map(os.path.getsize, read))
