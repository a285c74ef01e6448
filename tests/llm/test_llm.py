"""The text operators against brute force, exact round trips and their edge cases."""

import os
import random
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thornbill.llm import dedup, hashing, leakage, lookalike, pairs, pieces, sentences, spans, tokens

# ---------------------------------------------------------------- sentences


def model(*abbreviations, starters=()):
    return sentences.Model(abbreviations={("en", a) for a in abbreviations}, starters={("en", s) for s in starters})


def split(text, lang="en", m=None):
    return [text[a:b] for a, b in sentences.Splitter(m or sentences.Model()).split(text, lang)]


@pytest.mark.parametrize("text, lang, expected", [
    ("One. Two!  Three?", "en", ["One.", "Two!", "Three?"]),
    ("It is 12.8 m. Version v2.833.1 came.", "en", ["It is 12.8 m.", "Version v2.833.1 came."]),
    ("K. R. Yai drew it. The end", "en", ["K. R. Yai drew it.", "The end"]),
    ("“Is it open?” asked Ann. “Stop! It rains!” and he ran. Yes.", "en", ["“Is it open?” asked Ann.", "“Stop! It rains!” and he ran.", "Yes."]),
    ("A board says “Closed until 1827.” Nobody came.", "en", ["A board says “Closed until 1827.”", "Nobody came."]),
    ("(The toll was 2 coins.) Most paid.", "en", ["(The toll was 2 coins.)", "Most paid."]),
    ("Wait... did it rain? Yes.", "en", ["Wait... did it rain?", "Yes."]),
    ("a line\nbreak alone. Ends\n\nnot", "en", ["a line\nbreak alone.", "Ends\n\nnot"]),
    ("Worth it?Prices rose. See mill.example now.", "en", ["Worth it?", "Prices rose.", "See mill.example now."]),
    ("पहला है। दूसरा है | तीसरा है . चौथा", "hi", ["पहला है।", "दूसरा है |", "तीसरा है .", "चौथा"]),
    ("“खुला है?” राम ने पूछा। हाँ।", "hi", ["“खुला है?” राम ने पूछा।", "हाँ।"]),
    ("門は「止まれ。川だ。」と叫んだ。次。", "ja", ["門は「止まれ。川だ。」と叫んだ。", "次。"]),
    ("เดินไป 8 วัน หอคอยสวย มากๆ เลย", "th", ["เดินไป 8 วัน", "หอคอยสวย", "มากๆ เลย"]),
    ("", "en", []), (None, None, []), (" \n ", None, []), ("...", "en", ["..."]),
])
def test_sentences(text, lang, expected):
    assert split(text, lang) == expected


def test_abbreviations_end_a_sentence_only_before_a_starter():
    m = model("dr", "ltd", starters=("the",))
    assert split("Dr. Ann sold it to X Ltd. in 1817. To X Ltd. The end.", m=m) == ["Dr. Ann sold it to X Ltd. in 1817.", "To X Ltd.", "The end."]


def test_swapped_case():
    m = model("dr")
    assert split("wAIT... DID IT RAIN? dR. aNN SAID SO. tHE END", m=m) == ["wAIT... DID IT RAIN?", "dR. aNN SAID SO.", "tHE END"]


def test_quotations_of_any_length():
    inner = "It rains. Nobody came. " * 60
    for a, b in ("“”", "「」", '""', "()", "«»"):
        assert split(f"He wrote {a}{inner.strip()}{b} and left. Yes.") == [f"He wrote {a}{inner.strip()}{b} and left.", "Yes."]
    # A mark without its other mark is no quotation.
    assert split('He wrote "It rains. He "left" again. Yes.') == ['He wrote "It rains.', 'He "left" again.', "Yes."]
    deep = "(" * 3000 + "A. B" + ")" * 3000 + " c. D"
    assert len(split(deep)) == 1 and len(split(f"{deep} then. Even")) == 2


def test_collocations_keep_a_stop_inside():
    m = sentences.Model(collocations={("de", "## oktober"), ("en", "f kennedy")}, starters={("en", "kennedy")})
    assert split("Am 3. Oktober kam er. Im Jahr 1990. Danach nicht.", "de", m) == ["Am 3. Oktober kam er.", "Im Jahr 1990.", "Danach nicht."]
    assert split("John F. Kennedy ran.", m=m) == ["John F. Kennedy ran."]
    assert split("John F. Kennedy ran.", m=sentences.Model(starters={("en", "kennedy")})) == ["John F.", "Kennedy ran."]


def reduced(m, text, lang):
    """The part of a model that a text may ask for."""
    asked = sentences.questions(text, sentences.base_language(lang))
    return sentences.Model(*({x for x in kind if x in asked} for kind in (m.abbreviations, m.collocations, m.starters, m.lower)), m.cased)


WORDS = ["Mr", "mr", "Ｍｒ", "e.g", "12", "K", "dr", "No", "the", "The", "ends", "don't", "well-known", "м", "“so", "end”", "(at", "that)", "[Mr", "दिन", "है"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(WORDS), st.sampled_from([" ", ". ", ".", "? ", "... ", ".” ", '."', " ", "। "])), max_size=14), st.sampled_from(["en", "hi", None]), st.integers(0, 1 << 30))
def test_a_text_asks_for_all_it_needs(parts, lang, seed):
    r = random.Random(seed)
    text = "".join(w + s for w, s in parts)
    types = sorted({sentences.type_of(w) for w in WORDS} | {"e.g", "the"})
    entries = {(x, t) for x in ("en", "hi", "ru", "") for t in types}
    some = lambda of: {x for x in of if r.random() < 0.5}
    pairs = {(x, f"{a} {b}") for x in ("en", "hi", "") for a in types for b in types if len(a) <= 2}
    m = sentences.Model(some(entries), some(pairs), some(entries), some(entries), True)
    assert sentences.Splitter(reduced(m, text, lang)).split(text, lang) == sentences.Splitter(m).split(text, lang)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_both_ways_of_a_model_on_all_passages(spark):
    docs = sentences._passages(spark, "/root/testdata/sf0.01")
    rows = sentences.learn(docs).collect()
    m = sentences.Model.of([tuple(r) for r in rows])
    assert {r.kind for r in rows} >= {"a", "s", "l"}
    for _, text, lang in docs.collect():
        assert sentences.Splitter(reduced(m, text, lang)).split(text, lang) == sentences.Splitter(m).split(text, lang)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB1 .!?\n“”()।。ก \"'", max_size=60))
def test_sentences_cover_everything_but_space(text):
    got = sentences.Splitter(sentences.Model()).split(text)
    kept = "".join(text[a:b] for a, b in got)
    assert "".join(kept.split()) == "".join(text.split())
    assert all(a < b and text[a:b].strip() == text[a:b] for a, b in got)
    assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))


def test_learning(spark):
    random.seed(2)
    names = ["".join(random.choices("bdgklmnp", k=3)) + "a" for _ in range(300)]
    months = ["Maerz", "April", "Oktober"]
    dates = [(2000 + i, f"Am {random.randint(1, 28)}. {random.choice(months)} kam {random.choice(['Anna', 'Otto'])} mit dem Boot nach {random.choice(names)}. Es war schon sehr kalt im Jahr {random.randint(1900, 1999)}. {random.choice(['Der', 'Die', 'Das'])} Turm stand lange am Markt neben {random.choice(names)}. {random.choice(['Der', 'Die', 'Das'])} Hof brannte am Abend bis {random.choice(names)}.", "de", 0) for i in range(300)]
    german = {tuple(r) for r in sentences.learn(spark.createDataFrame(dates, "id long, text string, lang string, kind int")).collect()}
    tied, first = ({x for k, _, x in german if k == kind} for kind in "cs")
    assert tied >= {f"## {m.lower()}" for m in months} and not tied & {"## der", "## die", "## das"} and first >= {"der", "die", "das"}, (tied, first)
    verbs = ["ran", "swam", "slept", "sang", "read"]
    rows = []
    for i in range(200):
        text = " ".join(f"{random.choice(['The', 'A', 'Nobody'])} dog of Dr. {random.choice(names).title()} {random.choice(verbs)} near {random.choice(names)} mill." for _ in range(4))
        rows.append((i, text, "en", 0))
    docs = spark.createDataFrame([*rows, (900, None, None, 0), (901, " ", "en", 0)], "id long, text string, lang string, kind int")
    learned = {tuple(r) for r in sentences.learn(docs.where("text is not null")).collect()}
    assert ("a", "en", "dr") in learned and ("a", "en", "mill") not in learned and ("s", "en", "nobody") in learned
    got = sentences.split_sentences(docs, sentences.learn(docs.where("text is not null")))
    assert got.count() == 800 and not got.where("id >= 900").count()
    sentences.MODEL_ROWS, keep = 0, sentences.MODEL_ROWS
    try:
        joined = sentences.split_sentences(docs, sentences.learn(docs.where("text is not null")))
        assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, got.collect()))
    finally:
        sentences.MODEL_ROWS = keep
    assert sentences.split_sentences(docs.limit(0), sentences.learn(docs.limit(0))).count() == 0


# ---------------------------------------------------------------- pieces


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abc .!\n。", max_size=400), st.integers(20, 60), st.integers(0, 15))
def test_pieces(text, limit, overlap):
    got = pieces.cut(text, limit, overlap)
    if not text:
        assert got == []
        return
    assert got[0][0] == 0 and got[-1][1] == len(text) and all(0 < b - a <= limit for a, b, _ in got)
    assert all(y[0] == x[1] - overlap and y[1] > x[1] for x, y in zip(got, got[1:]))
    kinds = {k for _, _, k in got}
    assert ("forced" in kinds) == bool(len(text) > limit and pieces.stretches(text, limit))
    longest = max((b - a for a, b in pieces.stretches(text, 0)), default=0)
    if longest <= limit - 2 * overlap - 2:
        assert "squeezed" not in kinds


def test_unspaced_stops_are_boundaries():
    kinds = {k for _, _, k in pieces.cut("abcdefghi." * 200, 1200, 120)}
    assert kinds == {"stop", "end"}
    assert "forced" not in {k for _, _, k in pieces.cut("a" * 1150 + " " + "b" * 1150, 1200, 120)}
    assert {k for _, _, k in pieces.cut("x " + " " * 3000 + "y", 1200, 120)} == {"space", "end"}


def test_piece_rows(spark):
    rows = [("a", "x " * 700, (5, 1405)), ("a", "x " * 700, (5, 1405)), ("b", "y" * 1300, None), ("c", "short", (0, 5)), (None, "z " * 900, None), ("d", None, None), ("e", ("word. " * 300) + "w" * 1201, (0, 0))]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "chunk_id string, text string, char_span struct<start:int,end:int>, position int, row int")
    got = defaultdict(list)
    for r in pieces.oversized_pieces(df).orderBy("chunk_id", "position").collect():
        got[r.chunk_id].append(r)
    assert set(got) == {"a", "b", "e"}
    assert got["a"][0].char_span.start == 5 and got["b"][0].char_span is None and got["e"][0].char_span is None
    assert got["a"][1].char_span.start == got["a"][0].char_span.end - 120
    assert {k: any(x.ends == "forced" for x in v) for k, v in got.items()} == {"a": False, "b": True, "e": True}
    assert pieces.oversized_pieces(df.limit(0)).count() == 0


# ---------------------------------------------------------------- pairs

QUERY = "how long is the Rai canal"


@pytest.mark.parametrize("answer, lang, defect", [
    (None, "en", "empty"), ("", "en", "empty"), ("​ …", "en", "empty"), ("N/A", "hi", "empty"), ("[ ]", "en", "empty"),
    ("I'm afraid I cannot answer that.", "en", "refusal"), ("इस प्रश्न में सहायता करना संभव नहीं है।", "hi", "refusal"), ("抱歉，我无法回答这个问题。", "zh", "refusal"),
    ("Sorry tales aside, no one can answer for the old charts: It measures 4.8 km.", "en", None),
    ("HOW LONG IS THE RAI CANAL?", "en", "copy"), ("You asked: how long is the Rai canal", "en", "copy"), ("Asked how long is the Rai canal, most guides reply 12.7 km.", "en", None),
    ("Der Schacht reicht 791 Meter tief in den Berg.", "en", "language"), ("全長は72.4キロとされている。", "ta", "language"), ("居民共有755252人。", "ja", "language"),
    ("442 metres (रेलैदिदो in the local script)", "en", None), ("35.0 km", "hi", None), ("1861年", "ja", None),
])
def test_pair_rules(answer, lang, defect):
    assert pairs.examine(QUERY, answer, lang)["defect"] == defect


@pytest.mark.parametrize("answer, lang, expected", [
    ("The treaty does not include Norway.", "en", None), ("Patients are unable to say that they are ill.", "en", None), ("He said: Sorry, the shop is closed.", "en", None),
    ("Vegan food does not contain meat.", "en", None), ("The text does not include vowels.", "en", None), ("It is not certain who dug it.", "en", None), ("他不知道自己的父亲是谁。", "zh", None),
    ("The passages do not mention it.", "en", True), ("I don't know.", "en", True), ("我不知道。", "zh", True), ("不知道。", "zh", True), ("The mill is old.", "en", False), ("मुझे पता नहीं।", "hi", True),
])
def test_negative_answers_are_no_refusals(answer, lang, expected):
    assert pairs.refuses("who made it", answer, lang) is expected
    assert pairs.examine("who made it", answer, lang)["defect"] == ("refusal" if expected else None)


def test_what_only_the_corpus_shows(spark):
    r = random.Random(12)
    rows = [(i, f"how old is the {w} mill", f"The {w} mill is said to be {i} years of age and it was built by hand near the river.", "en") for i, w in enumerate(("".join(r.choices("bdgkmnprst", k=6)) for _ in range(150)))]
    rows += [(500 + i, f"who owns barn {w}", "That does not say anything at all.", "en") for i, w in enumerate("abc")] + [(510, "what is a treaty", "The treaty does not include Norway.", "en")]
    rows += [(520, "how old is the mill", "Vanha mylly rakennettiin joen rannalle kauan sitten käsin.", "en")]
    # A limit of 25 characters cuts many answers.
    rows += [(600 + i, f"who dug canal {i}", f"{w} dug it with their own two hands"[:25], "en") for i, w in enumerate(("".join(r.choices("bdgkmnprst", k=7)).title() for _ in range(30)))]
    df = spark.createDataFrame(rows, "id int, query string, answer string, lang string")
    got = {x.id: x.defect for x in pairs.broken_pairs(df).collect()}
    assert got == {500: "refusal", 501: "refusal", 502: "refusal", 520: "language"} | {600 + i: "truncated" for i in range(30)}
    spikes = pairs.length_spikes(pairs._examined(df)).collect()
    assert [(x.lang, x.length) for x in spikes] == [("en", 25)]


def test_truncated_pairs(spark):
    good = [(i, f"how long is the Ra{c} canal", f"The Ra{c} canal is {i}.5 km long and was surveyed in 19{i}.", "en") for i, c in enumerate("bcdfghjklmnp", 11)]
    odd = [
        (1, "how long is the Rab canal", "The Rab canal is 3", "en"), (2, "how long is the Rac canal", "The Rac can", "en"), (3, "q", "The canal is open. The Rac canal is…", "en"),
        (4, "how long is the Rad canal", "The Rad canal is 11.5 km long and was surveyed in 1911", "en"), (5, "q", "113 metres", "en"), (6, None, "Lantern", "en"), (7, "x", None, None),
    ]
    df = spark.createDataFrame(good + odd, "id int, query string, answer string, lang string").withColumn("mask", F.lit(1))
    got = {r.id: r.defect for r in pairs.broken_pairs(df).collect()}
    assert got == {1: "truncated", 2: "truncated", 3: "truncated", 7: "empty"}
    assert pairs.broken_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize("times", [1, 20])
def test_truncated_pairs_at_any_size(spark, times):
    rows = []
    for k in range(times):
        c = "".join("bcdfghjklm"[int(x)] for x in f"{k:03}")
        rows += [("", f"The Ra{c}{x} canal is {i}.5 km long and was surveyed in the old days.") for i, x in enumerate("npqrst", 11)]
        rows += [("cut", f"The Ra{c}{x} canal is {i}.") for i, x in enumerate("vw", 11)]
        rows += [("cut", f"The Ra{c}x canal is 12.5 km lo and was surv in"), ("", "Lantern"), ("", f"Nobody of {c} lives in a shed by the mill.")]
    rows += [("", f"A {w} stood where they came in.") for w in ("barn", "mill")]
    data = [(i, f"q {i}" if a == "Lantern" else f"about {a.split()[1]}", a, "en") for i, (_, a) in enumerate(rows)]
    got = {r.id: r.defect for r in pairs.broken_pairs(spark.createDataFrame(data, "id int, query string, answer string, lang string")).collect()}
    assert got == {i: "truncated" for i, (kind, _) in enumerate(rows) if kind}


def test_truncated_within_an_earlier_sentence(spark):
    rows = [
        (1, "about Rab", "The Rab canal is old. It was dug by hand near the mill. Nobody minds.", "en"), (2, "about Rac", "The Rac canal is old. It was dug by hand", "en"),
        (3, "about Rad", "A ferry sank when it was dug by hand.", "en"), (4, "about Raf", "The Raf canal is old. Nobody minds", "en"), (5, "about Rag", "A bell was dug by hand.", "en"),
    ]
    got = {r.id: r.defect for r in pairs.broken_pairs(spark.createDataFrame(rows, "id int, query string, answer string, lang string")).collect()}
    assert got == {2: "truncated"}


def test_shortened_across_ranges(spark):
    words = sorted({"".join(random.Random(i).choices("ab", k=random.Random(i).randint(1, 8))) for i in range(200)})
    df = spark.createDataFrame([("en", w) for w in words], "lang string, mask string")
    got = {r.mask: r.longer for r in pairs.shortened(df).collect()}
    assert got == {w: any(x != w and x.startswith(w) for x in words) for w in words}


# ---------------------------------------------------------------- copies


def test_copies_against_brute_force(spark):
    random.seed(3)
    base = ["One two", "three", "", None, "Ünï cödé"]
    rows = []
    for i in range(200):
        t = random.choice(base)
        rows.append((i, random.choice(["a-1", "A/1", " a 1", "b", None]), t if t is None else random.choice([t, t.upper(), f" {t}!", t.replace(" ", "\n")])))
    df = spark.createDataFrame([(*r, "z") for r in rows], "row_id int, passage_id string, text string, digest string")

    def canon(x):
        return None if x is None else "".join(c for c in x.upper().lower() if unicodedata.category(c)[0] in "LM" or unicodedata.category(c) == "Nd")

    groups = defaultdict(list)
    for i, p, t in rows:
        groups[canon(p), canon(t)].append(i)
    expected = sorted((g[0], x) for g in groups.values() for x in g[1:])
    assert sorted(map(tuple, dedup.duplicates(df, "row_id", ["passage_id", "text"]).collect())) == expected
    got = {r.first: r.n_copies for r in dedup.copies(df, "row_id", ["text", "passage_id"]).collect()}
    assert got == {g[0]: len(g) for g in groups.values()}
    assert dedup.duplicates(df.limit(0), "row_id", ["text"]).count() == 0


# ---------------------------------------------------------------- look-alikes


@pytest.mark.parametrize("a, b, same", [
    ("Ｅａｃｈ Ｄｒ.", "Each Dr.", True), ("café", "café", True), ("re­ach​", "reach", True), ("a b c", "a b c", True), ("Тhе Ζanu", "The Zanu", True),
    ("ﬁrst ⼈", "first 人", True), ("كي", "کی", True), ("ガ", "ガ", True), ("well‑worn", "well-worn", True), ("अा", "आ", True), ("Привет", "Привeт", True),
    ("a  b", "a b", False), ("café", "cafe", False), ("A", "a", False), ("x²", "x2", False), ("Привет", "Privet", False), ("o", "0", False),
])
def test_look_alikes(a, b, same):
    assert (lookalike.consistent_form(a) == lookalike.consistent_form(b)) is same


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(blacklist_categories=("Cs",)), st.sampled_from("eａȩ́́​аТ कि़ெளா각가")), max_size=30))
def test_form_is_stable_and_composed(text):
    form = lookalike.consistent_form(text)
    assert lookalike.consistent_form(form) == form
    assert lookalike.consistent_form(unicodedata.normalize("NFD", text)) == form


def test_alike_pairs(spark):
    rows = [("k", "a", "1", "reach"), ("k", "b", "2", "re­ach"), ("k", "c", "2", "reach"), ("k", "d", "3", "rеach"), ("j", "e", "4", "re­ach"), ("k", "f", None, "r­each"), ("k", "g", "5", None), ("k", "h", "6", "other"), ("k", "a", "1", "reach")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "kind string, key string, owner string, text string, form int")
    members = lookalike.alike_members(df)
    got = sorted((r.key_a, r.key_b) for r in lookalike.alike_pairs(members).collect())
    assert got == [("a", "b"), ("a", "d"), ("b", "d"), ("c", "d")]
    assert [(r.kind, r.n_texts, r.n_members, r.n_links) for r in lookalike.alike_classes(members).collect()] == [("k", 3, 4, 4)]
    none = lookalike.alike_members(df.limit(0))
    assert lookalike.alike_pairs(none).count() == 0 and lookalike.alike_classes(none).count() == 0
    assert {r.key: r.form for r in lookalike.with_form(df.select("key", "text"), "key", "text").collect()}["g"] is None


def test_alike_classes_of_boilerplate(spark):
    r = random.Random(7)
    ways = ["see the map", "s\u00adee the map", "see\u00a0the map", "sее the map"]
    rows = [("k", f"{i:05}", str(r.randint(0, 9)), r.choice(ways)) for i in range(300)] + [("k", "x", "x", "other"), ("j", "y", "1", ways[0]), ("j", "z", "1", ways[1])]
    members = lookalike.alike_members(spark.createDataFrame(rows, "kind string, key string, owner string, text string"))
    got = {x.kind: (x.n_texts, x.n_members, x.n_links) for x in lookalike.alike_classes(members).collect()}
    links = sum(a[2] != b[2] and a[3] != b[3] for n, a in enumerate(rows[:300]) for b in rows[:n])
    assert got == {"k": (4, 300, links), "j": (2, 2, 0)} and lookalike.alike_pairs(members).where("kind = 'k'").distinct().count() == links
    # Work follows the members: ten times as many give millions of links, but as many rows as writings and owners.
    many = spark.range(200_000).select(F.lit("k").alias("kind"), F.col("id").cast("string").alias("key"), (F.col("id") % 1000).cast("string").alias("owner"), F.element_at(F.array(*map(F.lit, ways)), (F.col("id") % 4 + 1).cast("int")).alias("text"))
    assert lookalike.alike_classes(lookalike.alike_members(many)).first().n_links == 200_000 * 150_000 // 2


# ---------------------------------------------------------------- tokens

try:
    VOCABULARY = tokens.read_vocabulary()
except OSError:
    VOCABULARY = None
needs_vocabulary = pytest.mark.skipif(VOCABULARY is None, reason="no vocabulary here")


@needs_vocabulary
@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_match_the_reference_encoder_and_decode(text):
    import tiktoken

    bpe = tokens.coder(tokens.serialise_model(VOCABULARY))
    reference = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks={t: i for i, t in enumerate(VOCABULARY)}, special_tokens={}) if not hasattr(tokens, "_reference") else tokens._reference
    tokens._reference = reference
    ids = bpe.encode(text)
    assert ids == reference.encode_ordinary(text) and bpe.decode(ids) == text


@needs_vocabulary
def test_id_rows(spark):
    long = "lorem ipsum " * 20_000
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "  \n", 0), (4, "<|endoftext|>", 0), (5, long, 0)], "doc_id int, text string, ids int")
    got = {r.doc_id: r.ids for r in tokens.encode_texts(df, "doc_id", "text").collect()}
    assert got[1] == [] and got[2] == [] and got[3] and 50256 not in got[4]
    back = tokens.decode_ids(tokens.encode_texts(df, "doc_id", "text"), "doc_id", "ids")
    assert {r.doc_id: r.text for r in back.collect()} == {1: "", 2: "", 3: "  \n", 4: "<|endoftext|>", 5: long}
    assert tokens.encode_texts(df.limit(0), "doc_id", "text").count() == 0


# ---------------------------------------------------------------- leaks


def test_leaks_against_brute_force(spark):
    random.seed(4)
    word = lambda: "".join(random.choices("abcde", k=random.randint(2, 5)))
    items = [(i, " ".join(word() for _ in range(random.randint(1, 14)))) for i in range(25)] + [(90, None), (91, "?!")]
    docs = []
    for i in range(120):
        t = [word() for _ in range(30)]
        source = random.choice(items[:25])[1].split()
        part = source[: max(1, len(source) * random.randint(3, 10) // 10)]
        docs.append((i, " ".join(t[:15] + [p.upper() + "," for p in part] + t[15:])))
    docs += [(900, None), (901, ""), (902, docs[0][1])]
    c = lambda x: "".join(ch for ch in (x or "").lower() if ch.isalnum())
    expected = set()
    for d, t in docs:
        for i, x in items:
            n, h = len(c(x)), (len(c(x)) + 1) // 2
            if n and any(c(x)[k : k + h] in c(t) for k in range(n - h + 1)):
                expected.add((d, i))
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc int, text string, item int")
    it = spark.createDataFrame([(*r, 1) for r in items], "item int, text string, doc int")
    one = leakage.seeded_pairs(df, it).where("2 * run >= n").where("score >= n")
    assert {(r.doc, r.item) for r in one.collect()} == expected
    leakage.BLOCK_CHARS, keep = 200, leakage.BLOCK_CHARS
    try:
        several = leakage.seeded_pairs(df, it).where("2 * run >= n")
        assert {(r.doc, r.item) for r in several.collect()} == expected
    finally:
        leakage.BLOCK_CHARS = keep
    assert leakage.seeded_pairs(df.limit(0), it).count() == 0
    assert leakage.seeded_pairs(df, it.limit(0)).count() == 0


def test_half_copies_behind_a_fragment(spark, tmp_path):
    r = random.Random(8)
    letters = lambda k: "".join(r.choices("abcdefgh", k=k))
    items = [(i, letters(100)) for i in range(30)]
    docs = [(i, letters(40) + t[60:80] + letters(50) + t[50:] + letters(40)) for i, t in items]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/test_items.parquet")
    assert sorted((x.doc_id, x.item_id) for x in leakage.p7_found(spark, str(tmp_path)).collect()) == [(i, i) for i in range(30)]


def test_edited_copies_are_aligned(spark, tmp_path):
    r = random.Random(6)
    letters = lambda k: "".join(r.choices("abcdefgh", k=k))
    items = [(i, letters(200)) for i in range(5)]
    docs, expected = [], set()
    for i, t in items:
        for every in (40, 25, 16):
            d = len(docs)
            docs.append((d, letters(90) + "".join("x" if j % every == every // 2 else c for j, c in enumerate(t)) + letters(90)))
            expected.add((d, i))
        docs.append((len(docs), letters(300) + t[20:60]))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/test_items.parquet")
    got = leakage.p7_alignments(spark, str(tmp_path)).collect()
    assert {(x.doc_id, x.item_id) for x in got} == expected
    texts, tests = dict(docs), dict(items)
    assert all(x.score == leakage.align(hashing.code_points(tests[x.item_id]), hashing.code_points(texts[x.doc_id])) for x in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abc", max_size=12), st.text(alphabet="abc", max_size=30)), max_size=9))
def test_alignments_of_several_pairs(pairs):
    a, b = ([hashing.code_points(x) for x in side] for side in (zip(*pairs) if pairs else ([], [])))
    assert list(leakage.alignments(a, b)) == [leakage.align(x, y) for x, y in zip(a, b)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc", max_size=12), st.text(alphabet="abc", max_size=12))
def test_alignment_against_brute_force(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            s = leakage.MATCH if a[i] == b[j] else leakage.MISMATCH
            h[i + 1][j + 1] = max(0, h[i][j] + s, h[i][j + 1] - leakage.GAP, h[i + 1][j] - leakage.GAP)
            best = max(best, h[i + 1][j + 1])
    assert leakage.align(hashing.code_points(a), hashing.code_points(b)) == best


# ---------------------------------------------------------------- spans


def brute_spans(docs, length):
    where = defaultdict(set)
    for d, t in docs:
        for i in range(len(t or "") - length + 1):
            where[t[i : i + length]].add(d)
    out = []
    for d, t in docs:
        runs = []
        for i in range(len(t or "") - length + 1):
            if len(where[t[i : i + length]]) > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + length
                else:
                    runs.append([i, i + length])
        out += [(d, a, b) for a, b in runs]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_spans_against_brute_force(spark, seed):
    r = random.Random(seed)
    stock = ["".join(r.choices("abcd क🙂", k=r.randint(10, 90))) for _ in range(6)]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(r.randint(1, 4)):
            s = r.choice(stock)
            a = r.randint(0, len(s) // 2)
            parts += [s[a : r.randint(a, len(s))], "".join(r.choices("wxyz", k=r.randint(0, 12)))]
        docs.append((i, "".join(parts)))
    docs += [(100, None), (101, ""), (102, "a" * 200), (103, "a" * 150), (104, "a" * 19), (105, "wx" * 80 + stock[0]), (106, stock[0] + stock[0])]
    df = spark.createDataFrame([(*x, 1, 1) for x in docs], "doc int, text string, mark int, parts int")
    got = sorted((x.doc, x.span_start, x.span_end) for x in spans.shared_spans(df, 20).collect())
    assert got == brute_spans(docs, 20)


def test_spans_repeated_in_other_surroundings(spark):
    r = random.Random(5)
    docs = []
    for i in range(0, 60, 2):
        passage, first, second = ("".join(r.choices("abcdefgh", k=k)) for k in (26, 60, 60))
        copied = first[:30] + passage + first[30:]
        docs += [(i, copied + second[:30] + passage + second[30:]), (i + 1, copied)]
    df = spark.createDataFrame(docs, "doc long, text string")
    got = sorted((x.doc, x.span_start, x.span_end) for x in spans.shared_spans(df, 20).collect())
    assert got == brute_spans(docs, 20)


def test_spans_in_blocks_and_empty(spark, monkeypatch):
    text = "".join(random.Random(9).choices("abcdef", k=700))
    whole = {(int(m), int(w)) for m, w, *_ in zip(*spans.segments_of(text, 40))}
    monkeypatch.setattr(spans, "BLOCK", 100)
    marks = {m for m, _ in whole}
    assert {int(m) for m in spans.segments_of(text, 40)[0]} == marks
    assert spans.segments_of("short", 40)[0].size == 0
    empty = spark.createDataFrame([], "doc long, text string")
    assert spans.shared_spans(empty, 20).count() == 0


def test_window_minima():
    x = np.random.default_rng(1).integers(0, 1000, 257).astype(np.uint64)
    for w in (1, 2, 7, 256, 257):
        assert list(hashing.window_minima(x, w)) == [min(x[i : i + w]) for i in range(len(x) - w + 1)]
    assert len(hashing.window_minima(x, 300)) == 0
