"""Text functions as column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from thornbill import config as C
from thornbill.tables import WS

WORD = r"[\p{L}\p{N}_]"
#: A border between a word character and anything else, in which combining marks are no word characters.
BORDER = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def clean(c: Column) -> Column:
    """White space runs of any kind become one space, the ends are stripped; null for null."""
    return F.trim(F.regexp_replace(c, f"[{WS}]+", " "))


def sentences(c: Column) -> Column:
    """Sentences of the cleaned text, split at white space behind a terminator; no sentence for blank, null for null."""
    return F.filter(F.split(clean(c), r"(?<=[.?!।॥۔]) "), lambda s: s != "")


def words(c: Column) -> Column:
    """White-space tokens; none for blank."""
    return F.filter(F.split(clean(c), " "), lambda s: s != "")


def tokens(c: Column) -> Column:
    """Lexical tokens: runs of letters, numbers and underscores, lower-cased one by one."""
    return F.transform(F.regexp_extract_all(c, F.lit(f"({WORD}+)"), F.lit(1)), lambda t: F.lower(t))


def base_lang(c: Column) -> Column:
    """Primary language tag in small letters, ``en`` for null."""
    return F.coalesce(F.lower(F.split_part(c, F.lit("-"), F.lit(1))), F.lit("en"))


def detect_lang(c: Column, default: str = "en") -> Column:
    """The language of the script with the most letters, the first seen on ties; the default where there is none or Latin
    letters are more."""
    found = []
    for tag, low, high in C.SCRIPT_BLOCKS:
        letter = rf"[\p{{L}}&&[\x{{{low:04x}}}-\x{{{high:04x}}}]]"
        found.append(F.struct(F.regexp_count(c, F.lit(letter)).alias("n"), (-F.regexp_instr(c, F.lit(letter))).alias("at"), F.lit(tag).alias("tag")))
    best = F.array_max(F.array(*found))
    latin = F.regexp_count(c, F.lit(r"[\p{L}&&[\x{0000}-\x{024f}]]"))
    return F.when((best["n"] > 0) & (best["n"] >= latin), best["tag"]).otherwise(F.lit(default))


def is_unsafe(c: Column) -> Column:
    return c.rlike(rf"(?i){BORDER}(?:{C.UNSAFE}){BORDER}")


def is_contentless(c: Column) -> Column:
    """Blank, a filler as a whole, fewer than two tokens, or fillers only."""
    filler = F.array(*map(F.lit, C.FILLER))
    whole = F.regexp_replace(F.lower(F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")), "^[!?.,। ]+|[!?.,। ]+$", "")
    t = tokens(c)
    return (whole == "") | F.array_contains(filler, whole) | (F.size(t) < 2) | F.forall(t, lambda x: F.array_contains(filler, x))


def check_input(text: Column, stt_confidence: Column, floor: float = C.STT_FLOOR) -> Column:
    """The first reason to refuse a question, null for none. A null confidence passes; a null text is contentless."""
    text = F.coalesce(text, F.lit(""))
    return F.when(stt_confidence < floor, "low_stt_confidence").when(is_unsafe(text), "unsafe").when(is_contentless(text), "contentless")


def sanitize(c: Column) -> Column:
    """Instructions that ride in on a passage are replaced."""
    return F.regexp_replace(c, f"(?i){C.INJECTION}", C.REDACTED.replace("$", r"\$"))


def needs_synthesis(query: Column, confidence: Column) -> Column:
    """Comparing or summarising phrases, long conjunctive questions, or a weak answer."""
    q = F.lower(query)
    cue = F.exists(F.array(*map(F.lit, C.SYNTHESIS_CUES)), lambda x: F.contains(q, x))
    joined = F.exists(F.array(*map(F.lit, C.CONJUNCTIONS)), lambda x: F.contains(q, x))
    return cue | ((F.size(words(q)) > C.SYNTHESIS_WORDS) & joined) | (confidence < C.SYNTHESIS_FLOOR)


# What a question asks for, and what shows that a sentence has it.
_SPACE = f"[{WS}]"
INTENTS = (
    ("when|what year|कब|எப்போது", rf"{BORDER}(?:1[5-9]\p{{Nd}}{{2}}|20\p{{Nd}}{{2}}){BORDER}"),
    ("how many|how much|कितन|எவ்வளவு", r"\p{Nd}"),
    ("cost|price|salary|कीमत|விலை", rf"[$₹€£]{_SPACE}?\p{{Nd}}|{BORDER}\p{{Nd}}+(?:[.,]\p{{Nd}}+)?{_SPACE}?(?:crore|lakh|million|billion|percent|%)"),
    ("who|किसने|कौन|யார்", rf"{BORDER}[A-Z][a-z]+{_SPACE}+[A-Z][a-z]+{BORDER}"),
)


def intent_bonus(query: Column, sentence: Column) -> Column:
    """0.08 for each kind of fact that is asked for and found, 0.16 at most."""
    hits = sum((F.when(query.rlike(rf"(?iu){BORDER}(?:{trigger}){BORDER}") & sentence.rlike(evidence), 1).otherwise(0) for trigger, evidence in INTENTS), F.lit(0))
    return F.when(hits >= 2, F.lit(0.16)).when(hits == 1, F.lit(0.08)).otherwise(F.lit(0.0))


def overlap(query_tokens: Column, sentence: Column) -> Column:
    """The share of the query's distinct tokens that the sentence has; 0 if either has none."""
    q, s = F.array_distinct(query_tokens), F.array_distinct(tokens(sentence))
    return F.when((F.size(q) > 0) & (F.size(s) > 0), F.size(F.array_intersect(q, s)) / F.size(q)).otherwise(F.lit(0.0))


def prompt(query: Column, texts: Column) -> Column:
    """The numbered, sanitised context and the question."""
    lines = F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), sanitize(t)))
    return F.concat(F.lit("<context>\n"), F.array_join(lines, "\n"), F.lit("\n</context>\n\nQuestion: "), query)


def cites(answer: Column) -> Column:
    """Whether a generated answer may be used: it cites, and doesn't say that the context lacks the answer."""
    return ~F.contains(answer, F.lit("NOT_IN_CONTEXT")) & answer.rlike(r"\[\p{Nd}+\]")


def generated_text(response: Column) -> Column:
    """The text of a generator's JSON response; null where it has none."""
    return F.get_json_object(response, "$.candidates[0].content.parts[0].text")


def speech_confidence(logprobs: Column, text: Column) -> Column:
    """Mean log-probability plus one, one at most; without any, 1 for a text and 0 for none."""
    n = F.size(logprobs)
    mean = F.aggregate(logprobs, F.lit(0.0), lambda s, x: s + x) / n
    return F.when(n > 0, F.least(F.lit(1.0), mean + 1)).otherwise(F.when(F.coalesce(text, F.lit("")) != "", 1.0).otherwise(0.0))


def language_tag(code: Column, tags: dict[str, str], default: str | None = None) -> Column:
    """The tag of a language code by a fixed table."""
    table = F.create_map(*(F.lit(x) for kv in tags.items() for x in kv))
    return F.coalesce(F.try_element_at(table, code), F.lit(default))


def bar_width(ms: Column, budget: Column) -> Column:
    """Per cent of the budget that a stage's bar fills: 1.5 at least, 100 at most."""
    return F.least(F.lit(100.0), F.greatest(F.lit(1.5), ms / budget * 100))
