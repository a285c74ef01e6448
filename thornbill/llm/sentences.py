"""Sentence boundaries across languages and scripts.

Abbreviations, collocations and sentence starters are learned from the texts themselves, language by language, with
log-likelihood ratios (after Kiss and Strunk, 2006): an abbreviation nearly always has its stop, is short, and hardly ever
stands at the end of a text; a collocation is a number or an initial with a word that follows its stop more often than
chance, though that word begins no sentences elsewhere; a starter follows sure ends more often than chance. Every stop is
then classified with these statistics, the shape of its token, the quotation or bracket it stands in and the letter case
around it. Other terminators, quotations and Thai spaces need no statistics.
"""

from __future__ import annotations

import bisect
import functools
import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thornbill.llm.lookalike import INVISIBLE, former
from thornbill.tables import durable, is_blank, table

#: The language that is assumed for a script where the row's own language has another script.
SCRIPT_LANGUAGE = {"LATIN": "en", "DEVANAGARI": "hi", "BENGALI": "bn", "TAMIL": "ta", "TELUGU": "te", "ARABIC": "ur", "THAI": "th", "HAN": "zh", "KANA": "ja", "CYRILLIC": "ru", "GREEK": "el", "HANGUL": "ko"}
_SCRIPTS = {"LATIN": r"\p{Latin}", "DEVANAGARI": r"\p{Devanagari}", "BENGALI": r"\p{Bengali}", "TAMIL": r"\p{Tamil}", "TELUGU": r"\p{Telugu}", "ARABIC": r"\p{Arabic}", "THAI": r"\p{Thai}", "KANA": r"\p{Hiragana}\p{Katakana}", "HAN": r"\p{Han}", "CYRILLIC": r"\p{Cyrillic}", "GREEK": r"\p{Greek}", "HANGUL": r"\p{Hangul}"}
#: Languages written in Latin letters: rows of them keep their own statistics.
LATIN_LANGUAGES = frozenset("en de fr es it pt nl sv da no nb nn fi pl cs sk sl hr ro hu tr id ms vi sw et lv lt ca eu gl af sq is ga cy mt tl".split())
#: Rows of a learned model that travel with the code; of a larger one each text gets, by a join, the entries it may ask for.
#: Both ways give the same sentences.
MODEL_ROWS = 50_000
ABBREVIATION_SCORE, COLLOCATION_RATIO, STARTER_RATIO = 0.3, 7.88, 30.0
#: Characters of the longest abbreviation; a longer token is none.
TOKEN = 60

_STOPS = ".!?。！？।॥۔؟|…．｡"
_SP = r"[\s\u0085\u001c-\u001f]"
_INV = regex.escape(INVISIBLE) + "‌‍"
_CLOSERS = "”’»」』）)\\]】\"'"
_OPENERS = "“‘«「『（(\\[【\"'"
_TERM = regex.compile(rf"[{regex.escape(_STOPS)}](?:[{_INV}]*[{regex.escape(_STOPS)}])*[{_INV}]*")
_AFTER = regex.compile(rf"[{_CLOSERS}{_INV}]*")
_NEXT = regex.compile(rf"(?:{_SP}|[{_INV}])*")
_OPEN = regex.compile(rf"[{_OPENERS}{_INV}]*")
_WORD = regex.compile(rf"[\p{{L}}\p{{M}}](?:[\p{{L}}\p{{M}}{_INV}]|['’\-](?=\p{{L}}))*")
_FOLLOWING = regex.compile(f"({_AFTER.pattern})({_NEXT.pattern})({_OPEN.pattern})({_WORD.pattern})?")
_TOKEN_BORDER = regex.compile(rf"(?r)[\s{_OPENERS}{_CLOSERS},;:–—]")
_NUMBER_BEFORE = regex.compile(rf"\p{{Nd}}{_SP}$")
_LATIN_WORD = regex.compile(r"\p{Latin}[\p{Latin}\p{M}]+")
_THAI = regex.compile(r"\p{Thai}")
_PAIRS = {"“": "”", "「": "」", "『": "』", "«": "»", "（": "）", "(": ")"}
_BRACKETS = "(（"


@lru_cache(maxsize=100_000)
def language_of(word: str, lang: str) -> str:
    """The language whose statistics a word belongs to: the row's if it is of the word's script, else the script's."""
    for name, chars in _SCRIPT_TESTS:
        if chars.search(word):
            if name == "LATIN":
                return lang if lang in LATIN_LANGUAGES else "en"
            if name == "ARABIC" and lang in ("ar", "fa", "ps", "sd"):
                return lang
            if name == "DEVANAGARI" and lang in ("mr", "ne", "sa"):
                return lang
            return SCRIPT_LANGUAGE[name]
    return lang


_SCRIPT_TESTS = [(k, regex.compile(f"[{v}]")) for k, v in _SCRIPTS.items()]


def base_language(lang: str | None) -> str:
    """``en`` for ``EN`` and ``en-IN``; the empty string for null."""
    return (lang or "").replace("_", "-").split("-")[0].strip().lower()


@lru_cache(maxsize=100_000)
def type_of(token: str) -> str:
    """A token as it is counted: in its consistent form, without case; numbers are all one type."""
    t = former().form(token).strip("".join(dict.fromkeys("“”‘’«»「」『』（）()[]【】\"',;:–—")))
    if t and t[0].isdigit() and not any(c.isalpha() for c in t):
        return "##"
    return t.lower()


@dataclass
class Model:
    """``abbreviations``, ``collocations`` (two types with a space between) and ``starters`` hold ``(language, type)``;
    ``lower`` the words that mostly have a small letter. ``cased`` says whether the whole model has any such word."""

    abbreviations: set = field(default_factory=set)
    collocations: set = field(default_factory=set)
    starters: set = field(default_factory=set)
    lower: set = field(default_factory=set)
    cased: bool = False

    @classmethod
    def of(cls, rows, cased: bool | None = None) -> "Model":
        m = cls()
        for kind, lang, type_ in rows:
            {"a": m.abbreviations, "c": m.collocations, "s": m.starters, "l": m.lower}[kind].add((lang, type_))
        m.cased = bool(m.lower) if cased is None else cased
        return m


# ---------------------------------------------------------------- statistics

_BARE = "”’»」』）)]】\"'" + INVISIBLE
_SPACE_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c != " ")


def count_token(token: str, after: str | None, lang: str, n: int, counts: Counter) -> None:
    """Adds the statistics of ``n`` equal tokens of one language: ``(language, kind, type, next type)`` → number. ``after`` is
    the next token, empty at the end of the text; it is only looked at behind a stop.

    Kinds: w a token; p a token with a single stop behind it (next type empty at the end of the text, ``<`` before it for
    a small letter); t a sure end and the type behind it; e an end (``$`` at the end of the text); c a word with a small
    (next type l) or capital letter (u).
    """
    kind = type_of(token)
    bare = token.rstrip(_BARE)
    stop = len(bare) > 0 and bare[-1] in _STOPS
    name = kind.rstrip(_STOPS) if stop else kind
    if not name:
        return
    own = language_of(name, lang)
    counts[own, "w", name, ""] += n
    if name.isalpha() and name.isascii():
        counts[own, "c", name, "l" if token.lstrip("“‘(\"'")[:1].islower() else "u"] += n
    if not stop:
        return
    following = type_of(after).rstrip(_STOPS) if after else ""
    if bare[-1] == "." and not bare.endswith(".."):
        counts[own, "p", name, ("<" if after and after[:1].islower() else "") + following] += n
    elif following and bare == token and not bare.endswith(("..", "…")):
        counts[language_of(following, lang), "t", "", following] += n
    counts[own, "e", "", "" if after else "$"] += n


def statistics(docs: DataFrame) -> DataFrame:
    """``lang, kind, a, b, n`` over all rows of ``docs`` (``text, lang``).

    Tokens, each behind which a stop may stand with the one that follows, are counted as they are written, with map-side
    combining; Python sees each distinct one once, brings it to its type, and the types' counts are added up.
    """
    closing = _STOPS + _BARE
    stop = F.substring("token", -1, 1).isin(list(closing)) & F.col("token").rlike(f"[{_STOPS}][{_BARE.replace(']', chr(92) + ']')}]*$")
    t = docs.select("lang", F.filter(F.split(F.translate("text", _SPACE_CHARS, " " * len(_SPACE_CHARS)), " "), lambda x: x != "").alias("t"))
    t = t.select("lang", F.explode(F.arrays_zip(F.col("t").alias("token"), F.slice("t", F.lit(2), F.size("t")).alias("after"))).alias("w")).select("lang", "w.token", F.coalesce("w.after", F.lit("")).alias("after"))
    t = t.groupBy("lang", "token", F.when(stop, F.col("after")).alias("after")).agg(F.count(F.lit(1)).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(counts)
            out = pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(4)), pa.array([counts[k] for k in keys], pa.int64())], names=["lang", "kind", "a", "b", "n"])
            counts.clear()
            return out

        for batch in batches:
            for lang, token, after, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                count_token(token, after, base_language(lang), n, counts)
            if len(counts) > 300_000:
                yield flush()
        yield flush()

    return t.mapInArrow(run, "lang string, kind string, a string, b string, n long").groupBy("lang", "kind", "a", "b").agg(F.sum("n").alias("n"))


def _dunning(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """Twice the log-likelihood ratio of ``b`` depending on a preceding ``a``, both counted, ``ab`` together, among ``n``."""
    clip = lambda p: F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    both = lambda k, m, p: k * F.log(p) + (m - k) * F.log(1 - p)
    p, p1, p2 = clip(b / n), clip(ab / a), clip((b - ab) / F.greatest(n - a, F.lit(1.0)))
    return 2 * (both(ab, a, p1) + both(b - ab, n - a, p2) - both(ab, a, p) - both(b - ab, n - a, p))


def learn(docs: DataFrame) -> DataFrame:
    """``kind, lang, type``: the abbreviations (a), collocations (c, two types with a space between), sentence starters (s)
    and small words (l) of each language."""
    counts = durable(statistics(docs))
    langs = counts.groupBy("lang").agg(
        F.sum(F.when(F.col("kind") == "w", F.col("n"))).cast("double").alias("N"),
        F.coalesce(F.sum(F.when(F.col("kind") == "p", F.col("n"))), F.lit(0)).cast("double").alias("P"),
        F.coalesce(F.sum(F.when(F.col("kind") == "e", F.col("n"))), F.lit(0)).cast("double").alias("E"),
        F.coalesce(F.sum(F.when((F.col("kind") == "e") & (F.col("b") == "$"), F.col("n"))), F.lit(0)).cast("double").alias("R"),
    )
    langs = durable(langs)
    kind = lambda k: F.when(F.col("kind") == k, F.col("n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    types = durable(counts.where("kind in ('w', 'p', 'c')").groupBy("lang", F.col("a").alias("type")).agg(
        total(kind("w")).alias("all"), total(kind("p")).alias("with"), total(F.when(F.col("b") == "", kind("p"))).alias("last"), total(F.when(F.col("b").startswith("<"), kind("p"))).alias("small"),
        total(kind("c")).alias("n"), total(F.when(F.col("b") == "l", kind("c"))).alias("l"),
    ))
    words, stops = types.where("all > 0").select("lang", "type", "all"), types.where("with > 0").select("lang", "type", "with", "last", "small")
    t = types.where("with > 0 and all > 0").drop("n", "l").join(langs, "lang")
    p1 = F.least(F.greatest(F.col("P") / F.col("N"), F.lit(1e-6)), F.lit(0.9))
    k, n = F.col("with"), F.greatest("all", "with")
    ratio = 2 * (k * F.log(F.lit(0.99) / p1) + (n - k) * F.log(F.lit(0.01) / (1 - p1)))
    inner = F.length(F.regexp_replace("type", "[^.]", ""))
    letters = F.greatest(F.length("type") - inner, F.lit(1))
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters, -(n - k))
    # Against being an ordinary last word: how rarely the type ends a text, next to how often ends of sentences do so.
    rate = F.least(F.greatest(F.col("R") / F.greatest("E", F.lit(1.0)), F.lit(0.05)), F.lit(0.5))
    final = F.col("last") * F.log(rate / 0.02) + (k - F.col("last")) * F.log((1 - rate) / 0.98) - F.col("small") * 0.5
    abbreviations = durable(t.where((F.col("type") != "##") & (score >= ABBREVIATION_SCORE) & (final < 0)).select("lang", "type"))

    # Whether a number or an initial ends a sentence is open.
    follow = counts.where("kind = 'p' and b <> '' and not startswith(b, '<') and a <> '##' and length(replace(a, '.', '')) <> 1").join(abbreviations.withColumnRenamed("type", "a"), ["lang", "a"], "left_anti").select("lang", F.col("b").alias("type"), "n")
    starts = durable(follow.unionByName(counts.where("kind = 't'").select("lang", F.col("b").alias("type"), "n")).groupBy("lang", "type").agg(F.sum("n").cast("double").alias("first")))
    s = starts.join(words, ["lang", "type"]).join(langs, "lang").where("type <> '##' and type <> ''")
    base = F.least(F.greatest(F.col("E") / F.col("N"), F.lit(1e-6)), F.lit(0.9))
    n, k = F.greatest("all", "first"), F.col("first")
    p = F.least(F.greatest(k / n, F.lit(1e-6)), F.lit(1 - 1e-6))
    ratio = 2 * (k * F.log(p / base) + (n - k) * F.log((1 - p) / (1 - base)))
    starters = durable(s.where((p > 2 * base) & (ratio >= STARTER_RATIO) & (k >= 5)).select("lang", "type"))
    # What is mostly followed by starters is an ordinary last word after all.
    behind = counts.where("kind = 'p'").join(abbreviations.withColumnRenamed("type", "a"), ["lang", "a"]).join(starters.select("lang", F.col("type").alias("b"), F.lit(1).alias("hit")), ["lang", "b"], "left")
    ordinary = behind.groupBy("lang", F.col("a").alias("type")).agg((F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0)) / F.sum("n")).alias("share")).where("share >= 0.4").select("lang", "type")
    abbreviations = abbreviations.join(ordinary, ["lang", "type"], "left_anti")
    lower = types.where("n >= 5 and l > 0.6 * n").select("lang", "type")
    # A number or an initial and what follows its stop, more often than it stands anywhere, and than it stands behind stops: a
    # word that begins sentences is tied to no number, nor is a word of small letter that has a capital there. Numbers end
    # sentences often, so they need as much as a starter does.
    pairs = counts.where("kind = 'p' and ltrim('<', b) <> ''").groupBy("lang", F.col("a").alias("left"), F.expr("ltrim('<', b)").alias("type")).agg(F.sum("n").cast("double").alias("ab"), F.sum(F.when(F.col("b").startswith("<"), F.col("n")).otherwise(0)).alias("small"))
    pairs = pairs.where("left = '##' or length(replace(left, '.', '')) = 1").where("type <> '##'").join(starters, ["lang", "type"], "left_anti")
    pairs = pairs.join(stops.select("lang", F.col("type").alias("left"), F.col("with").alias("a")), ["lang", "left"]).join(words.withColumnRenamed("all", "b"), ["lang", "type"]).join(langs.select("lang", "N", "E"), "lang")
    pairs = pairs.join(starts, ["lang", "type"], "left").join(lower.withColumn("low", F.lit(True)), ["lang", "type"], "left")
    a, b, ab, first = F.col("a"), F.col("b"), F.col("ab"), F.greatest(F.coalesce("first", F.lit(0.0)), F.col("ab"))
    ratio = F.least(_dunning(a, b, ab, F.col("N")), _dunning(a, first, ab, F.greatest("E", "a")))
    tied = (ab > 1) & (b >= ab) & (ab / a > F.greatest(b / F.col("N"), first / F.col("E"))) & (F.col("low").isNull() | (F.col("small") > ab / 2))
    number = F.col("left") == "##"
    collocations = pairs.where(tied & (number & (ab >= 5) & (ratio >= STARTER_RATIO) | ~number & (ratio >= COLLOCATION_RATIO))).select("lang", F.concat_ws(" ", "left", "type").alias("type"))
    kinds = {"a": abbreviations, "c": collocations, "s": starters, "l": lower}
    return functools.reduce(DataFrame.unionByName, (v.select(F.lit(k).alias("kind"), "lang", "type") for k, v in kinds.items()))


# ---------------------------------------------------------------- classification


_BLANK = regex.compile(rf"{_SP}*")
_REST = regex.compile(rf"(?:{_SP}|[\"'“”‘’{_INV.removesuffix('‌‍')}])*")
_MARKS = regex.compile("[“”‘’「」『』«»（）()\"]")


def _opens(text: str, i: int) -> bool | None:
    """Whether the straight mark at a place can only open (True) or only close (False); None where both can be."""
    before, behind = text[i - 1 : i], text[i + 1 : i + 2]
    left, right = not before or before.isspace() or before in _OPENERS, not behind or behind.isspace()
    return None if left == right else left


class Enclosures:
    """Quotations and brackets of a text, ``start, end, opener``, ends exclusive; one without its other mark is none."""

    def __init__(self, text: str):
        spans: list[tuple[int, int, str]] = []
        straight = -1
        stack: list[tuple[str, int]] = []
        for m in _MARKS.finditer(text):
            i, c = m.start(), m.group()
            if c == '"':
                # A mark that can only open, within an open quotation, says that the first one has lost its end.
                if straight >= 0 and _opens(text, i) is not True:
                    spans.append((straight, i + 1, '"'))
                    straight = -1
                elif straight >= 0 or _opens(text, i) is not False:
                    straight = i
            elif c in _PAIRS or c == "‘":
                stack.append((c, i))
            elif c == "’":
                if stack and stack[-1][0] == "‘" and not (text[i + 1 : i + 2].isalpha() and text[i - 1 : i].isalpha()):
                    spans.append((stack.pop()[1], i + 1, "‘"))
            else:
                for k in range(len(stack) - 1, -1, -1):
                    if _PAIRS.get(stack[k][0]) == c:
                        spans.append((stack[k][1], i + 1, stack[k][0]))
                        del stack[k:]
                        break
        self.spans = sorted(spans)
        self.starts = [a for a, _, _ in self.spans]
        self.outer = []  # the number of the innermost one that holds a span's start
        for k, (start, _, _) in enumerate(self.spans):
            self.outer.append(self._holding(k - 1, start))

    def _holding(self, k: int, place: int) -> int:
        while k >= 0 and not self.spans[k][0] < place < self.spans[k][1]:
            k = self.outer[k]
        return k

    def around(self, place: int) -> tuple[int, int, str] | None:
        """The innermost enclosure of a place."""
        k = self._holding(bisect.bisect_right(self.starts, place) - 1, place)
        return self.spans[k] if k >= 0 else None

    def next_after(self, place: int) -> list[tuple[int, int, str]]:
        """The three enclosures that begin next, from a place on."""
        k = bisect.bisect_left(self.starts, place)
        return self.spans[k : k + 3]


class Case:
    """What capital letters mean around a place of a text: usual, swapped, title (all words have one), or none."""

    def __init__(self, text: str):
        self.text = text
        self.known: dict[int, str] = {}

    @staticmethod
    def _kind(w: str) -> str:
        if w.islower():
            return "l"
        if w.isupper():
            return "U"
        if w[0].isupper() and w[1:].islower():
            return "T"
        return "s" if w[0].islower() and w[1:].isupper() else "x"

    def _kinds(self, place: int = 0) -> Iterator[str]:
        return (self._kind(m.group()) for m in _LATIN_WORD.finditer(self.text, place))

    @functools.cached_property
    def swapped(self) -> bool:
        return "s" in self._kinds()

    @functools.cached_property
    def capital(self) -> bool:
        return any(k in "Tx" for k in self._kinds())

    @functools.cached_property
    def last(self) -> list[str]:
        return list(self._kinds())[-6:]

    def mode(self, place: int) -> str:
        if (found := self.known.get(place)) is None:
            near = list(itertools.islice(self._kinds(place), 6)) or self.last
            if "s" in near or near.count("U") > near.count("l"):
                found = "swapped" if self.swapped else "none"
            elif "l" in near:
                found = "usual" if self.capital else "none"
            else:
                found = "title"
            self.known[place] = found
        return found


@dataclass(slots=True)
class Place:
    """A place where a sentence may end: the terminators ``start:end``, ``after`` them and their closing marks, what follows
    from ``nxt`` on, its first word (begun at ``first``), and for one in a quotation or bracket that it closes, ``inside``."""

    start: int
    end: int
    run: str
    after: int
    nxt: int
    first: int
    word: str | None
    inside: tuple[int, int, str] | None
    quoted: int  # where that quotation or bracket begins


def places(text: str, spans: Enclosures) -> Iterator[Place]:
    """All places where a sentence may end, whatever the model says."""
    form = former().form
    for m in _TERM.finditer(text):
        start, end = m.span()
        begun = inside = spans.around(start)
        if inside:
            # Only right before the closing mark can a sentence end, and then behind that mark.
            if _REST.match(text, end).end() < inside[1] - 1:
                continue
            after = inside[1]
            outer = spans.around(inside[0])
            if outer:
                if _BLANK.match(text, after).end() < outer[1] - 1:
                    continue
                after, inside = outer[1], outer
            after = _AFTER.match(text, after).end() if text[after : after + 1] in ")）”’」』" else after
            nxt = _NEXT.match(text, after).end()
            if nxt == len(text) or text[nxt] in _STOPS or text[nxt] in ",;:，、；：":
                continue
        else:
            f = _FOLLOWING.match(text, end)
            after, nxt = f.end(1), f.end(2)
            # A straight or single mark behind the stop may open what follows.
            while after > end and any(a < after <= b and a >= end for a, b, _ in spans.next_after(end)):
                after -= 1
            if after < f.end(1):
                nxt = _NEXT.match(text, after).end()
            if nxt == len(text) or text[nxt] in ",;:，、；：" and nxt == after:
                continue
        if inside or after < f.end(1):
            first = _OPEN.match(text, nxt).end()
            word = _WORD.match(text, first)
            word = word and word.group()
        else:
            first, word = f.end(3), f.group(4)
        yield Place(start, end, form(m.group()), after, nxt, first, word, inside, begun[0] if begun else -1)


def token_before(text: str, begun: int, start: int) -> str:
    """The token before a stop, of a sentence begun at ``begun``; of one longer than any abbreviation, its end."""
    low = max(begun, start - TOKEN - 1)
    border = _TOKEN_BORDER.search(text, low, start)
    return text[border.end() if border else low : start]


def questions(text: str, lang: str) -> set[tuple[str, str]]:
    """``(language, type)`` of all entries that a model may be asked for when a text is split, whatever it answers."""
    out: set[tuple[str, str]] = set()
    ends: list[int] = [0]
    for p in places(text, Enclosures(text)):
        right = []
        if p.word:
            plain = former().form(p.word)
            right = [plain.lower(), type_of(p.word)]
            out.update((language_of(t, lang), t) for t in right)
            out.add((language_of(plain, lang), plain.lower()))
        if set(p.run) <= {"."}:
            # The sentence may have begun behind any earlier place, or anywhere before the token.
            for begun in {0, *(e for e in ends if p.start - TOKEN - 1 < e <= p.start)}:
                token = token_before(text, begun, p.start)
                left = former().form(token.rsplit(".", 1)[-1])
                for t in {type_of(token), type_of(left), *([type_of(f"{left}.{p.word}")] if p.word else ())}:
                    out.add((language_of(t, lang), t))
                    out.update((language_of(t, lang), f"{t} {r}") for r in right)
        ends = [*ends[-TOKEN:], p.after]
    return out


class Splitter:
    def __init__(self, model: Model):
        self.model = model

    def _begins(self, word: str, place: int, case: Case, lang: str) -> bool | None:
        """Whether a word looks like the first of a sentence; None where that can't be seen."""
        plain = former().form(word)
        if not _LATIN_WORD.match(plain) and not (plain[:1].isascii() and plain[:1].isalpha()):
            return None
        mode = case.mode(place)
        key = (language_of(plain, lang), plain.lower())
        if mode == "none":
            return True if key in self.model.starters else False if key in self.model.lower else None
        if mode == "title" and key in self.model.lower and key not in self.model.starters:
            return False
        if plain[0].isupper() == (mode != "swapped"):
            return True
        # A small letter where the corpus has a capital says that case means nothing here.
        return False if key in self.model.lower or not self.model.cased else None

    def _abbreviation(self, token: str, lang: str) -> bool:
        t = type_of(token)
        bare = t.replace(".", "")
        if len(bare) == 1 and bare.isalpha():
            return True
        return (language_of(t, lang), t) in self.model.abbreviations

    def _starts(self, word: str, lang: str) -> bool:
        t = type_of(word)
        return (language_of(t, lang), t) in self.model.starters

    def _collocated(self, token: str, word: str, lang: str) -> bool:
        left = type_of(token)
        return (language_of(left, lang), f"{left} {type_of(word)}") in self.model.collocations

    def _stop(self, text: str, begun: int, p: Place, begins: bool | None, case: Case, lang: str) -> bool:
        """Whether the single stop at a place, of a sentence begun at ``begun``, ends it."""
        token = token_before(text, begun, p.start)
        previous, follows = text[p.start - 1 : p.start], text[p.nxt : p.nxt + 1]
        if p.end == p.after == p.nxt == p.first:  # nothing between the stop and what follows
            if follows.isdigit() and previous.isdigit():
                return False
            left = former().form(token.rsplit(".", 1)[-1])
            if not left or not (follows.isalnum() or follows in _OPENERS):
                return False
            if left.isdigit():
                return p.word is not None and begins is not False
            if self._abbreviation(token if "." in token else left, lang):
                return False
            if len(left) < 3:
                if _LATIN_WORD.match(left + "aa"):
                    return begins is True and "." in token and left.islower()
                return len(left) > 1 and p.word is not None and not self._abbreviation(f"{left}.{p.word}", lang)
            if follows.isdigit():
                return True
            if begins is None and _LATIN_WORD.search(left) and p.word and former().form(p.word)[:1].isascii():
                return False
            return begins is not False
        if p.word and self._collocated(token, p.word, lang):
            return False
        unit = len(token) == 1 and begun < p.start - 2 and bool(_NUMBER_BEFORE.search(text[p.start - 3 : p.start - 1]))
        if not unit and self._abbreviation(token, lang):
            if not p.word or case.mode(p.first) == "none":
                return False
            return begins is not False and len(type_of(p.word)) > 1 and self._starts(p.word, lang)
        # A small letter behind a word that may be an abbreviation not seen often enough.
        return begins is not False or case.mode(p.first) == "none" or not (len(token) <= 3 and token.isalpha() or "." in token)

    def boundaries(self, text: str, lang: str) -> list[int]:
        """Where sentences end, not counting the end of the text."""
        case, spans = Case(text), Enclosures(text)
        out: list[int] = []
        begun = 0
        for p in places(text, spans):
            if p.end <= begun:
                continue
            if p.inside:
                if p.inside[2] in _BRACKETS:
                    ends = _REST.match(text, begun).end() >= p.quoted
                else:
                    ends = self._after_quotation(text, begun, p, case, lang)
            elif set(p.run) <= {"."}:
                begins = self._begins(p.word, p.first, case, lang) if p.word else None
                if len(p.run) >= 3:
                    ends = begins is True or begins is None and (not p.word or self._starts(p.word, lang))
                else:
                    ends = self._stop(text, begun, p, begins, case, lang)
            else:
                ends = True
            if ends:
                out.append(p.after)
                begun = p.after
        return sorted(set(out) | self._thai(text, spans.around)) if _THAI.search(text) else out

    def _after_quotation(self, text: str, begun: int, p: Place, case: Case, lang: str) -> bool:
        """Whether a sentence ends with the quotation that a terminator closes, rather than going on behind it."""
        latin = _LATIN_WORD.search(text, begun, p.inside[1]) is not None
        if not p.word:
            return latin and text[p.nxt].isdigit() or p.first > p.nxt
        begins = self._begins(p.word, p.first, case, lang)
        if begins is not None:
            return begins
        if _LATIN_WORD.match(former().form(p.word)):
            return True
        if latin and not any(x.search(text, begun, p.inside[0]) for n, x in _SCRIPT_TESTS if n != "LATIN"):
            return True
        return p.first > p.nxt or self._starts(p.word, lang)

    @staticmethod
    def _thai(text: str, around) -> set[int]:
        """Spaces of Thai text, unless next to a numeral or the repetition mark or within a quotation."""
        found = set()
        for m in _SPACES.finditer(text):
            a, b = m.start() - 1, m.end()
            while a >= 0 and text[a] in INVISIBLE:
                a -= 1
            while b < len(text) and text[b] in INVISIBLE:
                b += 1
            if a < 0 or b >= len(text) or not (_THAI.match(text[a]) or _THAI.match(text[b])):
                continue
            if text[a].isdigit() or text[b].isdigit() or "ๆ" in (text[a], text[b]) or text[b] in _STOPS or around(m.start()):
                continue
            found.add(m.start())
        return found

    def split(self, text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
        """``start, end`` of the sentences of a text; none for a null or blank text."""
        if not text:
            return []
        lang = base_language(lang)
        out: list[tuple[int, int]] = []
        a = 0
        for b in [*self.boundaries(text, lang), len(text)]:
            part = text[a:b].lstrip()
            if part:
                start, end = b - len(part), b - len(part) + len(part.rstrip())
                if out and not any(c.isalnum() for c in text[start:end]):
                    out[-1] = (out[-1][0], end)
                else:
                    out.append((start, end))
            a = b
        return out


_SPACES = regex.compile(rf"{_SP}+")


# ---------------------------------------------------------------- on tables


def _asked(docs: DataFrame) -> DataFrame:
    """``id, lang, type``: the entries that each text may ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *key) for i, text, lang in zip(*(batch.column(k).to_pylist() for k in range(3))) for key in questions(text, base_language(lang))]
            ids, langs, types = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(types, pa.string())], names=["id", "lang", "type"])

    return docs.mapInArrow(run, "id long, lang string, type string")


def split_sentences(docs: DataFrame, model: DataFrame) -> DataFrame:
    """``id, sent_start, sent_end`` of every sentence of ``docs`` (``id long, text, lang``).

    Rows with a null or blank text have none. A model of up to MODEL_ROWS rows travels with the code; of a larger one each
    row gets, by a join, the entries that splitting it may ask for, so the sentences are the same.
    """
    docs = docs.select(F.col("id").cast("long"), "text", "lang").where(F.col("text").isNotNull() & ~is_blank(F.col("text")))
    model = durable(model)
    shared = None
    cased = model.where("kind = 'l'").limit(1).count() > 0
    if model.limit(MODEL_ROWS + 1).count() <= MODEL_ROWS:
        shared = Model.of([tuple(r) for r in model.collect()], cased)
        rows = docs
    else:
        own = _asked(docs).join(model, ["lang", "type"]).groupBy("id").agg(F.collect_set(F.struct("kind", "lang", "type")).alias("entries"))
        rows = docs.join(own, "id", "left").select("id", "text", "lang", "entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(shared) if shared is not None else None
        for batch in batches:
            ids, starts, ends = [], [], []
            entries = batch.column(3).to_pylist() if splitter is None else [None] * len(batch)
            for i, text, lang, own in zip(*(batch.column(k).to_pylist() for k in range(3)), entries):
                s = splitter or Splitter(Model.of(((e["kind"], e["lang"], e["type"]) for e in own or []), cased))
                for a, b in s.split(text, lang):
                    ids.append(i)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["id", "sent_start", "sent_end"])

    return rows.mapInArrow(run, "id long, sent_start long, sent_end long")


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "passages").select(F.col("row_id").alias("id"), "text", "lang")
    return p.where(F.col("text").isNotNull() & ~is_blank(F.col("text")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_id, sent_start, sent_end`` of every sentence of passages."""
    docs = _passages(spark, sf_dir)
    return split_sentences(docs, learn(docs)).withColumnRenamed("id", "row_id")


def p1_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``kind, lang, type``: what was learned from passages: abbreviations (a), collocations (c), starters (s), small words (l)."""
    return learn(_passages(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_model": p1_model}
ORACLES: dict[str, str] = {}
