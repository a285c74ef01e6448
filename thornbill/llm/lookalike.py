"""One consistent form for texts that look the same."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thornbill.tables import canonical, durable, table

# Letters of other alphabets that look like a Latin letter, pair by pair.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХԚԜаеѕіјорсухһԁԛԝѵӏ", "ABESIJKMHOPCTYXQWaesijopcyxhdqwvl"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϳ", "ABEZHIKMNOPTYXovj"))
OTHER_LATIN = dict(zip("ɑɡ", "ag"))
# Letters and digits of the Arabic script that share their shape with the one used in Urdu and Persian.
ARABIC = dict(zip("يىكه٠١٢٣٧٨٩", "ییکہ۰۱۲۳۷۸۹"))
# Spellings that Indic scripts render like a single letter.
INDIC = {"अा": "आ", "अॉ": "ऑ", "अो": "ओ", "अौ": "औ", "एे": "ऐ", "আ": "আ", "অা": "আ", "ெள": "ௌ", "ஒள": "ஔ"}
# Hyphens of the same look.
HYPHENS = {"‐": "-", "‑": "-"}
#: Compatibility mappings that keep the look. Superscripts, circles, fractions and the like change it and stay.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Format characters that show nothing, and never shape their neighbours.
INVISIBLE = "­͏᠎​‎‏‪-‮⁠-⁤⁦-⁯﻿"
_JOINERS = "‌‍"


def _class(chars: set[str]) -> str:
    """A regular expression's character class of these characters, as ranges."""
    points, parts = sorted(map(ord, chars)), []
    for p in points:
        if parts and parts[-1][1] == p - 1:
            parts[-1][1] = p
        else:
            parts.append([p, p])
    return "".join(re.escape(chr(a)) if a == b else f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in parts)


def _is_letter(c: str) -> bool:
    return unicodedata.category(c)[0] in "LM"


class Former:
    """Brings texts to their form. Built from the character database once in each process."""

    def __init__(self) -> None:
        compat: dict[str, str] = {}
        no, first, second, marks, viramas = set(), set(), set(), set(), set()
        # Ideographs, Hangul syllables, surrogates and all beyond the ideographic plane neither combine nor decompose otherwise.
        for p in (*range(0xA0, 0x3400), *range(0xA000, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20)):
            c = chr(p)
            if (ccc := unicodedata.combining(c)) == 9:
                viramas.add(c)
            elif ccc:
                marks.add(c)
            how = unicodedata.decomposition(c)
            if not how:
                continue
            if how[0] == "<":
                if how.startswith(SAME_LOOK) and not c.isspace() and not unicodedata.normalize("NFKC", c).startswith(" "):
                    compat[c] = unicodedata.normalize("NFKC", c)
            elif unicodedata.normalize("NFC", c) != c:
                no.add(c)
            else:
                parts = unicodedata.normalize("NFD", c)
                first.update(chr(int(how.split()[0], 16)), parts[0])
                second.add(parts[-1])
        spaces = {chr(p) for p in range(0x80, 0x3001) if chr(p).isspace() and chr(p) not in "\x85  "}
        self.single = compat | ARABIC | OTHER_LATIN | HYPHENS | {c: " " for c in spaces}
        self.alike = CYRILLIC | GREEK
        self.to_cyrillic = {v: k for k, v in CYRILLIC.items()}
        self.to_greek = {v: k for k, v in GREEK.items()}
        self.viramas = viramas
        jamo = {chr(p) for p in range(0x1161, 0x1176)} | {chr(p) for p in range(0x11A8, 0x11C3)}
        letters = "[^\\W\\d_]"
        foreign = _class(set(self.alike))
        # The quick check: a character that may not be in its form. It starts with one class of few
        # ranges beyond the basic plane, so stable text is skipped fast.
        changing = _class(set(self.single) | no | jamo) + INVISIBLE + _JOINERS
        ends = {s[-1] for s in INDIC}
        tests = [f"(?<=[{changing}])", f"(?<=[{_class(first)}][{_class(second)}])", f"(?<=[{_class(marks)}]{{2}})", *(f"(?<={s})" for s in INDIC)]
        basic = {c for c in set(self.single) | no | jamo | second | marks | ends if c <= "\uffff"}
        self.check = re.compile(f"[{_class(basic)}{INVISIBLE}{_JOINERS}\U00010000-\U0010ffff](?:{'|'.join(tests)})")
        self.tail = re.compile(f"[{_class(marks | second | viramas)}{changing}]*")
        self.extends = marks | second | viramas | set(INVISIBLE) | set(_JOINERS) | ends
        self.foreign = re.compile(f"[{foreign}]")
        self.word = re.compile(f"(?:{letters}|[{_class(marks)}])+")
        self.drop = re.compile(f"[{INVISIBLE}]+")
        self.indic = re.compile("|".join(map(re.escape, INDIC)))
        self.joiner = re.compile(f"[{_JOINERS}]")
        self.table = str.maketrans(self.single)

    def _join(self, m: re.Match) -> str:
        before = m.string[m.start() - 1 : m.start()]
        if before and (before in self.viramas or "\u0600" <= before <= "\u08ff" or m.group() == "\u200d" and unicodedata.category(before) in ("So", "Sk", "Mn")):
            return m.group()
        return ""

    def _segment(self, s: str) -> str:
        s = self.drop.sub("", s)
        s = unicodedata.normalize("NFC", unicodedata.normalize("NFC", s).translate(self.table))
        return self.indic.sub(lambda x: INDIC[x.group()], self.joiner.sub(self._join, s))

    def _splice(self, text: str, m: re.Match | None) -> str:
        """The text with its unstable segments replaced; each reaches from the starter before it over all marks behind it."""
        parts, done = [], 0
        while m:
            start, end = m.start(), self.tail.match(text, m.end()).end()
            while start > done and (start == m.start() or text[start] in self.extends):
                start -= 1
            parts += text[done:start], self._segment(text[start:end])
            done = end
            m = self.check.search(text, done)
        return "".join([*parts, text[done:]])

    def _letters(self, m: re.Match) -> str:
        """A word with look-alikes: in the alphabet of the letters that have no Latin look-alike, else in Latin."""
        word = m.group()
        if word.isascii() or not self.foreign.search(word):
            return word
        plain = unicodedata.normalize("NFD", word)
        kinds = {unicodedata.name(c, "").split(" ")[0] for c in plain if c not in self.alike and _is_letter(c)}
        if "CYRILLIC" in kinds:
            return "".join(self.to_cyrillic.get(c, c) for c in word)
        if "GREEK" in kinds:
            return "".join(self.to_greek.get(c, c) for c in word)
        return unicodedata.normalize("NFC", "".join(self.alike.get(c, c) for c in word))

    def form(self, text: str) -> str:
        if text.isascii():
            return text
        if m := self.check.search(text):
            text = self._splice(text, m)
        return self.word.sub(self._letters, text) if self.foreign.search(text) else text


@lru_cache(maxsize=1)
def former() -> Former:
    return Former()


def consistent_form(text: str | None) -> str | None:
    """The form of one text; null for null. Two texts that look the same have the same form; another number of spaces,
    another letter case or an accent more or less gives another form."""
    return None if text is None else former().form(text)


def with_form(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, form``: the text of every row in its form. Narrow; whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([consistent_form(t) for t in batch.column(1).to_pylist()], pa.string())], names=[key, "form"])

    return df.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, form string")


def _digests(df: DataFrame) -> DataFrame:
    """``kind, key, owner, raw, form`` with 128-bit digests of the text as stored and of its form."""

    def digest(t: str) -> bytes:
        return blake2b(t.encode(), digest_size=16).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = former().form
        for batch in batches:
            raw, shaped = [], []
            for t in batch.column(3).to_pylist():
                raw.append(d := digest(t))
                shaped.append(d if (f := form(t)) == t else digest(f))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(raw, pa.binary()), pa.array(shaped, pa.binary())], names=["kind", "key", "owner", "raw", "form"])

    return df.select("kind", "key", "owner", "text").mapInArrow(run, "kind string, key string, owner string, raw binary, form binary")


def alike_members(items: DataFrame) -> DataFrame:
    """``kind, key, owner, raw, form``: the texts of those forms that are written in two ways or more, each key and writing
    once, with digests of the text and of its form.

    ``items`` has ``kind, key, owner, text``; rows with a null in any of the four are left out. Groups are reduced to their
    least and greatest text with map-side combining, and only their members are joined back, a row a group on one side.
    """
    rows = durable(_digests(items.dropna(subset=["kind", "key", "owner", "text"])).distinct())
    groups = rows.groupBy("kind", "form").agg(F.min("raw").alias("least"), F.max("raw").alias("most")).where("least <> most").select("kind", "form")
    return rows.join(groups, ["kind", "form"]).select("kind", "key", "owner", "raw", "form")


def alike_classes(members: DataFrame) -> DataFrame:
    """``kind, form, n_texts, n_members, n_links``: each class of texts that only look the same, with the number of its
    writings, of its members, and of pairs of members of two owners and two writings.

    Links are counted, not formed: all pairs, less those of one writing, less those of one owner, and those of both again.
    """
    cells = members.groupBy("kind", "form", "raw", "owner").agg(F.count(F.lit(1)).alias("n"))
    square = lambda keys, name: cells.groupBy("kind", "form", *keys).agg(F.sum("n").alias("n")).groupBy("kind", "form").agg(F.sum(F.col("n") * F.col("n")).alias(name), F.sum("n").alias("m"), F.count(F.lit(1)).alias("k"))
    raw, owner, both = square(["raw"], "same_raw"), square(["owner"], "same_owner").drop("m", "k"), square(["raw", "owner"], "same_both").drop("m", "k")
    links = (F.col("m") * F.col("m") - F.col("same_raw") - F.col("same_owner") + F.col("same_both")) / 2
    out = raw.join(owner, ["kind", "form"]).join(both, ["kind", "form"])
    return out.select("kind", F.lower(F.hex("form")).alias("form"), F.col("k").alias("n_texts"), F.col("m").alias("n_members"), links.cast("long").alias("n_links"))


def alike_pairs(members: DataFrame) -> DataFrame:
    """``kind, key_a, key_b``: the links of the classes of ``members``, as pairs. A pair whose keys have several writings may
    come several times. Class of equal texts meets class of equal texts, so copies of one text meet no copies of it and the
    work follows the number of pairs; where classes are enough, :func:`alike_classes` does without."""
    members = durable(members)
    classes = members.select("kind", "form", "raw").distinct()
    a, b = (classes.withColumnRenamed("raw", f"raw_{x}") for x in "ab")
    couples = a.join(b, ["kind", "form"]).where("raw_a < raw_b")
    one, two = (members.select("kind", "form", F.col("raw").alias(f"raw_{x}"), F.col("key").alias(f"k{x}"), F.col("owner").alias(f"o{x}")) for x in "ab")
    pairs = couples.join(one, ["kind", "form", "raw_a"]).join(two, ["kind", "form", "raw_b"]).where("oa <> ob and ka <> kb")
    return pairs.select("kind", F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "passages").select(F.lit("passage").alias("kind"), F.col("passage_id").alias("key"), canonical(F.col("passage_id")).alias("owner"), "text")
    c = table(spark, sf_dir, "chunks").select(F.concat(F.lit("chunk "), "strategy").alias("kind"), F.col("chunk_id").alias("key"), canonical(F.col("passage_id")).alias("owner"), "text")
    return p.unionByName(c)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``kind, key_a, key_b`` of the pairs of passages, and of chunks of one strategy, that only look the same: the classes
    of query ``p5_classes``, spelled out."""
    pairs = alike_pairs(alike_members(_items(spark, sf_dir)))
    return pairs.withColumn("kind", F.element_at(F.split("kind", " "), 1)).distinct()


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``kind, form, n_texts, n_members, n_links`` of every class of texts that only look the same."""
    return alike_classes(alike_members(_items(spark, sf_dir)))


def p5_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``kind, key, form``: the class of every passage and chunk that is in one."""
    return alike_members(_items(spark, sf_dir)).select("kind", "key", F.lower(F.hex("form")).alias("form")).distinct()


def p5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_id, form`` of every row of passages."""
    return with_form(table(spark, sf_dir, "passages"), "row_id", "text")


def p5_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chunk_id, form`` of every row of chunks."""
    return with_form(table(spark, sf_dir, "chunks"), "chunk_id", "text")


QUERIES = {"p5_found": p5_found, "p5_classes": p5_classes, "p5_members": p5_members, "p5_passages": p5_passages, "p5_chunks": p5_chunks}
ORACLES: dict[str, str] = {}
