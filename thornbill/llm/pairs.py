"""Prompt and response pairs of no use as a pair, with the kind of their defect.

Sentences of responses are masked (digits and the words of their query become place-holders) and sorted, and neighbours'
common prefixes show which last sentences are shortened versions of others, in whatever place of a response; lengths at which many responses break off are found; then the rules
for empty, refusing and copying responses and for other languages apply.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thornbill.llm.lookalike import INVISIBLE, former
from thornbill.llm.sentences import SCRIPT_LANGUAGE, Model, Splitter, base_language
from thornbill.tables import durable, table

# Stand-ins for a missing value, by their letters and digits.
MISSING = frozenset("null none nil nan na n/a undefined missing unknown empty blank tbd nodata novalue noanswer notavailable notapplicable undef void".split())
# Phrases that decline, say that one can't answer, or deny something, by language.
REFUSALS = {
    "en": r"\b(?:can\s?not|can['’]?t|could not|couldn['’]?t|unable to|not able to|won['’]?t|will not|must decline to|decline to|refuse to|have to decline)\b.{0,40}\b(?:answer|help|assist|respond|reply|provide|comply|say|tell|discuss|share)|\b(?:do not|don['’]?t|does not|doesn['’]?t|did not)\b.{0,20}\b(?:know|mention|say|contain|cover|include|state|have (?:an|the|any|enough))\b|\bno (?:answer|information)\b.{0,30}\b(?:found|given|available)|\b(?:was|were|be|is) not found\b|\btoo little to (?:reply|answer|say)|\boutside of what i\b|\b(?:sorry|apologies|afraid)\b.{0,30}\b(?:unable|not|no|cannot|can['’]?t|decline|outside|little)\b|\bnot (?:sure|certain)\b|\bno idea\b|\bas an ai\b|\b(?:would|could) (?:only |just )?be (?:a guess|guessing|speculati)|\bnothing (?:on|about|regarding|relevant)\b.{0,60}\b(?:turned up|found|appears?|here|given|available)\b|\brephrase (?:your|the) question|\btry (?:another|a different) (?:query|question)|\b(?:sorry|apologies)\s*[,;:!]|\bi['’]?m afraid\b|\bregret(?:fully)?\b",
    "hi": r"उत्तर (?:नहीं|देने में असमर्थ)|जानकारी नहीं|सहायता करना संभव नहीं|नहीं दे सक|नहीं बता सक|नहीं मिला|पता नहीं|मालूम नहीं|असमर्थ|माफ़ (?:कीजिए|करें)|क्षमा (?:करें|कीजिए)|खेद है|प्रश्न बदलकर",
    "bn": r"উত্তর দিতে পার(?:ছি|ব) না|উত্তর পাওয়া যায়নি|জানা নেই|জানি না|সাহায্য করতে পার(?:ছি|ব) না|বলতে পার(?:ছি|ব) না|সম্ভব নয়|অক্ষম|দুঃখিত|ক্ষমা করবেন|অন্য প্রশ্ন করুন",
    "ta": r"பதிலளிக்க (?:முடியாது|இயலாது|முடியவில்லை)|தெரியாது|விடை கிடைக்கவில்லை|உதவ (?:முடியாது|இயலாது)|கூற (?:முடியாது|இயலாது)|தெரியவில்லை|மன்னிக்கவும்|வருந்துகிறேன்|வேறு கேள்வி",
    "te": r"జవాబు (?:ఇవ్వలేను|దొరకలేదు|చెప్పలేను|తెలియదు|లేదు)|నాకు తెలియదు|సహాయం చేయలేను|సమాధానం (?:ఇవ్వలేను|దొరకలేదు|లేదు)|చెప్పలేను|క్షమించండి|మరో ప్రశ్న",
    "ur": r"جواب نہیں|معلوم نہیں|مدد نہیں کر|نہیں دے سک|نہیں بتا سک|نہیں جانت|قاصر|ممکن نہیں|معذرت|افسوس ہے|کوئی اور سوال",
    "ja": r"分かりかね|わかりかね|分かりません|わかりません|答えられません|お?答え(?:する(?:こと)?が)?できません|答えかね|見つかりません|存じません|お手伝いできません|お応えできません|申し訳|残念ながら|別の質問",
    "zh": r"无法(?:回答|提供|作答|帮助|协助|得知)|不能(?:回答|提供)|没有(?:找到|给出|提到)|不清楚|不知道|找不到(?:答案)?|未(?:找到|提及)|帮不了|不便回答|抱歉|很遗憾|对不起|换一个问题",
    "th": r"ไม่ทราบ|ไม่สามารถ|ไม่พบคำตอบ|ไม่รู้|ตอบไม่ได้|ขออภัย.*ไม่",
}
# What shows, in the same sentence, that such a phrase is about the answering itself: the first person, the texts
# that were given, or the question.
FRAMES = {
    "en": r"\b(?:i|i['’]?m|i['’]?d|we|me|us)\b|\b(?:passages?|pages?|sources?|texts?|context|documents?|excerpts?|articles?|snippets?|materials?)\b.{0,40}\b(?:do|does|did)(?: not|n['’]t) (?:mention|say|contain|cover|include|state|have|provide|give)\s*(?:(?:it|this|that|any|anything|enough|an? answer|the answer|information|details|so|what|which|who|when|where|how)\b|\W*$)|\bsay too little\b|\b(?:no answer|no information|nothing)\b.{0,80}\b(?:passages?|pages?|sources?|texts?|context|documents?|excerpts?|articles?|snippets?|materials?|here)\b|\b(?:the|an|your) (?:answer|question|request|query)\b|\bas an ai\b",
    "hi": r"\b(?:मैं|मुझे|मेरे|हम|हमें)\b|अंश|प्रश्न|सवाल|इस बारे|इसका उत्तर",
    "bn": r"আমি|আমার|আমরা|অংশ|প্রশ্ন|এ বিষয়ে",
    "ta": r"நான்|எனக்கு|என்னால்|பகுதி|கேள்வி|இதற்கு|இது பற்றி",
    "te": r"నేను|నాకు|భాగా|ప్రశ్న|దీనికి|దీని గురించి",
    "ur": r"مجھے|(?:^|[،,])\s*میں\b|ہم |اقتباس|سوال|اس بارے|اس کا جواب|معذرت|افسوس",
    "ja": r"私|文章|資料|段落|抜粋|質問|その件|申し訳|残念|(?:お?答え|お応え|お手伝い|かね)|(?:^|[、，,])(?:分かり|わかり|存じ)ません",
    "zh": r"我|段落|文中|原文|资料|文本|问题|答案|(?:^|[，,、])(?:抱歉|很遗憾|对不起|不清楚|不知道|无法|不便|帮不了)",
    "th": r"ฉัน|ผม|เรา|ข้อมูล|คำถาม|คำตอบ|ขออภัย|ตอบ",
}
# Frequent function words that tell languages of Latin script apart.
FUNCTION_WORDS = {
    "en": "the of is was in by from how it its and on to an that this are were with for at as their not be has have had after about most it's lies up end",
    "de": "der die das und ist nicht ein eine den dem des im mit auf für von zu bei aus wurde sind nach wird liegt über",
    "fr": "le la les des du de et est une un dans par pour sur avec qui au aux selon été se à en depuis",
    "es": "el los las del de y es una un en por para con que se según fue a desde la está su",
    "pt": "o os as do da dos das de e é uma um em por para com que segundo foi no na desde",
    "it": "il lo gli della delle dei di e è una un nel con che per secondo fu da si sono dal",
    "nl": "het een en van is op te dat niet met voor zijn door naar bij uit aan de volgens",
    "sv": "och att det är som en ett på av för med den till inte från enligt",
    "id": "yang dan di dari dengan untuk ini itu pada adalah sejak tahun oleh ke dihuni sekitar menurut tidak",
    "pl": "i w na z do nie jest się od to przez według oraz po",
    "tr": "ve bir bu için ile olarak da de daha olan göre yılında",
    "vi": "và của là có được trong cho một các với năm theo",
    "sw": "ya wa na kwa ni katika za la mwaka kutoka",
}
_FUNCTION = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
#: Scripts in which a language is written; where not given, the script's own language decides.
SCRIPTS_OF = {"ja": {"KANA", "HAN"}, "zh": {"HAN"}, "ko": {"HANGUL", "HAN"}, "mr": {"DEVANAGARI"}, "ne": {"DEVANAGARI"}, "fa": {"ARABIC"}, "ar": {"ARABIC"}}
_BLOCKS = {"LATIN": "Latin", "DEVANAGARI": "Devanagari", "BENGALI": "Bengali", "TAMIL": "Tamil", "TELUGU": "Telugu", "ARABIC": "Arabic", "THAI": "Thai", "HAN": "Han", "CYRILLIC": "Cyrillic", "GREEK": "Greek", "HANGUL": "Hangul"}
_SCRIPT = {k: regex.compile(rf"\p{{{v}}}") for k, v in _BLOCKS.items()} | {"KANA": regex.compile(r"[\p{Hiragana}\p{Katakana}]")}

#: Share of an ending's occurrences that must close a sentence for it to be one; closed sentences for each that goes on behind
#: the same number, up to which the closed are cut.
FINAL_SHARE, CLOSED_SHARE = 0.1, 1.0
#: Different queries that must have got the same answer, word for word and with nothing of the query, for a denial to be a
#: refusal without saying so; share of a language's answers that a word must stand in to be common, and words without any
#: common one that make an answer one of another language.
SAME_ANSWER, COMMON_SHARE, STRANGE_WORDS = 3, 0.01, 4

_WORDS = regex.compile(r"[\p{L}\p{M}]+")
_ENDS = regex.compile(r"[.!?。！？।॥۔؟|．｡][\s”’»」』）)\]\"']*$")
_DANGLING = regex.compile(r"(?:\.{2,}|…|[\s\-–—,;:、，；：(（\[“‘「『])+$")
_VALUE = regex.compile(r"[^\p{L}\p{Nd}]*\p{Nd}[\p{Nd}.,٫٬/]*\s*(?:[\p{L}\p{M}.%°²³]{0,18}|\p{Han}{1,4}|[\p{Hiragana}\p{Katakana}]{1,6})?(?:\s*[(（][^()（）]*[)）]?)?[\s.。।۔]*")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
_PARENTHESES = regex.compile(r"[(（][^()（）]*[)）]?")


def letters_of(text: str) -> str:
    """Letters, combining marks and digits of a text in its consistent form, without case."""
    return "".join(c for c in former().form(text).lower() if unicodedata.category(c)[0] in "LM" or c.isdigit())


def is_empty(answer: str) -> bool:
    """Nothing but white space, invisible characters, punctuation or a stand-in for a missing value."""
    core = letters_of(answer)
    return not core or core in MISSING


def copies_query(query: str, answer: str) -> bool:
    """Says only what the query says: the query once or several times, with at most a few framing words."""
    q, a = letters_of(query), letters_of(answer)
    if not q or q not in a:
        return False
    rest = a.replace(q, "")
    return len(rest) <= 20 and not any(c.isdigit() for c in rest)


_REFUSAL = {k: regex.compile(former().form(unicodedata.normalize("NFC", v)), regex.I | regex.S) for k, v in REFUSALS.items()}


_FRAME = {k: regex.compile(former().form(unicodedata.normalize("NFC", v)), regex.I) for k, v in FRAMES.items()}
_CLAUSE = regex.compile(r"[.!?。！？।॥۔;；]+")


def refuses(query: str, answer: str, lang: str) -> bool | None:
    """Whether an answer declines, or says that it cannot answer, and gives no number that the query doesn't have; None for a
    denial of which only its repetition under other queries could show that it is no answer."""
    known = set(regex.findall(r"\p{Nd}+", query))
    if any(d not in known for d in regex.findall(r"\p{Nd}+", answer)):
        return False
    found: bool | None = False
    for clause in _CLAUSE.split(former().form(answer)):
        for k, phrase in _REFUSAL.items():
            if (k == lang or k == "en" or lang not in _REFUSAL) and phrase.search(clause):
                if _FRAME[k].search(clause):
                    return True
                found = None
    return found


def strange(query: str, answer: str, lang: str) -> list[str] | None:
    """The words of small letter of an answer in Latin script that aren't the query's; None for too few to tell its language."""
    if lang in SCRIPTS_OF or lang in SCRIPT_LANGUAGE.values() and lang != "en":
        return None
    known = set(_WORDS.findall(former().form(query).lower()))
    words = [w for w in _WORDS.findall(_PARENTHESES.sub(" ", former().form(answer))) if w.islower() and w not in known and _SCRIPT["LATIN"].match(w)]
    return sorted(set(words)) if len(words) >= STRANGE_WORDS else None


def other_language(query: str, answer: str, lang: str) -> bool:
    """Written in another language than ``lang``; names in brackets and words of the query don't count."""
    words = set(_WORDS.findall(query.lower()))
    text = _PARENTHESES.sub(" ", former().form(answer))
    own = [w for w in _WORDS.findall(text.lower()) if w not in words]
    body = "".join(own)
    if len(body) < 3 or not lang:  # the unit of a bare value is in no language
        return False
    counts = {k: len(p.findall(body)) for k, p in _SCRIPT.items()}
    total = sum(counts.values())
    latin = lang not in SCRIPTS_OF and lang not in SCRIPT_LANGUAGE.values() or lang == "en"
    fit = SCRIPTS_OF.get(lang) or ({"LATIN"} if latin else {k for k, v in SCRIPT_LANGUAGE.items() if v == lang})
    if total and 2 * sum(counts[k] for k in fit) < total:
        return True
    if lang == "ja":
        return counts["HAN"] >= 5 and not counts["KANA"] and not _SCRIPT["KANA"].search(text)
    if lang == "zh":
        return counts["KANA"] > 0
    if latin:
        tokens = [w for w in _WORDS.findall(text.lower())]
        score = {k: sum(w in v for w in tokens) for k, v in _FUNCTION.items()}
        best = max(score, key=lambda k: (score[k], k == lang))
        return best != lang and score[best] >= 2 and score[best] > score.get(lang, 0)
    return False


def mask(query: str, text: str) -> str:
    """A text in its form without case, each digit as 0 and each word of the query, or the beginning of one at the end, as ¤."""
    words = set(_WORDS.findall(former().form(query).lower()))
    low = regex.sub(r"\s+", " ", regex.sub(r"\p{Nd}", "0", former().form(text).lower())).strip()

    def one(m: regex.Match) -> str:
        w = m.group()
        begun = m.end() == len(low) and len(w) > 2 and any(x.startswith(w) for x in words)
        return "¤" if len(w) > 1 and (w in words or begun) else w

    return regex.sub(r"¤(?: ¤)*", "¤", _WORDS.sub(one, low))


def endings_of(text: str) -> list[str]:
    """What stands before each place where a masked sentence could end, the whole sentence last: the last two words, in
    scripts without spaces the last four characters."""
    words = text.split(" ")
    out = []
    for i, w in enumerate(words):
        places = [j for j in range(1, len(w)) if _CJK.search(w[max(0, j - 4) : j])]
        out += [w[max(0, j - 4) : j] for j in places]
        out.append(w[-4:] if _CJK.search(w[-4:]) else " ".join(words[max(0, i - 1) : i + 1]))
    return out


_SPLITTER = Splitter(Model())


def last_sentence(answer: str, lang: str) -> tuple[str, bool, list[str]]:
    """The last sentence without its end, whether it has a terminator, and the sentences before it."""
    spans = _SPLITTER.split(answer.strip(INVISIBLE), lang)
    text = answer.strip(INVISIBLE)
    if not spans:
        return "", False, []
    a, b = spans[-1]
    part = text[a:b].rstrip(INVISIBLE)
    dangling = bool(_DANGLING.search(part))
    closed = not dangling and bool(_ENDS.search(part))
    bare = _DANGLING.sub("", part) if dangling else _ENDS.sub("", part)
    return bare.rstrip(), closed, [_ENDS.sub("", text[a:b].rstrip(INVISIBLE)).rstrip() for a, b in spans[:-1]]


def examine(query: str | None, answer: str | None, lang: str | None) -> dict:
    """The rules that look at one pair, and what the corpus-wide comparison needs: the masked last sentence, and those before it."""
    query, lang = query or "", base_language(lang)
    out = {"defect": None, "mask": None, "closed": False, "value": False, "dangling": False, "length": len(answer or ""), "ending": None, "name": False, "inside": [], "before": [], "same": None, "words": None}
    if answer is None or is_empty(answer):
        return out | {"defect": "empty"}
    declines = refuses(query, answer, lang)
    if declines:
        return out | {"defect": "refusal"}
    if copies_query(query, answer):
        return out | {"defect": "copy"}
    if other_language(query, answer, lang):
        return out | {"defect": "language"}
    bare, closed, others = last_sentence(answer, lang)
    alone = not others
    masked = mask(query, bare)
    tail = mask("", bare).split(" ")
    *inside, ending = endings_of(mask("", bare))
    value = alone and bool(_VALUE.fullmatch(former().form(answer)))
    dangling = bool(_DANGLING.search(answer.rstrip().rstrip(INVISIBLE)))
    # One or two words without a number that aren't the query's may be a bare value too.
    name = alone and len(tail) <= 2 and not regex.search("[0¤]", masked) and not _CJK.search(masked)
    return out | {"mask": masked, "closed": closed, "value": value, "dangling": dangling, "ending": ending, "name": name, "inside": inside, "before": [mask(query, x) for x in others], "same": mask(query, answer) if declines is None else None, "words": strange(query, answer, lang)}


_EXAMINED = "id long, lang string, defect string, mask string, closed boolean, value boolean, dangling boolean, length int, ending string, name boolean, inside array<string>, before array<string>, same string, words array<string>, pair long, asked long"


def _examined(pairs: DataFrame) -> DataFrame:
    names = ["defect", "mask", "closed", "value", "dangling", "length", "ending", "name", "inside", "before", "same", "words"]
    types = [pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int32(), pa.string(), pa.bool_(), *[pa.list_(pa.string())] * 2, pa.string(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [examine(q, a, lang) for q, a, lang in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))]
            langs = pa.array([base_language(x) for x in batch.column(3).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), langs, *(pa.array([r[n] for r in rows], t) for n, t in zip(names, types)), *batch.columns[4:]], names=["id", "lang", *names, "pair", "asked"])

    return pairs.select(F.col("id").cast("long"), "query", "answer", "lang", F.xxhash64("query", "answer").alias("pair"), F.xxhash64("query").alias("asked")).mapInArrow(run, _EXAMINED)


def shortened(masks: DataFrame) -> DataFrame:
    """``lang, mask, longer``: of distinct masked sentences, whether another goes on where this one breaks off.

    Sorted by text, a sentence that another continues is a prefix of its next neighbour. The sort is by range over
    distinct texts, so no key is hot; only the first text of each range is passed between ranges.
    """
    spark = masks.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(masks.repartitionByRange(parts, "lang", "mask").withColumn("part", F.spark_partition_id()))
    here = F.struct("lang", "mask")
    within = W.partitionBy("part").orderBy("lang", "mask")
    firsts = ranged.groupBy("part").agg(F.min(here).alias("first"))  # one row a range
    firsts = firsts.select("part", F.lead("first").over(W.orderBy("part")).alias("beyond"))
    following = ranged.withColumn("next", F.lead(here).over(within)).join(F.broadcast(firsts), "part").withColumn("next", F.coalesce("next", "beyond"))
    longer = (F.col("next.lang") == F.col("lang")) & F.expr("startswith(next.mask, mask)")
    return following.select("lang", "mask", F.coalesce(longer, F.lit(False)).alias("longer"))


def length_spikes(examined: DataFrame) -> DataFrame:
    """``lang, length``: lengths at which at least 20 responses, and ten times as many as at both neighbours together, break off."""
    counts = examined.where("defect is null and not closed and not value and not name").groupBy("lang", "length").count()
    order = W.partitionBy("lang").orderBy("length").rangeBetween(-1, 1)  # a row a length, not a row a response
    return counts.withColumn("around", F.sum("count").over(order) - F.col("count")).where("count >= 20 and count > 10 * around").select("lang", "length")


def repeated_denials(examined: DataFrame) -> DataFrame:
    """``lang, same``: denials that at least SAME_ANSWER different queries got, with no word or number of any of them."""
    rows = examined.where("same is not null and not same rlike '[0¤]'").select("lang", "same", "asked").distinct()
    return rows.groupBy("lang", "same").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SAME_ANSWER).select("lang", "same")


def without_common_words(examined: DataFrame) -> DataFrame:
    """``id``: answers in Latin script with several words, none of which stands in at least COMMON_SHARE of the language's
    answers, each pair counted once. Of a language only as many words can be common as answers have in COMMON_SHARE."""
    rows = examined.where("defect is null and words is not null")
    distinct = rows.dropDuplicates(["lang", "pair"])
    of = distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("n_answers"))
    counts = distinct.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    common = counts.join(of, "lang").where(F.col("n") >= F.greatest(COMMON_SHARE * F.col("n_answers"), F.lit(2.0))).select("lang", "word")
    known = rows.select("id", "lang", F.explode("words").alias("word")).join(common, ["lang", "word"], "left_semi").select("id").distinct()
    enough = of.where(F.col("n_answers") >= 1 / COMMON_SHARE).select("lang")
    return rows.join(enough, "lang", "left_semi").select("id").distinct().join(known, "id", "left_anti")


def broken_pairs(pairs: DataFrame) -> DataFrame:
    """``id, defect``: the pairs of no use, each with one defect; rules apply in the order empty, refusal, copy, language,
    truncated. ``pairs`` has ``id long, query string, answer string, lang string``. A null answer is empty; a null query
    is never copied; without a language no other language is found. What only the corpus shows: a denial is a refusal if
    other queries got it too, and an answer without any common word of its language is one of another language.

    An open last sentence (no terminator, or one that trails off) is whole if the corpus has it closed, and broken off if
    another sentence of the corpus goes on from it or its last words hardly ever end a sentence. A bare value is never broken
    off, nor one or two words from which nothing goes on. A closed sentence that ends with a number is broken off, at the
    number's point, if more sentences go on from there. Only shares over distinct pairs decide, whatever the number of rows.
    """
    rows = durable(_examined(pairs))
    denials = repeated_denials(rows).withColumn("denial", F.lit("refusal"))
    foreign = without_common_words(rows).withColumn("foreign", F.lit("language"))
    later = F.when(F.col("defect").isNull(), F.coalesce("denial", "foreign"))
    rows = durable(rows.join(denials, ["lang", "same"], "left").join(foreign, "id", "left").withColumn("defect", F.coalesce("defect", later)).drop("denial", "foreign", "same", "words"))
    fine = rows.where("defect is null")
    distinct = fine.where("not value").dropDuplicates(["lang", "pair"])
    masks = distinct.groupBy("lang", "mask").agg(F.count_if("closed").alias("n_closed"), F.count(F.lit(1)).alias("n"))
    masks = durable(masks)
    # A sentence may go on as any sentence of another answer; only last sentences show whether it is whole.
    before = distinct.select("lang", F.explode("before").alias("mask")).groupBy("lang", "mask").agg(F.count(F.lit(1)).alias("n"))
    sentences = durable(masks.select("lang", "mask", "n").unionByName(before).groupBy("lang", "mask").agg(F.sum("n").alias("n")))
    known = masks.join(shortened(sentences.select("lang", "mask")), ["lang", "mask"])
    # How many sentences go on behind each digit, for those that break off there.
    at = F.explode(F.expr("filter(sequence(1, length(mask) - 1), i -> substring(mask, i, 1) = '0')"))
    going = sentences.where("length(mask) > 1").select("lang", "mask", "n", at.alias("i")).select("lang", F.expr("substring(mask, 1, i)").alias("mask"), "n")
    going = going.groupBy("lang", "mask").agg(F.sum("n").alias("n_going"))
    closing = distinct.where("closed").select("lang", "ending", F.lit(1).alias("final"))
    passing = distinct.select("lang", F.explode("inside").alias("ending"), F.lit(0).alias("final"))
    endings = closing.unionByName(passing).groupBy("lang", "ending").agg(F.avg("final").alias("final"))
    spikes = length_spikes(rows).withColumn("spike", F.lit(True))
    looked = fine.where("not value").join(known, ["lang", "mask"]).join(going, ["lang", "mask"], "left").join(endings, ["lang", "ending"], "left").join(spikes, ["lang", "length"], "left")
    whole = (F.col("n_closed") > 0) & ~F.col("dangling")
    ends = F.coalesce("final", F.lit(0)) >= FINAL_SHARE
    broken_open = ~F.col("closed") & ~whole & (F.col("dangling") | F.col("longer") | (F.coalesce("spike", F.lit(False)) & ~F.col("name")) | ~(ends | F.col("name")))
    # A number cut at its point looks closed.
    broken_closed = F.col("closed") & F.col("mask").rlike("0$") & (F.col("n_closed") <= CLOSED_SHARE * F.col("n_going"))
    truncated = looked.where(broken_open | broken_closed).select("id", F.lit("truncated").alias("defect"))
    return rows.where("defect is not null").select("id", "defect").unionByName(truncated)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``eval_id, defect`` of every broken pair of eval_set."""
    pairs = table(spark, sf_dir, "eval_set").select(F.col("eval_id").alias("id"), "query", F.col("gold_answer").alias("answer"), "lang")
    return broken_pairs(pairs).withColumnRenamed("id", "eval_id")


QUERIES = {"p3_found": p3_found}
ORACLES: dict[str, str] = {}
