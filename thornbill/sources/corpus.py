"""Reading passages, chunks, questions and traces, and the corpus harvest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thornbill import config as C
from thornbill.functions.text import base_lang, language_tag
from thornbill.tables import SENT, durable, exists, is_blank, table

PASSAGE_SCHEMA = "passage_id string, text string, lang string, questions array<string>"
EVAL_SCHEMA = "query_id long, query string, lang string, gold_passage_id string, gold_answer string"


def defaults(df: DataFrame) -> DataFrame:
    """A corpus relation with its defaults: language ``en``, no questions, identifiers as text."""
    return df.select(F.col("passage_id").cast("string"), "text", F.coalesce("lang", F.lit("en")).alias("lang"), F.coalesce("questions", F.array().cast("array<string>")).alias("questions"))


def read_corpus_json(spark: SparkSession, path: str) -> DataFrame:
    """Passages of a JSON array, or of one JSON object a line, with defaults for missing fields."""
    return defaults(spark.read.schema(PASSAGE_SCHEMA).json(path, multiLine=_is_array(spark, path)))


def _is_array(spark: SparkSession, path: str) -> bool:
    """Whether JSON files hold arrays, by the first line that isn't blank; tables are written as objects by line."""
    first = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    return bool(first) and first[0][0].lstrip("\ufeff \t").startswith("[")


def read_eval_json(spark: SparkSession, path: str | None) -> DataFrame:
    """Evaluation rows of JSON, like passages; none where no path is given or no file is there."""
    if not path or not exists(spark, path):
        return spark.createDataFrame([], EVAL_SCHEMA)
    return spark.read.schema(EVAL_SCHEMA).json(path, multiLine=_is_array(spark, path))


def demo_corpus(spark: SparkSession) -> DataFrame:
    """A small corpus for trying things out."""
    rows = [
        ("demo-1", "A mill grinds grain. The oldest mill on this river was built in 1704. It still runs on market days.", "en", ["when was the oldest mill built", "what does a mill do"]),
        ("demo-2", "यह पुल पत्थर का बना है। इसे 1810 में खोला गया था।", "hi", ["पुल कब खोला गया"]),
        ("demo-3", "Ferries cross the lake twice a day. The crossing takes 40 minutes.", "en", ["how long does the ferry take"]),
    ]
    return spark.createDataFrame(rows, PASSAGE_SCHEMA)


def sample(spark: SparkSession, path: str, columns: list[str], n: int) -> DataFrame:
    """``n`` rows of some columns of a parquet source; only those columns, and as few files as that takes, are read."""
    return spark.read.parquet(path).select(*columns).limit(n)


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each passage_id: of its rows whose text isn't blank, the last delivered (greatest row_id)."""
    p = table(spark, sf_dir, "passages").where(F.col("text").isNotNull() & ~is_blank(F.col("text")) & F.col("passage_id").isNotNull())
    p = p.groupBy("passage_id").agg(F.max_by(F.struct("text", "lang", "questions"), "row_id").alias("p"))
    return p.select("passage_id", "p.text", base_lang(F.col("p.lang")).alias("lang"), F.coalesce("p.questions", F.array().cast("array<string>")).alias("questions"))


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delivered chunks, one row for each chunk_id: of several the one of least passage, strategy, position and text hash,
    with a language if any of them has one."""
    return _once(table(spark, sf_dir, "chunks").where("chunk_id is not null and text is not null"))


def chunks_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of :func:`chunk_table`. Only chunks whose id (by its 64-bit hash) was delivered several times are shuffled, all
    others stay where they are; with more than SENT such ids all are shuffled."""
    c = table(spark, sf_dir, "chunks").where("chunk_id is not null and text is not null")
    h = F.xxhash64("chunk_id").alias("_h")
    again = durable(c.select(h).groupBy("_h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_h"))
    if again.count() > SENT:
        return _once(c)
    c = c.select("*", h)
    more = _once(c.join(F.broadcast(again), "_h", "left_semi"))
    one = c.join(F.broadcast(again), "_h", "left_anti").withColumn("lang", base_lang(F.col("lang")))
    return one.select(*more.columns).unionByName(more)


def _once(c: DataFrame) -> DataFrame:
    row = F.struct("passage_id", "text", "strategy", "position", "parent_id", "answers_passage")
    c = c.groupBy("chunk_id").agg(F.min_by(row, F.struct("passage_id", "strategy", "position", F.xxhash64("text"))).alias("c"), F.max(F.lower(F.split_part("lang", F.lit("-"), F.lit(1)))).alias("lang"))
    return c.select("chunk_id", "c.passage_id", "c.text", "c.strategy", F.coalesce("lang", F.lit("en")).alias("lang"), "c.position", "c.parent_id", "c.answers_passage")


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set of searches: rows of eval_set whose id is divisible by 20, with a query that isn't blank."""
    e = table(spark, sf_dir, "eval_set").where((F.col("eval_id") % 20 == 0) & F.col("query").isNotNull() & ~is_blank(F.col("query")))
    return e.select(F.col("eval_id").alias("qid"), "query", "lang", F.col("gold_passage_id").alias("gold"))


def eval_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qid, query, lang, gold`` of all rows of eval_set with a query that isn't blank."""
    e = table(spark, sf_dir, "eval_set").where(F.col("query").isNotNull() & ~is_blank(F.col("query")))
    return e.select(F.col("eval_id").alias("qid"), "query", "lang", F.col("gold_passage_id").alias("gold"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces, each trace_id once (its first log entry), however often it was delivered."""
    t = table(spark, sf_dir, "traces").where("trace_id is not null")
    cols = ["query", "lang", "stt_confidence", "timings", "total_ms", "budget_ms", "path", "refused", "asked_at"]
    return t.groupBy("trace_id").agg(F.min_by(F.struct(*cols), F.struct("logged_at", "asked_at")).alias("t")).select("trace_id", "t.*")


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested source rows as a question dataset has them: a query, its answer, and parallel arrays of its passages and of
    whether each is the answering one, rebuilt from passages and eval_set."""
    p = passages(spark, sf_dir).where(F.col("passage_id").rlike(r"^[0-9]+-[a-z]+-[gd]$"))
    p = p.select(F.split_part("passage_id", F.lit("-"), F.lit(1)).cast("long").alias("query_id"), F.split_part("passage_id", F.lit("-"), F.lit(2)).alias("tag"), (F.split_part("passage_id", F.lit("-"), F.lit(3)) == "g").cast("int").alias("sel"), "text")
    p = p.groupBy("query_id", "tag").agg(F.sort_array(F.collect_list(F.struct("sel", "text"))).alias("ps"))
    e = table(spark, sf_dir, "eval_set").groupBy("query_id").agg(F.min_by(F.struct("query", "gold_answer"), "eval_id").alias("e"))
    return p.join(e, "query_id", "left").select("query_id", F.col("tag").alias("target_lang"), "e.query", F.col("e.gold_answer").alias("answer"), F.struct(F.col("ps.sel").alias("is_selected"), F.col("ps.text").alias("texts")).alias("passages"))


def harvest(source: DataFrame, held_out_every: int = 2) -> tuple[DataFrame, DataFrame]:
    """``(passages, eval rows)`` from nested source rows.

    A row without an answering passage is dropped; the first answering passage is gold, the first other one a distractor.
    A row with an answer whose query_id is divisible by ``held_out_every`` is held out: it gives an eval row, and its
    passage keeps no question, so that no question leaks.
    """
    tag = F.coalesce(language_tag(F.col("target_lang"), C.DATASET_TAGS), F.col("target_lang"))
    s = source.withColumn("g", F.array_position("passages.is_selected", F.lit(1))).where("g > 0").withColumn("d", F.array_position("passages.is_selected", F.lit(0))).withColumn("tag", tag)
    held = (F.col("query_id") % held_out_every == 0) & (F.coalesce("answer", F.lit("")) != "") & F.col("query").isNotNull()
    s = s.withColumn("held", F.coalesce(held, F.lit(False)))
    none = F.array().cast("array<string>")
    gold = F.struct(F.concat_ws("-", "query_id", "tag", F.lit("g")).alias("passage_id"), F.element_at("passages.texts", F.col("g").cast("int")).alias("text"), F.when(F.col("held") | F.col("query").isNull(), none).otherwise(F.array("query")).alias("questions"))
    distractor = F.when(F.col("d") > 0, F.struct(F.concat_ws("-", "query_id", "tag", F.lit("d")).alias("passage_id"), F.try_element_at("passages.texts", F.col("d").cast("int")).alias("text"), none.alias("questions")))
    rows = s.select(F.col("tag").alias("lang"), F.explode(F.array_compact(F.array(gold, distractor))).alias("p"))
    return rows.select("p.passage_id", "p.text", "lang", "p.questions"), s.where("held").select("query_id", "query", F.col("tag").alias("lang"), F.concat_ws("-", "query_id", "tag", F.lit("g")).alias("gold_passage_id"), F.col("answer").alias("gold_answer"))


def build_corpus(source: DataFrame, languages: list[str], n_rows: int = 400, n_eval: int = 60) -> tuple[DataFrame, DataFrame]:
    """``(passages, eval rows)`` as a corpus is built, languages in order, rows of a language in order of query_id, until its
    limits are met; the limits are the feature, as for a sampling.

    ``source`` has ``query_id, target_lang, query, answer, eng_query, eng_answer, passages`` (parallel arrays ``is_selected,
    texts, english``). A query_id is taken in the first language that has it only, even if that row gives nothing. Of a row
    with an answering passage, its passage and first other one come in the language while there are fewer than ``n_rows``,
    and, of the first language, in English too while there are fewer than ``2 * n_rows``. While there are fewer than
    ``n_eval`` evaluation rows, rows are held out: their passages have no question, and each answer gives a row.
    Running numbers need only a few small columns of a row, never its texts.
    """
    order = F.array_position(F.array(*map(F.lit, languages)), F.col("target_lang"))
    s = source.where(F.col("target_lang").isin(languages)).withColumn("lang_no", order)
    s = first_visits(s, "query_id", ["lang_no"]).withColumn("g", F.array_position("passages.is_selected", F.lit(1))).where("g > 0").withColumn("d", F.array_position("passages.is_selected", F.lit(0)))
    tag = F.coalesce(language_tag(F.col("target_lang"), C.DATASET_TAGS), F.col("target_lang"))
    size = F.when(F.col("d") > 0, 2).otherwise(1)
    w = W.partitionBy("lang_no").orderBy("query_id").rowsBetween(W.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    twin = F.col("lang_no") == 1
    has = lambda c: (F.coalesce(c, F.lit("")) != "").cast("int")
    n = s.select("query_id", "lang_no", size.alias("size"), twin.alias("twin"), has("answer").alias("a"), has("eng_answer").alias("ea"))
    # As long as the language is open, a row gives both; what it has given only grows, so it closes once.
    n = n.withColumn("all_before", before(F.when(F.col("twin"), 2 * F.col("size")).otherwise(F.col("size")))).withColumn("own", F.col("all_before") < n_rows)
    n = n.withColumn("given", before(F.when(F.col("own"), F.col("size")).otherwise(0))).withColumn("english", before(F.when(F.col("twin"), F.col("size")).otherwise(0)))
    n = n.withColumn("eng", F.col("twin") & (F.col("given") + F.when(F.col("own"), F.col("size")).otherwise(0) + F.col("english") < 2 * n_rows))
    n = n.withColumn("made", before(F.when(F.col("own"), F.col("a")).otherwise(0) + F.when(F.col("eng"), F.col("ea")).otherwise(0))).withColumn("held", F.col("made") < n_eval)
    n = n.withColumn("own_eval", F.col("own") & (F.col("a") == 1) & (F.col("made") < n_eval))
    n = n.withColumn("eng_eval", F.col("eng") & (F.col("ea") == 1) & (F.col("made") + F.col("own_eval").cast("int") < n_eval))
    s = s.withColumn("tag", tag).join(n.select("query_id", "own", "eng", "held", "own_eval", "eng_eval"), "query_id")
    none = F.array().cast("array<string>")

    def rows(on: str, lang: Column, query: str, texts: str) -> DataFrame:
        key = lambda kind: F.concat_ws("-", "query_id", lang, F.lit(kind))
        gold = F.struct(key("g").alias("passage_id"), F.element_at(texts, F.col("g").cast("int")).alias("text"), F.when(F.col("held") | F.col(query).isNull(), none).otherwise(F.array(query)).alias("questions"))
        other = F.when(F.col("d") > 0, F.struct(key("d").alias("passage_id"), F.try_element_at(texts, F.col("d").cast("int")).alias("text"), none.alias("questions")))
        return s.where(on).select(lang.alias("lang"), F.explode(F.array_compact(F.array(gold, other))).alias("p")).select("p.passage_id", "p.text", "lang", "p.questions")

    def evals(on: str, lang: Column, query: str, said: str) -> DataFrame:
        return s.where(on).select("query_id", F.col(query).alias("query"), lang.alias("lang"), F.concat_ws("-", "query_id", lang, F.lit("g")).alias("gold_passage_id"), F.col(said).alias("gold_answer"))

    passages_ = rows("own", F.col("tag"), "query", "passages.texts").unionByName(rows("eng", F.lit("en"), "eng_query", "passages.english"))
    return passages_, evals("own_eval", F.col("tag"), "query", "answer").unionByName(evals("eng_eval", F.lit("en"), "eng_query", "eng_answer"))


def first_visits(df: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of every key by ``order``, whatever becomes of it later; keys are combined on the map side."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def locate_languages(df: DataFrame, wanted: list[str], column: str = "target_lang") -> DataFrame:
    """``file, lang`` of one file for each wanted language; raises for languages that no file has."""
    found = df.where(F.col(column).isin(wanted)).groupBy(F.col(column).alias("lang")).agg(F.min("_metadata.file_path").alias("file"))
    missing = set(wanted) - {r.lang for r in found.select("lang").collect()}  # as many rows as languages wanted
    if missing:
        raise ValueError(f"no file for {sorted(missing)}")
    return found.select("file", "lang")
