"""Records that are the same but for formatting, found by dictionary encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thornbill.tables import WS, canonical, durable, is_blank, table


def passage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_id, passage_id, text`` of every record: rows of passages whose text is neither null nor blank, and
    rows of raw_passages whose ``record`` is well-formed JSON (a missing or null field is null). Records that are
    cut off are no records."""
    p = table(spark, sf_dir, "passages").select("row_id", "passage_id", "text").where(F.col("text").isNotNull() & ~is_blank(F.col("text")))
    v = F.try_parse_json("record")
    r = table(spark, sf_dir, "raw_passages").select("row_id", v.alias("v")).where("v is not null")
    r = r.select("row_id", *(F.try_variant_get("v", f"$.{k}", "string").alias(k) for k in ("passage_id", "text")))
    return p.unionByName(r)


def _digest(value: Column) -> Column:
    """128 bits of a value; no bytes for null."""
    return F.coalesce(F.unhex(F.md5(value)), F.lit(b""))


def encode(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key, codes``: each record as the sorted array of (field number, value number).

    Distinct raw values are found first, each is canonicalised once, and equal canonical values get one integer:
    the smallest ``key`` at which the value occurs, unique within its field and the same in every run. Texts are
    shuffled once, by digest, copies combined on the map side; from then on only digests and integers move. A null
    value has a code of its own, other than that of an empty text. An empty table gives an empty table.
    """
    cells = records.select(key, F.posexplode(F.array(*(F.col(f).cast("string") for f in fields))).alias("field", "value"))
    cells = cells.withColumn("digest", _digest(F.col("value")))
    values = cells.groupBy("field", "digest").agg(F.min(key).alias("first"), F.any_value("value").alias("value"))
    values = durable(values.select("field", "digest", "first", _digest(canonical(F.col("value"))).alias("form")))  # read for the codes and again for the dictionary
    codes = values.groupBy("field", "form").agg(F.min("first").alias("code"))
    dictionary = values.join(codes, ["field", "form"]).select("field", "digest", "code")
    coded = cells.select(key, "field", "digest").join(dictionary, ["field", "digest"])
    return coded.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("field", "code"))).alias("codes"))


def copies(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``codes, first, n_copies``: each distinct record once, its smallest key and how many records it stands for."""
    return encode(records, key, fields).groupBy("codes").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n_copies"))


def duplicates(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``first, copy``: one row for each record that is a copy of one with a smaller key. The groups are counted
    with map-side combining; the join back has one row a group on one side, so a hot group is split by the
    adaptive skew join, never gathered."""
    coded = durable(encode(records, key, fields))  # compact tuples, read for the groups and again for their members
    heads = coded.groupBy("codes").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return coded.join(heads, "codes").where(F.col(key) != F.col("first")).select("first", F.col(key).alias("copy"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``first_row_id, copy_row_id`` of every passage record that repeats one with a smaller row_id."""
    return duplicates(passage_records(spark, sf_dir), "row_id", ["passage_id", "text"]).toDF("first_row_id", "copy_row_id")


def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_id, n_copies``: each passage record once, by its smallest row_id, with the number of its copies."""
    return copies(passage_records(spark, sf_dir), "row_id", ["passage_id", "text"]).select(F.col("first").alias("row_id"), "n_copies")


_RECORDS = rf"""
with rec as (
  select row_id, passage_id, text from passages where text is not null and regexp_matches(text, '[^{WS}]')
  union all
  select row_id, json_extract_string(record, '$.passage_id'), json_extract_string(record, '$.text') from raw_passages where json_valid(record)),
canon as (
  select row_id, lower(upper(regexp_replace(passage_id, '[^\p{{L}}\p{{M}}\p{{Nd}}]', '', 'g'))) a,
         lower(upper(regexp_replace(text, '[^\p{{L}}\p{{M}}\p{{Nd}}]', '', 'g'))) b from rec)
"""

ORACLES = {
    "p4_found": _RECORDS + ", g as (select row_id, min(row_id) over (partition by a, b) f from canon) select f as first_row_id, row_id as copy_row_id from g where f <> row_id",
    "p4_records": _RECORDS + "select min(row_id) as row_id, count(*) as n_copies from canon group by a, b",
}
QUERIES = {"p4_found": p4_found, "p4_records": p4_records}
