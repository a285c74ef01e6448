"""Reading tables, cutting lineage durably, and the character classes shared by both SQL dialects."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Unicode white space, spelled out so that Java and RE2 read the same class (RE2's own \s is ASCII only).
WS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Keys whose hashes are sent to every task at once, 16 bytes each; of more keys none is sent.
SENT = 1_000_000
#: What is not a letter, a combining mark or a decimal digit.
NOT_ALNUM = r"[^\p{L}\p{M}\p{Nd}]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``; only the columns a plan uses are read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session. Only where none is named and all runs on one machine (tests, a laptop) is one made;
    on a cluster without one this raises, as a folder of one machine would be lost with it."""
    sc = spark.sparkContext
    have = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        have = tempfile.mkdtemp(prefix="thornbill-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(have)
    return have


def _remove(spark: SparkSession, path: str) -> None:
    fs, where = _path(spark, path)
    fs.delete(where, True)


def release(spark: SparkSession) -> None:
    """Removes all that :func:`durable` wrote in this session; whatever was built on it can't be read afterwards."""
    _kept.clear()
    for path in _written.pop(spark.sparkContext.applicationId, ()):
        _remove(spark, path)


def written(spark: SparkSession, path: str) -> None:
    """Says that a path is this session's, to be removed with it."""
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)


def _path(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _path(spark, path)
    return fs.exists(where)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, where = _path(spark, path)
    return fs.exists(where) and fs.getFileStatus(where).isDirectory()


def version(spark: SparkSession, path: str) -> tuple:
    """Time and size of the files below a path; other content has another version."""
    fs, where = _path(spark, path)
    return tuple((f.getPath().toString(), f.getModificationTime(), f.getLen()) for f in fs.listStatus(where))


def kept(spark: SparkSession, key: tuple, build: Callable[[], object]) -> object:
    """What ``build`` gives, built once for each key and session; for tables that were written and are only read from then on."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _kept:
        _kept[key] = build()
    return _kept[key]


_kept: dict[tuple, object] = {}
#: What was written, by application; removed when the driver ends.
_written: dict[str, list[str]] = {}


def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    with contextlib.suppress(Exception):
        release(spark)


atexit.register(_release_at_exit)


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as compressed columns and read again, its lineage cut; survives lost executors.
    Plans built on it read only the columns they use, and see its size."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    written(spark, path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def among(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` may be in ``wanted`` (one column, written before), so that a join that follows shuffles only these:
    the keys' 64-bit hashes are sent, at most SENT of them, else all rows stay. A few others may be left in."""
    if wanted.count() > SENT:
        return rows
    hashes = wanted.select(F.xxhash64(wanted.columns[0]).alias("_h")).distinct()
    return rows.withColumn("_h", F.xxhash64(key)).join(F.broadcast(hashes), "_h", "left_semi").select(*rows.columns)


def is_blank(c: Column) -> Column:
    """True where a text has nothing but white space of any kind; null for null."""
    return ~c.rlike(f"[^{WS}]")


def canonical(c: Column) -> Column:
    """Letters, combining marks and digits only, case folded by upper and lower; null for null."""
    return F.lower(F.upper(F.regexp_replace(c, NOT_ALNUM, "")))
