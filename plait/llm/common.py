"""Helpers shared by the training-data operators.

Everything that must survive the loss of an executor is written as Parquet
below ``spark.checkpoint.dir`` (read from the session), never to a
machine-local folder and never with ``localCheckpoint``. Tables that a later one
replaces are deleted by the operators, and the rest when the application ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Whitespace that separates words: space and U+0009 to U+000D.
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a private one only where all run in one process."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.plait.local.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        path = "file://" + tempfile.mkdtemp(prefix="plait-checkpoint-")
        spark.conf.set("spark.plait.local.checkpoint.dir", path)
    return path.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _delete_all(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        _delete(spark, path)


_FOLDERS: set[str] = set()


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage durably."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/plait/{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_delete_all, spark, folder)
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._plait_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._plait_path)


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns beside ``__plait_row``, a struct of all columns: ``select("__plait_row.*")`` gives them back, whatever their names."""
    return docs.select(F.struct("*").alias("__plait_row"), *names)


#: Bytes of one Arrow batch between Spark and Python.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after limiting the Arrow batches of its session: a task holds several at once, and texts may be long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def same_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")
