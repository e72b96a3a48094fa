"""Files and datasets as sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: Superset of the usage events, one nullable field for each of their fields.
EVENT_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("event", "session_id", "key", "content_type", "server", "tool", "agent_id", "agent_type", "direction")]
    + [T.StructField(n, T.LongType()) for n in ("ts", "original_bytes", "compressed_bytes", "view_bytes", "restored_bytes", "result_bytes", "prompt_bytes", "parent_context_bytes", "tool_calls", "duration_ms", "input_tokens", "output_tokens", "bytes", "total_calls", "total_original_bytes", "total_compressed_bytes", "subagents_spawned", "subagent_total_tokens")]
    + [T.StructField(n, T.DoubleType()) for n in ("ratio", "compression_ratio", "saved_pct")]
    + [T.StructField("auto_compressed", T.BooleanType())]
)
# The names of events that are taken.
EVENTS = ("compress", "decompress", "tool_call", "subagent_spawn", "subagent_complete", "context_transfer", "session_end")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files; ``text`` is null where a file is no UTF-8, ``content`` has the bytes."""
    rows = spark.read.format("binaryFile").load(path)
    text = F.when(F.is_valid_utf8("content"), F.decode("content", "utf-8"))
    return rows.select("path", "content", text.alias("text"), F.col("length").alias("n_bytes"), "modificationTime")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Records of an NDJSON path; malformed lines are skipped."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    with_bad = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(with_bad).json(path, mode="PERMISSIVE")
    # the parsed rows are kept apart from the raw ones, which a filter on the corrupt column alone may not read
    return rows.select("*").where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def savings_log(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, T.StructType([T.StructField("d", T.DateType()), T.StructField("saved", T.LongType()), T.StructField("tool", T.StringType())]))


def parse_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """``lines`` with e (the event) and valid: JSON, a known event name and a session id."""
    e = F.from_json(F.col(column), EVENT_SCHEMA)
    rows = lines.withColumn("e", e)
    ok = F.try_parse_json(column).isNotNull() & F.col("e.event").isin(*EVENTS) & (F.length(F.coalesce("e.session_id", F.lit(""))) > 0)
    return rows.withColumn("valid", F.coalesce(ok, F.lit(False)))


def accept_batches(lines: DataFrame, batch: str, column: str = "value") -> DataFrame:
    """(batch, n_lines, n_bad, accepted): a batch is taken whole or not at all."""
    rows = parse_events(lines, column)
    return rows.groupBy(batch).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(~F.col("valid")).alias("n_bad")).withColumn("accepted", F.col("n_bad") == 0)


def ingest(lines: DataFrame, batch: str, path: str, column: str = "value") -> None:
    """Write the lines of accepted batches as NDJSON, partitioned by date and session."""
    good = accept_batches(lines, batch, column).where("accepted").select(batch)
    rows = parse_events(lines, column).join(good, batch, "left_semi")
    day = F.coalesce(F.to_date(F.timestamp_seconds(F.col("e.ts"))), F.current_date())
    rows.select(F.col(column).alias("value"), day.alias("date"), F.col("e.session_id").alias("session_id")).write.partitionBy("date", "session_id").mode("append").text(path)


def append_dataset(rows: DataFrame, path: str) -> None:
    """Append one chunk of JSON records."""
    rows.write.mode("append").json(path)


def dataset_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(name, chunks, size_bytes, updated_at) of each dataset below a path: from listing, no record is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path).drop("content")
    name = F.regexp_extract("path", r"([^/]+)/[^/]+\z", 1)
    return files.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("chunks"), F.sum("length").alias("size_bytes"), F.max("modificationTime").alias("updated_at"))


def delete_dataset(spark: SparkSession, path: str, name: str) -> bool:
    """Delete the dataset ``name`` below a path with all its chunks; whether it was there."""
    if name in ("", ".", "..") or "/" in name:
        raise ValueError(f"{name!r} is no name of a dataset")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def download(spark: SparkSession, path: str, date: str | None = None) -> DataFrame:
    """Lines of a dataset; a date prunes partitions."""
    rows = spark.read.text(path)
    return rows.where(F.col("date") == F.lit(date).cast("date")) if date is not None else rows


def sample(rows: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """The first n records in the order of their keys, one at least (the limit is the feature)."""
    return rows.orderBy(*order).limit(max(1, n))


def dataset_stats(events: DataFrame, session: str, ts: str, size: str) -> DataFrame:
    """(total_rows, total_bytes, sessions, first_day, last_day)"""
    day = F.to_date(ts)
    return events.agg(F.count(F.lit(1)).alias("total_rows"), F.sum(size).alias("total_bytes"), F.countDistinct(session).alias("sessions"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def distribution(events: DataFrame, event: str) -> DataFrame:
    """(event, n, pct) with each event's share of all, most frequent first. The total is taken over the few sums."""
    counts = events.groupBy(F.col(event).alias("event")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(1)))
    return counts.withColumn("total", total).select("event", "n", F.round(F.col("n") * 100.0 / F.col("total"), 4).alias("pct")).orderBy(F.desc("n"), "event")


def path_metadata(files: DataFrame) -> DataFrame:
    """(dates, sessions, size_bytes, updated_at) read from paths of the form .../{date}/{session}/{ms}.jsonl; files: (path, length, modificationTime)."""
    part = lambda k: F.regexp_extract("path", r"/([0-9]{4}-[0-9]{2}-[0-9]{2})/([^/]+)/[^/]+\z", k)
    return files.agg(F.countDistinct(F.nullif(part(1), F.lit(""))).alias("dates"), F.countDistinct(F.nullif(part(2), F.lit(""))).alias("sessions"), F.sum("length").alias("size_bytes"), F.max("modificationTime").alias("updated_at"))
