"""The content-addressed store as tables: blobs (id, content, n_bytes, first_seen)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify


def content_ids(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with id (SHA-256 of the UTF-8 bytes, null for null) and n_bytes."""
    return docs.withColumns({"id": F.sha2(F.col(text).cast("binary"), 256), "n_bytes": F.octet_length(text).cast("long")})


def distinct_blobs(docs: DataFrame, seq: str) -> DataFrame:
    """(id, n_bytes, first_seen, n_copies) over documents in the order of ``seq``."""
    return content_ids(docs).where("id is not null").groupBy("id", "n_bytes").agg(F.min(seq).alias("first_seen"), F.count(F.lit(1)).alias("n_copies"))


def put(store: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` (id, ...) that the store does not hold yet, one for each id. Append them to store them."""
    return new.dropDuplicates(["id"]).join(store.select("id"), "id", "left_anti")


def exists(refs: DataFrame, store: DataFrame) -> DataFrame:
    """``refs`` (id, ...) that the store holds: only ids are read."""
    return refs.join(store.select("id"), "id", "left_semi")


def missing(refs: DataFrame, store: DataFrame) -> DataFrame:
    return refs.join(store.select("id"), "id", "left_anti")


def get(refs: DataFrame, store: DataFrame) -> DataFrame:
    return refs.join(store, "id")


def stats(store: DataFrame) -> DataFrame:
    """(entries, bytes) of the rows with a valid id."""
    return store.where(classify.is_valid_id(F.col("id"))).agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes"))


def verify(refs: DataFrame, store: DataFrame) -> DataFrame:
    """(view_id, checked_refs, missing_refs, ok) of refs (view_id, id); ids are compared in lower case."""
    ours = refs.select("view_id", F.lower("id").alias("id"))
    joined = ours.join(store.select("id", F.lit(1).alias("here")), "id", "left")
    gone = F.array_sort(F.collect_set(F.when(F.col("here").isNull(), F.col("id"))))
    return joined.groupBy("view_id").agg(F.count(F.lit(1)).alias("checked_refs"), gone.alias("missing_refs")).withColumn("ok", F.size("missing_refs") == 0)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a private one only where all run in one process and the session names none."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        master = spark.sparkContext.master
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        path = "file://" + tempfile.mkdtemp(prefix="plait-checkpoint-")
    return path.rstrip("/")


def cut(df: DataFrame, label: str = "gc") -> DataFrame:
    """Write and read again in the shared folder: what follows does not run the past again."""
    path = f"{shared_folder(df.sparkSession)}/plait/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reachable(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids that ``edges`` (id, to) reach from ``roots`` (id), roots included.

    References follow content hashes and so have no cycles; the rounds number the longest chain. Each round's
    frontier is written, and only the question whether it is empty reaches the driver.
    """
    seen = cut(roots.select("id").distinct())
    front = seen
    while True:
        front = cut(edges.join(front, "id").select(F.col("to").alias("id")).distinct().join(seen, "id", "left_anti"))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front))


def references(store: DataFrame) -> DataFrame:
    """(id, to): ids of other blobs that a blob's content holds, found by their shape and an equi-join."""
    found = store.select("id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("(?=([0-9a-f]{64}))"), F.lit(1)))).alias("to"))
    return found.join(store.select(F.col("id").alias("to")), "to").where("id <> to").select("id", "to")


def gc(store: DataFrame, cutoff, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(what to delete, one row of deleted, freed_bytes, skipped_no_provenance).

    Candidates were first seen before the cutoff; those that a survivor reaches survive. A blob of unknown age
    survives and is counted. Nothing is deleted here: keep ``store.join(deleted, "id", "left_anti")``.
    """
    old = F.coalesce(F.col("first_seen") < F.lit(cutoff), F.lit(False))
    safe = reachable(store.where(~old), references(store) if edges is None else edges)
    marked = store.withColumn("old", old).join(safe.withColumn("live", F.lit(True)), "id", "left")
    gone = F.col("old") & F.col("live").isNull()
    report = marked.agg(F.count_if(gone).alias("deleted"), F.coalesce(F.sum(F.when(gone, F.col("n_bytes"))), F.lit(0)).alias("freed_bytes"), F.count_if(F.col("first_seen").isNull()).alias("skipped_no_provenance"))
    deleted = marked.where(gone).select(*store.columns)
    return deleted, report
