"""Command line over files and tables: ``python -m plait VERB ...``.

Paths are whatever Spark reads. Views and blobs are Parquet; documents are whole files, or Parquet with doc_id and text.
"""

from __future__ import annotations

import argparse
import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .functions import costs
from .operators import blobs, ledger, sessions, telemetry, views
from .sources import files


def documents(spark: SparkSession, path: str) -> DataFrame:
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    rows = files.read_documents(spark, path)
    return rows.select(F.xxhash64("path").alias("doc_id"), "path", "text")


def compress(spark, a):
    made = views.compress(documents(spark, a.input)) if a.max_bytes is None else views.compress_budget(documents(spark, a.input), a.max_bytes)
    made.write.mode("overwrite").parquet(f"{a.output}/views")
    made = spark.read.parquet(f"{a.output}/views")
    views.stored(made).write.mode("overwrite").parquet(f"{a.output}/blobs")
    made.agg(F.count(F.lit(1)).alias("documents"), F.sum("n_bytes").alias("bytes"), F.sum("view_bytes").alias("view_bytes")).show()


def decompress(spark, a):
    views.decompress(spark.read.parquet(f"{a.input}/views"), spark.read.parquet(f"{a.input}/blobs")).write.mode("overwrite").parquet(a.output)


def verify(spark, a):
    api.verify(spark.read.parquet(f"{a.input}/views"), spark.read.parquet(f"{a.input}/blobs")).groupBy("ok").count().show()


def retrieve(spark, a):
    span = tuple(map(int, a.lines.split("-"))) if a.lines else None
    api.retrieve(documents(spark, a.input), max_bytes=a.max_bytes, mask=not a.unmask, lines=span, pattern=a.grep, context=a.context, first=a.head, last=a.tail).select("described", "text").show(truncate=False)


def session(spark, a):
    sessions.compress(spark.read.parquet(a.input)).write.mode("overwrite").parquet(a.output)


def make_ledger(spark, a):
    lines = spark.read.text(a.input).select(F.lit(0).alias("doc_id"), F.monotonically_increasing_id().alias("seq"), "value")
    for r in ledger.index(ledger.entries(lines, a.min_bytes)).collect():
        print(r.index_text)


def gc(spark, a):
    if not a.days:  # collection is off
        return
    store = spark.read.parquet(a.input)
    cutoff = int((datetime.datetime.now(datetime.UTC) - datetime.timedelta(days=a.days)).timestamp())
    deleted, report = blobs.gc(store.withColumn("content", F.col("content").cast("string")), cutoff)
    report.show()
    if a.kept:
        store.join(deleted.select("id"), "id", "left_anti").write.mode("overwrite").parquet(a.kept)


def statusline(spark, a):
    counters = spark.read.json(a.counters, schema="total_original long, total_compressed long, append_bytes_avoided long")
    telemetry.statusline(counters, files.savings_log(spark, a.input), datetime.date.fromisoformat(a.today) if a.today else datetime.date.today()).show()


def ingest(spark, a):
    files.ingest(spark.read.text(a.input).withColumn("batch", F.col("_metadata.file_path")), "batch", a.output)


def push(spark, a):
    files.append_dataset(spark.read.json(a.input), a.output)


def pull(spark, a):
    files.download(spark, a.input, a.date).select("value").write.mode("overwrite").text(a.output)


def delete(spark, a):
    print("deleted" if files.delete_dataset(spark, a.input, a.dataset) else "not found")


def preview(spark, a):
    rows = spark.read.text(a.input).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos"), "value")
    files.sample(rows, ["file", "pos"], a.n).select("value").show(a.n, truncate=False)


def datasets(spark, a):
    files.dataset_metadata(spark, a.input).orderBy("name").show(truncate=False)


def stats(spark, a):
    api.stats(files.read_json_lines(spark, a.input, files.EVENT_SCHEMA), telemetry.pricing(spark, a.pricing), a.model).show(truncate=False)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("plait", description=__doc__)
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name, run, output=False, **options):
        v = verbs.add_parser(name)
        v.add_argument("input")
        if output:
            v.add_argument("output")
        for k, (kind, default) in options.items():
            if kind is bool:
                v.add_argument("--" + k.replace("_", "-"), action="store_true")
            else:
                v.add_argument("--" + k.replace("_", "-"), type=kind, default=default)
        v.set_defaults(run=run)

    verb("compress", compress, True, max_bytes=(int, None))
    verb("decompress", decompress, True)
    verb("verify", verify)
    verb("retrieve", retrieve, lines=(str, None), grep=(str, None), context=(int, 0), head=(int, None), tail=(int, None), max_bytes=(int, None), unmask=(bool, False))
    verb("session", session, True)
    verb("ledger", make_ledger, min_bytes=(int, costs.LEDGER_MIN_BYTES))
    verb("gc", gc, days=(int, 7), kept=(str, None))
    verb("statusline", statusline, counters=(str, None), today=(str, None))
    verb("ingest", ingest, True)
    verb("push", push, True)
    verb("pull", pull, True, date=(str, None))
    verb("delete", delete, dataset=(str, ""))
    verb("preview", preview, n=(int, 10))
    verb("datasets", datasets)
    verb("stats", stats, model=(str, "default"), pricing=(str, None))
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    a.run(SparkSession.builder.appName("plait").getOrCreate(), a)


if __name__ == "__main__":
    main()
