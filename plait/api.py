"""The eight operations of the engine over DataFrames.

``compress``, ``decompress``, ``verify``, ``retrieve``, ``changed``, ``compress_budget``, ``compress_append`` and ``stats``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import classify, costs, masking
from .operators import blobs, lines, sessions, telemetry, views

compress = views.compress
decompress = views.decompress
compress_budget = views.compress_budget
changed = sessions.changed


def verify(made: DataFrame, store: DataFrame) -> DataFrame:
    """(view_id, checked_refs, missing_refs, ok) for the views that refer to blobs; only ids of the store are read."""
    return blobs.verify(views.references(made), store)


def retrieve(docs: DataFrame, max_bytes: int | None = None, mask: bool = True, **selection) -> DataFrame:
    """(doc_id, text, n_lines, total_lines, total_bytes, described): a slice of each text. Without a selector the text is exact.

    ``max_bytes`` makes a budgeted view of a slice that is larger; masking is for display and on by default.
    """
    total = docs.select("doc_id", F.size(classify.text_lines(F.col("text"))).cast("long").alias("total_lines"), F.octet_length("text").cast("long").alias("total_bytes"))
    if not any(selection.get(k) is not None for k in ("lines", "pattern", "first", "last")):
        out = docs.select("doc_id", "text").join(total, "doc_id").withColumn("n_lines", F.col("total_lines"))
    else:
        rows = lines.select_lines(docs, **selection)
        ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
        cut = rows.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"), F.count(F.lit(1)).alias("n_lines"))
        out = total.join(cut, "doc_id", "left").withColumns({"text": F.coalesce("text", F.lit("")), "n_lines": F.coalesce("n_lines", F.lit(0).cast("long"))})
    out = out.withColumn("described", lines.describe(F.col("total_lines"), F.col("n_lines"), **selection))
    if max_bytes is not None:
        made = compress_budget(out.select("doc_id", "text"), max_bytes).select("doc_id", "body")
        out = out.join(made, "doc_id").withColumn("text", F.when(F.octet_length("text") > max_bytes, F.col("body")).otherwise(F.col("text"))).drop("body")
    return out.withColumn("text", masking.mask_secrets("text")["masked"]) if mask else out


def compress_append(chunks: DataFrame) -> DataFrame:
    """Only the new chunk of each append, with running totals: (key, seq, chunk_bytes, total_bytes, avoided_bytes)."""
    return sessions.appended(chunks)


def stats(events: DataFrame, rates: DataFrame, model: str = "default", append_avoided: int = 0) -> DataFrame:
    """One row: calls, bytes, savings, estimated tokens and USD for a model."""
    sums = telemetry.lifetime(events).withColumn("model", F.lit(model))
    tokens = telemetry.saved_tokens(F.col("saved"), F.lit(append_avoided))
    priced = telemetry.with_rates(sums, rates).withColumn("tokens_saved", F.round(tokens, 3))
    return priced.withColumn("usd_saved", F.round(telemetry.usd(F.col("tokens_saved"), F.col("input_per_mtok")), 6))


__all__ = ["changed", "compress", "compress_append", "compress_budget", "costs", "decompress", "retrieve", "stats", "verify"]
