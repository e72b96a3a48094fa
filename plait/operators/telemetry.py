"""Aggregates over usage events: savings, tools, recent rates and status lines. All native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import classify, costs


def pricing(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(model, input_per_mtok, cache_read_per_mtok): the built-in table, or a JSON file of {model: {...}} in its place."""
    if path is None:
        return spark.createDataFrame([(k, *v) for k, v in costs.PRICING.items()], "model string, input_per_mtok double, cache_read_per_mtok double")
    rate = "struct<input_per_mtok:double,cache_read_per_mtok:double>"
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{rate}>")).alias("model", "r"))
    return whole.select("model", "r.input_per_mtok", "r.cache_read_per_mtok")


def with_rates(rows: DataFrame, rates: DataFrame, model: str = "model") -> DataFrame:
    """``rows`` with the rates of their model, or the default's. Rate tables are a handful of rows by nature."""
    known = F.broadcast(rates.where("model <> 'default'").select(F.col("model").alias(model), "input_per_mtok", "cache_read_per_mtok"))
    base = rates.where("model = 'default'").select("input_per_mtok", "cache_read_per_mtok").first()
    i, c = (base[0], base[1]) if base else (None, None)
    joined = rows.join(known, model, "left")
    return joined.withColumns({"input_per_mtok": F.coalesce("input_per_mtok", F.lit(i).cast("double")), "cache_read_per_mtok": F.coalesce("cache_read_per_mtok", F.lit(c).cast("double"))})


def token_estimate(docs: DataFrame, klass: Column | None = None) -> DataFrame:
    """(lang, class, n_docs, n_bytes, tokens): sizes and estimated tokens by language and content class (``klass``, else that of the text)."""
    klass = classify.content_class(F.col("text")) if klass is None else klass
    rows = docs.select("lang", klass.alias("class"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("b"))
    sums = rows.groupBy("lang", "class").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("b").alias("n_bytes"))
    return sums.withColumn("tokens", F.round(classify.estimated_tokens(F.col("n_bytes"), F.col("class")), 3))


def lifetime(events: DataFrame, original: str = "original_bytes", compressed: str = "compressed_bytes") -> DataFrame:
    """(calls, original, compressed, saved, saved_pct)"""
    sums = events.agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum(original), F.lit(0)).alias("original"), F.coalesce(F.sum(compressed), F.lit(0)).alias("compressed"))
    saved = F.greatest(F.lit(0).cast("long"), F.col("original") - F.col("compressed"))
    return sums.withColumns({"saved": saved, "saved_pct": classify.saved_percent(F.col("original"), F.col("compressed"))})


def saved_tokens(saved: Column, appended: Column) -> Column:
    return (saved + appended) / costs.BYTES_PER_TOKEN["prose"]


def usd(tokens: Column, rate: Column) -> Column:
    return tokens / 1e6 * rate


def reports(usage: DataFrame, by: str = "key", every: int = costs.REPORT_EVERY, rate: float = costs.PRICING["default"][0]) -> DataFrame:
    """One report of ``by`` (a host) after each ``every`` compressions, over all of its compressions so far:
    (by, calls, original, compressed, saved, saved_pct, tokens_saved, cost_saved_usd). Sending them is left to a sink.
    """
    upto = W.partitionBy(by).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    rows = usage.where("is_retrieve = 0").select(by, F.count(F.lit(1)).over(upto).alias("calls"), F.sum("original_bytes").over(upto).alias("original"), F.sum("compressed_bytes").over(upto).alias("compressed"))
    rows = rows.where(F.col("calls") % every == 0).withColumn("saved", F.greatest(F.lit(0).cast("long"), F.col("original") - F.col("compressed")))
    tokens = saved_tokens(F.col("saved"), F.lit(0))
    return rows.withColumns({"saved_pct": F.round(F.coalesce(F.try_divide(F.col("saved") * 100.0, F.col("original")), F.lit(0.0)), 1), "tokens_saved": F.floor(tokens), "cost_saved_usd": F.round(usd(tokens, F.lit(rate)), 6)})


def tool_metrics(events: DataFrame, by: str = "tool", limit: int = 20) -> DataFrame:
    """The ``limit`` most used values of ``by``: compressions, retrieves, bytes, retrieve_rate, net_saved (a top-k report)."""
    retrieved = F.col("is_retrieve") == 1
    sums = events.groupBy(by).agg(
        F.count_if(~retrieved).alias("compressions"),
        F.count_if(retrieved).alias("retrieves"),
        F.sum("bytes_saved").alias("bytes_saved"),
        F.sum("bytes_retrieved").alias("bytes_retrieved"),
    )
    n = F.col("compressions") + F.col("retrieves")
    out = sums.withColumns({"retrieve_rate": F.when(n > 0, F.round(F.col("retrieves") / n, 6)).otherwise(F.lit(0.0)), "net_saved": F.col("bytes_saved") - F.col("bytes_retrieved")})
    return out.orderBy(F.desc("compressions"), by).limit(limit)


def recent_rates(events: DataFrame, by: str = "tool", seq: str = "seq", window: int = costs.RECENT_EVENTS) -> DataFrame:
    """Each event with its tool's retrieve rate over the last ``window`` events and the size that suggests."""
    part = W.partitionBy(by).orderBy(seq).rowsBetween(1 - window, 0)
    hits, n = F.sum("is_retrieve").over(part), F.count(F.lit(1)).over(part)
    rows = events.withColumns({"hits": hits, "n_recent": n})
    # rate > 0.30 in whole numbers
    above = F.col("hits") * 100 > F.col("n_recent") * int(costs.RETRIEVE_RATE * 100)
    return rows.withColumn("suggested_min_bytes", F.when(above, costs.SUGGESTED_MIN_BYTES).otherwise(0))


def latest_rates(events: DataFrame, by: str = "tool", seq: str = "seq") -> DataFrame:
    """(tool, hits, n_recent, suggested_min_bytes) after the last event of each."""
    rows = recent_rates(events, by, seq)
    return rows.groupBy(by).agg(F.max_by("hits", seq).alias("hits"), F.max_by("n_recent", seq).alias("n_recent"), F.max_by("suggested_min_bytes", seq).alias("suggested_min_bytes"))


def proxy_stats(events: DataFrame) -> DataFrame:
    """Calls and bytes by tool with a grand total (null tool), in one pass of grouping sets; ordered by bytes saved."""
    sums = events.groupingSets([["tool"], []], "tool").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("compressed_bytes") < F.col("original_bytes")).alias("compressed_calls"),
        F.sum("original_bytes").alias("original_bytes"),
        F.sum("compressed_bytes").alias("compressed_bytes"),
    )
    saved = F.greatest(F.lit(0).cast("long"), F.col("original_bytes") - F.col("compressed_bytes"))
    ratio = F.round(classify.compression_ratio(F.col("original_bytes"), F.col("compressed_bytes")), 3)
    return sums.withColumns({"saved_bytes": saved, "ratio": ratio}).orderBy(F.desc("saved_bytes"), "tool")


def statusline(counters: DataFrame, log: DataFrame, today) -> DataFrame:
    """(lifetime_saved, today_saved) of counters (total_original, total_compressed, append_bytes_avoided) and log (d, saved, tool)."""
    c = counters.select((F.greatest(F.lit(0), F.col("total_original") - F.col("total_compressed")) + F.col("append_bytes_avoided")).alias("life"), F.lit(0).alias("now"))
    rows = log.select(F.coalesce("saved", F.lit(0)).alias("life"), F.when(F.col("d") == F.lit(today), F.coalesce("saved", F.lit(0))).otherwise(0).alias("now"))
    return c.unionByName(rows).agg(F.coalesce(F.sum("life"), F.lit(0)).cast("long").alias("lifetime_saved"), F.coalesce(F.sum("now"), F.lit(0)).cast("long").alias("today_saved"))


def allowed(calls: DataFrame, deny: DataFrame, thresholds: DataFrame, default: int = costs.HOOK_THRESHOLD) -> DataFrame:
    """Calls (tool, n_bytes, is_error, ...) to compress: tool not denied, no error, larger than the tool's threshold or the default."""
    name = F.regexp_replace(F.upper("tool"), "[^A-Z0-9]", "_")
    rows = calls.join(deny.select("tool").distinct(), "tool", "left_anti").where(~F.coalesce("is_error", F.lit(False)))
    rows = rows.withColumn("tool_name", name).join(thresholds.select(F.col("tool").alias("tool_name"), "min_bytes"), "tool_name", "left")
    return rows.where(F.col("n_bytes") > F.coalesce("min_bytes", F.lit(default))).drop("min_bytes", "tool_name")


def merge_tools(ours: DataFrame, theirs: DataFrame, prefix: str = "pb_") -> DataFrame:
    """Union of tool lists (name, description); ours that collide with one of theirs get a prefix."""
    hit = theirs.select("name", F.lit(True).alias("taken")).distinct()
    renamed = ours.join(hit, "name", "left").select(F.when(F.col("taken"), F.concat(F.lit(prefix), F.col("name"))).otherwise(F.col("name")).alias("name"), "description")
    return theirs.select("name", "description").unionByName(renamed)
