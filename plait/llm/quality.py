"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Native: Spark expressions only. Each document gets whole-text metrics. Each metric is a
smoothed ratio (x + 1) / (y + 1), and its bucket is floor(32 * ln(ratio)): buckets are 3 % wide wherever the
ratio lies. The counts of a (lang, source) group's buckets are its quantile sketch: sketches of parts of a group
merge by adding counts (which the map-side combine does, so a hot source
costs no more than another), quantiles have a relative error of one bucket, and results
do not depend on the order of merging. A document is rejected when a metric
lies above its group's fence, q75 + reach * (q75 - q25), in logarithms; for word length
also below q25 - reach * (q75 - q25). So a fence is made of the group's quartiles alone: no value of a metric is
fixed, and a group whose documents vary more has wider fences. By the smoothing, a count of zero
weighs more in a short text, so quartiles differ even where most documents have no symbol or repeated line.
Groups of fewer than ``min_rows`` documents use the merged sketch of their language, and languages of fewer the
sketch of all.

The base rules reject texts under 20 words and texts of which over 30 % of the words lie
in 8-word windows found twice or more. Windows are compared by 64-bit hashes.

Defined cases. Null and blank texts have no words: all measures are zero and the base
rules reject them. Null lang or source form groups of their own. Repeated rows count and
are judged one by one. An empty table gives an empty table. Extra columns of any name are kept by
``quality_filter``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, let, materialise, packed, words_of

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
MIN_ROWS = 200
#: Thresholds are broadcast up to so many groups, which is counted first; beyond, they join by shuffle.
BROADCAST_GROUPS = 20_000
#: Buckets of a sketch for each factor of e.
PER_E = 32
#: metric: (x, y, reach in interquartile ranges, also bounded below)
METRICS = {
    "symbol_ratio": ("n_symbols", "word_chars", 2, False),
    "dup_line_ratio": ("n_dup_lines", "n_lines", 2, False),
    "stutter_ratio": ("n_stutter", "n_words", 3, False),
    "upper_ratio": ("n_upper", "word_chars", 4, False),
    "word_length": ("word_chars", "n_words", 4, True),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_stutter")


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more, given the hashes in order of position."""

    def of_sorted(s: Column) -> Column:
        n = F.size(s)
        same = F.zip_with(F.slice(s, F.lit(1), n - 1), F.slice(s, F.lit(2), n - 1), lambda a, b: a["h"] == b["h"])
        no = F.array(F.lit(False))

        def of_same(e: Column) -> Column:
            twice = F.zip_with(F.concat(no, e), F.concat(e, no), lambda a, b: a | b)
            at = F.zip_with(s, twice, lambda x, t: F.when(t, x["p"]))
            return let(F.sort_array(F.array_compact(at)), of_positions)

        return let(same, of_same)

    def of_positions(p: Column) -> Column:
        m = F.size(p)
        steps = F.zip_with(F.slice(p, F.lit(1), m - 1), F.slice(p, F.lit(2), m - 1), lambda a, b: F.least(F.lit(WINDOW), b - a))
        return F.aggregate(steps, F.lit(WINDOW), lambda acc, x: acc + x)

    keyed = F.transform(hashes, lambda h, p: F.struct(h.alias("h"), p.alias("p")))
    return let(F.sort_array(keyed), of_sorted)


def _repeat_words(words: Column) -> Column:
    n = F.size(words)
    each = lambda w: F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), each)
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))
    return F.when(n < WINDOW, F.lit(0)).otherwise(found)


def _stutter(words: Column) -> Column:
    """Words that equal the word before."""
    n = F.size(words)
    same = F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: a == b)
    return F.when(n < 2, F.lit(0)).otherwise(F.size(F.filter(same, lambda x: x)))


def measures(text: Column) -> Column:
    """A struct of the whole-text measures, all long."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    of_words = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            _stutter(w).cast("long").alias("n_stutter"),
        ),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return let(
        F.struct(of_words.alias("w"), of_lines.alias("l"), F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), F.regexp_count(whole, F.lit("\\p{Lu}")).cast("long").alias("n_upper")),
        lambda s: F.struct(s["w"]["n_words"].alias("n_words"), s["w"]["word_chars"].alias("word_chars"), s["n_symbols"].alias("n_symbols"), s["l"]["n_dup_lines"].alias("n_dup_lines"), s["w"]["n_repeat_words"].alias("n_repeat_words"), s["l"]["n_lines"].alias("n_lines"), s["n_upper"].alias("n_upper"), s["w"]["n_stutter"].alias("n_stutter")),
    )


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEAT_PERCENT)


def bucket(m: Column, metric: str) -> Column:
    """The sketch's bucket of a smoothed ratio."""
    num, den, *_ = METRICS[metric]
    return F.floor(F.log((m[num] + 1) / (m[den] + 1)) * PER_E)


def sketches(measured: DataFrame, m: str) -> DataFrame:
    """(lang, source, metric, bucket, n): the sketch of every group over the documents that pass the base rules."""
    each = F.array(*[F.struct(F.lit(k).alias("metric"), bucket(F.col(m), k).alias("bucket")) for k in METRICS])
    rows = measured.where(~base_failed(F.col(m))).select("lang", "source", F.explode(each).alias("e"))
    return rows.groupBy("lang", "source", "e.metric", "e.bucket").agg(F.count(F.lit(1)).alias("n"))


def _quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Merge the sketches within ``by`` and read (n, q25, q75) of each metric."""
    merged = sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    part = W.partitionBy(*by, "metric")
    ranked = merged.withColumn("upto", F.sum("n").over(part.orderBy("bucket"))).withColumn("all", F.sum("n").over(part))
    at = lambda p: F.min(F.when(F.col("upto") * 100 >= F.col("all") * p, F.col("bucket")))
    return ranked.groupBy(*by, "metric").agg(F.max("all").alias("n"), at(25).alias("q25"), at(75).alias("q75"))


def thresholds(sketch: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """(lang, source, <metric>_high, <metric>_low): one row for each group, bounds in buckets."""
    named = lambda df, p: df.select(*[F.col(c).alias(p + c) for c in df.columns])
    g, of_lang, of_all = (named(_quartiles(sketch, by), p) for by, p in ((["lang", "source"], "g_"), (["lang"], "l_"), ([], "a_")))
    joined = g.join(of_lang, g.g_lang.eqNullSafe(of_lang.l_lang) & (g.g_metric == of_lang.l_metric), "left").join(of_all, F.col("g_metric") == F.col("a_metric"), "left")
    pick = lambda q: F.when(F.col("g_n") >= min_rows, F.col("g_" + q)).when(F.col("l_n") >= min_rows, F.col("l_" + q)).otherwise(F.col("a_" + q))
    long = joined.select(F.col("g_lang").alias("lang"), F.col("g_source").alias("source"), F.col("g_metric").alias("metric"), pick("q25").alias("q25"), pick("q75").alias("q75"))
    spread, aggs = F.col("q75") - F.col("q25"), []
    for k, (_, _, reach, _) in METRICS.items():
        aggs += [F.max(F.when(F.col("metric") == k, F.col("q75") + spread * reach)).alias(f"{k}_high"), F.max(F.when(F.col("metric") == k, F.col("q25") - spread * reach)).alias(f"{k}_low")]
    return long.groupBy("lang", "source").agg(*aggs)


def judge(measured: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """``measured`` (a written table of ``__plait_m``, lang, source and any others) with ``__plait_failed`` and ``__plait_kept``."""
    sketch = materialise(sketches(measured, "__plait_m"), "sketches")
    bounds = materialise(thresholds(sketch, min_rows), "thresholds")
    discard(sketch)
    bounds = bounds.select(F.col("lang").alias("__plait_lang"), F.col("source").alias("__plait_source"), *[F.col(f"{k}_{e}").alias(f"__plait_{k}_{e}") for k in METRICS for e in ("high", "low")])
    if bounds.count() <= BROADCAST_GROUPS:
        bounds = F.broadcast(bounds)
    out = measured.join(bounds, F.col("lang").eqNullSafe(F.col("__plait_lang")) & F.col("source").eqNullSafe(F.col("__plait_source")), "left")
    m, good = F.col("__plait_m"), F.lit(True)
    for k, (*_, below) in METRICS.items():
        b = bucket(m, k)
        good = good & (b <= F.col(f"__plait_{k}_high"))
        if below:
            good = good & (b >= F.col(f"__plait_{k}_low"))
    failed = base_failed(m)
    return out.select(*measured.columns, failed.alias("__plait_failed"), (~failed & F.coalesce(good, F.lit(True))).alias("__plait_kept"))


def quality_report(docs: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """(doc_id, measures..., base_failed, kept) for every row of ``docs``."""
    measured = materialise(docs.select("doc_id", "lang", "source", measures(F.col("text")).alias("__plait_m")), "measures")
    out = judge(measured, min_rows)
    return out.select("doc_id", *[F.col("__plait_m")[c].alias(c) for c in MEASURES], F.col("__plait_failed").alias("base_failed"), F.col("__plait_kept").alias("kept"))


def quality_filter(docs: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """Stage: the rows of ``docs`` that are kept, with their columns."""
    measured = materialise(packed(docs, "lang", "source", measures(F.col("text")).alias("__plait_m")), "measured")
    return judge(measured, min_rows).where("__plait_kept").select("__plait_row.*")
