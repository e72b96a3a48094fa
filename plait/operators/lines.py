"""Line operators over the relation (doc_id, line_no, line): native, one shuffle on doc_id.

All windows are partitioned by document, so a plan has one exchange that the operators
below it share. Null text has no lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import classify, costs


def of_doc():
    return W.partitionBy("doc_id")


def in_order():
    return W.partitionBy("doc_id").orderBy("line_no")


def digits(n: Column) -> Column:
    return F.length(n.cast("string"))


def explode_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line), numbered from 0; trailing empty lines stay."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return rows.withColumn("line_no", F.col("line_no").cast("long"))


def numbered(lines: DataFrame) -> DataFrame:
    return lines.withColumn("n_lines", F.count(F.lit(1)).over(of_doc()))


def runs(lines: DataFrame, *also: str) -> DataFrame:
    """Maximal runs of equal lines: (doc_id, *also, first_line, line, run). Runs do not cross a change of ``also``."""
    same = F.col("line") == F.lag("line").over(in_order())
    for c in also:
        same = same & (F.col(c) == F.lag(c).over(in_order()))
    flagged = lines.withColumn("starts", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    island = flagged.withColumn("island", F.sum("starts").over(in_order()))
    return island.groupBy("doc_id", "island", *also).agg(F.min("line_no").alias("first_line"), F.first("line").alias("line"), F.count(F.lit(1)).alias("run")).drop("island")


def run_pays(line: Column, run: Column, min_repeat: int = costs.MIN_REPEAT) -> Column:
    b = F.octet_length(line)
    return (run >= min_repeat) & (b + 1 + costs.REPEAT + digits(run) < (b + 1) * run)


def zones(lines: DataFrame, threshold: int = costs.LINE_THRESHOLD, head: int = costs.HEAD_LINES, tail: int = costs.TAIL_LINES) -> DataFrame:
    """Lines with n_lines and zone: whole, head, middle or tail."""
    n = F.col("n_lines")
    h = F.least(F.lit(head).cast("long"), n)
    t = F.least(F.lit(tail).cast("long"), n - h)
    zone = F.when(n <= threshold, "whole").when(F.col("line_no") < h, "head").when(F.col("line_no") >= n - t, "tail").otherwise("middle")
    return numbered(lines).withColumn("zone", zone)


def elided(zoned: DataFrame) -> DataFrame:
    """(doc_id, first_line, n, ref, bytes): what the middle of each document is stored as."""
    middle = zoned.where("zone = 'middle'").groupBy("doc_id").agg(F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    raw = F.array_join(F.transform("ls", lambda x: x["line"]), "\n")
    return middle.select("doc_id", "first_line", "n", F.sha2(raw, 256).alias("ref"), raw.alias("content"))


def segments(docs: DataFrame, threshold: int = costs.LINE_THRESHOLD, head: int = costs.HEAD_LINES, tail: int = costs.TAIL_LINES, min_repeat: int = costs.MIN_REPEAT) -> DataFrame:
    """The text view as rows (doc_id, seg_no, op, n, ref, line): run-length, elision and back references, all native.

    Lines that begin with a marker character are for ``plait.functions.views``; this form has no in-band markers to escape.
    """
    zoned = zones(explode_lines(docs), threshold, head, tail)
    shown = runs(zoned.where("zone <> 'middle'"), "zone")
    pays = run_pays(F.col("line"), F.col("run"), min_repeat)
    one = lambda op, n, sub: F.struct(F.lit(op).alias("op"), n.cast("long").alias("n"), F.lit(sub).alias("sub"))
    parts = F.when(pays, F.array(one("L", F.lit(0), 0), one("R", F.col("run"), 1))).otherwise(F.array_repeat(one("L", F.lit(0), 0), F.col("run").cast("int")))
    literal = shown.select("doc_id", "first_line", "line", F.posexplode(parts).alias("k", "s")).select("doc_id", "first_line", "k", "s.op", "s.n", F.lit(None).cast("string").alias("ref"), "line")
    hole = elided(zoned).select("doc_id", "first_line", F.lit(0).alias("k"), F.lit("E").alias("op"), F.col("n").cast("long").alias("n"), "ref", F.lit(None).cast("string").alias("line"))
    view = literal.unionByName(hole).withColumn("seg_no", (F.row_number().over(of_doc().orderBy("first_line", "k")) - 1).cast("long"))
    first = F.min(F.when(F.col("op") == "L", F.col("seg_no"))).over(W.partitionBy("doc_id", "line"))
    back = (F.col("op") == "L") & (F.col("seg_no") > first) & (costs.DEDUP + digits(first) < F.octet_length("line"))
    return view.select("doc_id", "seg_no", F.when(back, "D").otherwise(F.col("op")).alias("op"), F.when(back, first.cast("long")).otherwise(F.col("n")).alias("n"), "ref", F.when((F.col("op") == "L") & ~back, F.col("line")).alias("line"))


def segment_cost(op: Column, n: Column, line: Column) -> Column:
    return F.when(op == "L", F.octet_length(line)).when(op == "R", costs.REPEAT + digits(n)).when(op == "E", costs.ELIDE + digits(n)).otherwise(costs.DEDUP + digits(n))


def view_sizes(segs: DataFrame) -> DataFrame:
    """(doc_id, n_segments, view_bytes)"""
    cost = segment_cost(F.col("op"), F.col("n"), F.col("line")).cast("long")
    return segs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_segments"), (F.sum(cost) + F.count(F.lit(1)) - 1).alias("view_bytes"))


def restore(segs: DataFrame, blobs: DataFrame) -> DataFrame:
    """(doc_id, text): segments back to texts; blobs: (ref, content)."""
    literals = segs.where("op = 'L'").select("doc_id", F.col("seg_no").cast("long").alias("n"), F.col("line").alias("source"))
    d = segs.join(literals, ["doc_id", "n"], "left").join(blobs.select("ref", "content"), "ref", "left")
    own = F.when(F.col("op") == "L", F.col("line")).when(F.col("op") == "D", F.coalesce("source", F.lit(""))).when(F.col("op") == "E", F.col("content"))
    last = F.last(own, ignorenulls=True).over(of_doc().orderBy("seg_no").rowsBetween(W.unboundedPreceding, -1))
    part = F.when(F.col("op") == "R", F.array_join(F.array_repeat(last, (F.col("n") - 1).cast("int")), "\n")).otherwise(own)
    rows = d.withColumn("part", part).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seg_no", "part"))).alias("ps"))
    return rows.select("doc_id", F.array_join(F.transform("ps", lambda x: x["part"]), "\n").alias("text"))


def duplicates(lines: DataFrame) -> DataFrame:
    """Lines that repeat an earlier line of their document: (doc_id, line_no, first_line, line)."""
    first = F.min("line_no").over(W.partitionBy("doc_id", "line"))
    return lines.withColumn("first_line", first).where("line_no > first_line").select("doc_id", "line_no", "first_line", "line")


def scored(lines: DataFrame) -> DataFrame:
    return lines.withColumn("score", classify.anomaly_score(F.col("line")))


def top_lines(lines: DataFrame, k: int) -> DataFrame:
    """The k highest scores of each document, ties by position."""
    rank = F.row_number().over(of_doc().orderBy(F.desc("score"), "line_no")).cast("long")
    return scored(lines).withColumn("rank", rank).where(F.col("rank") <= k)


def gap_groups(lines: DataFrame, keep: Column) -> DataFrame:
    """Lines that are not kept, grouped into the gaps between kept ones: (doc_id, gap, first_line, n)."""
    flagged = lines.withColumn("kept", F.when(keep, 1).otherwise(0)).withColumn("gap", F.sum("kept").over(in_order()))
    return flagged.where("kept = 0").groupBy("doc_id", "gap").agg(F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n"))


# Retrieval. Lines are numbered from 0 inside and from 1 in ranges.


def read_lines(docs: DataFrame) -> DataFrame:
    """Lines as a reader sees them: no trailing empty line, no carriage return."""
    rows = docs.select("doc_id", F.posexplode(classify.text_lines(F.col("text"))).alias("line_no", "line"))
    return rows.withColumn("line_no", F.col("line_no").cast("long"))


def line_range(lines: DataFrame, first: int, last: int) -> DataFrame:
    return lines.where(F.col("line_no").between(max(first, 1) - 1, last - 1))


def line_matches(pattern: str) -> Column:
    """Contains the pattern, or fits it as a whole if it is a glob."""
    return F.col("line").rlike(classify.glob_regex(pattern)) if "*" in pattern or "?" in pattern else F.col("line").contains(pattern)


def grep(lines: DataFrame, pattern: str, context: int = 0) -> DataFrame:
    """Matching lines and ``context`` lines around each, in order, overlaps merged."""
    hit = F.when(line_matches(pattern), 1).otherwise(0)
    if not context:
        return lines.where(hit == 1)
    near = F.max("hit").over(in_order().rowsBetween(-context, context))
    return lines.withColumn("hit", hit).withColumn("near", near).where("near = 1").drop("hit", "near")


def head(lines: DataFrame, n: int) -> DataFrame:
    return lines.where(F.col("line_no") < n)


def tail(lines: DataFrame, n: int) -> DataFrame:
    return numbered(lines).where(F.col("line_no") >= F.col("n_lines") - n).drop("n_lines")


def select_lines(docs: DataFrame, lines: tuple[int, int] | None = None, pattern: str | None = None, context: int = 0, first: int | None = None, last: int | None = None) -> DataFrame:
    """One selector in the order of precedence range, pattern, head, tail; none gives all lines."""
    rows = read_lines(docs)
    if lines is not None:
        return line_range(rows, *lines)
    if pattern is not None:
        return grep(rows, pattern, context)
    if first is not None:
        return head(rows, first)
    return tail(rows, last) if last is not None else rows


def describe(total: Column, selected: Column, lines: tuple[int, int] | None = None, pattern: str | None = None, context: int = 0, first: int | None = None, last: int | None = None) -> Column:
    """What a selection holds, in words."""
    every = F.format_string("all %d lines", total)
    if lines is not None:
        said = F.format_string("lines %d-%d of %d (%d lines returned)", F.lit(lines[0]), F.least(F.lit(lines[1]).cast("long"), total), total, selected)
    elif pattern is not None:
        around = f" ±{context} context" if context else ""
        said = F.format_string("grep %s → %d of %d lines", F.lit(f'"{pattern}"{around}'), selected, total)
    elif first is not None:
        said = F.format_string("head %d of %d lines", F.least(F.lit(first).cast("long"), total), total)
    elif last is not None:
        said = F.format_string("tail %d of %d lines", F.least(F.lit(last).cast("long"), total), total)
    else:
        said = F.format_string("%d of %d lines", selected, total)
    return F.when(selected == total, every).otherwise(said)
