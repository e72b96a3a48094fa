"""Keyed versions (key, seq, content): status, diffs, appends and overlap with other keys."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import costs, linediff, views
from . import blobs


def by_key():
    return W.partitionBy("key").orderBy("seq")


def with_previous(versions: DataFrame) -> DataFrame:
    """Versions with id, prev_id and prev_content: the version before of the same key."""
    rows = versions.withColumn("id", F.sha2(F.col("content").cast("binary"), 256))
    return rows.withColumns({"prev_id": F.lag("id").over(by_key()), "prev_content": F.lag("content").over(by_key())})


def status(versions: DataFrame) -> DataFrame:
    """(key, seq, id, prev_id, status): first, unchanged or changed."""
    rows = versions.select("key", "seq", F.sha2(F.col("content").cast("binary"), 256).alias("id"))
    rows = rows.withColumn("prev_id", F.lag("id").over(by_key()))
    said = F.when(F.col("prev_id").isNull(), "first").when(F.col("prev_id") == F.col("id"), "unchanged").otherwise("changed")
    return rows.withColumn("status", said)


def latest(versions: DataFrame) -> DataFrame:
    """(key, id): the state of every key, the last writer wins."""
    return versions.groupBy("key").agg(F.max_by(F.sha2(F.col("content").cast("binary"), 256), "seq").alias("id"))


def merge_state(stored: DataFrame, ours: DataFrame) -> DataFrame:
    """Union of two states (key, id); ours win."""
    rows = stored.select("key", "id", F.lit(0).alias("own")).unionByName(ours.select("key", "id", F.lit(1).alias("own")))
    return rows.groupBy("key").agg(F.max_by("id", "own").alias("id"))


def record(state: DataFrame, seen: DataFrame) -> DataFrame:
    """The state (key, id) after contents (key, content) were seen: their hashes are kept, and nothing of the contents."""
    return merge_state(state, seen.select("key", F.sha2(F.col("content").cast("binary"), 256).alias("id")))


def changed(state: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (key, hash) with known and changed; hashes are compared in lower case, and one that is no hash gives null."""
    rows = asked.join(state.select("key", "id"), "key", "left")
    valid = F.col("hash").rlike(r"\A[0-9a-fA-F]{64}\z")
    known = F.col("id").isNotNull()
    return rows.select("key", "hash", F.when(valid, known).alias("known"), F.when(valid, known & (F.col("id") != F.lower("hash"))).alias("changed"))


def appended(versions: DataFrame, full: bool = False) -> DataFrame:
    """Append streams: (key, seq, chunk_bytes, total_bytes, avoided_bytes[, content]).

    Sizes are running sums, so a long stream costs one row a chunk; ``full`` also builds each accumulated text.
    A line break stands between two chunks that both have text.
    """
    upto = by_key().rowsBetween(W.unboundedPreceding, 0)
    b = F.octet_length(F.coalesce("content", F.lit(""))).cast("long")
    filled = F.when(F.octet_length("content") > 0, 1).otherwise(0)
    rows = versions.withColumns({"chunk_bytes": b, "filled": filled})
    total = F.sum("chunk_bytes").over(upto) + F.greatest(F.lit(0), F.sum("filled").over(upto) - 1)
    rows = rows.withColumn("total_bytes", total.cast("long"))
    out = rows.select("key", "seq", "content", "chunk_bytes", "total_bytes", (F.col("total_bytes") - F.col("chunk_bytes")).alias("avoided_bytes"))
    if not full:
        return out.drop("content")
    parts = F.collect_list(F.nullif("content", F.lit(""))).over(upto)
    return out.withColumn("content", F.array_join(parts, "\n"))


def stream_text(chunks: Column) -> Column:
    return F.array_join(F.filter(chunks, lambda c: c != ""), "\n")


_OPS = T.StructType([T.StructField("kind", T.StringType()), T.StructField("same", T.LongType()), T.StructField("deleted", T.LongType()), T.StructField("inserted", T.LongType()), T.StructField("view_bytes", T.LongType()), T.StructField("ops", T.StringType())])


def _version_view(old: str | None, new: str | None):
    if new is None:
        return None, None, None, None, None, None
    if old is None:
        return "first", None, None, None, views.size_of(new), None
    if old == new:
        return "unchanged", None, None, None, costs.UNCHANGED, None
    a, b = views.escaped(old), views.escaped(new)
    if linediff.too_large(a, b):
        return "full", None, None, None, views.size_of("\n".join(b)), None
    ops = linediff.diff(a, b)
    sums = {k: sum(n for op, n, _ in ops if op == k) for k in "SXI"}
    return "diff", sums["S"], sums["X"], sums["I"], linediff.diff_bytes(ops), json.dumps(ops, ensure_ascii=False)


@F.pandas_udf(_OPS)
def version_view(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_version_view(a, b) for a, b in zip(old, new, strict=True)], columns=[f.name for f in _OPS]).astype({k: "Int64" for k in ("same", "deleted", "inserted", "view_bytes")})


@F.pandas_udf(T.StringType())
def apply_ops(old: pd.Series, new: pd.Series, kind: pd.Series, ops: pd.Series) -> pd.Series:
    """The version again: from the one before and a diff, or as stored."""

    def one(a, b, k, o):
        if k == "unchanged" or (k == "diff" and a is None):
            return a
        if k != "diff":
            return b
        return "\n".join(map(views.unescape_line, linediff.apply(views.escaped(a), [(x, n, ls) for x, n, ls in json.loads(o)])))

    return pd.Series([one(*x) for x in zip(old, new, kind, ops, strict=True)])


def diffs(versions: DataFrame) -> DataFrame:
    """(key, seq, kind, same, deleted, inserted, view_bytes, ops): each version against the one before."""
    rows = with_previous(versions).withColumn("v", version_view("prev_content", "content"))
    return rows.select("key", "seq", "prev_id", "id", *[F.col("v")[f.name].alias(f.name) for f in _OPS])


def compress(versions: DataFrame) -> DataFrame:
    """Session views (key, seq, kind, id, prev_id, body, view_bytes): body is the text of first and full views and the operations of diffs."""
    rows = with_previous(versions).withColumn("v", version_view("prev_content", "content"))
    body = F.when(F.col("v.kind") == "diff", F.col("v.ops")).when(F.col("v.kind").isin("first", "full"), F.col("content"))
    return rows.select("key", "seq", F.col("v.kind").alias("kind"), "id", "prev_id", body.alias("body"), F.col("v.view_bytes").alias("view_bytes"))


def decompress(made: DataFrame, store: DataFrame) -> DataFrame:
    """(key, seq, content) of session views and the store (id, content) of earlier versions; a missing version gives null."""
    needs = F.when(F.col("kind").isin("diff", "unchanged"), F.col("prev_id"))
    rows = made.withColumn("need", needs).join(store.select(F.col("id").alias("need"), F.col("content").cast("string").alias("old")), "need", "left")
    whole = F.when(F.col("kind").isin("first", "full"), F.col("body"))
    content = F.when((F.col("kind") == "diff") & F.col("old").isNotNull(), apply_ops("old", "body", "kind", "body")).when(F.col("kind") == "unchanged", F.col("old")).otherwise(whole)
    return rows.select("key", "seq", content.alias("content"))


def references(made: DataFrame) -> DataFrame:
    """(view_id, id): the versions that session views need."""
    return made.where(F.col("kind").isin("diff", "unchanged")).select(F.struct("key", "seq").alias("view_id"), F.col("prev_id").alias("id"))


def cross_key_views(docs: DataFrame) -> DataFrame:
    """First versions as diffs to the document of another key that overlaps most, where that is smaller: (key, other, n_bytes, view_bytes, ops)."""
    near = overlaps(docs).select("key", "other")
    text = docs.select("key", "content")
    pairs = near.join(text, "key").join(text.select(F.col("key").alias("other"), F.col("content").alias("old")), "other")
    rows = pairs.withColumn("v", version_view("old", "content")).withColumn("n_bytes", F.octet_length("content").cast("long"))
    size = F.when(F.col("v.kind") == "unchanged", F.lit(costs.DIFF)).otherwise(F.col("v.view_bytes"))
    return rows.select("key", "other", "n_bytes", size.cast("long").alias("view_bytes"), F.col("v.ops").alias("ops")).where("view_bytes < n_bytes")


def _digest(text: Column) -> Column:
    """The first 16 bytes of the SHA-256: contents and lines travel as these."""
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def _in_common(probes: DataFrame, reached: DataFrame, mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """(asks, other, overlap): the copies of all lines in common, for asks whose probes lead to an earlier other.

    probes: (asks, before, line), mine: (asks, line, copies), reached and theirs: (other, line), the lines that probes may hold
    and all. ``before`` bounds the other's head.
    """
    pairs = probes.join(reached, "line").where(F.col("other.head") < F.col("before")).select("asks", "other").distinct()
    return pairs.join(mine, "asks").join(theirs, ["other", "line"]).groupBy("asks", "other").agg(F.sum("copies").alias("overlap"))


def overlaps(docs: DataFrame, min_lines: int = costs.CROSS_KEY_MIN_LINES, common: int = costs.COMMON_HOLDERS) -> DataFrame:
    """(key, other, n_lines, overlap): the earlier document that holds most of a document's lines, a third at least.

    docs: (key, seq, content); null content has no lines. Ties go to the earliest, then the smallest key. Copies of a content share
    their first document, so only distinct contents meet. A content of n lines needs a partner for ceil(n / 3) of them, so it
    shares one of its *rarest* lines with each partner: the lines that very many hold, and whose copies together are fewer than
    that, propose no pair. Pairs that meet are counted over all lines.

    Lines of more than ``common`` holders do not pair documents. A partner that shares nothing else is told by the set of its common
    lines alone, and the earliest document of each such set stands for all of them; the sets, which are far fewer, meet instead. So
    pairs grow with the rows times ``common``, and beside that with the different sets. ``common`` changes the work and no result.
    """
    rows = docs.where("content is not null").select("key", F.struct("seq", "key").alias("me"), _digest(F.col("content")).alias("id"), F.split("content", "\n", -1).alias("ls"))
    own = rows.groupBy("id").agg(F.min("me").alias("head"), F.count(F.lit(1)).alias("docs"), F.max(F.size("ls")).cast("long").alias("n_lines"))
    lines = rows.select("id", F.explode("ls").alias("line")).select("id", _digest(F.col("line")).alias("line")).groupBy("id", "line").agg(F.count(F.lit(1)).alias("all"))
    # Written, as Spark divides the rows of one line among tasks only where a join reads its sides as they were dealt.
    held = blobs.cut(lines.groupBy("line").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1"), "overlaps")
    found = lines.join(held, "line").join(own, "id")
    found = found.select(F.struct("head", "id").alias("doc"), "n_lines", "line", F.expr("all div docs").alias("copies"), "holders")
    shared = blobs.cut(found, "overlaps")

    need = F.ceil(F.col("n_lines") / 3)
    upto = W.partitionBy("doc").orderBy(F.desc("holders"), "line").rowsBetween(W.unboundedPreceding, 0)
    able = shared.where(F.col("n_lines") >= min_lines)
    rare = able.withColumn("rest", F.sum("copies").over(upto)).where((F.col("rest") >= need) & (F.col("holders") <= common))
    probes = rare.select(F.col("doc").alias("asks"), F.col("doc.head").alias("before"), "line")
    holding = shared.withColumnRenamed("doc", "other")
    by_rare = _in_common(probes, holding.where(F.col("holders") <= common).select("other", "line"), able.select(F.col("doc").alias("asks"), "line", "copies"), holding.select("other", "line"))
    by_rare = by_rare.select(F.col("asks.id").alias("id"), F.col("other.head").alias("other_head"), "overlap")

    hot = shared.where(F.col("holders") > common).groupBy("doc", "n_lines").agg(F.array_sort(F.collect_list(F.struct((-F.col("holders")).alias("less"), "line", "copies"))).alias("hot"))
    said = lambda one: F.sha2(F.array_join(F.transform("hot", one), ","), 256)
    hot = hot.withColumns({"asks": said(lambda x: F.concat(F.hex(x["line"]), F.lit(" "), x["copies"].cast("string"))), "kind": said(lambda x: F.hex(x["line"]))})
    theirs = hot.groupBy("kind").agg(F.min("doc").alias("other"), F.first("hot").alias("hot")).select("other", F.explode("hot.line").alias("line"))
    asking = hot.where((F.col("n_lines") >= min_lines) & (F.aggregate("hot", F.lit(0).cast("long"), lambda n, x: n + x["copies"]) >= need))
    mine = asking.groupBy("asks").agg(F.max("doc.head").alias("before"), F.min(need).alias("need"), F.first("hot").alias("hot")).select("asks", "before", "need", F.posexplode("hot").alias("at", "x"))
    mine = mine.select("asks", "before", "need", "at", "x.line", "x.copies")
    rest = F.sum("copies").over(W.partitionBy("asks").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    probes = mine.withColumn("rest", rest).where(F.col("rest") >= F.col("need")).select("asks", "before", "line")
    by_set = _in_common(probes, theirs, mine.select("asks", "line", "copies"), theirs)
    # For each number of lines in common, the earliest that has it.
    by_set = by_set.groupBy("asks", "overlap").agg(F.min("other.head").alias("other_head"))
    by_set = asking.select("asks", "doc").join(by_set, "asks").where(F.col("other_head") < F.col("doc.head")).select("doc.id", "other_head", "overlap")

    best = by_rare.unionByName(by_set).groupBy("id").agg(F.min(F.struct((-F.col("overlap")).alias("less"), "other_head")).alias("b"))
    best = best.join(own.select("id", "n_lines"), "id").where(-F.col("b.less") * 3 >= F.col("n_lines")).select("id", "b")
    # A later copy of a content has its first document as a partner for all lines, unless that has such a partner itself.
    each = rows.select("key", "id", "me", F.size("ls").cast("long").alias("n_lines")).join(own.select("id", "head"), "id").join(best, "id", "left")
    later = (F.col("me") != F.col("head")) & (F.col("n_lines") >= min_lines) & (F.coalesce(-F.col("b.less"), F.lit(0)) < F.col("n_lines"))
    out = each.select("key", F.when(later, F.col("head.key")).otherwise(F.col("b.other_head.key")).alias("other"), "n_lines", F.when(later, F.col("n_lines")).otherwise(-F.col("b.less")).alias("overlap"))
    return out.where("other is not null")
