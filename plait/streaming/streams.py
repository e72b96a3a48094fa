"""Structured Streaming forms of the keyed operators.

State is keyed: one row of state for a key, held in the state store and never on the driver. The order within a
key is the order of ``seq`` inside a micro-batch, whatever files and Arrow batches its rows come in, and arrival between micro-batches.
For that, a key's rows of one micro-batch are held together: bound them by the source's limit on a trigger
(``maxFilesPerTrigger``, ``maxBytesPerTrigger``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import costs, linediff, views


def in_order(pdfs: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple]:
    """The rows of a key's micro-batch in the order of ``seq``, over all its Arrow batches."""
    parts = [pdf[["seq", *columns]] for pdf in pdfs]
    rows = pd.concat(parts).sort_values("seq", kind="stable") if parts else pd.DataFrame(columns=["seq", *columns])
    return rows.itertuples(index=False, name=None)


def append_stream(chunks: DataFrame) -> DataFrame:
    """Running size of each key's appended text: (key, seq, chunk_bytes, total_bytes, avoided_bytes)."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (total,) = state.get if state.exists else (0,)
        rows = []
        for seq, content in in_order(pdfs, "content"):
            b = views.size_of(content) if content else 0
            total += b + (1 if b and total else 0)
            rows.append((key[0], seq, b, total, total - b))
        yield pd.DataFrame(rows, columns=["key", "seq", "chunk_bytes", "total_bytes", "avoided_bytes"])
        state.update((total,))

    return chunks.groupBy("key").applyInPandasWithState(step, "key long, seq long, chunk_bytes long, total_bytes long, avoided_bytes long", "total long", "append", GroupStateTimeout.NoTimeout)


def session_stream(versions: DataFrame) -> DataFrame:
    """Each version against the last of its key: (key, seq, id, kind, view_bytes); kind is first, unchanged, diff or full."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (old,) = state.get if state.exists else (None,)
        rows = []
        for seq, content in in_order(pdfs, "content"):
            new = content or ""
            ident = hashlib.sha256(new.encode()).hexdigest()
            if old is None:
                kind, size = "first", views.size_of(new)
            elif old == new:
                kind, size = "unchanged", costs.UNCHANGED
            else:
                a, b = views.escaped(old), views.escaped(new)
                kind, size = ("full", views.size_of(new)) if linediff.too_large(a, b) else ("diff", linediff.diff_bytes(linediff.diff(a, b)))
            rows.append((key[0], seq, ident, kind, size))
            old = new
        yield pd.DataFrame(rows, columns=["key", "seq", "id", "kind", "view_bytes"])
        state.update((old,))

    return versions.groupBy("key").applyInPandasWithState(step, "key long, seq long, id string, kind string, view_bytes long", "content string", "append", GroupStateTimeout.NoTimeout)


def recent_rate_stream(events: DataFrame, window: int = costs.RECENT_EVENTS) -> DataFrame:
    """Retrieve rate over the last ``window`` events of each tool: a count window in bounded list state."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        rows = []
        for seq, hit in in_order(pdfs, "is_retrieve"):
            last = [*last, int(hit)][-window:]
            above = sum(last) * 100 > len(last) * int(costs.RETRIEVE_RATE * 100)
            rows.append((key[0], seq, sum(last), len(last), costs.SUGGESTED_MIN_BYTES if above else 0))
        yield pd.DataFrame(rows, columns=["tool", "seq", "hits", "n_recent", "suggested_min_bytes"])
        state.update((last,))

    return events.groupBy("tool").applyInPandasWithState(step, "tool string, seq long, hits long, n_recent long, suggested_min_bytes long", "last array<long>", "append", GroupStateTimeout.NoTimeout)


def dedup_stream(contents: DataFrame) -> DataFrame:
    """Contents that were not seen before, by id; the state holds ids only."""
    return contents.withColumn("id", F.sha2(F.col("content").cast("binary"), 256)).dropDuplicates(["id"])


def counters_stream(events: DataFrame) -> DataFrame:
    """Running calls and bytes by tool; use output mode complete or update."""
    return events.groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.sum("original_bytes").alias("original_bytes"), F.sum("compressed_bytes").alias("compressed_bytes"))


def daily_stream(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events by day and name with a watermark (an extension)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event").agg(F.count(F.lit(1)).alias("n"))


def to_json_sink(stream: DataFrame, path: str, checkpoint: str):
    """Append events as NDJSON, exactly once."""
    return stream.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)


def to_batches_sink(stream: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand each micro-batch of events, as NDJSON lines in one column ``value``, to ``send`` (rows, batch number).

    The checkpoint gives a batch that failed again under the same number, so a ``send`` that drops numbers it has seen sends each event once.
    """
    return stream.select(F.to_json(F.struct("*")).alias("value")).writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
