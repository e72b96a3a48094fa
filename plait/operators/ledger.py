"""Ledger of a transcript: tool results found in nested messages, and a capped index of them."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import classify, costs, jsontree


def _content(value) -> str:
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        texts = [x["text"] for x in value if isinstance(x, dict) and isinstance(x.get("text"), str)]
        if texts:
            return "\n".join(texts)
    return jsontree.canonical(value)


def _response(value) -> str:
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        if isinstance(value.get("stdout"), str) and value["stdout"]:
            return value["stdout"]
        file = value.get("file")
        if isinstance(file, dict) and isinstance(file.get("content"), str):
            return file["content"]
        for k in ("content", "output", "text", "result"):
            if isinstance(value.get(k), str):
                return value[k]
    return jsontree.canonical(value)


def tool_results(message) -> list[tuple[str, str]]:
    """(tool, content) of every tool result in a message, outermost first."""
    if isinstance(message, list):
        return [r for x in message for r in tool_results(x)]
    if not isinstance(message, dict):
        return []
    if message.get("type") == "tool_result":
        name = message.get("tool_name")
        return [(name if isinstance(name, str) else "unknown", _content(message.get("content")))]
    if "tool_response" in message and isinstance(message.get("tool_name"), str):
        return [(message["tool_name"], _response(message["tool_response"]))]
    if isinstance(message.get("content"), list):
        return tool_results(message["content"])
    return [r for x in message.values() if isinstance(x, dict | list) for r in tool_results(x)]


def entries(lines: DataFrame, min_bytes: int = costs.LEDGER_MIN_BYTES) -> DataFrame:
    """(doc_id, seq, sha, tool_name, preview, n_bytes) of transcript lines (doc_id, seq, value).

    Blank lines, comments (#) and lines that are no JSON are skipped.
    """

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for d, s, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                line = (v.as_py() or "").strip()
                if not line or line.startswith("#"):
                    continue
                try:
                    found = tool_results(jsontree.parse(line))
                except (ValueError, RecursionError):
                    continue
                for k, (tool, content) in enumerate(found):
                    for col, x in zip(out, (d, s, k, tool, content), strict=True):
                        col.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "seq", "part", "tool_name", "content"])

    src = lines.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("seq").cast("long").alias("seq"), "value")
    rows = src.mapInArrow(run, "doc_id long, seq long, part long, tool_name string, content string")
    return rows.where(F.octet_length("content") >= min_bytes).select("doc_id", "seq", "part", F.sha2("content", 256).alias("sha"), "tool_name", classify.preview(F.col("content")).alias("preview"), F.octet_length("content").cast("long").alias("n_bytes"))


def index(rows: DataFrame, max_lines: int = costs.INDEX_LINES, max_bytes: int = costs.INDEX_BYTES) -> DataFrame:
    """(doc_id, index_text, n_lines): the first entries of each document, as many as both caps allow (the cap is the feature)."""
    line = F.concat_ws(" ", "sha", "tool_name", "preview")
    part = W.partitionBy("doc_id").orderBy("seq", "part")
    upto = part.rowsBetween(W.unboundedPreceding, 0)
    told = rows.withColumn("line", line).withColumns({"rank": F.row_number().over(part), "bytes": F.sum(F.octet_length("line") + 1).over(upto)})
    kept = told.where((F.col("rank") <= max_lines) & (F.col("bytes") <= max_bytes))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "line")))
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("index_text"), F.count(F.lit(1)).alias("n_lines"))


def guidance(texts: DataFrame, marker: str) -> DataFrame:
    """(doc_id, n_markers): lines that hold a marker, as guidance before a transcript is shortened."""
    lines = F.split("text", "\n", -1)
    return texts.select("doc_id", F.size(F.filter(lines, lambda x: x.contains(marker))).cast("long").alias("n_markers"))


def dump(value) -> str:
    return json.dumps(value, ensure_ascii=False)
