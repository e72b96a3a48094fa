"""Tool calls: what of a response is replaced by a view, what that saves, and short forms of tool schemas."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import classify, costs
from . import sessions, views

SCHEMA_BYTES = 300
DESCRIPTION_CHARS = 200


def _slim(text: str | None) -> str | None:
    """A JSON schema with the types of its properties only; larger than 300 bytes it is any object."""
    if text is None:
        return None
    try:
        value = json.loads(text)
    except ValueError:
        value = None
    if not isinstance(value, dict):
        return '{"type":"object"}'
    out = {k: value[k] for k in ("type", "required") if k in value}
    if isinstance(value.get("properties"), dict):
        out["properties"] = {k: {"type": v["type"]} if isinstance(v, dict) and "type" in v else {} for k, v in value["properties"].items()}
    short = views.to_json(out)
    return short if len(short.encode()) <= SCHEMA_BYTES else '{"type":"object"}'


@F.pandas_udf(T.StringType())
def slim_schema(schema: pd.Series) -> pd.Series:
    return schema.map(_slim)


def trim_tools(tools: DataFrame) -> DataFrame:
    """(name, description, schema) with the first sentence of the description and a slim schema."""
    return tools.select("name", classify.first_sentence(F.col("description"), DESCRIPTION_CHARS).alias("description"), slim_schema("schema").alias("schema"))


def url_parts(url: Column) -> Column:
    """Struct (host, port, path) of a URL; the port is the scheme's where none is given."""
    scheme = F.regexp_extract(url, r"\A([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    host = F.regexp_extract(url, r"\A[^:]+://(?:[^/@?#]*@)?([^/:?#]*)", 1)
    port = F.regexp_extract(url, r"\A[^:]+://(?:[^/@?#]*@)?[^/:?#]*:([0-9]+)", 1)
    path = F.regexp_extract(url, r"\A[^:]+://[^/?#]*(/[^?#]*)", 1)
    given = F.when(port != "", port.cast("int")).when(F.lower(scheme) == "https", 443).otherwise(80)
    return F.struct(host.alias("host"), given.alias("port"), F.when(path == "", "/").otherwise(path).alias("path"))


def session_id(seed: Column) -> Column:
    """Eight hex digits."""
    return F.substring(F.sha2(seed.cast("string"), 256), 1, 8)


def auto_compress(responses: DataFrame, threshold: int = costs.PROXY_THRESHOLD) -> DataFrame:
    """Responses (doc_id, text, is_error) with the view that replaces them, if any: (doc_id, n_bytes, sent_bytes, kind, body).

    Errors and responses up to the threshold stay, and so does one whose view with its header is not smaller.
    """
    fit = responses.where(~F.coalesce("is_error", F.lit(False)) & (F.octet_length("text") > threshold))
    used = views.worth_it(views.compress(fit), threshold).select("doc_id", "kind", "body", "view_bytes")
    head = F.when(F.col("kind") == "json", costs.HEADER["json"]).otherwise(costs.HEADER["text"])
    rows = responses.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes")).join(used, "doc_id", "left")
    return rows.select("doc_id", "n_bytes", F.coalesce(F.col("view_bytes") + head, F.col("n_bytes")).alias("sent_bytes"), "kind", "body")


def hook_savings(calls: DataFrame, threshold: int = costs.HOOK_THRESHOLD) -> DataFrame:
    """Tool outputs (key, seq, tool, content) shown as diffs to the one before under their key: (key, seq, tool, n_bytes, sent_bytes, saved).

    Outputs up to the threshold pass, and so does one whose diff is not smaller.
    """
    rows = sessions.with_previous(calls).withColumn("v", sessions.version_view("prev_content", "content"))
    n = F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")
    sent = F.when((n > threshold) & (F.col("v.view_bytes") + costs.HEADER["session"] < n), F.col("v.view_bytes") + costs.HEADER["session"]).otherwise(n)
    return rows.select("key", "seq", "tool", n.alias("n_bytes"), sent.alias("sent_bytes"), (n - sent).alias("saved"))


def write_report(stats: DataFrame, path: str) -> None:
    """One JSON file of a small aggregate (a row for each tool)."""
    stats.coalesce(1).write.mode("overwrite").json(path)
