"""Views of whole documents: compress, restore and verify, one Arrow pass without a shuffle.

A view row is (doc_id, kind, body, n_bytes, view_bytes, refs, blobs): kind is text, json or a format name,
body the rendered view, refs the blobs it needs and blobs what it stores, as (id, content).
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify, costs, jsontree, views
from .blobs import cut

SCHEMA = "doc_id long, kind string, body string, n_bytes long, view_bytes long, refs array<string>, blobs array<struct<id:string,content:binary>>"
_BLOBS = pa.list_(pa.struct([("id", pa.string()), ("content", pa.binary())]))


def _rows(b: pa.RecordBatch, made: list) -> pa.RecordBatch:
    kinds, bodies, before, after, refs, blobs = zip(*made, strict=True) if made else ([],) * 6
    return pa.RecordBatch.from_arrays(
        [b.column(0), pa.array(kinds, pa.string()), pa.array(bodies, pa.string()), pa.array(before, pa.int64()), pa.array(after, pa.int64()), pa.array(refs, pa.list_(pa.string())), pa.array(blobs, _BLOBS)],
        names=["doc_id", "kind", "body", "n_bytes", "view_bytes", "refs", "blobs"],
    )


def _pack(kind: str, text: str, view, blobs):
    held = [{"id": k, "content": v} for k, v in blobs.items()]
    return kind, views.render(view), views.size_of(text), views.view_bytes(view), views.refs_of(view), held


def view_of(text: str | None, fmt: str | None, **options):
    """JSON, then a known format, then lines; null text has a null view."""
    if text is None:
        return "text", None, None, None, [], []
    if fmt is None:
        try:
            body = jsontree.compress(text)
            return "json", body, views.size_of(text), views.size_of(body), [], []
        except (ValueError, RecursionError):
            pass
        return _pack("text", text, *views.compress_text(text, **options))
    return _pack(fmt, text, *views.compress_format(text, fmt))


def compress(docs: DataFrame, hint: str | None = None, **options) -> DataFrame:
    """Views of (doc_id, text); the format is the column ``hint`` if it names one, else detected."""
    given = F.lit(None).cast("string") if hint is None else F.col(hint)
    # JSON comes first unless a hint is given, so a detected format only counts for what is no JSON.
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", given.alias("hint"), classify.format_or_hint(F.col("text"), given).alias("fmt"))

    def run(batches):
        for b in batches:
            made = []
            for t, h, f in zip(b.column(1), b.column(2), b.column(3), strict=True):
                text, told, fmt = t.as_py(), h.as_py(), f.as_py()
                first = view_of(text, fmt if told == fmt else None, **options) if told else view_of(text, None, **options)
                made.append(first if first[0] == "json" or fmt is None or text is None or first[0] == fmt else view_of(text, fmt))
            yield _rows(b, made)

    return src.mapInArrow(run, SCHEMA)


def compress_text(docs: DataFrame, **options) -> DataFrame:
    """Line views only."""

    def run(batches):
        for b in batches:
            texts = [t.as_py() for t in b.column(1)]
            yield _rows(b, [("text", None, None, None, [], []) if t is None else _pack("text", t, *views.compress_text(t, **options)) for t in texts])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def compress_budget(docs: DataFrame, max_bytes: int) -> DataFrame:
    """Views of at most ``max_bytes`` where first line, last line and one marker allow it."""

    def run(batches):
        for b in batches:
            texts = [t.as_py() for t in b.column(1)]
            yield _rows(b, [("text", None, None, None, [], []) if t is None else _pack("text", t, *views.compress_budget(t, max_bytes)) for t in texts])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def stored(made: DataFrame) -> DataFrame:
    """(id, content): the blobs that views store, one row for each."""
    return made.select(F.explode("blobs").alias("b")).select("b.id", "b.content").dropDuplicates(["id"])


def references(made: DataFrame) -> DataFrame:
    """(view_id, id)"""
    return made.select(F.col("doc_id").alias("view_id"), F.explode("refs").alias("id"))


def decompress(made: DataFrame, store: DataFrame) -> DataFrame:
    """(doc_id, text) of (doc_id, kind, body, refs) and store (id, content); a missing blob gives null text."""
    refs = made.select("doc_id", F.explode("refs").alias("id")).distinct().join(store.select("id", "content"), "id")
    held = refs.groupBy("doc_id").agg(F.collect_list(F.struct("id", "content")).alias("held"))
    src = made.select("doc_id", "kind", "body").join(held, "doc_id", "left")

    def run(batches):
        for b in batches:
            out = []
            for kind, body, held in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                blobs = {x["id"]: bytes(x["content"]) for x in held or ()}
                try:
                    out.append(None if body is None else jsontree.decompress(body) if kind == "json" else views.expand(views.read(body), blobs.__getitem__))
                except KeyError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return src.mapInArrow(run, "doc_id long, text string")


def _raw_view(raw: bytes | None, **options):
    """A view of bytes: lines of UTF-8 text, else a reference to the whole."""
    if raw is None:
        return "text", None, None, None, [], []
    try:
        return _pack("text", raw.decode(), *views.compress_text(raw.decode(), **options))
    except UnicodeDecodeError:
        ref = views.blob_id(raw)
        view = [("W", 0, ref, "")]
        return "raw", views.render(view), len(raw), views.view_bytes(view), [ref], [{"id": ref, "content": raw}]


def compress_bytes(docs: DataFrame, column: str = "content", **options) -> DataFrame:
    """Line views of (doc_id, binary); what is no UTF-8 is stored whole."""

    def run(batches):
        for b in batches:
            yield _rows(b, [_raw_view(c.as_py(), **options) for c in b.column(1)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("content")).mapInArrow(run, SCHEMA)


def decompress_bytes(made: DataFrame, store: DataFrame) -> DataFrame:
    """(doc_id, content) as bytes, of views of any kind but JSON."""
    raw = made.where("kind = 'raw'").select("doc_id", F.col("refs")[0].alias("id")).join(store.select("id", "content"), "id", "left").select("doc_id", "content")
    text = decompress(made.where("kind <> 'raw'"), store).select("doc_id", F.col("text").cast("binary").alias("content"))
    return text.unionByName(raw)


# JSON with subtrees in the store.


def compress_json(docs: DataFrame, store: DataFrame) -> DataFrame:
    """Views of JSON texts in which subtrees that the store (id, ...) holds are references; new subtrees are stored.

    "Holds" means before this batch, or earlier in the same document. Documents of one batch do not see each other: run batches in
    the order of calls to let later ones refer to earlier ones. Texts that are no JSON have a null body.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def listed(batches):
        for b in batches:
            ids, refs = [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    blobs: dict[str, bytes] = {}
                    jsontree.store_subtrees(jsontree.columnarize(jsontree.escape(jsontree.parse(t.as_py()))), set(), blobs)
                except (ValueError, TypeError):
                    continue
                ids += [d] * len(blobs)
                refs += list(blobs)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(refs, pa.string())], names=["doc_id", "id"])

    there = src.mapInArrow(listed, "doc_id long, id string").join(store.select("id").distinct(), "id", "left_semi")
    known = there.groupBy("doc_id").agg(F.collect_set("id").alias("known"))

    def run(batches):
        for b in batches:
            made = []
            for t, k in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                try:
                    text, blobs = t.as_py(), {}
                    value = jsontree.store_subtrees(jsontree.columnarize(jsontree.escape(jsontree.parse(text))), set(k or ()), blobs)
                except (ValueError, TypeError):
                    made.append(("json", None, None, None, [], []))
                    continue
                body = jsontree.canonical(value)
                held = [{"id": i, "content": c} for i, c in blobs.items()]
                made.append(("json", body, views.size_of(text), views.size_of(body), sorted(set(jsontree.stored_refs(value))), held))
            yield _rows(b, made)

    return src.join(known, "doc_id", "left").select("doc_id", "text", "known").mapInArrow(run, SCHEMA)


def decompress_json(made: DataFrame, store: DataFrame) -> DataFrame:
    """(doc_id, text): stored subtrees are put back round by round, as they may refer to others. Missing ones give null text.

    Each round is written and read again, so it runs once. Ids are hashes of contents, so references have no cycles and the rounds end
    after the longest chain.
    """
    rows = cut(made.select("doc_id", "body"), "json")
    held = store.select("id", F.col("content").cast("string").alias("content"))
    while True:
        found = _refs_of_bodies(rows)
        if found.isEmpty():
            break
        of_doc = found.join(held, "id").groupBy("doc_id").agg(F.collect_list(F.struct("id", "content")).alias("held"))
        rows = cut(rows.join(of_doc, "doc_id", "left").mapInArrow(_put_back, "doc_id long, body string"), "json")

    def run(batches):
        for b in batches:
            texts = [None if t.as_py() is None else jsontree.canonical(jsontree.unescape(jsontree.restore(json.loads(t.as_py())))) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, "doc_id long, text string")


def _refs_of_bodies(rows: DataFrame) -> DataFrame:
    pattern = '\\{"~x":"([0-9a-f]{64})"\\}'
    return rows.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(pattern), F.lit(1)))).alias("id"))


def _put_back(batches):
    for b in batches:
        out = []
        for body, held in zip(b.column(1), b.column(2).to_pylist(), strict=True):
            blobs = {x["id"]: x["content"] for x in held or ()}
            try:
                out.append(None if body.as_py() is None else jsontree.canonical(_one_round(json.loads(body.as_py()), blobs)))
            except KeyError:
                out.append(None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "body"])


def _one_round(value, blobs: dict[str, str]):
    if isinstance(value, dict) and len(value) == 1 and jsontree.STORED in value:
        return json.loads(blobs[value[jsontree.STORED]])
    if isinstance(value, dict):
        return {k: _one_round(v, blobs) for k, v in value.items()}
    return [_one_round(v, blobs) for v in value] if isinstance(value, list) else value


#: Version of the view format.
VERSION = 1


def encode(made: DataFrame) -> DataFrame:
    """(doc_id, view): each view as one string that starts with its version and kind."""
    return made.select("doc_id", F.concat(F.lit(f"VIEW:{VERSION}:"), F.col("kind"), F.lit("\n"), F.col("body")).alias("view"))


def decode(encoded: DataFrame) -> DataFrame:
    """(doc_id, kind, body, refs) of encoded views; a string of another version or without a header has a null kind and body."""
    head = rf"(?s)\AVIEW:{VERSION}:([a-z-]+)\n(.*)\z"
    known = F.col("view").rlike(head)
    rows = encoded.select("doc_id", F.when(known, F.regexp_extract("view", head, 1)).alias("kind"), F.when(known, F.regexp_extract("view", head, 2)).alias("body"))
    marker = f"(?m)^{views.MARK}[EW]:[0-9]*:([0-9a-f]{{64}}){views.MARK}$"
    stored = '\\{"~x":"([0-9a-f]{64})"\\}'
    refs = F.when(F.col("kind") == "json", F.regexp_extract_all("body", F.lit(stored), F.lit(1))).otherwise(F.regexp_extract_all("body", F.lit(marker), F.lit(1)))
    return rows.withColumn("refs", F.coalesce(refs, F.array().cast("array<string>")))


def header(kind: str) -> int:
    return costs.HEADER["json" if kind == "json" else "session" if kind == "session" else "text"]


def worth_it(made: DataFrame, threshold: int = costs.PROXY_THRESHOLD) -> DataFrame:
    """Views that are used: large enough before, and smaller after with their header."""
    cost = F.when(F.col("kind") == "json", costs.HEADER["json"]).otherwise(costs.HEADER["text"])
    return made.where((F.col("n_bytes") > threshold) & (F.col("view_bytes") + cost < F.col("n_bytes")))


def json_sizes(docs: DataFrame, column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, json_bytes, keys, types): encoded size, and names and types of the top-level keys of JSON texts."""

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(1):
                try:
                    text = t.as_py()
                    value = jsontree.parse(text)
                    types = {k: jsontree.type_name(v) for k, v in sorted(value.items())} if isinstance(value, dict) else {}
                    rows.append((views.size_of(text), views.size_of(jsontree.compress(text)), list(types), list(types.values())))
                except (ValueError, TypeError):
                    rows.append((None, None, None, None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], strings), pa.array(cols[3], strings)], names=["doc_id", "n_bytes", "json_bytes", "keys", "types"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("text"))
    return src.mapInArrow(run, "doc_id long, n_bytes long, json_bytes long, keys array<string>, types array<string>")


def subtrees(docs: DataFrame, column: str = "text", min_bytes: int = costs.CROSS_CALL_MIN_BYTES) -> DataFrame:
    """(doc_id, subtree, ref, n_bytes, n): serialised arrays, objects and long strings of each JSON text."""

    def run(batches):
        for b in batches:
            ids, texts, counts = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    seen = jsontree.subtree_counts(jsontree.parse(t.as_py()))
                except (ValueError, TypeError):
                    continue
                for s, n in seen.items():
                    if len(s.encode()) >= min_bytes:
                        ids.append(k)
                        texts.append(s)
                        counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=["doc_id", "subtree", "n"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("text")).mapInArrow(run, "doc_id long, subtree string, n long")
    return rows.select("doc_id", "subtree", F.sha2("subtree", 256).alias("ref"), F.octet_length("subtree").alias("n_bytes"), "n")


def cross_call(docs: DataFrame, seq: str, column: str = "text", min_bytes: int = costs.CROSS_CALL_MIN_BYTES) -> DataFrame:
    """Subtrees with whether an earlier document (by ``seq``) has stored them: (doc_id, ref, n_bytes, seen_before)."""
    from pyspark.sql import Window as W

    rows = subtrees(docs, column, min_bytes).join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(seq).alias("seq")), "doc_id")
    first = F.min("seq").over(W.partitionBy("ref"))
    return rows.select("doc_id", "ref", "n_bytes", (first < F.col("seq")).alias("seen_before"))


def to_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
