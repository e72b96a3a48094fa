import hashlib
import json

from plait.operators import blobs, sessions, views
from pyspark.sql import functions as F


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_bytes_come_back(spark):
    rows = [(1, b"plain\ntext"), (2, b"\xff\xfe\x00raw"), (3, b""), (4, None), (5, ("line\n" * 100).encode())]
    made = views.compress_bytes(spark.createDataFrame(rows, "doc_id long, content binary")).cache()
    assert {r.doc_id: r.kind for r in made.collect()}[2] == "raw"
    got = {r.doc_id: None if r.content is None else bytes(r.content) for r in views.decompress_bytes(made, views.stored(made)).collect()}
    assert got == dict(rows)
    assert not blobs.verify(views.references(made), views.stored(made).limit(0)).where("ok").count()


def test_json_batches_share_a_store(spark):
    author = {"name": "somebody with a long name", "mail": "somebody@example.com", "site": "https://example.com/somebody", "n": 1}
    docs = [{"id": k, "author": author, "nested": {"again": [author, {"deep": author}]}, "~x": "escaped"} for k in range(3)]
    first = spark.createDataFrame([(0, json.dumps(docs[0])), (9, "no json")], "doc_id long, text string")
    empty = spark.createDataFrame([], "id string, content binary")
    a = views.compress_json(first, empty).cache()
    store = views.stored(a).cache()
    b = views.compress_json(spark.createDataFrame([(k, json.dumps(docs[k])) for k in (1, 2)], "doc_id long, text string"), store).cache()
    sizes = {r.doc_id: r.view_bytes for r in a.unionByName(b).collect()}
    assert sizes[1] < sizes[0] and sizes[9] is None
    both = store.unionByName(views.stored(b)).dropDuplicates(["id"])
    got = {r.doc_id: r.text for r in views.decompress_json(a.unionByName(b), both).collect()}
    assert got[9] is None and all(json.loads(got[k]) == docs[k] for k in range(3))
    lost = {r.doc_id: r.text for r in views.decompress_json(b, both.limit(0)).collect()}
    assert lost == {1: None, 2: None}
    assert blobs.verify(views.references(b), both).where("not ok").count() == 0


def test_session_views_come_back_from_the_store(spark):
    rows = [("k", 1, "a\nb\nc"), ("k", 2, "a\nb\nc"), ("k", 3, "a\nX\nc\nd"), ("m", 1, ""), ("m", 2, "new"), ("n", 1, "forged")]
    v = spark.createDataFrame(rows, "key string, seq long, content string")
    made = sessions.compress(v).cache()
    store = v.select(F.sha2(F.col("content").cast("binary"), 256).alias("id"), "content").dropDuplicates(["id"])
    got = {(r.key, r.seq): r.content for r in sessions.decompress(made, store).collect()}
    assert got == {(k, s): c for k, s, c in rows}
    lost = {(r.key, r.seq): r.content for r in sessions.decompress(made, store.limit(0)).collect()}
    assert lost["k", 1] == "a\nb\nc" and lost["k", 2] is None and lost["k", 3] is None
    checked = blobs.verify(sessions.references(made), store)
    assert checked.count() == 3 and checked.where("not ok").count() == 0


def test_cross_key_views(spark):
    base = "\n".join(f"setting {k} = value {k}" for k in range(30))
    other = base.replace("value 3\n", "changed\n").replace("value 17", "also changed")
    rows = [("a", 1, base), ("b", 2, other), ("c", 3, "unrelated\n" * 6), ("d", 4, base)]
    got = {r.key: r for r in sessions.cross_key_views(spark.createDataFrame(rows, "key string, seq long, content string")).collect()}
    assert set(got) == {"b", "d"} and got["b"].other == "a" and got["b"].view_bytes < len(other) / 2
    ops = [(o, n, ls) for o, n, ls in json.loads(got["b"].ops)]
    from plait.functions import linediff

    assert "\n".join(linediff.apply(base.split("\n"), ops)) == other
    assert sha(base) != sha(other)
