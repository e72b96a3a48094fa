import datetime
import hashlib
import json

import pytest
from plait import api
from plait.operators import blobs, ledger, lines, sessions, telemetry, views
from plait.sources import files
from plait.streaming import streams
from pyspark.sql import functions as F


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


DOCS = ["", "one", "a\nb\n", "same line that is long enough to pay\n" * 8, "\n".join(f"line {k} with some words in it" for k in range(90)), None, "{\"a\": [1, 2.0]}", "diff --git a/x b/x\n@@ -1 +1 @@\n" + "\n".join(f" c{k}" for k in range(12)), "x\r\ny\r\n", "é\n" * 70]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string")


def test_views_come_back_and_verify(spark, docs):
    made = api.compress(docs).cache()
    kinds = {r.doc_id: r.kind for r in made.collect()}
    assert kinds[6] == "json" and kinds[7] == "git-diff" and kinds[4] == "text"
    store = views.stored(made)
    got = {r.doc_id: r.text for r in api.decompress(made, store).collect()}
    want = dict(enumerate(DOCS)) | {6: '{"a":[1,2.0]}'}
    assert got == want
    assert all(r.ok for r in api.verify(made, store).collect())
    broken = api.verify(made, store.limit(0)).collect()
    assert broken and not any(r.ok for r in broken)
    lost = {r.doc_id: r.text for r in api.decompress(made, store.limit(0)).collect()}
    assert lost[4] is None and lost[1] == "one"


def test_encoded_views(spark, docs):
    made = api.compress(docs).where("body is not null").cache()
    again = views.decode(views.encode(made)).cache()
    key = lambda df: {r.doc_id: (r.kind, r.body, sorted(r.refs)) for r in df.collect()}
    assert key(again) == key(made)
    other = views.decode(spark.createDataFrame([(1, "VIEW:2:text\nx"), (2, "no header")], "doc_id long, view string"))
    assert {(r.kind, r.body) for r in other.collect()} == {(None, None)}


def test_native_segments_match_views(spark, docs):
    from plait.functions import views as plain

    got = {}
    for r in lines.segments(docs).orderBy("doc_id", "seg_no").collect():
        got.setdefault(r.doc_id, []).append((r.op, r.n, r.ref or "", r.line or ""))
    for k, t in enumerate(DOCS):
        if t is not None:
            assert got[k] == plain.compress_text(t)[0], k
    sizes = {r.doc_id: r.view_bytes for r in lines.view_sizes(lines.segments(docs)).collect()}
    assert all(sizes[k] == plain.view_bytes(plain.compress_text(t)[0]) for k, t in enumerate(DOCS) if t is not None)


def test_budget_and_worth(spark, docs):
    made = api.compress_budget(docs, 400)
    rows = {r.doc_id: r for r in made.collect()}
    assert rows[4].view_bytes <= 400 and rows[5].body is None
    store = views.stored(made)
    assert {r.doc_id: r.text for r in views.decompress(made, store).collect()} == dict(enumerate(DOCS))
    assert {r.doc_id for r in views.worth_it(views.compress_text(docs), 100).collect()} == {3, 4, 9}


@pytest.mark.parametrize(
    "selection, text, said",
    [
        ({}, "l0\nl1\nl2 x\nl3\nl4 x\nl5", "all 6 lines"),
        ({"lines": (2, 3)}, "l1\nl2 x", "lines 2-3 of 6 (2 lines returned)"),
        ({"lines": (5, 99)}, "l4 x\nl5", "lines 5-6 of 6 (2 lines returned)"),
        ({"pattern": "x"}, "l2 x\nl4 x", 'grep "x" → 2 of 6 lines'),
        ({"pattern": "x", "context": 1}, "l1\nl2 x\nl3\nl4 x\nl5", 'grep "x" ±1 context → 5 of 6 lines'),
        ({"pattern": "l? x"}, "l2 x\nl4 x", 'grep "l? x" → 2 of 6 lines'),
        ({"pattern": "none"}, "", 'grep "none" → 0 of 6 lines'),
        ({"first": 2}, "l0\nl1", "head 2 of 6 lines"),
        ({"last": 1}, "l5", "tail 1 of 6 lines"),
        ({"lines": (1, 1), "pattern": "x", "first": 3}, "l0", "lines 1-1 of 6 (1 lines returned)"),
    ],
)
def test_retrieve(spark, selection, text, said):
    df = spark.createDataFrame([(1, "l0\nl1\nl2 x\nl3\nl4 x\nl5")], "doc_id long, text string")
    r = api.retrieve(df, **selection).first()
    assert (r.text, r.described) == (text, said)


def test_retrieve_is_exact_masks_and_budgets(spark):
    df = spark.createDataFrame([(1, "a\r\nb\n"), (2, "password=longenough\n" + "word " * 300)], "doc_id long, text string")
    rows = {r.doc_id: r.text for r in api.retrieve(df).collect()}
    assert rows[1] == "a\r\nb\n" and rows[2].startswith("[MASKED:password:ough]")
    assert api.retrieve(df, mask=False).where("doc_id = 2").first().text.startswith("password=longenough")
    small = {r.doc_id: r.text for r in api.retrieve(df, max_bytes=200).collect()}
    assert small[1] == "a\r\nb\n"


def test_store(spark):
    store = blobs.content_ids(spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "doc_id long, text string"))
    d = blobs.distinct_blobs(store, "doc_id")
    assert blobs.stats(d).first() == (2, 2)
    assert {r.id: (r.first_seen, r.n_copies) for r in d.collect()} == {sha("a"): (1, 2), sha("b"): (2, 1)}
    new = blobs.content_ids(spark.createDataFrame([(5, "b"), (6, "c"), (7, "c")], "doc_id long, text string"))
    assert [r.id for r in blobs.put(d, new).collect()] == [sha("c")]
    assert sorted(r.doc_id for r in blobs.exists(new, d).collect()) == [5]
    assert sorted(r.doc_id for r in blobs.missing(new, d).collect()) == [6, 7]


def test_gc_protects_what_survivors_reach(spark):
    a, b, c, d, e = "leaf", None, None, "old and alone", "unknown age"
    b = f"refers to {sha(a)}"
    c = f"new, refers to {sha(b)}"
    rows = [(sha(a), a, 4, 1000), (sha(b), b, 10, 1000), (sha(c), c, 20, 9999), (sha(d), d, 13, 1000), (sha(e), e, 11, None)]
    store = spark.createDataFrame(rows, "id string, content string, n_bytes long, first_seen long")
    deleted, report = blobs.gc(store, 5000)
    assert [r.id for r in deleted.collect()] == [sha(d)]
    assert tuple(report.first()) == (1, 13, 1)
    deleted, report = blobs.gc(store.where(F.col("id") != sha(c)), 5000)
    assert tuple(report.first()) == (3, 27, 1)
    assert tuple(blobs.gc(store.limit(0), 5000)[1].first()) == (0, 0, 0)


VERSIONS = [("k", 1, "a\nb\nc"), ("k", 2, "a\nb\nc"), ("k", 3, "a\nX\nc"), ("m", 1, "one"), ("m", 2, None), ("m", 3, "")]


def test_sessions(spark):
    v = spark.createDataFrame(VERSIONS, "key string, seq long, content string")
    rows = {(r.key, r.seq): r for r in sessions.diffs(v).collect()}
    assert [rows["k", s].kind for s in (1, 2, 3)] == ["first", "unchanged", "diff"]
    assert (rows["k", 3].same, rows["k", 3].deleted, rows["k", 3].inserted) == (2, 1, 1)
    state = sessions.latest(v)
    asked = spark.createDataFrame([("k", sha("a\nX\nc").upper()), ("k", sha("old")), ("z", sha("a")), ("k", "no hash")], "key string, hash string")
    got = {(r.key, r["hash"]): (r.known, r.changed) for r in sessions.changed(state, asked).collect()}
    assert got == {("k", sha("a\nX\nc").upper()): (True, False), ("k", sha("old")): (True, True), ("z", sha("a")): (False, False), ("k", "no hash"): (None, None)}


def test_appends(spark):
    v = spark.createDataFrame([("k", 1, "ab"), ("k", 2, ""), ("k", 3, "cd"), ("k", 4, None)], "key string, seq long, content string")
    rows = sorted((r.seq, r.chunk_bytes, r.total_bytes, r.content) for r in sessions.appended(v, full=True).collect())
    assert rows == [(1, 2, 2, "ab"), (2, 0, 2, "ab"), (3, 2, 5, "ab\ncd"), (4, 0, 5, "ab\ncd")]


def brute_overlaps(rows):
    out = {}
    for key, seq, text in rows:
        if text is None:
            continue
        mine = text.split("\n")
        found = []
        for other, seq2, text2 in rows:
            if text2 is not None and (seq2, other) < (seq, key):
                n = sum(x in set(text2.split("\n")) for x in mine)
                if len(mine) >= 5 and n * 3 >= len(mine):
                    found.append((-n, seq2, other))
        if found:
            n, _, other = min(found)
            out[key] = (other, len(mine), -n)
    return out


def test_overlaps_match_brute_force(spark):
    import random

    rng = random.Random(6)
    rows = []
    for k in range(120):
        base = rng.choice(rows)[2].split("\n") if rows and rng.random() < 0.5 else [f"l{rng.randrange(60)}" for _ in range(rng.randint(3, 12))]
        text = "\n".join(x if rng.random() > 0.3 else f"l{rng.randrange(60)}" for x in [*base, *["shared"] * rng.randint(0, 2)])
        rows.append((k, 200 - k if k % 7 == 0 else k, text))
    rows += [(k, 300 + k, rows[k % 20][2]) for k in range(120, 160)] + [(500, 500, None), (501, 501, "")]
    got = {r.key: (r.other, r.n_lines, r.overlap) for r in sessions.overlaps(spark.createDataFrame(rows, "key long, seq long, content string")).collect()}
    assert got == brute_overlaps(rows)


def overlap_rows():
    import random

    rng = random.Random(7)
    rows = []
    for k in range(150):
        often = rng.sample(["x", "y", "z", "w"], rng.randint(0, 4))
        often = [x for x in often for _ in range(rng.choice((1, 1, 2)))]
        rows.append((k, rng.randint(0, 90), "\n".join([*often, *(f"own{k} {j}" if rng.random() < 0.7 else f"l{rng.randrange(25)}" for j in range(rng.randint(0, 6)))])))
    return rows + [(k, rng.randint(0, 90), rows[k % 30][2]) for k in range(150, 180)]


@pytest.mark.parametrize("common", [0, 1, 4, 30, 10**6])
def test_overlaps_by_sets_of_common_lines(spark, common):
    rows = overlap_rows()
    got = {r.key: (r.other, r.n_lines, r.overlap) for r in sessions.overlaps(spark.createDataFrame(rows, "key long, seq long, content string"), common=common).collect()}
    assert len(got) > 50 and got == brute_overlaps(rows)


def most_joined(plan):
    """The most rows that a join of an executed plan made."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return most_joined(plan.executedPlan())
    if plan.nodeName().endswith("QueryStage"):
        return most_joined(plan.plan())
    metric = plan.metrics().get("numOutputRows")
    own = metric.get().value() if "Join" in plan.nodeName() and metric.isDefined() else 0
    return max([own, *(most_joined(plan.children().apply(i)) for i in range(plan.children().size()))])


def test_overlaps_do_not_pair_all_holders_of_common_lines(spark):
    rows = [(k, k, "\n".join(["head", "second", *(f"own {k} {j}" for j in range(3))])) for k in range(400)]
    df = sessions.overlaps(spark.createDataFrame(rows, "key long, seq long, content string"))
    got = {r.key: (r.other, r.n_lines, r.overlap) for r in df.collect()}
    assert got == {k: (0, 5, 2) for k in range(1, 400)}
    assert most_joined(df._jdf.queryExecution().executedPlan()) <= 4000


def test_metrics(spark):
    ev = [("t", k, int(k >= 30), 10, 5) for k in range(50)] + [("u", k, int(k >= 40), 10, 5) for k in range(45)]
    df = spark.createDataFrame(ev, "tool string, seq long, is_retrieve int, bytes_saved long, bytes_retrieved long")
    got = {r.tool: (r.hits, r.n_recent, r.suggested_min_bytes) for r in telemetry.latest_rates(df).collect()}
    assert got == {"t": (20, 50, 2048), "u": (5, 45, 0)}
    top = telemetry.tool_metrics(df).collect()
    assert [(r.tool, r.compressions, r.retrieves, r.retrieve_rate, r.net_saved) for r in top] == [("u", 40, 5, 0.111111, 225), ("t", 30, 20, 0.4, 250)]


def test_statusline_and_stats(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"d":"2024-05-01","saved":1000,"tool":"Bash"}\nnot json\n{"d":"2024-04-30","saved":2000,"tool":"Read"}\n')
    log = files.savings_log(spark, str(tmp_path / "log.jsonl"))
    counters = spark.createDataFrame([(10000, 4000, 500)], "total_original long, total_compressed long, append_bytes_avoided long")
    assert tuple(telemetry.statusline(counters, log, datetime.date(2024, 5, 1)).first()) == (9500, 1000)
    events = spark.createDataFrame([(10000, 4000)], "original_bytes long, compressed_bytes long")
    r = api.stats(events, telemetry.pricing(spark), "claude-opus-5", 600).first()
    assert (r.saved, r.saved_pct, r.tokens_saved, r.usd_saved) == (6000, "60.0%", 2000.0, 0.03)
    assert api.stats(events.limit(0), telemetry.pricing(spark)).first().saved_pct == "0.0%"


def test_pricing_file(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"mine": {"input_per_mtok": 1.5, "cache_read_per_mtok": 0.5}, "default": {"input_per_mtok": 9.0, "cache_read_per_mtok": 1.0}}))
    rates = telemetry.pricing(spark, str(tmp_path / "p.json"))
    rows = telemetry.with_rates(spark.createDataFrame([("mine",), ("other",)], "model string"), rates).collect()
    assert {r.model: r.input_per_mtok for r in rows} == {"mine": 1.5, "other": 9.0}


def test_ledger(spark):
    big = "r" * 3000
    messages = [
        {"role": "user", "content": [{"type": "tool_result", "tool_name": "Bash", "content": big}]},
        {"type": "tool_result", "content": [{"type": "text", "text": big}, {"type": "text", "text": "more"}]},
        {"tool_name": "Read", "tool_response": {"file": {"content": big + "!"}}},
        {"outer": {"inner": [{"type": "tool_result", "tool_name": "Deep", "content": {"k": big}}]}},
        {"type": "tool_result", "tool_name": "Small", "content": "tiny"},
    ]
    rows = [(1, k, json.dumps(m)) for k, m in enumerate(messages)] + [(1, 9, "# comment"), (1, 10, ""), (1, 11, "{broken"), (1, 12, None)]
    e = ledger.entries(spark.createDataFrame(rows, "doc_id long, seq long, value string"))
    got = {r.seq: (r.tool_name, r.n_bytes) for r in e.collect()}
    assert got == {0: ("Bash", 3000), 1: ("unknown", 3005), 2: ("Read", 3001), 3: ("Deep", 3008)}
    r = ledger.index(e, max_lines=2).first()
    assert r.n_lines == 2 and r.index_text.split("\n")[0].startswith(sha(big) + " Bash rrr")
    assert ledger.guidance(spark.createDataFrame([(1, "a <m>\nb\n<m>")], "doc_id long, text string"), "<m>").first().n_markers == 2


def test_ingest_and_datasets(spark, tmp_path):
    good = [{"event": "compress", "session_id": "s1", "ts": 1714521600}, {"event": "session_end", "session_id": "s1", "ts": 1714608000}]
    rows = [("b1", json.dumps(x)) for x in good] + [("b2", json.dumps(good[0])), ("b2", '{"event":"unknown","session_id":"s"}'), ("b3", "{bad"), ("b4", '{"event":"compress"}')]
    df = spark.createDataFrame(rows, "batch string, value string")
    assert {r.batch: r.accepted for r in files.accept_batches(df, "batch").collect()} == {"b1": True, "b2": False, "b3": False, "b4": False}
    files.ingest(df, "batch", f"{tmp_path}/harvest")
    assert files.download(spark, f"{tmp_path}/harvest").count() == 2
    day = files.download(spark, f"{tmp_path}/harvest", "2024-05-02")
    assert day.count() == 1 and "PartitionFilters: [isnotnull(date" in day._jdf.queryExecution().toString()
    for _ in range(2):
        files.append_dataset(spark.range(3).withColumn("x", F.lit("y")).coalesce(1), f"{tmp_path}/sets/one")
    meta = files.dataset_metadata(spark, f"{tmp_path}/sets").first()
    assert (meta.name, meta.chunks) == ("one", 2) and meta.size_bytes > 0
    assert files.sample(spark.range(50), ["id"], 0).count() == 1
    paths = spark.createDataFrame([("/h/2024-05-01/s1/1.jsonl", 5, None), ("/h/2024-05-01/s2/2.jsonl", 7, None), ("/other", 1, None)], "path string, length long, modificationTime timestamp")
    assert tuple(files.path_metadata(paths).first())[:3] == (1, 2, 13)
    texts = files.read_documents(spark, f"{tmp_path}/sets/one").collect()
    assert all(r.text.startswith("{") for r in texts if r.path.endswith(".json"))


def run_stream(spark, rows, build, tmp_path, name):
    rows.write.parquet(f"{tmp_path}/{name}/in")
    stream = build(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/{name}/in"))
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    v = spark.createDataFrame([(1, 1, "a\nb"), (1, 2, "a\nb"), (1, 3, "a\nc"), (2, 1, "x")], "key long, seq long, content string").repartition(1)
    got = {(r.key, r.seq): (r.kind, r.view_bytes) for r in run_stream(spark, v, streams.session_stream, tmp_path, "s_session")}
    want = {(r.key, r.seq): (r.kind, r.view_bytes) for r in sessions.diffs(v).collect()}
    assert got == want
    sizes = {(r.key, r.seq): (r.total_bytes, r.avoided_bytes) for r in run_stream(spark, v, streams.append_stream, tmp_path, "s_append")}
    assert sizes == {(r.key, r.seq): (r.total_bytes, r.avoided_bytes) for r in sessions.appended(v).collect()}
    ev = spark.createDataFrame([("t", k, int(k >= 30)) for k in range(50)], "tool string, seq long, is_retrieve int").repartition(1)
    rates = run_stream(spark, ev, streams.recent_rate_stream, tmp_path, "s_rate")
    assert max((r.seq, r.hits, r.suggested_min_bytes) for r in rates) == (49, 20, 2048)
    assert len(run_stream(spark, v, streams.dedup_stream, tmp_path, "s_dedup")) == 3


def test_tools(spark):
    ours = spark.createDataFrame([("get", "a"), ("put", "b")], "name string, description string")
    theirs = spark.createDataFrame([("put", "c")], "name string, description string")
    assert sorted(r.name for r in telemetry.merge_tools(ours, theirs).collect()) == ["get", "pb_put", "put"]


def test_a_key_with_many_arrow_batches_is_folded_in_order(spark, tmp_path):
    """25,000 events of one key in falling order, more than one Arrow batch."""
    rows = spark.range(25_000).selectExpr("'t' AS tool", "24999 - id AS seq", "CAST((24999 - id) % 3 = 0 AS INT) AS is_retrieve").coalesce(1)
    got = {r.seq: r for r in run_stream(spark, rows, streams.recent_rate_stream, tmp_path, "s_long")}
    assert [got[k].n_recent for k in (0, 1, 48, 49, 24_999)] == [1, 2, 49, 50, 50]
    assert all(got[k].hits == sum(x % 3 == 0 for x in range(max(0, k - 49), k + 1)) for k in range(0, 25_000, 997))


def test_events_reach_a_sink_in_batches(spark, tmp_path):
    rows = spark.range(10).selectExpr("id", "'e' AS event")
    rows.write.parquet(f"{tmp_path}/events")
    seen = []
    sink = streams.to_batches_sink(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/events"), lambda df, k: seen.append((k, sorted(r.value for r in df.collect()))), f"{tmp_path}/ck")
    sink.trigger(availableNow=True).start().awaitTermination()
    assert sum((v for _, v in seen), []) == sorted(f'{{"id":{k},"event":"e"}}' for k in range(10))


def test_json_references_of_any_depth_come_back(spark):
    """Stored subtrees that refer to one another, forty deep."""
    store, inner, whole = [], '"leaf"', '"leaf"'
    for k in range(40):
        content, whole = f'{{"inner":{inner},"level":{k}}}', f'{{"inner":{whole},"level":{k}}}'
        store.append((sha(content), content.encode()))
        inner = f'{{"~x":"{sha(content)}"}}'
    made = spark.createDataFrame([(1, inner), (2, f'{{"~x":"{"0" * 64}"}}'), (3, None), (4, f'[{inner},1]')], "doc_id long, body string")
    got = {r.doc_id: r.text for r in views.decompress_json(made, spark.createDataFrame(store, "id string, content binary")).collect()}
    assert got == {1: whole, 2: None, 3: None, 4: f"[{whole},1]"}


def test_a_dataset_is_deleted(spark, tmp_path):
    for name in ("one", "two"):
        files.append_dataset(spark.range(3), f"{tmp_path}/{name}")
    assert files.delete_dataset(spark, str(tmp_path), "one") and not files.delete_dataset(spark, str(tmp_path), "one")
    assert [r.name for r in files.dataset_metadata(spark, str(tmp_path)).collect()] == ["two"]
    for name in ("", ".", "..", "a/b"):
        with pytest.raises(ValueError):
            files.delete_dataset(spark, str(tmp_path), name)


def test_hashes_alone_are_recorded(spark):
    state = spark.createDataFrame([("a", sha("old")), ("b", sha("same"))], "key string, id string")
    seen = spark.createDataFrame([("a", "new"), ("c", "first")], "key string, content string")
    assert {tuple(r) for r in sessions.record(state, seen).collect()} == {("a", sha("new")), ("b", sha("same")), ("c", sha("first"))}
