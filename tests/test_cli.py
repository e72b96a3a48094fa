import hashlib
import json

from plait.__main__ import main


def test_compress_and_back(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    log = "\n".join(f"line {k} of a long log" for k in range(200))
    (tmp_path / "in" / "a.log").write_text(log)
    (tmp_path / "in" / "b.json").write_text('{"b": 1, "a": [1, 2]}')
    main(["compress", f"{tmp_path}/in", f"{tmp_path}/out"])
    main(["verify", f"{tmp_path}/out"])
    assert "|true|" in capsys.readouterr().out
    main(["decompress", f"{tmp_path}/out", f"{tmp_path}/back"])
    assert {r.text for r in spark.read.parquet(f"{tmp_path}/back").collect()} == {log, '{"a":[1,2],"b":1}'}
    main(["retrieve", f"{tmp_path}/in/a.log", "--grep", "line 199"])
    assert "grep \"line 199\" → 1 of 200 lines" in capsys.readouterr().out


def test_datasets_events_and_reports(spark, tmp_path, capsys):
    event = {"event": "compress", "session_id": "s", "ts": 1714521600, "original_bytes": 1000, "compressed_bytes": 400}
    (tmp_path / "e.jsonl").write_text(json.dumps(event) + "\n")
    main(["ingest", f"{tmp_path}/e.jsonl", f"{tmp_path}/harvest"])
    assert spark.read.text(f"{tmp_path}/harvest").count() == 1
    main(["push", f"{tmp_path}/e.jsonl", f"{tmp_path}/sets/one"])
    main(["datasets", f"{tmp_path}/sets"])
    main(["preview", f"{tmp_path}/sets/one", "--n", "1"])
    main(["stats", f"{tmp_path}/e.jsonl", "--model", "claude-opus-5"])
    out = capsys.readouterr().out
    assert "one" in out and "session_id" in out and "60.0%" in out
    main(["pull", f"{tmp_path}/sets/one", f"{tmp_path}/pulled"])
    assert json.loads(spark.read.text(f"{tmp_path}/pulled").first().value) == event
    main(["pull", f"{tmp_path}/harvest", f"{tmp_path}/day", "--date", "2024-05-01"])
    assert spark.read.text(f"{tmp_path}/day").count() == 1
    main(["push", f"{tmp_path}/e.jsonl", f"{tmp_path}/sets/two"])
    main(["delete", f"{tmp_path}/sets", "--dataset", "two"])
    main(["delete", f"{tmp_path}/sets", "--dataset", "two"])
    assert "deleted\nnot found" in capsys.readouterr().out
    (tmp_path / "log").write_text('{"d":"2024-05-01","saved":1000,"tool":"x"}\n')
    (tmp_path / "c").write_text('{"total_original":10000,"total_compressed":4000,"append_bytes_avoided":500}')
    main(["statusline", f"{tmp_path}/log", "--counters", f"{tmp_path}/c", "--today", "2024-05-01"])
    assert "7500" in capsys.readouterr().out
    (tmp_path / "t.jsonl").write_text(json.dumps({"type": "tool_result", "tool_name": "Bash", "content": "x" * 50}) + "\n# no\n")
    main(["ledger", f"{tmp_path}/t.jsonl", "--min-bytes", "10"])
    assert "Bash" in capsys.readouterr().out


def test_gc_and_sessions(spark, tmp_path, capsys):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [(sha("a"), "a", 1, 1000), (sha("b"), "b", 1, 99999999999)]
    spark.createDataFrame(rows, "id string, content string, n_bytes long, first_seen long").write.parquet(f"{tmp_path}/blobs")
    main(["gc", f"{tmp_path}/blobs", "--days", "0", "--kept", f"{tmp_path}/off"])
    assert not (tmp_path / "off").exists()
    main(["gc", f"{tmp_path}/blobs", "--kept", f"{tmp_path}/kept"])
    assert [r.id for r in spark.read.parquet(f"{tmp_path}/kept").collect()] == [sha("b")]
    spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "key string, seq long, content string").write.parquet(f"{tmp_path}/v")
    main(["session", f"{tmp_path}/v", f"{tmp_path}/sv"])
    assert sorted(r.kind for r in spark.read.parquet(f"{tmp_path}/sv").collect()) == ["diff", "first"]
