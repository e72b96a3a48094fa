import hashlib
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from plait.llm import chat, queries
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def conversations():
    hard = ["plain", "", None, "<|end|>\n", "<|turn|>user<|text|>x", r"<\|", r"<\\|text|>", "<", "<<|next|>", "a<|", "|>", "\n", "\\", r"\### Assistant: </turn> ok", "日本 😀", "<" + "\\" * 5 + "|end|>", "x" * 100_000]
    rows = []
    for k, t in enumerate(hard):
        rows += [(k, 0, "user", t, "x"), (k, 1, "assistant", t, "x"), (k, 2, "assistant", f"{t} again", "x"), (k, 3, "user", t, "x")]
    rows += [(50, 2, "user", "third", "x"), (50, 0, "system", "first", "x"), (50, 1, "user", "second", "x"), (50, 1, "user", "second", "x"), (50, None, None, "no turn", "x"), (None, 0, "user", "no id", "x"), (None, 0, "user", "no id", "x"), (None, 1, "assistant", "no id either", "x"), (51, 0, "<|end|>", "odd role", "x")]
    return rows


def expected(rows):
    by = {}
    for k, (c, n, r, t, _) in enumerate(rows):
        by.setdefault((c, k if c is None else 0), []).append((n is not None, n or 0, r or "", t or ""))
    out = []
    for (c, _), ts in by.items():
        ts.sort()
        told = "".join(f"{r}\n{t}\n" for *_, r, t in ts)
        loss = "".join(t for *_, r, t in ts if r == "assistant")
        out.append((str(c), len(ts), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out)


def test_everything_comes_back_from_the_strings(spark):
    rows = conversations()
    got = chat.format_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.conv_id), *tuple(r)[1:5]) for r in got) == expected(rows)


def test_template_merging_and_mask(spark):
    rows = [(1, 0, "user", "hi", ""), (1, 1, "assistant", "a<|end|>", ""), (1, 2, "assistant", "b", ""), (1, 3, "user", "bye", "")]
    r = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).first()
    assert r.formatted == "<|turn|>user<|text|>hi<|end|>\n<|turn|>assistant<|text|>a<\\|end|><|next|>b<|end|>\n<|turn|>user<|text|>bye<|end|>\n"
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == ["a<\\|end|>", "b"]


def test_spans_count_code_points_and_bytes(spark):
    rows = [(1, 0, "usér", "日本 😀", ""), (1, 1, "assistant", "é<|", ""), (1, 2, "assistant", "", ""), (1, 3, "assistant", "😀x", "")]
    r = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).first()
    raw = r.formatted.encode()
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == ["é<\\|", "", "😀x"]
    assert [raw[s.first_byte : s.first_byte + s.n_bytes].decode() for s in r.loss_spans] == ["é<\\|", "", "😀x"]


def test_time_grows_with_the_turns(spark):
    """Sixteen thousand turns of one conversation take about four times what four thousand take, not sixteen."""

    def seconds(n, roles):
        df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), roles.alias("role"), F.repeat(F.lit("text of a turn "), 4).alias("text"))
        began = time.perf_counter()
        assert chat.format_report(df).first().n_turns == n
        return time.perf_counter() - began

    for roles in (F.when(F.col("id") % 2 == 0, "user").otherwise("assistant"), F.lit("assistant")):
        seconds(100, roles)
        assert seconds(16_000, roles) < 6 * max(1.0, seconds(4_000, roles))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), st.text(alphabet="<|>\\ae\nndtur", max_size=20)), min_size=1, max_size=6))
def test_any_turns_come_back(spark, turns):
    rows = [(1, k, r, t, "") for k, (r, t) in enumerate(turns)]
    got = chat.format_report(spark.createDataFrame(rows, SCHEMA)).first()
    assert ("1", *tuple(got)[1:5]) == expected(rows)[0]


def test_escape_is_a_bijection(spark):
    texts = ["<|", r"<\|", r"<\\|", "<<||", r"\<|", "<\\", "|", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t and "<|" not in r.e


def test_the_query_adds_its_conversation(spark, tmp_path):
    spark.createDataFrame(conversations(), SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    rows = [*conversations(), (-7, 0, "user", "\\### Assistant: </turn> ok", ""), (-7, 1, "assistant", "\\### Assistant: </turn> ok", "")]
    got = queries.op10_chat_format(spark, str(tmp_path)).collect()
    assert sorted((str(r.conv_id), *tuple(r)[1:5]) for r in got) == expected(rows)


def test_empty_table_and_native_plan(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert chat.format_report(df).count() == 0
    plan = chat.format_report(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
