import pytest
from plait.functions import classify, masking
from pyspark.sql import functions as F

A36 = "a" * 36
SECRETS = {
    "aws_key": "AKIA" + "B" * 16,
    "github_token": "ghp_" + A36,
    "github_oauth": "gho_" + A36,
    "github_pat": "github_pat_" + "c" * 82,
    "slack_token": "xoxb-" + "1" * 20,
    "google_api_key": "AIza" + "d" * 35,
    "npm_token": "npm_" + A36,
    "bearer_token": "Bearer " + "e" * 24,
    "auth_token": "_authToken=" + "f" * 12,
    "password": "password=hunter2hunter2",
    "secret": "secret=" + "g" * 9,
    "token": "token=" + "h" * 12,
    "api_key": "api_key='" + "i" * 12 + "'",
    "private_key": "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----\n",
    "url_credentials": "https://user:passw@host/path",
    "jwt": "eyJ" + "a" * 40 + "." + "b" * 40 + "." + "c" * 30,
}


@pytest.mark.parametrize("kind", SECRETS)
def test_each_kind_is_masked(kind):
    text = f"before {SECRETS[kind]} after"
    out, n = masking.mask(text)
    assert n == 1 and f"[MASKED:{kind}:{SECRETS[kind][-4:]}]" in out and out.startswith("before ")
    assert SECRETS[kind] not in out


@pytest.mark.parametrize("text", ["a" * 64, "0123abcd" * 8, "550e8400-e29b-41d4-a716-446655440000", "password=short", "error_code=404", "mypassword=longenoughvalue", "QUJDREVG" * 10, "https://host/path@x", "https://user@host/", "AKIA" + "B" * 17, "token = abcdefghijkl", ""])
def test_harmless_text_stays(text):
    assert masking.mask(text) == (text, 0)


def test_assigned_values_get_a_precise_kind():
    assert "[MASKED:github_token:" in masking.mask("token=ghp_" + A36)[0]
    assert "[MASKED:aws_key:" in masking.mask("secret=AKIA" + "B" * 16)[0]


def test_many_secrets_in_one_pass():
    text = " ".join(SECRETS[k] for k in ("npm_token", "password", "aws_key"))
    assert masking.mask(text)[1] == 3


def test_masking_of_a_table(spark):
    rows = spark.createDataFrame([("password=longenough",), (None,), ("clean",)], "t string").select(masking.mask_secrets("t").alias("m")).collect()
    assert [tuple(r.m) for r in rows] == [("[MASKED:password:ough]", 1), (None, 0), ("clean", 0)]


CLASSES = [
    ('{"a": 1}', "json"),
    ("  [1, 2]", "json"),
    ("[ERROR] something", "logs"),
    ("[true]", "json"),
    ("2024-01-01 started", "logs"),
    ("1700000000 started", "logs"),
    ("x INFO y", "logs"),
    ("def f(x):", "code"),
    ("a letter from home", "code"),
    ("SELECT a", "code"),
    ("deadbeef" * 10, "hex"),
    ("plain words, nothing else here!", "prose"),
    ("", "prose"),
    (None, "prose"),
    ("zz" * 2047 + "zé INFO: cut inside a character", "prose"),
    ("\n" * 12 + "2024-with words of no class", "prose"),
]


def test_content_classes(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CLASSES)], "k int, t string")
    got = {r.k: r.c for r in df.select("k", classify.content_class(F.col("t")).alias("c")).collect()}
    assert [got[k] for k in range(len(CLASSES))] == [c for _, c in CLASSES]


FORMATS = [
    ("=== test session starts ===\nx", "pytest"),
    ("a.py::test_x PASSED", "pytest"),
    ("   Compiling x v1", "cargo"),
    ("test a::b ... ok", "cargo"),
    ("diff --git a/x b/x", "git-diff"),
    ("--- a/x\n+++ b/x", "git-diff"),
    ("--- a/x", None),
    ("On branch main", "git-status"),
    ("abcdef1 first\nabcdef2 second", "git-log"),
    ("abcdef1 first\nnot a hash", None),
    ("added 3 packages in 1s", "package-manager"),
    ('{"a":1}\n{"a":2}', "jsonl"),
    ('{"a":1}\r\n[2]\r\nx', "jsonl"),
    ("\n" * 45 + "On branch main", None),
    ("", None),
    (None, None),
]


def test_formats(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(FORMATS)], "k int, t string")
    got = {r.k: r.f for r in df.select("k", classify.detect_format(F.col("t")).alias("f")).collect()}
    assert [got[k] for k in range(len(FORMATS))] == [f for _, f in FORMATS]
    hinted = df.select(classify.format_or_hint(F.col("t"), F.lit("cargo")).alias("f")).distinct().collect()
    assert [r.f for r in hinted] == ["cargo"]
    assert df.where("k = 0").select(classify.format_or_hint(F.col("t"), F.lit("what")).alias("f")).first().f == "pytest"


def test_small_functions(spark):
    r = spark.range(1).select(
        classify.human_tokens(F.lit(1_234_567)).alias("a"),
        classify.human_tokens(F.lit(1_500)).alias("b"),
        classify.human_bytes(F.lit(2048)).alias("c"),
        classify.preview(F.lit("a  b\n\nc" + "x" * 100)).alias("d"),
        classify.saved_percent(F.lit(10000), F.lit(4000)).alias("e"),
        classify.saved_percent(F.lit(0), F.lit(0)).alias("f"),
        classify.is_valid_id(F.lit("A" * 64)).alias("g"),
        classify.is_valid_id(F.lit("../x")).alias("h"),
        classify.first_sentence(F.lit("Does a thing. And more.")).alias("i"),
        classify.session_key(F.lit('{"file_path": "/a", "query": "q"}')).alias("j"),
        classify.response_text(F.lit('{"stdout": "", "output": "o"}')).alias("k"),
    ).first()
    assert (r.a, r.b, r.c, r.e, r.f, r.g, r.h, r.i, r.j, r.k) == ("1.2M", "1.5k", "2.0 KB", "60.0%", "0.0%", True, False, "Does a thing.", "session:/a", "o")
    assert r.d.startswith("a b cxx") and len(r.d) <= 80
