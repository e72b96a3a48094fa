"""Queries over small stated inputs, for what the tables of a folder do not hold: formats, secrets, nested JSON.

Each input is written once and given to Spark as rows and to SQL as VALUES; the SQL computes the result in its own way or, where SQL has
no means, states it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify, masking
from ..functions.views import MARK
from ..operators import sessions, tools, views
from ..operators.blobs import cut
from .catalogue import _ESC, _segs, query, table, versions_of


def quoted(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A common table expression of rows."""
    cell = lambda v: quoted(v) if v is None or isinstance(v, str) else str(v)
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)})"


# Formats.

_PYTEST = ["=== test session starts ===", "collected 9 items", "", *[f"tests/test_a.py::test_{k} PASSED [ {k * 9}%]" for k in range(8)], "tests/test_a.py::test_x FAILED [ 99%]", "........F...... [ 72%]", "..s.. [100%]", "." * 80, "___ test_x ___", "    assert 1 == 2", "E   AssertionError PASSED", "> x", "FAILED tests/test_a.py::test_x", "=== 1 failed ===", ""]
_CARGO = [*[f"   Compiling dep{k} v1.{k}.0" for k in range(7)], "   Downloading crates ...", "warning: unused variable", "    Finished dev", *[f"test mod::case_{k} ... ok" for k in range(5)], "test mod::bad ... FAILED", "error[E0308]: mismatched types", "test result: FAILED. 5 passed"]
_DIFF = ["diff --git a/x b/x", "--- a/x", "+++ b/x", "@@ -1,20 +1,20 @@", *[f" context {k}" for k in range(6)], "-old", "+new", *[f" more context {k}" for k in range(11)], "+last", " end"]
_STATUS = ["On branch main", "Changes not staged for commit:", "\tmodified:   a.py", "", "Untracked files:", "\tb.py"]
_NPM = ["npm notice new version", "Downloading a", "Collecting b", "npm WARN deprecated c", "Using cached d", "added 12 packages in 3s", "Successfully installed e", "Installing f", "found 2 vulnerabilities", "plain"]
_JSONL = ['{"ts": 1, "level": "info", "msg": "a"}', *[f'{{"ts": {k}, "level": "info", "msg": "m{k}"}}' for k in range(9)], '{"ts": 1}', "", *[f'{{"msg": "x{k}", "ts": {k}, "level": "b"}}' for k in range(3)], "no json"]
FORMATS = {"pytest": _PYTEST, "cargo": _CARGO, "git-diff": _DIFF, "git-status": _STATUS, "package-manager": _NPM, "jsonl": _JSONL}
_FORMAT_ROWS = [(k, "\n".join(v)) for k, v in FORMATS.items()]
_LOW = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"""WITH {values("c", "name, text", _FORMAT_ROWS)},
 l AS (SELECT name, unnest(range(len(ls)))::BIGINT AS k, unnest(ls) AS line, unnest(ls[1:1] || ls[1:-2]) AS prev, ls[1] AS head FROM (SELECT name, string_split(text, {_ESC}) AS ls FROM c)),
 d AS (SELECT *, CASE
  WHEN name = 'pytest' THEN CASE WHEN regexp_matches(line, '^(===|---|___|FAILED |ERROR |    |>|E |short test summary)') THEN '' WHEN contains(line, ' PASSED') OR (trim(line) <> '' AND strlen(trim(line)) < 80 AND regexp_full_match(trim(line), '[.FEs \\[\\]%0-9]+')) THEN 'noise' ELSE '' END
  WHEN name = 'cargo' THEN CASE WHEN starts_with(line, '   Compiling ') OR starts_with(line, '   Downloading ') THEN 'building' WHEN starts_with(line, 'test ') AND suffix(line, ' ... ok') THEN 'passing' ELSE '' END
  WHEN name = 'git-diff' THEN CASE WHEN starts_with(line, ' ') THEN 'context' ELSE '' END
  WHEN name = 'package-manager' THEN CASE WHEN regexp_matches({_LOW}, 'error|warn|successfully installed|successfully downloaded|failed|vulnerability|vulnerabilities|^requirement already satisfied') OR (contains({_LOW}, 'added ') AND contains({_LOW}, 'packages')) THEN '' WHEN regexp_matches({_LOW}, '^(downloading|installing|collecting|npm notice|obtaining|using cached)') THEN 'progress' ELSE '' END
  WHEN name = 'jsonl' THEN CASE WHEN k > 0 AND json_valid(line) AND trim(line) <> '' AND list_sort(json_keys(CASE WHEN json_valid(line) AND trim(line) <> '' THEN line ELSE '{{}}' END)) = list_sort(json_keys(head)) THEN 'record' ELSE '' END
  ELSE '' END AS class FROM (SELECT l.*, CASE WHEN name = 'jsonl' THEN head ELSE '{{}}' END AS h FROM l)),
 i AS (SELECT *, sum(starts) OVER (PARTITION BY name ORDER BY k) AS island FROM (SELECT *, CASE WHEN class = lag(class) OVER (PARTITION BY name ORDER BY k) THEN 0 ELSE 1 END AS starts FROM d)),
 z AS (SELECT *, row_number() OVER (PARTITION BY name, island ORDER BY k) AS pos, count(*) OVER (PARTITION BY name, island) AS n FROM i),
 e AS (SELECT *, class <> '' AND (class <> 'context' OR (n > 6 AND pos > 3 AND pos <= n - 3)) AS gone FROM z),
 s AS (SELECT name, strlen(line) AS b, 0 AS elided FROM e WHERE NOT gone UNION ALL SELECT name, 87 + len(count(*)::VARCHAR), count(*) FROM e WHERE gone GROUP BY name, island)
SELECT name, name AS kind, count(*) AS n_segments, sum(elided)::BIGINT AS n_elided, (sum(b) + count(*) - 1)::BIGINT AS view_bytes, true AS same FROM s GROUP BY name""")
def format_views(spark, sf_dir):
    """Each format's view by its rules, and whether the text comes back."""
    rows = spark.createDataFrame([(k, n, t) for k, (n, t) in enumerate(_FORMAT_ROWS)], "doc_id long, name string, text string")
    made = views.compress(rows, hint="name")
    back = views.decompress(made, views.stored(made)).select("doc_id", F.col("text").alias("back"))
    segments = F.split("body", "\n")
    told = F.transform(F.regexp_extract_all("body", F.lit("(?m)^E:([0-9]+):"), F.lit(1)), lambda x: x.cast("long"))
    joined = made.join(rows, "doc_id").join(back, "doc_id")
    return joined.select("name", "kind", F.size(segments).cast("long").alias("n_segments"), F.aggregate(told, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_elided"), "view_bytes", (F.col("back") == F.col("text")).alias("same"))


@query(f"WITH {values('c', 'name, text', _FORMAT_ROWS)} SELECT name, name AS fmt FROM c")
def formats_detected(spark, sf_dir):
    """Every format is told from its text alone."""
    return spark.createDataFrame(_FORMAT_ROWS, "name string, text string").select("name", classify.detect_format(F.col("text")).alias("fmt"))


# Secrets: (case, what stands before, the secret as SQL, what stands after, its kind; no kind: it stays). Values are made at run time.
_SECRETS = [
    ("aws", "key ", "'AKIA' || repeat('A', 16)", " end", "aws_key"),
    ("github", "", "'ghp_' || repeat('a', 36)", "", "github_token"),
    ("oauth", "(", "'gho_' || repeat('b', 36)", ")", "github_oauth"),
    ("pat", "x ", "'github_pat_' || repeat('c', 82)", "\nnext", "github_pat"),
    ("slack", "", "'xoxb-' || repeat('1', 20)", " ", "slack_token"),
    ("google", "k:", "'AIza' || repeat('d', 35)", "", "google_api_key"),
    ("npm", "", "'npm_' || repeat('e', 36)", "\n", "npm_token"),
    ("bearer", "Authorization: ", "'Bearer ' || repeat('f', 24)", "\n", "bearer_token"),
    ("password", "login ", "'password=' || repeat('g', 12)", " done", "password"),
    ("quoted", "", "'secret=\"' || repeat('h', 12) || '\"'", "", "secret"),
    ("token", "a&", "'token=' || repeat('i', 12)", "&b=1", "token"),
    ("precise", "", "'password=ghp_' || repeat('j', 36)", "", "github_token"),
    ("api", "; ", "'api_key=' || repeat('k', 10)", "", "api_key"),
    ("private", "before\n", "'-----BEGIN RSA PRIVATE KEY-----' || chr(10) || repeat('m', 64) || chr(10) || '-----END RSA PRIVATE KEY-----' || chr(10)", "after", "private_key"),
    ("url", "see ", "'https://user:' || repeat('n', 8) || '@host.example/x'", " end", "url_credentials"),
    ("hash", "", "repeat('0a', 32)", "", None),
    ("uuid", "", "'123e4567-e89b-12d3-a456-426614174000'", "", None),
    ("short", "", "'password=abc'", " ", None),
    ("code", "", "'error_code=404'", "", None),
    ("infix", "", "'mypassword=' || repeat('o', 12)", "", None),
    ("short aws", "", "'AKIA' || repeat('A', 12)", "", None),
    ("no password", "", "'https://host.example/' || repeat('p', 30)", "", None),
    ("prose", "a token of thanks, ", "'no secret'", "", None),
]
_SECRET_ROWS = "SELECT * FROM (VALUES " + ", ".join(f"({quoted(n)}, {quoted(a)}, {s}, {quoted(b)}, {quoted(k)})" for n, a, s, b, k in _SECRETS) + ") AS c(name, ahead, hidden, behind, kind)"


@query(f"WITH c AS ({_SECRET_ROWS}) SELECT name, (kind IS NOT NULL)::BIGINT AS n_masked, ahead || CASE WHEN kind IS NULL THEN hidden ELSE '[MASKED:' || kind || ':' || right(hidden, 4) || ']' END || behind AS masked FROM c")
def masked_secrets(spark, sf_dir):
    rows = spark.sql(_SECRET_ROWS.replace("\n", "\\n")).select("name", masking.mask_secrets(F.concat("ahead", "hidden", "behind")).alias("m"))
    return rows.select("name", "m.n_masked", "m.masked")


# JSON.

_PERSON = {"login": "a-rather-long-login", "id": 12345, "url": "https://host.example/users/a-rather-long-login", "site_admin": False}
_BIG = {"settings": {"retries": 3, "timeout": 30, "labels": ["alpha", "beta", "gamma", "delta", "epsilon"], "note": "the same object in several documents, long enough to store"}}
_JSON: list[tuple[str, object, bool, bool, bool]] = [  # name, value, has a table, a dictionary, interned subtrees
    ("table", [{"id": k, "status": f"s{k}", "region": f"r{k}"} for k in range(2)], True, False, False),
    ("dictionary", [{"id": k, "region": "europe-west" if k % 2 else "america-east"} for k in range(12)], True, True, False),
    ("unique", [{"id": k, "name": f"n{k}"} for k in range(6)], True, False, False),
    ("mixed", [{"a": 1}, 2, "x", None, [1.5, True]], False, False, False),
    ("interned", {"author": _PERSON, "committer": _PERSON, "reviewer": {"who": _PERSON, "when": 1}}, False, False, True),
    ("nested tables", {"rows": [{"k": k, "inner": [{"x": k, "y": 1}, {"x": k + 1, "y": 1}]} for k in range(4)]}, True, False, False),
    ("reserved", {"~t": {"k": [1], "r": [[2]]}, "~r": 0, "~~x": "y"}, False, False, False),
    ("unicode", {"ключ": "значение", "emoji": "😀", "quote": "\"\\\n"}, False, False, False),
    ("scalars", [0, -1, 2.5, 1e30, True, False, None, ""], False, False, False),
]


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@query(f"WITH {values('c', 'name, text, has_table, has_dictionary, has_interned', [(n, canonical(v), a, b, c) for n, v, a, b, c in _JSON])} SELECT name, text, has_table, has_dictionary, has_interned FROM c")
def json_views(spark, sf_dir):
    """Nested JSON encoded and decoded: what the encoding uses, and the canonical text again."""
    rows = spark.createDataFrame([(k, n, json.dumps(v, indent=1, ensure_ascii=False)) for k, (n, v, *_) in enumerate(_JSON)], "doc_id long, name string, text string")
    made = views.compress(rows.select("doc_id", "text"))
    back = views.decompress(made, views.stored(made))
    uses = lambda pattern: F.col("body").rlike(pattern)
    return rows.select("doc_id", "name").join(made.where("kind = 'json'").select("doc_id", "body"), "doc_id").join(back, "doc_id").select("name", "text", uses('"~t":\\{"(d|k)":').alias("has_table"), uses('"~t":\\{"d":').alias("has_dictionary"), uses('\\{"~i":').alias("has_interned"))


_CALLS = [(k, canonical({"call": k, "config": _BIG, "own": f"{k}" * (120 if k % 2 else 20)})) for k in range(4)]
_SUBTREE = canonical(_BIG)


@query(f"WITH {values('c', 'doc_id, text', _CALLS)} SELECT doc_id::BIGINT AS doc_id, text, CASE WHEN doc_id = 0 THEN 0 ELSE 1 END::BIGINT AS n_refs, (doc_id > 0) AS smaller FROM c")
def json_cross_calls(spark, sf_dir):
    """Calls one after the other: each refers to the subtrees that earlier calls stored, and all come back."""
    store = spark.createDataFrame([], "id string, content binary")
    made: DataFrame | None = None
    for k, text in _CALLS:
        one = cut(views.compress_json(spark.createDataFrame([(k, text)], "doc_id long, text string"), store), "call")
        store = cut(store.unionByName(views.stored(one)).dropDuplicates(["id"]), "store")
        made = one if made is None else made.unionByName(one)
    back = views.decompress_json(made, store)
    return made.select("doc_id", F.size("refs").cast("long").alias("n_refs"), (F.col("view_bytes") < F.col("n_bytes")).alias("smaller")).join(back, "doc_id").select("doc_id", "text", "n_refs", "smaller")


@query(f"WITH {values('c', 'doc_id, text', _CALLS)} SELECT doc_id::BIGINT AS doc_id, sha256({quoted(_SUBTREE)}) AS ref, strlen({quoted(_SUBTREE)})::BIGINT AS n_bytes, doc_id > 0 AS seen_before FROM c")
def json_shared_subtrees(spark, sf_dir):
    """The subtree that all calls share, by which call saw it first."""
    rows = spark.createDataFrame([(k, k, t) for k, t in _CALLS], "doc_id long, seq long, text string")
    shared = F.sha2(F.lit(_SUBTREE), 256)
    return views.cross_call(rows, "seq").where(F.col("ref") == shared).select("doc_id", "ref", F.col("n_bytes").cast("long").alias("n_bytes"), "seen_before")


_SHAPES = [({"a": 1, "b": "x"}, 3), ({"a": None, "c": [1], "d": {"e": 1}, "f": True}, 2), ({}, 1)]
_TYPES = {1: '{"a":"number","b":"string"}', 2: '{"a":"null","c":"array","d":"object","f":"boolean"}', 3: "{}"}


@query(f"WITH {values('c', 'schema, n_rows', [(_TYPES[k], n) for k, (_, n) in enumerate(_SHAPES, 1)])} SELECT schema, n_rows::BIGINT AS n_rows FROM c")
def inferred_schemas(spark, sf_dir):
    rows = spark.createDataFrame([(json.dumps(v),) for v, n in _SHAPES for _ in range(n)], "text string").withColumn("doc_id", F.monotonically_increasing_id())
    types = F.to_json(F.map_from_arrays("keys", "types"))
    return views.json_sizes(rows).select(types.alias("schema")).groupBy("schema").agg(F.count(F.lit(1)).alias("n_rows"))


# Budgets and line diffs over whole tables.

_BUDGET = 1000


@query(
    _segs(60, 15, 10)
    + f""", plain AS (SELECT doc_id, (sum(CASE op WHEN 'L' THEN strlen(line) WHEN 'R' THEN 23 + len(n::VARCHAR) WHEN 'E' THEN 87 + len(n::VARCHAR) ELSE 23 + len(n::VARCHAR) END) + count(*) - 1)::BIGINT AS b, count_if(op = 'E') AS refs FROM segs GROUP BY doc_id),
 low AS (SELECT *, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lo FROM lines WHERE doc_id IN (SELECT doc_id FROM plain WHERE b > {_BUDGET})),
 told AS (SELECT *, 1 + CASE WHEN regexp_matches(lo, 'error|fatal|panic|exception|critical') THEN 10 ELSE 0 END + CASE WHEN contains(lo, 'warn') THEN 5 ELSE 0 END + CASE WHEN regexp_matches(lo, 'fail|denied|refused|timeout|crash|abort|killed') THEN 8 ELSE 0 END + CASE WHEN strlen(line) > 200 THEN 2 ELSE 0 END AS score FROM low),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN line_no = 0 THEN 0 WHEN line_no = n_lines - 1 THEN 1 ELSE 2 END, score DESC, line_no) AS place FROM told),
 level AS (SELECT ranked.*, h, place <= greatest(least(2, n_lines), n_lines >> h) AS kept FROM ranked, range(1, 64) r(h) WHERE (n_lines >> (h - 1)) > 0),
 island AS (SELECT *, sum(edge) OVER (PARTITION BY doc_id, h ORDER BY line_no) AS i FROM (SELECT *, CASE WHEN kept = lag(kept) OVER (PARTITION BY doc_id, h ORDER BY line_no) THEN 0 ELSE 1 END AS edge FROM level)),
 piece AS (SELECT doc_id, h, line_no, line, 0 AS gone FROM island WHERE kept UNION ALL SELECT doc_id, h, min(line_no), NULL, count(*) FROM island WHERE NOT kept GROUP BY doc_id, h, i),
 placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, h ORDER BY line_no) - 1 AS pos FROM piece),
 seen AS (SELECT *, min(CASE WHEN gone = 0 THEN pos END) OVER (PARTITION BY doc_id, h, line) AS f FROM placed),
 sized AS (SELECT doc_id, h, (sum(CASE WHEN gone > 0 THEN 87 + len(gone::VARCHAR) WHEN pos > f AND 23 + len(f::VARCHAR) < strlen(line) THEN 23 + len(f::VARCHAR) ELSE strlen(line) END) + count(*) - 1)::BIGINT AS b, count_if(gone > 0) AS refs FROM seen GROUP BY doc_id, h),
 fits AS (SELECT doc_id, coalesce(min(CASE WHEN b <= {_BUDGET} THEN h END), max(h)) AS h FROM sized GROUP BY doc_id)
SELECT d.doc_id, strlen(d.text)::BIGINT AS n_bytes, coalesce(s.b, p.b) AS view_bytes, coalesce(s.b, p.b) <= {_BUDGET} AS within_budget, coalesce(s.refs, p.refs)::INTEGER AS n_refs
FROM documents d JOIN plain p USING (doc_id) LEFT JOIN fits USING (doc_id) LEFT JOIN sized s ON s.doc_id = d.doc_id AND s.h = fits.h"""
)
def budget_views(spark, sf_dir):
    made = views.compress_budget(table(spark, sf_dir, "documents").where("text is not null"), _BUDGET)
    return made.select("doc_id", "n_bytes", "view_bytes", (F.col("view_bytes") <= _BUDGET).alias("within_budget"), F.size("refs").alias("n_refs"))


#: Longest common subsequences, one line of the older version a step; the list holds the lengths for each line of the newer one.
_DIFFS = f"""WITH RECURSIVE v AS (SELECT conv_id AS key, turn AS seq, role AS tool, text, string_split(text, {_ESC}) AS b, lag(string_split(text, {_ESC})) OVER (PARTITION BY conv_id ORDER BY turn) AS a, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS old FROM conversations),
 lcs AS (SELECT key, seq, a, b, 0 AS i, list_transform(range(len(b) + 1), lambda x: 0::BIGINT) AS r FROM v WHERE a IS NOT NULL AND old <> text
  UNION ALL SELECT key, seq, a, b, i + 1, list_reduce(list_transform(range(1, len(b) + 1), lambda j: [j::BIGINT]), lambda acc, j: list_append(acc, greatest(acc[-1], r[j[1] + 1], CASE WHEN a[i + 1] = b[j[1]] THEN r[j[1]] + 1 ELSE 0 END)), [0::BIGINT]) FROM lcs WHERE i < len(a)),
 common AS (SELECT key, seq, r[-1] AS same, len(a) - r[-1] AS deleted, len(b) - r[-1] AS inserted FROM lcs WHERE i = len(a))"""


@query(_DIFFS + " SELECT v.key, v.seq, CASE WHEN old IS NULL THEN 'first' WHEN old = text THEN 'unchanged' ELSE 'diff' END AS kind, same::BIGINT AS same, deleted::BIGINT AS deleted, inserted::BIGINT AS inserted FROM v LEFT JOIN common USING (key, seq)")
def line_diff_counts(spark, sf_dir):
    """Lines kept, deleted and inserted against the version before."""
    return sessions.diffs(versions_of(spark, sf_dir)).select("key", "seq", "kind", "same", "deleted", "inserted")


_VERSIONS = ["one\ntwo\nthree\nfour", "one\ntwo and a half\nthree\nfour", "zero\none\ntwo and a half\nfour", "zero\none\ntwo and a half\nfour", "", "new\nnew\nnew"]
#: What the diffs of these versions weigh: 85 for the reference, one for each line break, 21 or 23 and the digits for each operation, and what is inserted.
_VERSION_VIEWS = [
    (0, "first", 18),
    (1, "diff", 85 + (1 + 22) + (1 + 24) + (1 + 24 + 1 + 14) + (1 + 22)),
    (2, "diff", 85 + (1 + 24 + 1 + 4) + (1 + 22) + (1 + 24) + (1 + 22)),
    (3, "unchanged", 90),
    (4, "diff", 85 + (1 + 24) + (1 + 24 + 1 + 0)),
    (5, "diff", 85 + (1 + 24) + (1 + 24 + 3 * (1 + 3))),
]


@query(f"WITH {values('c', 'seq, kind, view_bytes', _VERSION_VIEWS)} SELECT seq::BIGINT AS seq, kind, view_bytes::BIGINT AS view_bytes FROM c")
def version_view_sizes(spark, sf_dir):
    rows = spark.createDataFrame([("k", k, t) for k, t in enumerate(_VERSIONS)], "key string, seq long, content string")
    return sessions.diffs(rows).select("seq", "kind", F.col("view_bytes").cast("long").alias("view_bytes"))


@query(f"WITH {values('c', 'seq, kind, view_bytes', _VERSION_VIEWS)}, {values('t', 'seq, text', list(enumerate(_VERSIONS)))}, s AS (SELECT t.seq, strlen(text) * 40 AS n FROM t) SELECT seq::BIGINT AS seq, n::BIGINT AS n_bytes, CASE WHEN seq IN (3) AND n > 200 THEN 105 ELSE n END::BIGINT AS sent_bytes FROM s")
def hook_outputs(spark, sf_dir):
    """Tool outputs without a line break: a changed one is larger as a diff and passes; one that is repeated becomes its reference."""
    rows = spark.createDataFrame([("k", k, "bash", t.replace("\n", " ") * 40) for k, t in enumerate(_VERSIONS)], "key string, seq long, tool string, content string")
    return tools.hook_savings(rows, 200).select("seq", "n_bytes", "sent_bytes")
