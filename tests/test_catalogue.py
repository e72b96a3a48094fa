"""Every query with SQL against DuckDB on the smallest tables, and the others for their shape."""

import datetime
import os

import __spark_entry__
import duckdb
import pytest
from plait.plans import catalogue

SF = os.environ.get("PLAIT_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime) and v.tzinfo:
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    r = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    want = [tuple(plain(x[names.index(c)]) for c in columns) for x in r.fetchall()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_token_estimate_on_odd_texts(spark, tmp_path):
    texts = ["Ea " * 2000, "a" * 4096, "a" * 4097, "é" + "Dede " * 900, "\x0b2024-01-01", "\x0b1234567890", "\f 2024-01-01", "x\n\r2024-", "\x0b{", None, "", "ab" * 2047 + "aé INFO: cut inside a character"]
    spark.createDataFrame([(k, t, str(k)) for k, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in con.execute(catalogue.ORACLE_SQL["token_estimate"]).fetchall()}
    got = {r.lang: (r["class"], r.n_docs, r.n_bytes, r.tokens) for r in __spark_entry__.queries()["token_estimate"](spark, str(tmp_path)).collect()}
    assert got == want and {want[str(k)][0] for k in (0, 2, 3)} == {"prose"} and want["1"][0] == "hex"


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"lang", "class", "n_docs", "n_bytes", "tokens"}


def test_sql_names_are_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_llm_subpackage():
    root = os.path.dirname(__spark_entry__.__file__)
    for folder, _, names in os.walk(os.path.join(root, "plait")):
        if os.path.basename(folder) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n)) as f:
                    assert "plait.llm" not in (text := f.read()) and "from .llm" not in text and "from ..llm" not in text


def test_the_entry_works_without_the_llm_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(__spark_entry__.__file__)
    shutil.copytree(os.path.join(root, "plait"), tmp_path / "plait", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(__spark_entry__.__file__, tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(set(e.queries())), any(k.startswith('op') for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert out.stdout.split() == ["True", "False"], out.stderr
