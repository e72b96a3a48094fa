import math
import random
import re
from collections import Counter, defaultdict

from plait.llm import quality
from pyspark.sql import functions as F


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    hit = [False] * len(w)
    for k in range(len(w) - 7):
        if windows[tuple(w[k : k + 8])] > 1:
            hit[k : k + 8] = [True] * 8
    ls = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": len(ls) - len(set(ls)), "n_repeat_words": sum(hit), "n_lines": len(ls), "n_upper": sum(x.isupper() and len(x) == 1 for x in t), "n_stutter": sum(a == b for a, b in zip(w, w[1:], strict=False))}


def texts():
    rng = random.Random(11)
    vocabulary = ["alpha", "beta", "gamma", "delta", "tree", "house", "straße", "日本", "été", "x"]
    out = [None, "", " \n\t ", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "same " * 40, "line one\nline one\n\n \nline two\nline one", "# * $ % & | < > " * 5, " nbsp stays a word", "\x0b\x0c x", "A" * 5000, "w " * 9 + "v"]
    for _ in range(60):
        words = rng.choices(vocabulary, k=rng.randint(5, 120))
        if rng.random() < 0.5:
            at = rng.randrange(len(words))
            words += words[at : at + rng.randint(3, 20)]
        out.append("".join(w + rng.choice([" ", " ", "\n", "  ", "\t"]) for w in words))
    out.append(" ".join(str(k % 9000) for k in range(30_000)))
    return out


def test_measures_match_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "k long, text string").select("k", quality.measures(F.col("text")).alias("m"))
    got = {r.k: r.m.asDict() for r in df.collect()}
    for k, t in rows:
        assert got[k] == brute(t), (k, t and t[:80])


def verdicts(rows, min_rows):
    """Brute force of the thresholds."""
    ms = [brute(t) for _, _, _, t in rows]
    failed = [m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"] for m in ms]

    def bucket(m, k):
        num, den, *_ = quality.METRICS[k]
        return math.floor(math.log((m[num] + 1) / (m[den] + 1)) * quality.PER_E)

    groups = defaultdict(list)
    for (_, lang, source, _), m, f in zip(rows, ms, failed, strict=True):
        if not f:
            for key in ((lang, source), (lang,), ()):
                groups[key].append(m)

    def quartile(ms, k, p):
        v = sorted(bucket(m, k) for m in ms)
        return next(x for j, x in enumerate(v, 1) if j * 100 >= len(v) * p)

    out = []
    for (d, lang, source, _), m, f in zip(rows, ms, failed, strict=True):
        good = True
        if not f:
            key = next((key for key in ((lang, source), (lang,)) if len(groups[key]) >= min_rows), ())
            for k, (*_, reach, below) in quality.METRICS.items():
                lo, hi = quartile(groups[key], k, 25), quartile(groups[key], k, 75)
                good &= bucket(m, k) <= hi + reach * (hi - lo) and (not below or bucket(m, k) >= lo - reach * (hi - lo))
        out.append((d, f, not f and good))
    return out


def corpus():
    rng = random.Random(2)
    rows = []
    for k in range(300):
        lang = rng.choice(["en", "de", None])
        words = rng.choices([f"word{j}" for j in range(300)], k=rng.randint(10, 80))
        if k % 10 == 0:
            words = [w + "$$$" for w in words]
        if k % 17 == 0:
            words = [w.upper() for w in words]
        rows.append((k, lang, rng.choice(["hot", "hot", "hot", "cold", "rare" if k % 50 == 0 else "hot", None]), " ".join(words)))
    return [*rows, rows[0], (None, "en", "hot", "no id " * 3), (900, "xx", "new", None)]


def test_verdicts_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, lang string, source string, text string, metric string")
    got = sorted((str(r.doc_id), r.base_failed, r.kept) for r in quality.quality_report(df, min_rows=30).collect())
    assert got == sorted((str(a), b, c) for a, b, c in verdicts(rows, 30))
    kept = quality.quality_filter(df, min_rows=30)
    assert kept.columns == df.columns
    assert kept.count() == sum(c for _, _, c in verdicts(rows, 30))


def test_the_groups_spread_sets_the_fence(spark):
    """The same document is kept in a group of uneven symbol ratios and rejected in an even one."""
    rng = random.Random(4)
    vocabulary = [f"w{j}" for j in range(400)]
    rows = []
    for k in range(400):
        words = rng.sample(vocabulary, 60)
        marks = 6 if k % 2 else rng.choice([0, 1, 3, 12, 40, 60])
        words = [w + "$" * (j < marks) for j, w in enumerate(words)]
        rows.append((k, "en", "even" if k % 2 else "uneven", " ".join(words)))
    probe = " ".join(w + "$" * (j < 45) for j, w in enumerate(rng.sample(vocabulary, 60)))
    rows += [(900, "en", "even", probe), (901, "en", "uneven", probe)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    kept = {r.doc_id for r in quality.quality_report(df, min_rows=30).collect() if r.kept}
    assert 900 not in kept and 901 in kept


def test_columns_of_any_name_come_back(spark):
    rows = [(k, "en", "s", " ".join(f"w{j}" for j in range(30)), 1, None, "z") for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string, `a.b` int, `n words` int, bucket string")
    out = quality.quality_filter(df)
    assert out.schema.names == df.schema.names and out.count() == 5


def test_sketches_merge(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, lang string, source string, text string").withColumn("m", quality.measures(F.col("text")))
    whole = quality.sketches(df, "m")
    halves = quality.sketches(df.where("doc_id % 2 = 0 or doc_id is null"), "m").unionByName(quality.sketches(df.where("doc_id % 2 = 1"), "m"))
    a = quality._quartiles(whole, ["lang", "source"]).collect()
    b = quality._quartiles(halves, ["lang", "source"]).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, lang string, source string, text string")
    assert quality.quality_report(df).count() == 0
    assert quality.quality_filter(df).count() == 0


def test_the_plan_is_native(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, lang string, source string, text string")
    plan = quality.quality_report(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
