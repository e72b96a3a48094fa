import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from plait.llm import langid

WORDS = {
    "en": "the of and house tree with water they have been there would light".split(),
    "de": "der die und haus baum mit wasser sie haben gewesen würde licht über".split(),
    "fr": "le la et maison arbre avec eau ils ont été serait lumière où".split(),
}


def corpus():
    rng = random.Random(4)
    out = []
    for k in range(240):
        lang = ["en", "de", "fr"][k % 3]
        out.append((k, " ".join(rng.choices(WORDS[lang], k=rng.randint(5, 120))), lang, "x"))
    return out


def test_held_out_accuracy_and_cases(spark):
    rows = corpus()
    odd = [(1000, None, "en", "x"), (1001, "", "de", "x"), (1002, "123 !? 456", "fr", "x"), (1003, "日本語", None, "x"), (None, "the house and the tree", "en", "x"), (1004, "the tree and water " * 9000, " ", "x"), rows[0]]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, langs string")
    got = langid.language_report(df).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    held = [k for k, *_ in rows if crc32(str(k).encode()) % 4 == 2]
    assert {r.doc_id for r in got if r.held_out and r.doc_id < 240} == set(held)
    truth = {k: lang for k, _, lang, _ in rows}
    assert sum(by[k].lang_pred == truth[k] for k in held) >= 0.98 * len(held)
    assert [by[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3
    assert by[1003].lang_pred in WORDS and by[1004].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got)


def test_mixtures_are_found(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, x string")
    model = langid.fit(df.select("lang", "text"))
    rng = random.Random(9)
    text = " ".join(rng.choices(WORDS["en"], k=400)) + " " + " ".join(rng.choices(WORDS["de"], k=200))
    rows = langid.detect(spark.createDataFrame([(1, text), (2, " ".join(rng.choices(WORDS["fr"], k=300)))], "doc_id long, text string"), model).collect()
    assert rows[0].langs == ["en", "de"] and abs(rows[0].shares[0] - 2 / 3) < 0.06
    assert rows[1].langs == ["fr"] and rows[1].shares == [1.0]


def test_em_matches_a_plain_version():
    rng = np.random.default_rng(2)
    like = rng.random((40, 3)) + 1e-3
    start = np.array([0, 25])
    weight, found, _ = langid._maximise(like, start, np.full((2, 3), 1 / 3), 50)
    for d, (a, b) in enumerate(((0, 25), (25, 40))):
        w = np.full(3, 1 / 3)
        for _ in range(50):
            r = w * like[a:b]
            w = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
        assert np.allclose(w, weight[d])
        assert np.isclose(np.log((w * like[a:b]).sum(axis=1)).sum(), found[d])


def test_batches_do_not_matter(monkeypatch, spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, x string")
    model = langid.fit(df.select("lang", "text"))
    units = [langid.buckets_of(t) for _, t, _, _ in corpus()[:40]]
    whole = langid.infer(model, units)
    each = np.vstack([langid.infer(model, [u]) for u in units])
    assert np.allclose(whole, each)


def brute(rows):
    """lang_pred, score and shares of every document, by plain loops over the definition."""
    buckets = lambda t: langid.buckets_of(t).tolist()
    letters = lambda t: t is not None and any(c.isalpha() for c in t)
    counts = {}
    for d, t, lang, *_ in rows:
        if d is not None and crc32(str(d).encode()) % 4 != 2 and lang and lang.strip() and letters(t):
            counts.setdefault(lang, Counter()).update(buckets(t))
    langs = sorted(counts)
    total = {z: sum(counts[z].values()) + langid.BUCKETS for z in langs}
    out = []
    for _, t, *_ in rows:
        if not letters(t) or not langs:
            out.append(("und", 0.0, {}))
            continue
        b = buckets(t)
        units = [[sum(math.log((counts[z][x] + 1) / total[z]) for x in b[k : k + langid.UNIT]) for z in langs] for k in range(0, len(b), langid.UNIT)]
        lift = [max(u) for u in units]
        like = [[math.exp(max(x - m, -600)) for x in u] for u, m in zip(units, lift, strict=True)]
        sums = [sum(u[z] for u in units) for z in range(len(langs))]
        lead = sums.index(max(sums))
        share = {lead: 1.0}
        best = sums[lead] - sum(lift)
        while True:
            mixed = [max(sum(share[z] * u[z] for z in share), 1e-300) for u in like]
            gain = {z: sum(u[z] / m for u, m in zip(like, mixed, strict=True)) - len(units) for z in range(len(langs)) if z not in share}
            if not gain or max(gain.values()) <= 0:
                break
            add = max(gain, key=lambda z: (gain[z], -z))
            trial = {z: 1 / (len(share) + 1) for z in [*share, add]}
            for _ in range(langid.STEPS):
                parts = []
                for u in like:
                    w = {z: trial[z] * u[z] for z in trial}
                    parts.append({z: w[z] / sum(w.values()) for z in w})
                trial = {z: sum(x[z] for x in parts) / len(parts) for z in trial}
            found = sum(math.log(sum(trial[z] * u[z] for z in trial)) for u in like)
            if found - best <= langid.PENALTY * math.log1p(len(units)):
                break
            share, best = trial, found
        top = min(share, key=lambda z: (-share[z], z))
        out.append((langs[top], share[top], {langs[z]: w for z, w in share.items()}))
    return out


def test_the_query_matches_brute_force(spark):
    rng = random.Random(12)
    rows = corpus()[:120] + [(900, None, "en", "x"), (901, "12 34", "de", "x"), (None, "die frau und das haus", "de", "x"), (902, "x", " ", "x")]
    for k in range(30):
        pair = rng.sample(list(WORDS), 2)
        rows.append((1000 + k, " ".join(" ".join(rng.choices(WORDS[z], k=rng.randint(20, 120))) for z in pair), None, "x"))
    got = langid.language_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, x string")).collect()
    want = {d: x for (d, *_), x in zip(rows, brute(rows), strict=True)}
    assert sum(len(x[2]) > 1 for x in want.values()) > 15
    for r in got:
        pred, score, shares = want[r.doc_id]
        assert (r.lang_pred, set(r.langs)) == (pred, set(shares)) and abs(r.score - score) < 1e-3
        assert all(abs(shares[z] - w) < 1e-3 for z, w in zip(r.langs, r.shares, strict=True))


def test_long_texts_have_longer_units(monkeypatch):
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.ones(langid.BUCKETS), 2)
    model = langid.Model(["a", "b"], np.log(p.T).astype(np.float32))
    t = np.r_[rng.choice(langid.BUCKETS, 14_000, p=p[1]), rng.choice(langid.BUCKETS, 6_000, p=p[0])]
    whole = langid.infer(model, [t])
    monkeypatch.setattr(langid, "ENTRIES", 256)
    assert langid.unit_of(20_000, 2) == 157 and langid.unit_of(100, 2) == langid.UNIT
    assert np.abs(whole - [[0.3, 0.7]]).max() < 0.02 and np.abs(langid.infer(model, [t]) - whole).max() < 0.03


def test_without_labels_and_without_rows(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.language_report(df).collect()] == [("und", 0.0)]
    assert langid.language_report(df.limit(0)).count() == 0


def test_too_many_languages_are_refused(spark):
    df = spark.createDataFrame([(str(k), "text") for k in range(5)], "lang string, text string")
    with pytest.raises(ValueError):
        langid.fit(df, max_languages=4)
