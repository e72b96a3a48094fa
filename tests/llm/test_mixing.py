import math
import random
from collections import Counter

import numpy as np
from plait.llm import hashing, mixing


def test_raking_meets_reachable_marginals():
    rng = np.random.default_rng(1)
    tokens = rng.integers(1000, 2000, (4, 3, 2)).astype(float)
    targets = [np.array([0.25, 0.3, 0.25, 0.2]), np.array([0.5, 0.3, 0.2]), np.array([0.4, 0.6])]
    p = mixing.rake(tokens, targets, 0.3)
    assert ((p > 0) & (p < 1)).all()
    for axis, t in enumerate(targets):
        got = (p * tokens).sum(axis=tuple(k for k in range(3) if k != axis))
        assert np.allclose(got / got.sum(), t, atol=1e-6)
        assert np.isclose(got.sum(), 0.3 * tokens.sum(), rtol=1e-6)


def test_raking_keeps_odds_ratios():
    tokens = np.arange(1.0, 9.0).reshape(2, 2, 2) * 1000
    p = mixing.rake(tokens, [np.array([0.5, 0.5])] * 3, 0.2)
    w = p  # factors of the three marginals only
    assert np.allclose(w[0, 0, 0] * w[1, 1, 0], w[0, 1, 0] * w[1, 0, 0])
    assert np.allclose(w[0, 0, 0] * w[1, 0, 1], w[0, 0, 1] * w[1, 0, 0])


def test_probabilities_stop_at_one_and_the_rest_is_fitted():
    tokens = np.array([[[100.0]], [[10_000.0]]])
    p = mixing.rake(tokens, [np.array([0.5, 0.5]), np.array([1.0]), np.array([1.0])], 0.5)
    assert p[0, 0, 0] == 1.0 and 0 < p[1, 0, 0] < 1


def test_absent_categories_give_their_share_to_the_others():
    tokens = np.zeros((3, 1, 1))
    tokens[0], tokens[1] = 1000, 3000
    p = mixing.rake(tokens, [np.array([0.25, 0.25, 0.5]), np.array([1.0]), np.array([1.0])], 0.2)
    got = (p * tokens)[:, 0, 0]
    assert np.isclose(got[0], got[1]) and got[2] == 0
    assert not mixing.rake(np.zeros((1, 1, 1)), [np.array([1.0])] * 3, 0.5).any()


def brute_topics(rows, n_topics=mixing.N_TOPICS, rounds=mixing.ROUNDS):
    """Topics from their definition, one document at a time."""
    hasher, size = hashing.Hasher(), mixing.DIMENSIONS
    vectors = []
    for _, text, *_ in rows:
        v = np.zeros(size)
        for w, n in Counter((text or "").encode().lower().split()).items():
            if len(w) >= mixing.LEAST_BYTES:
                h = int(hasher.words(w, np.array([len(w)]))[2][0])
                v[h % size] += math.log1p(n) * (-1 if h >> 63 else 1)
        vectors.append(np.rint(v / np.linalg.norm(v) * mixing.UNIT) if v.any() else None)
    named = {x[2] for x in rows} - {None}
    langs = [x[2] if x[2] in named else "other" for x in rows]
    mean = {z: np.mean([v for v, y in zip(vectors, langs, strict=True) if y == z and v is not None] or [np.zeros(size)], axis=0) for z in set(langs)}
    residual = []
    for v, z in zip(vectors, langs, strict=True):
        r = None if v is None else v - mean[z]
        residual.append(r if r is None or not r.any() else np.rint(r * mixing.FINE / np.linalg.norm(r)))
    directions = np.random.default_rng(mixing.SEED).standard_normal((n_topics, size))
    pick = lambda r: int(np.argmax(directions @ r))
    for _ in range(rounds):
        at = [None if r is None else pick(r) for r in residual]
        for k in range(n_topics):
            s = sum((r for r, x in zip(residual, at, strict=True) if x == k), np.zeros(size))
            if s.any():
                directions[k] = s / np.linalg.norm(s)
    return ["none" if r is None else f"t{pick(r)}" for r in residual]


def tempered(values, tokens):
    sums = Counter()
    for v, n in zip(values, tokens, strict=True):
        sums[v or "other"] += n
    power = {k: n**0.5 for k, n in sums.items() if n}
    return {k: v / sum(power.values()) for k, v in power.items()}


def brute_probabilities(rows, topics, budget=mixing.BUDGET):
    """Raking over a dictionary of cells, one marginal after the other."""
    tokens = [len((t or "").split()) for _, t, *_ in rows]
    keys = [(s or "other", z or "other", t) for (_, _, z, s, *_), t in zip(rows, topics, strict=True)]
    cells = Counter()
    for k, n in zip(keys, tokens, strict=True):
        cells[k] += n
    total = sum(cells.values())
    none = sum(n for k, n in cells.items() if k[2] == "none") / total
    goals = [tempered([r[3] for r in rows], tokens), tempered([r[2] for r in rows], tokens), {f"t{k}": (1 - none) / 8 for k in range(8)} | {"none": none}]
    for axis, goal in enumerate(goals):
        there = {k[axis] for k, n in cells.items() if n}
        share = sum(goal.get(x, 0) for x in there)
        goals[axis] = {x: goal.get(x, 0) / share * total * budget for x in there}
    weight = {k: budget for k, n in cells.items() if n}
    for _ in range(3000):
        for axis, goal in enumerate(goals):
            held = Counter()
            for k, w in weight.items():
                held[k[axis]] += cells[k] * min(w, 1)
            weight = {k: min(w * goal[k[axis]] / held[k[axis]], 1e9) if held[k[axis]] else w for k, w in weight.items()}
    return [min(1.0, weight.get(k, budget)) for k in keys]


THEMES = [[f"{a}{b}" for b in ("ation", "istics", "ology", "graphy", "metry", "nomics")] for a in ("carb", "stell", "bank", "harv", "opera", "circuit", "river", "fossil")]


def rows():
    rng = random.Random(5)
    out = []
    for k in range(600):
        words = rng.choices(THEMES[k % 8], k=5 + k % 20) + rng.choices(["common", "words", "in", "every", "text"], k=4)
        out.append((k, " ".join(words), ["en", "de", "fr", "es", None][k % 5], "hot" if k % 3 else f"site{k % 7}", "x"))
    return [*out, (None, "no id carbation", "en", "hot", "x"), (5000, None, "en", None, "x"), (5001, "", "xx", "unknown", "x"), (5002, "a b c", "en", "hot", "x"), out[3]]


SCHEMA = "doc_id long, text string, lang string, source string, `tokens.x` string"


def test_topics_and_probabilities_match_brute_force(spark):
    data = rows()
    got = mixing.mix_report(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    topics = brute_topics(data)
    want = sorted((str(d), len((t or "").split()), topic, round(p, 6)) for (d, t, *_), topic, p in zip(data, topics, brute_probabilities(data, topics), strict=True))
    assert sorted((str(r.doc_id), r.n_tokens, r.topic, round(r.probability, 6)) for r in got) == want


def test_topics_are_the_themes(spark):
    data = rows()[:600]
    by = {r.doc_id: r.topic for r in mixing.mix_report(spark.createDataFrame(data, SCHEMA)).collect()}
    # Documents of one theme share a topic, whatever their language.
    main = [Counter(by[k] for k in range(theme, 600, 8)).most_common(1)[0] for theme in range(8)]
    assert sum(n for _, n in main) >= 0.9 * 600 and len({t for t, _ in main}) >= 5


def test_report_and_sample(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = mixing.mix_report(df).collect()
    assert all(0 <= r.probability <= 1 for r in got)
    expected = sum(r.probability * r.n_tokens for r in got)
    kept = sum(r.n_tokens for r in got if r.kept)
    assert abs(kept - expected) < 0.15 * expected
    out = mixing.mix(df)
    assert out.columns == df.columns
    assert out.count() == sum(r.kept for r in got)
    assert len({r.kept for r in got if r.doc_id == 3}) == 1


def test_given_targets(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = mixing.mix_report(df, sources={"hot": 0.25, "other": 0.75}, langs={"en": 0.5, "de": 0.3, "other": 0.2}, budget=0.1).collect()
    weight = Counter()
    for r in got:
        weight[r.source == "hot"] += r.probability * r.n_tokens
        weight[r.lang] += r.probability * r.n_tokens
    total = weight[True] + weight[False]
    assert abs(weight[True] / total - 0.25) < 0.02 and abs(weight["en"] / total - 0.5) < 0.02 and abs(weight["de"] / total - 0.3) < 0.02


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(df).count() == 0 and mixing.mix_report(df).count() == 0
