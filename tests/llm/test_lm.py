import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from plait.llm import lm
from plait.llm.queries import VOCABULARY


def all_ways(pieces, text):
    """Summed weight of all segmentations, by listing them."""
    if not text:
        return 1.0
    return sum(w * all_ways(pieces, text[len(p) :]) for p, w in pieces.items() if text.startswith(p))


def small():
    return {lm.MARK: 0.1, lm.MARK + "a": 0.2, lm.MARK + "ab": 0.1, "a": 0.2, "b": 0.1, "ba": 0.1, "aba": 0.05, "bb": 0.15}


def test_forward_adds_up_all_segmentations():
    pieces = small()
    lattice = lm.Lattice(list(pieces), [math.log(w) for w in pieces.values()])
    for word in ("a", "b", "ab", "abab", "babba", "aabbaabb"):
        assert math.isclose(lattice.marginal(word.encode()), math.log(all_ways(pieces, lm.MARK + word)), rel_tol=1e-9)
    assert lattice.marginal(b"xyz") == lm.NEVER


def test_expected_counts_match_listing():
    pieces = small()
    names = list(pieces)
    lattice = lm.Lattice(names, [math.log(w) for w in pieces.values()])
    into = [0.0] * len(names)
    lattice.expect(b"abba", 3, into)

    def ways(text, used, weight):
        if not text:
            yield used, weight
        for p, w in pieces.items():
            if text.startswith(p):
                yield from ways(text[len(p) :], [*used, p], weight * w)

    total, want = 0.0, Counter()
    for used, w in ways(lm.MARK + "abba", [], 1.0):
        total += w
        for p in used:
            want[p] += w
    for p, e in zip(names, into, strict=True):
        assert math.isclose(e, 3 * want[p] / total, abs_tol=1e-9)


def test_long_words_are_expected_by_logarithms():
    pieces = small()
    names = list(pieces)
    lattice = lm.Lattice(names, [math.log(w) for w in pieces.values()])
    for word in (b"ab" * 20, b"ab" * 2000):
        plain, logs = [0.0] * len(names), [0.0] * len(names)
        lattice.expect(word, 2, plain)
        text = lm.spelled(word)
        lattice._expect_logs(text, [(end + 1, k) for end, k in lattice.auto.iter(text)], 2, logs)
        assert np.allclose(plain, logs, rtol=1e-9)
        # Pieces cover the word.
        assert math.isclose(sum(e * len(p) for e, p in zip(plain, names, strict=True)), 2 * len(text), rel_tol=1e-9)


def test_spellings_are_a_proper_distribution():
    pieces = small()
    lattice = lm.Lattice(list(pieces), [math.log(w) for w in pieces.values()])
    layers = [""]
    mass = math.exp(lattice.marginal(b""))
    for _ in range(11):
        layers = [w + c for w in layers for c in "ab"]
        mass += sum(math.exp(lattice.marginal(w.encode())) for w in layers)
    assert 0.93 < mass <= 1 + 1e-9


def rows():
    rng = random.Random(8)
    words = {"en": [f"word{k}" for k in range(60)], "de": [f"wort{k}" for k in range(60)], None: ["Odd", "odd", "ones"]}
    out = []
    for k in range(120):
        lang = rng.choice(list(words))
        out.append((k, " ".join(rng.choices(words[lang], k=rng.randint(1, 40))), lang, "x"))
    return [*out, (200, None, "en", "x"), (201, " ", "de", "x"), (None, "word1 new", "en", "x"), out[5], (202, "never-seen-" * 200, "en", "x"), (203, "word1 " * 20_000, "en", "x")]


def held(d):
    return d is not None and crc32(str(d).encode()) % 7 == 2


@pytest.mark.parametrize("entries", [lm.HEAD_ENTRIES, 40])
def test_report_matches_brute_force(spark, monkeypatch, entries):
    monkeypatch.setattr(lm, "HEAD_ENTRIES", entries)
    data = rows()
    got = lm.score_report(spark.createDataFrame(data, "doc_id long, text string, lang string, score string"), VOCABULARY, steps=1).collect()
    assert len(got) == len(data)
    words = lambda t: (t or "").encode().lower().split()
    train = [t for d, t, *_ in data if not held(d)]
    c = Counter(w for t in train for w in words(t))
    n, v = sum(c.values()) + len(train), len(c) + 1
    # The model from its definition.
    pieces, log_p, given = lm.vocabulary_of(VOCABULARY)
    assert not given
    into, lattice = [0.0] * len(pieces), lm.Lattice(pieces, log_p)
    for w in c:
        lattice.expect(w, 1, into)
    e = np.array(into) + lm.FLOOR
    lattice = lm.Lattice(pieces, np.log(e / e.sum()).tolist())
    d = lm.discount_of(*(sum(x == k for x in c.values()) for k in (1, 2)))

    def log10_p(w):
        spelling = lattice.marginal(w)
        rest = math.log10(d * len(c) / n) + spelling / math.log(10)
        return math.log10(max(c[w] - d, 0) / n + 10**rest) if c[w] else rest

    want = {}
    for k, t, *_ in data:
        ws = Counter(words(t))
        base = sum(m * math.log10((c[w] + 1) / (n + v + 1)) for w, m in ws.items()) + math.log10((len(train) + 1) / (n + v + 1))
        want[k] = (sum(ws.values()) + 1, 1 + sum(m for w, m in ws.items() if c[w]), base, math.log10(len(train) / n) + sum(m * log10_p(w) for w, m in ws.items()))
    for r in got:
        x = want[r.doc_id]
        assert (r.held_out, r.train_tokens, r.n_tokens, r.n_known) == (held(r.doc_id), n, x[0], x[1])
        assert math.isclose(r.base_score, x[2], rel_tol=1e-9) and math.isclose(r.score, x[3], rel_tol=1e-7)


def test_counts_do_not_depend_on_what_a_task_holds(spark):
    text = " ".join(f"w{k % 7000}" for k in range(20_000))
    df = spark.createDataFrame([(False, text), (True, "w1 new"), (False, "w1 " + "x" * 200_000)], "held_out boolean, text string").coalesce(1)
    got = {bytes(r.word): (r.c, r.n) for r in lm.word_counts(df).collect()}
    c = Counter(text.encode().split()) + Counter([b"w1", b"x" * 200_000])
    assert got == {w: (c[w], c[w] + (w in (b"w1", b"new"))) for w in [*c, b"new"]}


def test_the_whole_word_is_one_more_arc():
    pieces = small()
    lattice = lm.Lattice(list(pieces), [math.log(w) for w in pieces.values()])
    for word in ("a", "abab", ""):
        want = 0.3 * all_ways(pieces, lm.MARK + word) + 0.04
        assert math.isclose(lattice.marginal(word.encode(), math.log(0.3), math.log(0.04)), math.log(want), rel_tol=1e-9)
    assert math.isclose(lattice.marginal(b"xyz", math.log(0.3), math.log(0.04)), math.log(0.04))


def test_without_training_documents(spark):
    ids = [k for k in range(60) if held(k)][:3]
    df = spark.createDataFrame([(k, "some words", "en") for k in ids], "doc_id long, text string, lang string")
    got = lm.score_report(df, VOCABULARY).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and -100 < r.score < 0 for r in got)


def test_empty_table(spark):
    assert lm.score_report(spark.createDataFrame([], "doc_id long, text string, lang string"), VOCABULARY).count() == 0
