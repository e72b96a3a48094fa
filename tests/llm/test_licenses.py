import random
from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st
from plait.llm import licenses


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), max_size=25), st.lists(st.sampled_from("abcdef"), max_size=25))
def test_bit_parallel_common_length(a, b):
    assert licenses.common_length(a, b) == lcs(a, b)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), unique=True, max_size=20))
def test_increasing_subsequence(values):
    got = licenses.increasing(values)
    picked = [values[k] for k in got]
    assert picked == sorted(picked) and got == sorted(got)
    best = [1] * len(values)
    for k in range(len(values)):
        best[k] = 1 + max((best[j] for j in range(k) if values[j] < values[k]), default=0)
    assert len(got) == max(best, default=0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdefghij"), max_size=30), st.lists(st.sampled_from("abcdefghij"), max_size=30))
def test_alignment_is_a_common_subsequence(a, b):
    n = licenses.align(a, b)
    assert n <= lcs(a, b)
    assert licenses.align(b, b) == len(b)


def test_alignment_finds_edited_templates():
    t = licenses.words(licenses.TEMPLATES["BSD-3-Clause-text"])
    rng = random.Random(1)
    for _ in range(20):
        text = [w for w in t if rng.random() > 0.1]
        at = rng.randrange(len(text))
        text[at:at] = ["inserted", "words"]
        assert licenses.align(text, t) >= 0.95 * lcs(text, t)
        assert SequenceMatcher(None, text, t, autojunk=False).ratio() > 0.7


def test_scan_and_cases(spark):
    filler = "prose of the day and this is a word with more of it " * 40
    mit = licenses.TEMPLATES["MIT-text"]
    cases = {
        1: (f"{filler}\nReleased under the MIT License.\n{filler}", "MIT"),
        2: (f"{filler}\nThis work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        3: ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        4: ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        5: (f"{filler} {mit} {filler} {mit}", "MIT-text"),
        6: (mit.replace("without restriction", "with no restriction at all").upper(), "MIT-text"),
        7: (filler, None),
        8: (None, None),
        9: ("", None),
        10: (filler * 200, None),
        11: ("the license is under discussion and was released", None),
    }
    rows = [(k, t, "x") for k, (t, _) in cases.items()] + [(1, cases[1][0], "x"), (None, cases[3][0], "x")]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, coverage string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.license == cases[r.doc_id or 3][1], r
    first = next(r for r in got if r.doc_id == 1).found[0]
    words = licenses.words(cases[1][0])
    assert " ".join(words[first.first_word : first.end_word]).startswith("released under the mit license")


def test_the_upper_bound_loses_nothing():
    scanner = licenses.Scanner({"t": "one two three four five six seven eight nine ten"}, 0.8)
    rng = random.Random(3)
    template = scanner.templates[0][1]
    for _ in range(300):
        ws = [w for w in template if rng.random() > 0.15]
        ws = [x for w in ws for x in ([w, "noise"] if rng.random() < 0.2 else [w])]
        found = scanner.scan(" ".join(ws))
        assert bool(found) == (licenses.align(ws, template) >= 8)


WORDS = "the of and permission copy software notice any to granted use merge rights without limitation".split()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(WORDS), min_size=4, max_size=16), st.integers(0, 4), st.integers(0, 60), st.integers(0, 40), st.floats(0, 0.3), st.integers(0, 10**6))
def test_scan_is_the_alignment_of_the_whole_text(template, between, inserted, preface, dropped, seed):
    """Interleaved, inserted and far-apart templates: found just when the whole text's alignment covers 0.8."""
    rng = random.Random(seed)
    noise = lambda n: rng.choices([*WORDS, "mill", "stone", "wheel", "river"], k=n)
    text = noise(preface)
    cut = rng.randrange(len(template))
    for k, w in enumerate(template):
        text += noise(inserted) if k == cut else []
        text += [w] if rng.random() >= dropped else []
        text += noise(rng.randint(0, between))
    scanner = licenses.Scanner({"t": " ".join(template)}, 0.8)
    for tail in ([], noise(5)):
        found = scanner.scan(" ".join(text + tail))
        n = licenses.align(text + tail, template)
        assert [(x[0], x[1]) for x in found] == ([("t", n / len(template))] if n >= 0.8 * len(template) else [])


def test_interleaved_inserted_and_far_apart_licenses_are_found():
    scanner = licenses.Scanner({"MIT-text": licenses.TEMPLATES["MIT-text"]}, 0.8)
    t = scanner.templates[0][1]
    for foreign in (2, 3, 50):
        text = [x for w in t for x in (w, *["mill", "stone", "wheel"] * 20)[: foreign + 1]]
        ((_, coverage, first, end, _),) = scanner.scan(" ".join(text))
        assert coverage == 1.0 and first == 0 and end == (len(t) - 1) * (foreign + 1) + 1
    for inserted in (82, 400, 20_000):
        for preface in (0, 40, 60, 80):
            text = ["mill"] * preface + t[:43] + ["river"] * inserted + t[43:]
            ((_, coverage, first, end, density),) = scanner.scan(" ".join(text))
            assert coverage == 1.0 and (first, end) == (preface, preface + len(t) + inserted) and density == len(t) / (len(t) + inserted)
    dense = licenses.Scanner({"MIT-text": licenses.TEMPLATES["MIT-text"]}, 0.8, 0.3)
    assert not dense.scan(" ".join(t[:43] + ["river"] * 400 + t[43:])) and dense.scan(" ".join(t))


def test_an_edited_license_is_found_at_every_offset_of_a_long_text():
    scanner = licenses.Scanner({"MIT-text": licenses.TEMPLATES["MIT-text"]}, 0.8)
    t = scanner.templates[0][1]
    edited = [*t[:40], *(["whereas", "the", "clause"] * 9), *t[40:70], *(["the", "more"] * 20), *t[70:]]
    prose = ["the", "old", "mill", "of", "stones", "and", "wheels"] * 120
    for at in range(0, 400, 7):
        text = prose[:at] + edited + prose[at:]
        ((_, coverage, first, end, _),) = scanner.scan(" ".join(text))
        # Patience alignment takes unique words first, so it may miss a few of the common ones.
        assert 0.95 <= coverage <= licenses.common_length(text, t) / len(t) == 1.0
        assert coverage < 1.0 or at <= first < end <= at + len(edited)


def test_every_template_is_found_in_its_own_text():
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8)
    for name, t in licenses.TEMPLATES.items():
        best = min(scanner.scan("Preface of the work.\n" + t), key=lambda x: (-x[1] * x[4], -len(licenses.words(licenses.TEMPLATES[x[0]])), x[0]))
        assert best[0] == name and best[1] == 1.0


def test_templates_are_read_from_a_folder(spark, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("You may use this work as you like, provided that you sing.")
    (tmp_path / "other.md").write_text("no template")
    assert licenses.templates_from(spark, str(tmp_path)) == {"Own-1.0": "You may use this work as you like, provided that you sing."}


def test_empty_table(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
