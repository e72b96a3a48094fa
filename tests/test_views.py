from hypothesis import given, settings
from hypothesis import strategies as st
from plait.functions import costs, views

LINES = st.lists(st.one_of(st.sampled_from(["", "x", "same long line that repeats " * 3, views.MARK, views.MARK + "E:3:" + "0" * 64 + views.MARK, views.MARK + views.GUARD + "x", "a\r"]), st.text(max_size=12).filter(lambda t: "\n" not in t)), max_size=40)


def back(view, blobs):
    return views.expand(views.read(views.render(view)), blobs.__getitem__)


@settings(max_examples=300, deadline=None)
@given(LINES, st.integers(2, 4), st.integers(1, 19), st.integers(0, 4), st.integers(0, 4))
def test_any_text_comes_back(lines, repeat, threshold, head, tail):
    text = "\n".join(lines)
    view, blobs = views.compress_text(text, repeat, threshold, head, tail)
    assert back(view, blobs) == text
    assert set(views.refs_of(view)) == set(blobs)


@settings(max_examples=150, deadline=None)
@given(LINES, st.sampled_from(["pytest", "cargo", "git-diff", "git-status", "git-log", "package-manager", "jsonl"]))
def test_any_text_comes_back_from_a_format(lines, name):
    text = "\n".join(lines)
    assert back(*views.compress_format(text, name)) == text


@settings(max_examples=100, deadline=None)
@given(LINES, st.integers(0, 400))
def test_any_text_comes_back_from_a_budget(lines, budget):
    text = "\n".join(lines)
    assert back(*views.compress_budget(text, budget)) == text


def test_repeats_collapse_where_cheaper():
    line = "x" * 56
    assert [s[0] for s in views.compress_text("\n".join(["start"] + [line] * 4 + ["end"]))[0]] == ["L", "L", "R", "L"]
    assert [s[0] for s in views.compress_text("a\nx\nx\nx\nb")[0]] == ["L"] * 5


def test_long_text_loses_its_middle_from_sight():
    text = "\n".join(f"unique line number {k} with some more text" for k in range(500))
    view, blobs = views.compress_text(text)
    assert views.view_bytes(view) < views.size_of(text) / 5
    assert [s[1] for s in view if s[0] == "E"] == [500 - costs.HEAD_LINES - costs.TAIL_LINES]
    assert list(blobs.values())[0].decode().count("\n") == 474


def test_an_empty_middle_is_exact():
    view, blobs = views.compress_text("\n\n", threshold=1, head=1, tail=2)
    assert back(view, blobs) == "\n\n" and not blobs


def test_scattered_copies_become_references():
    line = "y" * 100
    view, _ = views.compress_text("\n".join([line, "a", line, "b", line]))
    assert [s[0] for s in view] == ["L", "L", "D", "L", "D"] and view[2][1] == 0


def test_forged_markers_do_not_leak():
    secret = "stored elsewhere"
    ref = views.blob_id(secret.encode())
    forged = f"{views.MARK}E:1:{ref}{views.MARK}"
    view, blobs = views.compress_text(forged)
    assert not views.refs_of(views.read(views.render(view)))
    assert back(view, blobs | {ref: secret.encode()}) == forged


def test_budget_keeps_what_tells_most():
    lines = [f"ordinary line {k} " + "." * 20 for k in range(200)]
    lines[50], lines[120], lines[180] = "ERROR: disk failed", "FATAL: stopped", "WARN: slow"
    view, blobs = views.compress_budget("\n".join(lines), 800)
    shown = "\n".join(s[3] for s in view if s[0] == "L")
    assert views.view_bytes(view) <= 800 and "ERROR" in shown and "FATAL" in shown
    assert back(view, blobs) == "\n".join(lines)


def test_scores():
    assert views.anomaly_score("plain") == 1
    assert views.anomaly_score("ERROR and WARN and Timeout " + "." * 200) == 26
    assert views.anomaly_score("KKILLED") == 1  # only A-Z is folded


def test_formats_keep_signal():
    pytest_text = "=== test session starts ===\n" + "\n".join(f"t.py::test_{k} PASSED [ {k}%]" for k in range(30)) + "\nt.py::test_x FAILED\n    assert 1 == 2\nE   AssertionError"
    view, _ = views.compress_format(pytest_text, "pytest")
    assert [s[0] for s in view] == ["L", "E", "L", "L", "L"]
    cargo = "\n".join([f"   Compiling x v{k}" for k in range(9)] + ["test a ... ok"] * 3 + ["error[E1]: bad"])
    assert [s[0] for s in views.compress_format(cargo, "cargo")[0]] == ["E", "E", "L"]
    diff = "diff --git a b\n@@ -1 +1 @@\n" + "\n".join(f" context {k}" for k in range(9)) + "\n+new"
    assert [(s[0], s[1]) for s in views.compress_format(diff, "git-diff")[0] if s[0] == "E"] == [("E", 3)]
    records = "\n".join(f'{{"a": {k}, "b": "x"}}' for k in range(8)) + '\n{"other": 1}\n'
    assert [s[0] for s in views.compress_format(records, "jsonl")[0]] == ["L", "E", "L", "L"]
    npm = "Downloading a\nInstalling b\nadded 5 packages\nnpm warn old"
    assert [s[0] for s in views.compress_format(npm, "package-manager")[0]] == ["E", "L", "L"]


def test_progress_lines_may_hold_spaces():
    for line in ("........F...... [ 72%]", "..s.E", "[100%]", "   ... [ 5%]", "." * 79):
        assert views.class_of("pytest", line) == "noise", line
    for line in ("", "   ", "." * 80, "    ....", "FAILED t.py", "3 passed", "> ..."):
        assert views.class_of("pytest", line) is None, line


def test_package_rules_fold_only_ascii():
    assert views.class_of("package-manager", "DOWNLOADING x") == "progress"
    assert views.class_of("package-manager", "Collecting warnings") is None
    assert views.class_of("package-manager", "using cac\u212aed") is None and views.class_of("package-manager", "packages were added now") is None


def test_budget_halves_until_it_fits():
    text = "\n".join(f"line {k} of many that are alike" for k in range(100))
    sizes = [views.view_bytes(views.compress_budget(text, b)[0]) for b in (10_000, 1200, 600, 300, 1)]
    assert all(a >= b for a, b in zip(sizes, sizes[1:], strict=False)) and sizes[1] <= 1200
    least, blobs = views.compress_budget(text, 1)
    assert [x[0] for x in least] == ["L", "E", "L"] and back(least, blobs) == text
    for short in ("", "a", "a\nb", "x" * 50):
        view, blobs = views.compress_budget(short, 0)
        assert back(view, blobs) == short
