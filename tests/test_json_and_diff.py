import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plait.functions import costs, jsontree, linediff

KEYS = st.one_of(st.sampled_from(["~t", "~i", "~r", "~x", "~~t", "k", "r", "d", "v"]), st.text(alphabet="abc~", max_size=3))
LEAVES = st.one_of(st.none(), st.booleans(), st.integers(-(2**31), 2**31), st.text(alphabet="ab 0", max_size=12), st.floats(allow_nan=False, allow_infinity=False))
TREES = st.recursive(LEAVES, lambda x: st.one_of(st.lists(x, max_size=5), st.dictionaries(KEYS, x, max_size=4)), max_leaves=40)


@settings(max_examples=400, deadline=None)
@given(TREES)
def test_any_tree_comes_back(tree):
    text = json.dumps(tree)
    assert jsontree.decompress(jsontree.compress(text)) == jsontree.canonical(tree)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.fixed_dictionaries({"a": LEAVES, "~b": TREES}), min_size=2, max_size=8))
def test_any_table_comes_back(rows):
    assert jsontree.decompress(jsontree.compress(json.dumps(rows))) == jsontree.canonical(rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(TREES, min_size=1, max_size=5))
def test_a_sequence_through_one_store_comes_back(trees):
    known, blobs = set(), {}
    for tree in trees:
        new = {}
        stored = jsontree.store_subtrees(jsontree.escape(tree), known, new)
        blobs |= new
        assert all(r in blobs for r in jsontree.stored_refs(stored))
        assert jsontree.canonical(jsontree.unescape(jsontree.resolve(stored, blobs.__getitem__))) == jsontree.canonical(tree)


def test_tables_dictionaries_and_interning():
    rows = [{"id": k, "status": "active", "region": "eu-west", "role": "reader"} for k in range(8)]
    t = jsontree.columnarize(rows)[jsontree.TABLE]
    assert t["k"] == ["id", "region", "role", "status"] and t["d"][0] is None and t["d"][1] == ["eu-west"]
    assert jsontree.TABLE in jsontree.columnarize([{"a": 1}, {"a": 2}])
    assert jsontree.columnarize([{"a": 1}, 2]) == [{"a": 1}, 2] and jsontree.columnarize([{"a": 1}]) == [{"a": 1}]
    author = {"name": "a name that is long", "mail": "someone@example.com", "id": 12345}
    doc = {"a": author, "b": {"x": author}, "c": [author]}
    assert jsontree.INTERNED in jsontree.intern(doc)
    assert jsontree.size_of(jsontree.intern(doc)) < jsontree.size_of(doc)


def test_repeats_converge():
    page = [{"n": k, "text": f"row {k} of a page with some words in it", "tags": ["x", "y", str(k)]} for k in range(30)]
    known, blobs, sizes = set(), {}, []
    for _ in range(5):
        stored = jsontree.store_subtrees(page, known, blobs)
        sizes.append(jsontree.size_of(stored))
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0] / 3


def test_numbers_keep_their_kind_and_nan_is_refused():
    assert jsontree.decompress(jsontree.compress("[1.0, 1, 12345678901234567890]")) == "[1.0,1,12345678901234567890]"
    for bad in ("NaN", "[Infinity]", "{", ""):
        with pytest.raises(ValueError):
            jsontree.parse(bad)


LINES = st.lists(st.sampled_from(["a", "b", "c", "", "long line"]), max_size=14)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(LINES, LINES)
def test_diffs_apply_and_are_shortest(old, new):
    ops = linediff.diff(old, new)
    assert linediff.apply(old, ops) == new
    assert sum(n for op, n, _ in ops if op == "S") == lcs(old, new)
    assert all(a[0] != b[0] for a, b in zip(ops, ops[1:], strict=False))


def test_one_edit_in_a_long_file():
    old = [f"line {k} of the file" for k in range(200)]
    new = [*old[:80], "edited", *old[81:]]
    ops = linediff.diff(old, new)
    assert [(o, n) for o, n, _ in ops] == [("S", 80), ("X", 1), ("I", 1), ("S", 119)]
    assert linediff.diff_bytes(ops) < 300


def test_too_large_pairs():
    assert linediff.too_large([""] * 4000, [""] * 4000) and not linediff.too_large([""] * 3000, [""] * 3000)
    assert costs.DIFF_CELLS == 16_000_000
