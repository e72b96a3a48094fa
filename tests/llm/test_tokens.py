import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plait.llm import tokens
from plait.llm.queries import VOCABULARY

S = tokens.START


def greedy(pieces, word):
    """Longest match by trying every length."""
    known, symbols, n = set(pieces), (S, *word), 0
    at = 0
    while at < len(symbols):
        size = next((k for k in range(len(symbols) - at, 0, -1) if symbols[at : at + k] in known), 0)
        if not size:
            return 1
        at += size
        n += 1
    return n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abc", min_size=1, max_size=5), max_size=12), st.lists(st.text(alphabet="abc", min_size=1, max_size=4), max_size=8), st.text(alphabet="abcd", max_size=14))
def test_counts_match_greedy_on_any_vocabulary(starts, others, word):
    pieces = {(S,)} | {(S, *p.encode()) for p in starts} | {tuple(p.encode()) for p in others} | {(b,) for b in b"abc"}
    assert tokens.Automaton(sorted(pieces)).count(word.encode()) == greedy(pieces, word.encode())


def test_unknown_words_are_one_token():
    a = tokens.Automaton([(S,), (97,), (S, 97, 97, 97)])
    assert a.count(b"aab") == greedy([(S,), (97,), (S, 97, 97, 97)], b"aab") == 1
    assert tokens.Automaton([(97,)]).count(b"a") == 1


def test_the_public_vocabulary_on_text():
    pieces = tokens.load_pieces(VOCABULARY)
    a = tokens.Automaton(pieces)
    known = frozenset(pieces)
    rng = random.Random(1)
    for w in ["the", "international", "Straße", "日本語", "été", "x" * 300, "aé" * 50, "\x00", "▁"] + ["".join(rng.choices("etaoin shrdlu".replace(" ", ""), k=rng.randint(1, 20))) for _ in range(200)]:
        assert a.count(w.encode()) == greedy(known, w.encode())


def test_table_and_cases(spark):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (2, None, "x"), (3, " \n", "x"), (None, "no id", "x"), (4, "word " * 50_000, "x")]
    got = tokens.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_words string"), VOCABULARY, memory=2).collect()
    known = frozenset(tokens.load_pieces(VOCABULARY))
    want = [(d, len((t or "").encode()), len((t or "").split()), sum(greedy(known, w.encode()) for w in set((t or "").split()) for _ in range((t or "").split().count(w)))) for d, t, _ in rows]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_empty_table(spark):
    assert tokens.token_counts(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).count() == 0


def test_a_missing_vocabulary_is_an_error(spark):
    with pytest.raises((OSError, RuntimeError)):
        tokens.token_counts(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "/nowhere.model")
