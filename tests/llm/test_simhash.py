import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from plait.llm import simhash

SCHEMA = "doc_id long, text string, fp string"


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(fps):
    lab = list(range(len(fps)))

    def find(x):
        while lab[x] != x:
            x = lab[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                lab[max(a, b)] = min(a, b)
    return [find(x) for x in range(len(fps))]


def documents():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 200))) for _ in range(60)]
    near = []
    for t in rows[:20]:
        for _ in range(3):
            words = t.split()
            words[rng.randrange(len(words))] = "changed"
            near.append(" ".join(words))
    return [*rows, *near, rows[0], rows[0], None, "", " \t\n", "One", "one", "two words", "é ü ß", "x " * 30_000]


def test_fingerprints_match_brute_force():
    for t in documents():
        raw = None if t is None else t.encode()
        assert simhash.fingerprint(raw) == brute_fingerprint(t)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_fingerprint_of_any_text(t):
    assert simhash.fingerprint(t.encode("utf-8", "surrogatepass")) == brute_fingerprint(t)


def test_long_text_is_hashed_in_chunks(monkeypatch):
    text = " ".join(str(k) for k in range(500)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SHINGLE_CHUNK", 7)
    assert simhash.fingerprint(text) == whole


def test_pivots_discard_every_pair_of_ten_bits_or_more():
    refs = simhash.pivots()
    assert len(set(refs.tolist())) == 64
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 500, dtype=np.uint64)
    b = a.copy()
    for k in range(500):
        for bit in rng.choice(64, size=rng.integers(0, 30), replace=False):
            b[k] ^= np.uint64(1) << np.uint64(bit)
    gap = np.abs(simhash.distance_table(a, refs) - simhash.distance_table(b, refs)).max(axis=1)
    dist = np.bitwise_count(a ^ b)
    assert (gap <= dist).all()  # a link is never discarded
    assert (gap[dist >= 10] > 3).all()


def check_components(spark, fps, cell_rows):
    ids = list(range(len(fps)))
    table = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in set(fps)], "fp long")
    roots = simhash.components(simhash.links(table, 3, cell_rows))
    got = {r.node: r.root for r in roots.collect()} if roots is not None else {}
    mine = [got.get(int(np.uint64(f).view(np.int64)), int(np.uint64(f).view(np.int64))) for f in fps]
    want = brute_components(fps)
    assert {(want[i] == want[j]) == (mine[i] == mine[j]) for i in ids for j in ids[:i]} <= {True}


def test_components_match_brute_force_also_in_divided_cells(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = [centre]
    for _ in range(120):  # one dense group that grows from itself
        f = rng.choice(fps)
        for _ in range(rng.randint(1, 4)):
            f ^= 1 << rng.randrange(64)
        fps.append(f)
    fps += [rng.getrandbits(64) for _ in range(60)]
    check_components(spark, fps, cell_rows=2048)
    check_components(spark, fps, cell_rows=6)


def test_a_chain_of_links_is_one_component(spark):
    fps = [0]
    for k in range(40):
        fps.append(fps[-1] ^ (1 << k % 64) ^ (1 << (k * 7 + 3) % 64) ^ (1 << (k * 11 + 5) % 64))
    check_components(spark, list(dict.fromkeys(fps)), cell_rows=2048)


def test_near_duplicates_and_cases(spark):
    texts = documents()
    rows = [(k, t, "extra") for k, t in enumerate(texts)] + [(5, texts[5], "repeat"), (None, texts[3], "no id"), (None, "alone here now then", "no id")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    comp = brute_components(fps)
    low = {}
    for (d, _, _), c in zip(rows, comp, strict=True):
        if d is not None:
            low[c] = min(d, low.get(c, d))
    want = sorted((str(d), str(low.get(c)), f) for (d, _, _), c, f in zip(rows, comp, fps, strict=True))
    assert sorted((str(r.doc_id), str(r.component_id), r.fp % 2**64) for r in got) == want


def test_keep_one_keeps_one_of_each_group_and_all_columns(spark):
    texts = documents()
    rows = [(k, t, "extra") for k, t in enumerate(texts)] + [(0, texts[0], "repeat")]
    out = simhash.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "fp"]
    comp = brute_components([brute_fingerprint(t) for t in texts])
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(comp))


def test_keep_one_without_ids(spark):
    rows = [(None, "a b c d e f", "x"), (None, "a b c d e f", "y"), (None, "g h i j k l m", "z"), (1, "n o p q r s", "x"), (None, "n o p q r s", "y")]
    got = sorted((r.doc_id is None, r.text) for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(False, "n o p q r s"), (True, "a b c d e f"), (True, "g h i j k l m")]


def test_keep_one_tells_rows_apart_by_id_and_text(spark):
    a, b, c = "a b c d e f", "n o p q r s", " ".join(f"w{k}" for k in range(200))
    near = c + " w200"
    assert 0 < (brute_fingerprint(c) ^ brute_fingerprint(near)).bit_count() <= 3
    rows = [(3, b, "x"), (5, a, "x"), (5, b, "x"), (7, "g h i j k l", "x"), (7, "t u v w x y", "x"), (None, c, "x"), (None, near, "x")]
    got = sorted((str(r.doc_id), r.text) for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect())
    assert [x for x in got if x[0] != "None"] == [("3", b), ("5", a), ("7", "g h i j k l"), ("7", "t u v w x y")]
    assert len(got) == 5 and got[-1][1] in (c, near)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.keep_one(df).count() == 0
