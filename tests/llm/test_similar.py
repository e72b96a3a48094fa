import random

import corpus_pipeline
import numpy as np
from plait.llm import similar

SCHEMA = "doc_id long, text string, lang string"


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def alike(a, b):
    return len(a & b) * 5 >= len(a | b) * 4


def brute(texts):
    """The component of each text, named by its first member."""
    sets, lab = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if lab[i] != lab[j] and alike(sets[i], sets[j]):
                old, new = max(lab[i], lab[j]), min(lab[i], lab[j])
                lab = [new if x == old else x for x in lab]
    return lab


def documents():
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(3000)]
    out = [None, "", " \n", "One", "one", "two words", "a b c d e"]
    for k in range(60):
        words = rng.choices(vocabulary, k=rng.randint(20, 300))
        out.append(" ".join(words))
        for n in (1, 2, 3, 5, 8):  # from above 0.8 to below, some only by way of others
            near = list(words)
            for _ in range(max(1, len(near) * n // 250)):
                near[rng.randrange(len(near))] = f"changed{rng.random()}"
            out.append(" ".join(near))
    chain = rng.choices(vocabulary, k=120)
    for _ in range(12):
        chain = chain[10:] + rng.choices(vocabulary, k=10)
        out.append(" ".join(chain))
    return out


def test_the_stage_matches_brute_force_jaccard(spark):
    texts = documents()
    want = set(brute(texts))
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], SCHEMA)
    out = dict(corpus_pipeline.STAGES)["simhash near-dedup"](spark, df, "")
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == want and len(want) < len(texts) - 100


def test_divided_open_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(similar, "CELL_ROWS", 2)
    texts = documents()[:150]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], SCHEMA)
    assert {r.doc_id for r in similar.keep_similar(df).collect()} == set(brute(texts))


def test_cells_match_brute_force():
    rng = random.Random(4)
    for _ in range(40):
        base = rng.sample(range(1, 200), 40)
        sets = [np.unique(np.array(rng.sample(base, rng.randint(30, 40)) + [200 + k], dtype=np.int64)) for k in range(12)]
        edges = similar.cell_edges(np.arange(12), np.arange(12), sets, 80)
        lab = list(range(12))
        for a, b in edges:
            assert alike(set(sets[a].tolist()), set(sets[b].tolist()))
            lab = [lab[a] if x == lab[b] else x for x in lab]
        assert not any(lab[i] != lab[j] and alike(set(sets[i].tolist()), set(sets[j].tolist())) for i in range(12) for j in range(i))


def test_rows_are_told_apart_by_id_and_text(spark):
    a, b, c = ("the first text has seven words here", "another text that is not like it", "one more of eight words for the nameless")
    rows = [(3, b, "x"), (5, a, "x"), (5, b, "x"), (6, a, "y"), (7, c, "x"), (7, "x " + " ".join(f"v{k}" for k in range(9)), "x"), (7, c, "x"), (None, c + " " + c, "x"), (None, c.upper() + " " + c, "y")]
    got = sorted((str(r.doc_id), r.text.lower()) for r in similar.keep_similar(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted([("3", b), ("5", a), ("7", c), ("7", rows[5][1]), ("None", c + " " + c)])


def test_empty_table(spark):
    assert similar.keep_similar(spark.createDataFrame([], SCHEMA)).count() == 0


def sets_at(rng, first, second, common):
    u = rng.integers(0, 1 << 63, first + second - common, dtype=np.uint64)
    return np.unique(u[:first]), np.unique(u[first - common :])


def test_simhash_fingerprints_and_pivot_distances_match_brute_force():
    sets = [np.empty(0, dtype=np.uint64), *sets_at(np.random.default_rng(2), 9, 700, 4)]
    vote = np.array([similar.votes(s) for s in sets])
    assert (vote[0] == 0).all()
    again = sum(similar.votes(sets[2][k : k + 1]) for k in range(len(sets[2])))  # one hash votes 1 or -1 for each bit
    assert (again == vote[2]).all() and set(similar.votes(sets[2][:1]).ravel().tolist()) == {-1, 1}
    for v, fp in zip(vote, similar.fingerprints(vote), strict=True):
        assert [int(x) >> k & 1 for x in fp for k in range(64)] == [int(x > 0) for x in v[0]]
    lead = similar.pivot_leads(vote)
    for k, p, r, c in ((1, 0, 0, 0), (1, 3, 12, 511), (2, 1, 5, 37), (2, 2, 7, 300)):
        signed = [float(s) * (-1) ** (c & bit).bit_count() for bit, s in enumerate(similar._SIGNS[p, r])]
        weighted = sum(abs(int(x)) for x, s in zip(vote[k, p], signed, strict=True) if x * s < 0)  # the distance, bits weighing as their votes
        assert lead[k, p, r, c] == np.abs(vote[k, p]).sum() - 2 * weighted


def test_pairs_at_the_limit_share_a_bucket_within_the_radius():
    rng = np.random.default_rng(9)
    for first, second, common in ((4, 5, 4), (9, 9, 8), (18, 18, 16), (40, 50, 40), (90, 90, 80)):
        vote = np.array([[similar.votes(s) for s in sets_at(rng, first, second, common)] for _ in range(60)])
        for a, b in vote:
            prints, keys = similar.fingerprints(np.array([a, b])), similar.bucket_keys(np.array([a, b])).reshape(2, -1, 4)
            assert similar.apart(prints[:1], prints[1])[0] <= similar.radius_of(80)
            assert (keys[0][:, :, None] == keys[1][:, None, :]).any()


def test_the_pivot_table_loses_no_pair():
    rng = np.random.default_rng(3)
    for n in (2, 5, 30):
        for radius in (60, 160, 225, 235):
            prints, label = rng.integers(-(1 << 63), 1 << 63, (n, 8)), rng.integers(0, 4, n)
            prints[n // 2] = prints[0] ^ np.array([(1 << 40) - 1, *[1] * 7])
            want = any(label[i] != label[j] and similar.apart(prints[i : i + 1], prints[j])[0] <= radius for i in range(n) for j in range(i))
            assert similar.partnered(prints, label, radius) == want


def test_no_pair_beyond_the_simhash_radius_is_linked(spark, monkeypatch):
    texts = [t for t in documents()[:60] if t]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], SCHEMA)
    monkeypatch.setattr(similar, "radius_of", lambda percent: -1)
    kept = dict(corpus_pipeline.STAGES)["simhash near-dedup"](spark, df, "").count()
    assert kept == len({shingles(t) for t in texts}) > len(set(brute(texts)))


def test_buckets_are_read_over_batches():
    import pyarrow as pa

    rows = [(1, 4), (2, 1), (2, 5), (2, 9), (3, 2), (4, 3), (4, 8)]
    for step in range(1, 8):
        parts = [pa.RecordBatch.from_pydict({"key": [k for k, _ in rows[i : i + step]], "node": [n for _, n in rows[i : i + step]]}) for i in range(0, 7, step)]
        got = sorted(r for b in similar._met(parts) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        assert got == [(2, 1, 1), (2, 5, 1), (2, 9, 1), (4, 3, 3), (4, 8, 3)]


def hot_group(n):
    """Near copies of one text, each with up to six words changed."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    out = []
    for _ in range(n):
        near = list(base)
        for at in rng.sample(range(len(near)), rng.randint(1, 6)):
            near[at] = f"changed{rng.random()}"
        out.append(" ".join(near))
    return out


def cells_of(spark, monkeypatch, texts):
    """The rows in cells and the classes of texts."""
    seen, cells = [], similar._open_cells

    def counted(*args):
        out = cells(*args)
        seen.append(out.count() if out is not None else 0)
        return out

    monkeypatch.setattr(similar, "_open_cells", counted)
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], SCHEMA)
    label = {r.doc_id: r.label for r in similar.grouped(df).collect()}
    monkeypatch.setattr(similar, "_open_cells", cells)
    low = {}
    for k in sorted(label):
        low.setdefault(label[k], k)
    return seen[0], [low[label[k]] for k in range(len(texts))]


def test_a_hot_group_is_in_its_cells_once(spark, monkeypatch):
    texts = hot_group(160) + documents()[:40]
    want = brute(texts)
    assert 20 < len(set(want)) < len(texts) - 20
    rows, got = cells_of(spark, monkeypatch, texts)
    assert got == want
    assert rows < 8 * len(texts)  # a cell for each bucket made 10,651 rows
    monkeypatch.setattr(similar, "CELL_ROWS", 7)
    assert cells_of(spark, monkeypatch, texts)[1] == want
    monkeypatch.setattr(similar, "SMALL_BUCKET", 10**9)  # no group
    assert cells_of(spark, monkeypatch, texts)[1] == want


def test_chunks_of_one_component_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(similar, "CELL_ROWS", 50)
    for connected, others in ((1000, 10), (2000, 10), (120, 115), (30, 20), (40, 11)):
        label = [7] * connected + list(range(100, 100 + others))
        most = f"named_struct('n', {connected}L, 'total', {connected}L, 'label', 7L)"
        rows = spark.createDataFrame(list(enumerate(label)), "node long, label long")
        rows = rows.selectExpr("5L as key", "node", "label", f"{len(label)}L as rows", f"{len(label)}L as total", f"{most} as most")
        cells = {}
        dealt = similar._dealt(rows).collect()
        for r in dealt:
            cells.setdefault((r.lo, r.hi), []).append(r.node)
        assert len(dealt) == len({(r.lo, r.hi, r.node) for r in dealt})
        if others == 10:
            assert len(dealt) == connected + 10 * connected // 50  # in proportion to the component, not to its square
        met = {(min(x, y), max(x, y)) for nodes in cells.values() for x in nodes for y in nodes if label[x] != label[y]}
        assert met == {(x, y) for y in range(connected, len(label)) for x in range(y)}


def test_large_buckets_are_known_over_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(similar, "SMALL_BUCKET", 2)
    rows = [(1, 4), (2, 1), (2, 5), (2, 9), (3, 2), (4, 3), (4, 8), (4, 11), (4, 12), (4, 13), (5, 1), (6, 2), (6, 7)]
    for step in range(1, 14):
        parts = [pa.RecordBatch.from_pydict({"key": [k for k, _ in rows[i : i + step]], "node": [n for _, n in rows[i : i + step]]}) for i in range(0, 13, step)]
        got = sorted(r for b in similar._beside(similar._met(parts)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        assert got == [(2, 5, 1, False), (2, 9, 1, False), *((4, n, 3, True) for n in (8, 11, 12, 13)), (6, 7, 2, False)]
    assert list(similar._beside([])) == []
