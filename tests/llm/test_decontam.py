import hashlib
import random
import re

import corpus_pipeline
import pytest
from plait.llm import decontam, hashing


def words(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())


def brute(text, items, size=8):
    ws = words(text)
    hit, found = [False] * len(ws), set()
    for name, item in items:
        iw = words(item)
        if not iw:
            continue
        n = min(size, len(iw))
        for k in range(len(iw) - n + 1):
            w = iw[k : k + n]
            for p in range(len(ws) - n + 1):
                if ws[p : p + n] == w:
                    hit[p : p + n] = [True] * n
                    found.add("null" if name is None else str(name))
    return len(ws), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def tables():
    rng = random.Random(7)
    vocabulary = ["the", "of", "and", "Über", "straße", "x1", "42", "naïve", "dog", "cat", "tree", "house"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))) for k in range(30)] + [(3, "the the the the the the the the the the"), (None, "no id item text here"), (99, None), (98, "short one"), (97, "..., !")]
    docs = []
    for k in range(60):
        parts = rng.choices(vocabulary, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = (rng.choice(items)[1] or "").split()
        docs.append((k, ", ".join(parts) if k % 2 else " ".join(parts), "x"))
    docs += [(0, docs[0][1], "repeat"), (100, None, "x"), (101, "", "x"), (102, "the " * 20_000, "x"), (None, "a Short ONE, here", "x")]
    return docs, items


@pytest.mark.parametrize("bits", [decontam.FILTER_BITS, 6])
def test_report_matches_brute_force(spark, bits, monkeypatch):
    """Also with a filter of so few bits that it lets almost everything through."""
    monkeypatch.setattr(decontam, "FILTER_BITS", bits)
    docs, items = tables()
    d = spark.createDataFrame(docs, "doc_id long, text string, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.contaminated_report(d, b).collect())
    want = []
    for k, t, _ in docs:
        x = (20_000, 20_000, 1, hashlib.sha256(b"3").hexdigest()) if k == 102 else brute(t, items)
        want.append((str(k), *x, x[2] >= 2))
    assert got == sorted(want)


def test_clean_keeps_columns_and_clean_rows(spark):
    docs, items = tables()
    d = spark.createDataFrame(docs, "doc_id long, text string, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.clean(d, b, min_items=1)
    assert out.schema == d.schema
    want = sorted((str(k), str(t), x) for k, t, x in docs if k != 102 and not brute(t, items)[2])
    assert sorted((str(r.doc_id), str(r.text), r["items"]) for r in out.collect()) == want


def test_the_stage_asks_more_of_short_items(spark, tmp_path):
    long, prose = "one two three four five six seven eight nine", "a day like others went by and rain fell on the mill "
    items = [(1, "the mill"), (2, "why not"), (3, long), (4, "six words that ask for more"), (5, "and this one answers them")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, prose * 3), (2, "The mill why not"), (3, prose + long), (4, prose + items[3][1] + " " + items[4][1]), (5, items[3][1] + " " + prose * 2), (6, prose + "nothing"), (7, prose + long[:-5])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = dict(corpus_pipeline.STAGES)["decontamination"](spark, d, str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == [1, 5, 6]


def test_partial_containment_matches_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate((8, 9, 20, 3, 1))]
    docs = []
    for k in range(80):
        parts = rng.choices(vocabulary, k=rng.randint(0, 30))
        item = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 3)):
            item[rng.randrange(len(item))] = "other"
        docs.append((k, " ".join(parts + item + parts[:3])))
    for contain in (0.75, 0.5, 0.875):
        _, found = decontam.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), contain=contain)
        got = {bytes(r.digest): (r["items"], [tuple(x) for x in r.runs]) for r in found.collect()}
        want = {}
        for _, t in docs:
            ws, names, hit = t.split(), set(), set()
            for name, item in items:
                iw = item.split()
                n = min(8, len(iw))
                for k in range(len(iw) - n + 1):
                    for p in range(len(ws) - n + 1):
                        if sum(x == y for x, y in zip(ws[p : p + n], iw[k : k + n], strict=True)) >= n * contain:
                            names.add(str(name))
                            hit |= set(range(p, p + n))
            if names:
                edges = [p for p in hit if p - 1 not in hit], [p + 1 for p in hit if p + 1 not in hit]
                want[hashlib.sha256(t.encode()).digest()] = (sorted(names), list(zip(sorted(edges[0]), sorted(edges[1]), strict=True)))
        assert got == want


def test_words_are_hashed_by_content():
    hasher = hashing.Hasher()
    rng = random.Random(9)
    texts = [b"", b"  ", b"One two", b"three", b"one TWO-one", b"x" * 5000 + b" " + b"y" * 4096, "Über straße 日本".encode(), b"a" * 3_000_000, b"end", (b"word " * 500_000) + b"last"]
    texts += [bytes(rng.choices(b"ab c,D", k=rng.randint(0, 40))) for _ in range(300)]
    folded = b"".join(texts).translate(decontam._FOLD)
    import numpy as np

    ends = np.cumsum([len(t) for t in texts])
    start, end, h = hasher.words(folded, ends)
    want = [w for t in texts for w in words(t.decode())]
    assert [folded[x:y] for x, y in zip(start, end, strict=True)] == want
    by = {}
    for w, x in zip(want, h.tolist(), strict=True):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


def test_a_passage_that_very_many_documents_share(spark):
    """A third of all documents hold one passage, many of them as copies, and one text is very long."""
    passage = "ten small words that so many of the texts repeat here"
    docs = [(k, f"{passage} tail {k % 40}" if k % 3 == 0 else f"other text {k}") for k in range(3000)] + [(9999, "noise " * 300_000 + passage)]
    items = [(1, passage), (2, passage + " and more of it than that"), (3, "words that no document has at all in any place")]
    out = decontam.contaminated_report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(out) == len(docs)
    for r in out:
        assert (r.n_hit, r.n_items) == ((11, 2) if r.doc_id % 3 == 0 or r.doc_id == 9999 else (0, 0))


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in decontam.contaminated_report(d, none).collect()] == [(1, 2, 0, 0)]
    assert decontam.contaminated_report(d.limit(0), none).count() == 0
