"""Language-model scoring by subword lattice likelihood.

The probability of a word is its *marginal* over a lattice: every way to spell it with the pieces of a unigram
vocabulary, each way weighing the product of its pieces' scores. A log-space forward recursion adds the ways up, so no single segmentation is
chosen. A document's log probability is the sum over its tokens, which are its words (A-Z lower-cased) and an end.

The vocabulary has two parts. Its subword pieces are those of a given public model and are never learned. Where that model is a unigram model,
its scores are used as they are; a BPE model has only ranks, so the scores of its pieces start from 1 / (rank + 10) and are
re-estimated over all distinct training words by ``steps`` of expectation-maximisation (forward and backward over the lattice; each distinct word counts
once, as spelling is what is left to words that counts say little about). They sum to 1 over the pieces that start
a word and those that continue one, which makes spelling a proper distribution over words. The other part are the words of the training
documents, each a piece of its own, with its absolutely discounted relative frequency as score; what the discount takes off is the
weight of the arc by which a word enters the subword pieces:

    P(word) = (c - d) / N + d V / N * spelling(word),  P(end) = documents / N,  d = n1 / (n1 + 2 n2)

so that the forward recursion of a word starts at d V / N and takes one more arc from its start to its end if the word is a piece.

Scale. Word counts are combined in each task, then by a shuffle on the word; the recursion runs once for each
distinct word. Words in the top log-buckets of frequency, ``HEAD_ENTRIES`` at most, are sent to the tasks that read
the documents; a document's other words, each rare by construction, join the table of words by
shuffle and are summed by document. Texts are not shuffled and results are exact for every word. What a task holds between batches is
bounded in bytes, not in words.

Defined cases. Null text is empty: one end token. A null doc_id trains and is not held out.
Repeated rows each count and each return their row. Without training documents N is 0,
words have their spelling alone and the end has probability 1. Extra columns are ignored. A very long word is a long lattice: time and memory are
linear in its length.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, small_batches
from .tokens import load_pieces

#: Words that are sent to every task at most, and the bytes of their spelling.
HEAD_ENTRIES = 1 << 18
HEAD_BYTES = 16 << 20
#: A task hands its counts on when it holds so many distinct words, or has read so many bytes (which bound those of the words).
HELD_WORDS = 1 << 18
HELD_BYTES = 64 << 20
STEPS = 3
#: Added to the expected count of every piece.
FLOOR = 0.05
NEVER = float("-inf")
#: Least probability that is still worked out by plain products.
LEAST = 1e-200
LN10 = math.log(10.0)
MARK = chr(256)


def spelled(word: bytes) -> str:
    """A word as the lattice reads it: the start mark and one character for each byte."""
    return MARK + word.decode("latin-1")


class Lattice:
    """Pieces with natural-log weights, searched by an Aho-Corasick automaton."""

    def __init__(self, pieces: list[str], log_p: list[float]):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for k, piece in enumerate(pieces):
            self.auto.add_word(piece, k)
        self.auto.make_automaton()
        self.size, self.log_p = [len(p) for p in pieces], log_p
        self.p = [math.exp(x) for x in log_p]

    def forward(self, text: str, start: float = 0.0, whole: float = NEVER) -> list[float]:
        """Log of the summed weight of all ways to each prefix: from ``start`` by pieces, and by the arc ``whole`` from start to end."""
        alpha = [NEVER] * (len(text) + 1)
        alpha[0] = start
        alpha[-1] = whole if text else start
        size, log_p, log1p, exp = self.size, self.log_p, math.log1p, math.exp
        for end, k in self.auto.iter(text):
            x, v = alpha[end + 1], alpha[end + 1 - size[k]] + log_p[k]
            if v > x:
                alpha[end + 1] = v + log1p(exp(x - v))
            elif v != NEVER:
                alpha[end + 1] = x + log1p(exp(v - x))
        return alpha

    def marginal(self, word: bytes, start: float = 0.0, whole: float = NEVER) -> float:
        return self.forward(spelled(word), start, whole)[-1]

    def expect(self, word: bytes, n: int, into: list[float]) -> None:
        """Add the expected use of each piece in n spellings of a word: by plain products for short words, by logarithms where those vanish."""
        text = spelled(word)
        size, p = self.size, self.p
        arcs = [(end + 1, k) for end, k in self.auto.iter(text)]
        alpha = [0.0] * (len(text) + 1)
        alpha[0] = 1.0
        for end, k in arcs:
            a = alpha[end - size[k]]
            if a:
                alpha[end] += a * p[k]
        total = alpha[-1]
        if total < LEAST:
            self._expect_logs(text, arcs, n, into)
            return
        beta = [0.0] * (len(text) + 1)
        beta[-1] = n / total
        for end, k in reversed(arcs):
            b = beta[end]
            if b:
                lo, v = end - size[k], b * p[k]
                into[k] += alpha[lo] * v
                beta[lo] += v

    def _expect_logs(self, text: str, arcs: list[tuple[int, int]], n: int, into: list[float]) -> None:
        alpha = self.forward(text)
        total = alpha[-1]
        if total == NEVER:
            return
        beta = [NEVER] * (len(text) + 1)
        beta[-1] = 0.0
        size, log_p, log1p, exp = self.size, self.log_p, math.log1p, math.exp
        for end, k in reversed(arcs):
            b = beta[end]
            if b == NEVER:
                continue
            lo = end - size[k]
            v = b + log_p[k]
            a = alpha[lo]
            if a != NEVER:
                into[k] += n * exp(a + v - total)
            x = beta[lo]
            beta[lo] = v + log1p(exp(x - v)) if v > x else x + log1p(exp(v - x))


def vocabulary_of(path: str) -> tuple[list[str], list[float], bool]:
    """Pieces, their log weights and whether those are a unigram model's own scores.

    A BPE model's scores are whole numbers, its ranks: the i-th piece in order of merging then weighs 1 / (i + 10).
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    score = {sp.id_to_piece(k): sp.get_score(k) for k in range(sp.get_piece_size())}
    rank = {x: k for k, x in enumerate(score)}
    given = any(x != int(x) for x in score.values())
    least = min(score.values())
    pieces = ["".join(map(chr, p)) for p in load_pieces(path)]

    def weight(piece: str) -> float:
        try:
            name = ("▁" if piece[:1] == MARK else "") + piece.removeprefix(MARK).encode("latin-1").decode()
        except UnicodeDecodeError:
            name = ""
        return math.exp(score.get(name, least - 10)) if given else 1.0 / (rank.get(name, len(rank)) + 10)

    w = np.array([weight(p) for p in pieces])
    return pieces, np.log(w / w.sum()).tolist(), given


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, n): occurrences of each word in training documents and in all; docs: (held_out, text)."""

    def run(batches):
        train: Counter[bytes] = Counter()
        held: Counter[bytes] = Counter()

        def hand_on():
            it = iter(held.keys() | train.keys())
            while part := list(islice(it, 1 << 14)):
                c = np.fromiter((train.get(w, 0) for w in part), dtype=np.int64, count=len(part))
                n = c + np.fromiter((held.get(w, 0) for w in part), dtype=np.int64, count=len(part))
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array(c), pa.array(n)], names=["word", "c", "n"])
            train.clear()
            held.clear()

        size = 0
        for b in batches:
            for out, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = t.as_py()
                if not text:
                    continue
                (held if out else train).update(text.lower().split())
                size += len(text)
                if size > HELD_BYTES or len(held) + len(train) > HELD_WORDS:
                    yield from hand_on()
                    size = 0
        yield from hand_on()

    src = small_batches(docs).select("held_out", F.col("text").cast("binary").alias("text"))
    rows = src.mapInArrow(run, "word binary, c long, n long")
    return rows.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def fit_pieces(words: DataFrame, pieces: list[str], log_p: list[float], steps: int = STEPS) -> list[float]:
    """Re-estimate the weights over all training words; only expected counts by piece reach the driver."""
    sc = words.sparkSession.sparkContext
    for _ in range(steps):
        given = sc.broadcast((pieces, log_p))

        def run(batches, given=given):
            lattice = Lattice(*given.value)
            into = [0.0] * len(lattice.size)
            for b in batches:
                for w in b.column(0):
                    lattice.expect(w.as_py(), 1, into)
            e = np.array(into)
            at = np.flatnonzero(e)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(e[at])], names=["piece", "e"])

        rows = words.where("c > 0").select("word").mapInArrow(run, "piece int, e double").groupBy("piece").agg(F.sum("e").alias("e")).toPandas()
        expected = np.full(len(pieces), FLOOR)
        expected[rows["piece"].to_numpy(dtype=np.int64)] += rows["e"].to_numpy(dtype=float)
        log_p = np.log(expected / expected.sum()).tolist()
    return log_p


def discount_of(n1: int, n2: int) -> float:
    return min(0.95, max(0.05, n1 / (n1 + 2 * n2) if n1 else 0.5))


def spell(words: DataFrame, pieces: list[str], log_p: list[float], tokens: int, types: int, d: float) -> DataFrame:
    """``words`` (word, c, n) with lp: the log10 probability of each word among ``tokens`` training tokens of ``types`` words."""
    given = words.sparkSession.sparkContext.broadcast((pieces, log_p))
    start = math.log(d * types / tokens) if types else 0.0

    def run(batches):
        lattice = Lattice(*given.value)
        for b in batches:
            with np.errstate(divide="ignore"):
                whole = np.log(np.maximum(b.column(1).to_numpy(zero_copy_only=False) - d, 0.0) / max(tokens, 1)).tolist()
            lp = np.fromiter((lattice.marginal(w.as_py(), start, x) for w, x in zip(b.column(0), whole, strict=True)), dtype=float, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lp / LN10)], names=["word", "c", "n", "lp"])

    return words.select("word", "c", "n").mapInArrow(run, "word binary, c long, n long, lp double")


def head_of(words: DataFrame, limit: int, limit_bytes: int):
    """Condition for the words in the top log-buckets of frequency: ``limit`` words and ``limit_bytes`` of them at most."""
    bucket = F.floor(F.log2("n") * 16)
    sizes = {r.b: (r.k, r.size) for r in words.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("k"), F.sum(F.octet_length("word")).alias("size")).collect()}
    least, held, size = max(sizes, default=0) + 1, 0, 0
    for b in sorted(sizes, reverse=True):
        held, size = held + sizes[b][0], size + sizes[b][1]
        if held > limit or size > limit_bytes:
            break
        least = b
    return bucket >= least


def score(docs: DataFrame, vocabulary: str, steps: int = STEPS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); docs: (doc_id, text, held_out).

    ``vocabulary`` is the path of a SentencePiece model on the driver.
    """
    spark = docs.sparkSession
    ends = docs.where("not held_out").count()
    words = materialise(word_counts(docs.select("held_out", "text")), "words")
    told = words.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    total, types, n1, n2 = (x or 0 for x in told)
    n = total + ends
    base_of = math.log10(n + types + (ends > 0) + 1)
    pieces, log_p, given = vocabulary_of(vocabulary)
    log_p = fit_pieces(words, pieces, log_p, steps if types and not given else 0)
    spelt = materialise(spell(words, pieces, log_p, n, types, discount_of(n1, n2)), "spelt")
    discard(words)
    in_head = head_of(spelt, HEAD_ENTRIES, HEAD_BYTES)
    head = spelt.where(in_head).select("word", "c", "lp").toPandas()
    at = {bytes(w): j for j, w in enumerate(head["word"])}
    known = head["c"].to_numpy(dtype=np.int64)
    table = np.column_stack([np.log10(known + 1.0) - base_of, (known > 0).astype(float), head["lp"].to_numpy(dtype=float)])
    shared = spark.sparkContext.broadcast((at, table, np.array([math.log10(ends + 1) - base_of, float(ends > 0), math.log10(ends / n) if ends else 0.0])))

    def run(batches):
        index, values, last = shared.value
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for t in b.column(2):
                text = t.as_py()
                seen = Counter(text.lower().split() if text else ())
                hits = [index.get(w, -1) for w in seen]
                times = np.fromiter(seen.values(), dtype=np.int64, count=len(seen))
                found = np.array(hits, dtype=np.int64)
                there = found >= 0
                sums = times[there] @ values[found[there]] + last
                rare = [w for w, j in zip(seen, hits, strict=True) if j < 0]
                for c, v in zip(cols, (row, int(times.sum()) + 1, round(sums[1]), float(sums[0]), float(sums[2]), rare, times[~there]), strict=True):
                    c.append(v)
                row += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            arrays = [pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], names=["doc_id", "held_out", "row", "n_tokens", "n_known", "base", "own", "rare", "times"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.col("text").cast("binary").alias("text"))
    schema = "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base double, own double, rare array<binary>, times array<long>"
    rows = materialise(src.mapInArrow(run, schema), "scored")
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("m"))
    found = rare.join(spelt.where(~in_head).select("word", "c", "lp"), "word")
    more = found.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("k2"),
        F.sum(F.col("m") * (F.log10(F.col("c") + 1) - base_of)).alias("b2"),
        F.sum(F.col("m") * F.col("lp")).alias("s2"),
    )
    out = rows.drop("rare", "times").join(more, "row", "left")
    zero = F.lit(0.0)
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k2", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b2", zero)).alias("base_score"),
        (F.col("own") + F.coalesce("s2", zero)).alias("score"),
    )


def score_report(docs: DataFrame, vocabulary: str, steps: int = STEPS) -> DataFrame:
    """Score all documents, learning from those whose crc32(doc_id as text) mod 7 is not 2."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return score(docs.select("doc_id", "text", held.alias("held_out")), vocabulary, steps)
