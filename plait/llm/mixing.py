"""Mixing sources to target weights by iterative proportional fitting.

The table of token sums by (source, language, topic) is raked to three target
marginals: each pass scales one marginal's cells to its targets, until all
three agree. A document is then kept with the calibrated probability
of its cell, by a hash of its doc_id, so the expected tokens of the sample meet the targets as far as the
cells hold enough tokens: probabilities stop at 1, and raking goes on over the other cells.

Targets are shares by category; values that no target names share the category ``other``. Where no targets are
given, they come from the data: the named categories are the ``MAX_NAMED`` largest by tokens, and shares go with the ``TEMPER``-th power of
token shares, which lifts small sources and languages as tempered sampling does; topics get equal shares.
So the contingency table has at most (S+1)(L+1)(T+1)
cells whatever the input, which bounds what is collected and sent back. Token sums are
whole numbers, so the fit does not depend on the order of summing.

Topics are clusters of the documents themselves. A document is the vector of its content words (``LEAST_BYTES`` bytes or more,
A-Z lower-cased, log(1 + count) each, hashed with signs to ``DIMENSIONS``) of length 1. The mean of its language is taken off, as topics would be
languages otherwise, and spherical k-means over all documents finds ``N_TOPICS`` directions in ``ROUNDS`` rounds from fixed
random ones. Vectors are whole numbers, so sums and topics do not depend on the order of rows either. Texts are read once, into a written
table of vectors that all later passes use.

Defined cases. Null or blank text has no tokens; it, and text without a content word, has the topic ``none`` and is kept with its cell's probability.
Null source or language counts as ``other``; a null doc_id hashes as null, so such rows share one draw
with each text. Repeated rows are kept or dropped together. An empty table gives an empty table. Extra columns of any name are kept by ``mix``.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, packed, small_batches
from .hashing import Hasher, TextBatch

N_TOPICS = 8
ROUNDS = 6
DIMENSIONS = 256
LEAST_BYTES = 5
#: Whole numbers that stand for 1 in a vector, and in the residual that is averaged.
UNIT, FINE = 127, 1 << 12
OTHER, NONE = "other", "none"
#: Categories that targets from the data name at most, and the power of their shares.
MAX_NAMED = 256
TEMPER = 0.5
#: Share of all tokens that the sample aims at.
BUDGET = 0.4
SEED = 7

_FOLD = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def text_vectors(hasher: Hasher, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens, and vectors of whole numbers (zero without a content word), of a batch of texts as bytes."""
    batch = TextBatch(hasher, texts, _FOLD)
    content = batch.end - batch.start >= LEAST_BYTES
    of, h = batch.of[content], batch.hash[content]
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (h[1:] != h[:-1])]) if len(of) else np.empty(0, dtype=np.int64)
    value = np.log1p(np.diff(np.r_[new, len(of)]))
    of, h = of[new], h[new]
    sign = np.where(h >> np.uint64(63) == 0, 1.0, -1.0)
    place = of * DIMENSIONS + (h % np.uint64(DIMENSIONS)).astype(np.int64)
    dense = np.bincount(place, weights=value * sign, minlength=len(texts) * DIMENSIONS).reshape(len(texts), DIMENSIONS)
    length = np.sqrt((dense * dense).sum(axis=1, keepdims=True))
    return batch.n_words, np.rint(np.divide(dense * UNIT, length, out=np.zeros_like(dense), where=length > 0)).astype(np.int8)


@F.arrow_udf(T.StructType([T.StructField("tokens", T.LongType()), T.StructField("vector", T.BinaryType())]))
def features(text: pa.Array) -> pa.Array:
    tokens, vectors = text_vectors(Hasher.shared(), text)
    return pa.StructArray.from_arrays([pa.array(tokens.astype(np.int64)), pa.array([v.tobytes() if v.any() else None for v in vectors], pa.binary())], names=["tokens", "vector"])


class Topics:
    """Means by language and directions of topics."""

    def __init__(self, means: dict[str, np.ndarray], directions: np.ndarray):
        self.means, self.directions = means, directions

    def residuals(self, langs: list[str], vectors: np.ndarray) -> np.ndarray:
        r = vectors - np.stack([self.means[x] for x in langs])
        length = np.sqrt((r * r).sum(axis=1, keepdims=True))
        return np.rint(np.divide(r * FINE, length, out=np.zeros_like(r), where=length > 0))

    def assign(self, langs: list[str], vectors: np.ndarray) -> np.ndarray:
        """The topic of each vector (ties: the smallest)."""
        return (self.residuals(langs, vectors) @ self.directions.T).argmax(axis=1)


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), dtype=np.int8).reshape(-1, DIMENSIONS).astype(np.float64)


def _sums(rows: DataFrame, label) -> dict[str, tuple[int, np.ndarray]]:
    """label: (count, sum of vectors); ``label`` gives the labels and whole-number vectors of a batch (language, vector)."""

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            names, vectors = label(b.column(0).to_pylist(), _vectors(b.column(1)))
            for name in sorted(set(names)):
                part = vectors[np.array([x == name for x in names])]
                held[name] = held.get(name, 0) + np.r_[len(part), part.sum(axis=0).astype(np.int64)]
        for name, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(v)), pa.array(range(len(v)), pa.int32()), pa.array(v)], names=["label", "at", "n"])

    out: dict[str, np.ndarray] = {}
    for r in rows.mapInArrow(run, "label string, at int, n long").groupBy("label", "at").agg(F.sum("n").alias("n")).collect():
        out.setdefault(r.label, np.zeros(DIMENSIONS + 1))[r["at"]] = r.n
    return {k: (int(v[0]), v[1:]) for k, v in out.items()}


def fit_topics(rows: DataFrame, n_topics: int = N_TOPICS, rounds: int = ROUNDS) -> Topics:
    """Topics of (lang, vector) over all rows with a vector."""
    rows = rows.where("vector is not null")
    means = {k: s / n for k, (n, s) in _sums(rows, lambda langs, v: (langs, v)).items()}
    topics = Topics(means, np.random.default_rng(SEED).standard_normal((n_topics, DIMENSIONS)))
    for _ in range(rounds if means else 0):
        shared = rows.sparkSession.sparkContext.broadcast(topics)

        def label(langs, v, shared=shared):
            t = shared.value
            return [str(x) for x in t.assign(langs, v)], t.residuals(langs, v)

        directions = topics.directions.copy()
        for k, (_, s) in _sums(rows, label).items():
            length = np.sqrt((s * s).sum())
            if length:
                directions[int(k)] = s / length
        topics = Topics(means, directions)
    return topics


def category(c: Column, named: list[str]) -> Column:
    return F.when(c.isin(named), c).otherwise(F.lit(OTHER))


def targets_from(featured: DataFrame, column: str, max_named: int = MAX_NAMED, temper: float = TEMPER) -> dict[str, float]:
    """Shares of the largest values of a column, by a power of their tokens; what is not named shares ``other``."""
    sums = featured.groupBy(column).agg(F.sum("__plait_f.tokens").alias("n"))
    named = sums.where(F.col(column).isNotNull() & (F.col(column) != OTHER)).orderBy(F.desc("n"), column).limit(max_named).collect()
    rest = (sums.agg(F.sum("n")).first()[0] or 0) - sum(r.n for r in named)
    power = {r[0]: float(r.n) ** temper for r in named} | {OTHER: float(rest) ** temper if rest > 0 else 0.0}
    total = sum(power.values())
    return {k: v / total for k, v in power.items()} if total else {OTHER: 1.0}


def rake(tokens: np.ndarray, targets: list[np.ndarray], budget: float, passes: int = 500, close: float = 1e-9) -> np.ndarray:
    """Probabilities of the cells of a three-way token table, fitted to the marginal targets.

    Targets of categories without tokens are dropped and the rest scaled to sum to 1.
    """
    total = tokens.sum()
    p = np.where(tokens > 0, min(1.0, budget), 0.0)
    if not total:
        return p
    goals = []
    for axis, share in enumerate(targets):
        there = tokens.sum(axis=tuple(k for k in range(3) if k != axis)) > 0
        share = np.where(there, share, 0.0)
        share = share / share.sum() if share.sum() else np.where(there, 1.0, 0.0) / there.sum()
        goals.append(share * total * budget)
    weight = p
    for _ in range(passes):
        worst = 0.0
        for axis, goal in enumerate(goals):
            others = tuple(k for k in range(3) if k != axis)
            held = (tokens * np.minimum(weight, 1.0)).sum(axis=others)
            scale = np.divide(goal, held, out=np.ones_like(held), where=held > 0)
            shape = [1, 1, 1]
            shape[axis] = -1
            before = np.minimum(weight, 1.0)
            weight = np.minimum(weight * scale.reshape(shape), 1e9)
            worst = max(worst, float(np.abs(np.minimum(weight, 1.0) - before).max()))
        if worst < close:
            break
    return np.minimum(weight, 1.0)


def with_probabilities(docs: DataFrame, sources: Mapping[str, float] | None = None, langs: Mapping[str, float] | None = None, topics: Mapping[str, float] | None = None, budget: float = BUDGET, seed: int = SEED, n_topics: int = N_TOPICS) -> DataFrame:
    """``docs`` (packed, with doc_id, source, lang and text) as __plait_row, and __plait_f (tokens, vector), __plait_topic, __plait_p and __plait_kept."""
    if not 0 < budget <= 1:
        raise ValueError("budget must lie in (0, 1]")
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(1 << 52)) / F.lit(float(1 << 52))
    read = small_batches(docs).select("__plait_row", F.col("source").alias("__plait_source"), F.col("lang").alias("__plait_lang"), draw.alias("__plait_draw"), features(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("__plait_f"))
    read = materialise(read, "featured")
    sources = targets_from(read, "__plait_source") if sources is None else sources
    langs = targets_from(read, "__plait_lang") if langs is None else langs
    topics = {f"t{k}": 1 / n_topics for k in range(n_topics)} if topics is None else topics
    names = [list(dict.fromkeys([*t, OTHER])) for t in (sources, langs, topics)]
    names[2] = list(dict.fromkeys([*names[2], NONE]))
    rows = read.withColumns({"__plait_s": category(F.col("__plait_source"), names[0]), "__plait_l": category(F.col("__plait_lang"), names[1])})
    model = rows.sparkSession.sparkContext.broadcast(fit_topics(rows.select(F.col("__plait_l").alias("lang"), F.col("__plait_f.vector").alias("vector")), n_topics))

    @F.arrow_udf(T.StringType())
    def topic(lang: pa.Array, vector: pa.Array) -> pa.Array:
        there = vector.is_valid()
        out = np.full(len(vector), NONE, dtype=object)
        if there.true_count:
            out[there.to_numpy(zero_copy_only=False)] = [f"t{k}" for k in model.value.assign(lang.filter(there).to_pylist(), _vectors(vector.filter(there)))]
        return pa.array(out, pa.string())

    rows = rows.withColumn("__plait_topic", topic("__plait_l", "__plait_f.vector"))
    rows = rows.withColumn("__plait_t", category(F.col("__plait_topic"), names[2]))
    cells = ["__plait_s", "__plait_l", "__plait_t"]
    at = [{n: k for k, n in enumerate(x)} for x in names]
    tokens = np.zeros([len(x) for x in names])
    for r in rows.groupBy(*cells).agg(F.sum("__plait_f.tokens").alias("tokens")).collect():
        tokens[at[0][r[0]], at[1][r[1]], at[2][r[2]]] = r[3] or 0
    shares = [np.array([t.get(n, 0.0) for n in x]) for t, x in zip((sources, langs, topics), names, strict=True)]
    # What has no topic keeps its share of the tokens.
    none = tokens[:, :, at[2][NONE]].sum() / tokens.sum() if tokens.sum() and NONE not in topics else shares[2][at[2][NONE]]
    shares[2] = shares[2] * (1 - none)
    shares[2][at[2][NONE]] = none
    p = rake(tokens, shares, budget)
    base = min(1.0, budget)
    table = [(s, lg, t, float(p[i, j, k]) if tokens[i, j, k] else base) for (i, s), (j, lg), (k, t) in itertools.product(*map(enumerate, names)) if tokens[i, j, k]]
    known = rows.sparkSession.createDataFrame(table, "__plait_s string, __plait_l string, __plait_t string, __plait_p double")
    out = rows.join(F.broadcast(known), cells, "left").withColumn("__plait_p", F.coalesce("__plait_p", F.lit(base)))
    return out.withColumn("__plait_kept", F.col("__plait_draw") < F.col("__plait_p"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Stage: the sample of ``docs``, with their columns."""
    return with_probabilities(packed(docs, "doc_id", "source", "lang", "text"), **options).where("__plait_kept").select("__plait_row.*")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, probability, kept) for every row of ``docs``."""
    rows = docs.select(F.struct("doc_id", "source", "lang").alias("__plait_row"), "doc_id", "source", "lang", "text")
    out = with_probabilities(rows, **options)
    return out.select("__plait_row.*", F.col("__plait_topic").alias("topic"), F.col("__plait_f.tokens").alias("n_tokens"), F.col("__plait_p").alias("probability"), F.col("__plait_kept").alias("kept"))
