"""Language identification by multilingual mixture inference.

A language is a distribution over hashed byte trigrams of letters (case folded, everything else in
ASCII a space), learned from labelled documents and smoothed by add-one. A document is cut into units of ``UNIT``
trigrams, and each unit is written in one language, so its likelihood is a mixture: expectation-maximisation estimates the document's
language proportions. The language set grows from the best single language by the language
with the steepest gain, as long as the log-likelihood rises by more than ``penalty * ln(units + 1)``
(penalised likelihood). The language of a document is the one with the largest
proportion (ties: the smaller name); its proportion is the score.

Counts of trigrams cover all labelled documents. The model has 2^16 rows for each language,
so its size is bound by the number of labels, which is counted and checked against ``max_languages`` (a parameter) before anything is
learned; each language's row is made by a task. Documents are scored in
vectors over many units. What a task holds is bounded by ``ENTRIES`` (units times languages, and trigrams times languages): the units of a very long text
are longer, so that there are no more of them, and all its trigrams count.

Defined cases. Text that is null or has no letter is ``und`` with score 0, and teaches nothing. Null or blank labels teach
nothing. Without any labelled document every language is ``und``. Repeated rows count and are
judged one by one. Extra columns are ignored; language labels, sources and ids are no input of a prediction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BUCKETS = 1 << 16
UNIT = 32
STEPS = 25
PENALTY = 3.0
MAX_LANGUAGES = 512
#: Units times languages that are inferred together, and trigrams times languages that are looked up together.
ENTRIES = 1 << 21

_FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def buckets_of(text: str) -> np.ndarray:
    """The hashed trigrams of a text, in order."""
    raw = (" " + text.lower() + " ").encode("utf-8", "surrogatepass").translate(_FOLD)
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(16)


def trigram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows of (lang, text)."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = text.as_py()
                if t is not None and has_letter(t):
                    if lang not in sums:
                        sums[lang] = np.zeros(BUCKETS, dtype=np.int64)
                    sums[lang] += np.bincount(buckets_of(t), minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])

    return small_batches(labelled).select("lang", "text").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages in order of name, and their log probabilities of each bucket."""

    def __init__(self, langs: list[str], log_p: np.ndarray):
        self.langs, self.log_p = langs, log_p


def _row(rows: pa.Table) -> pa.Table:
    """The log probabilities of one language as the bytes of 2^16 floats."""
    counts = np.zeros(BUCKETS)
    counts[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    log_p = np.log((counts + 1) / (counts.sum() + BUCKETS)).astype("<f4")
    return pa.table({"lang": rows.column("lang").slice(0, 1), "log_p": pa.array([log_p.tobytes()], pa.binary())})


def fit(docs: DataFrame, max_languages: int = MAX_LANGUAGES) -> Model:
    """Learn from the text and lang of ``docs``."""
    labelled = docs.where("lang is not null and trim(lang) <> '' and text is not null")
    n = labelled.agg(F.count_distinct("lang")).first()[0]
    if n > max_languages:
        raise ValueError(f"{n} languages; the model is bound to {max_languages}")
    rows = trigram_counts(labelled).groupBy("lang").applyInArrow(_row, "lang string, log_p binary")
    by = {r.lang: np.frombuffer(r.log_p, dtype="<f4") for r in rows.toLocalIterator()}
    log_p = np.empty((BUCKETS, len(by)), dtype=np.float32)
    for k, lang in enumerate(sorted(by)):
        log_p[:, k] = by[lang]
    return Model(sorted(by), log_p)


def _maximise(like: np.ndarray, start: np.ndarray, weight: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions, log-likelihoods and gains by document. like: units x languages; start: first unit of each document."""
    units = np.diff(np.r_[start, len(like)])
    of_unit = np.repeat(np.arange(len(start)), units)
    for _ in range(steps):
        part = weight[of_unit] * like
        part /= part.sum(axis=1, keepdims=True)
        weight = np.add.reduceat(part, start, axis=0) / units[:, None]
    mixed = (weight[of_unit] * like).sum(axis=1)
    gain = np.add.reduceat(like / mixed[:, None], start, axis=0) - units[:, None]
    return weight, np.add.reduceat(np.log(mixed), start), gain


def unit_of(n_trigrams: int, n_lang: int) -> int:
    """Trigrams of a unit: ``UNIT``, or more where a text would have too many units."""
    return max(UNIT, -(-n_trigrams // max(1, ENTRIES // n_lang)))


def infer(model: Model, trigrams: list[np.ndarray], penalty: float = PENALTY, steps: int = STEPS) -> np.ndarray:
    """Language proportions (documents x languages) of documents that have trigrams."""
    n_lang = len(model.langs)
    units = [unit_of(len(t), n_lang) for t in trigrams]
    sizes = np.array([-(-len(t) // u) for t, u in zip(trigrams, units, strict=True)])
    first = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
    log_like = np.empty((int(sizes.sum()), n_lang), dtype=np.float64)
    for t, u, at in zip(trigrams, units, first, strict=True):
        many = max(1, ENTRIES // (n_lang * u))
        for k in range(0, len(t), many * u):
            part = t[k : k + many * u]
            starts = np.arange(0, len(part), u)
            log_like[at + k // u : at + k // u + len(starts)] = np.add.reduceat(model.log_p[part], starts, axis=0, dtype=np.float64)
    best = log_like.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(log_like - best, -600.0))
    top = np.add.reduceat(best[:, 0], first)
    single = np.add.reduceat(log_like, first, axis=0)
    lead = single.argmax(axis=1)
    out = np.zeros((len(trigrams), n_lang))
    out[np.arange(len(trigrams)), lead] = 1.0
    score = single[np.arange(len(trigrams)), lead] - top
    gain = np.empty_like(out)
    for d in range(len(trigrams)):
        part = like[first[d] : first[d] + sizes[d]]
        gain[d] = (part / np.maximum(part[:, lead[d], None], 1e-300)).sum(axis=0) - sizes[d]
    open_ = np.arange(len(trigrams))
    cost = penalty * np.log1p(sizes)
    while len(open_):
        offer = np.where(out[open_] > 0, -np.inf, gain[open_])
        add = offer.argmax(axis=1)
        can = offer[np.arange(len(open_)), add] > 0
        open_, add = open_[can], add[can]
        if not len(open_):
            break
        weight = (out[open_] > 0).astype(float)
        weight[np.arange(len(open_)), add] = 1.0
        weight /= weight.sum(axis=1, keepdims=True)
        rows = np.concatenate([np.arange(first[d], first[d] + sizes[d]) for d in open_])
        start = np.r_[0, np.cumsum(sizes[open_])[:-1]].astype(np.int64)
        weight, found, more = _maximise(like[rows], start, weight, steps)
        won = found - score[open_] > cost[open_]
        took = open_[won]
        out[took], score[took], gain[took] = weight[won], found[won], more[won]
        open_ = took
    return out


def detect(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """(doc_id, lang_pred, score, langs, shares): langs and shares are the language set with its proportions."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            n = b.num_rows
            pred, score = ["und"] * n, [0.0] * n
            langs: list[list[str]] = [[] for _ in range(n)]
            shares: list[list[float]] = [[] for _ in range(n)]
            at, held, units = [], [], 0

            def flush():
                for k, w in zip(at, infer(m, held, penalty), strict=True):
                    there = np.flatnonzero(w > 0)
                    order = there[np.argsort(-w[there], kind="stable")]
                    pred[k], score[k] = m.langs[order[0]], float(min(w[order[0]], 1.0))
                    langs[k], shares[k] = [m.langs[x] for x in order], [float(w[x]) for x in order]
                at.clear()
                held.clear()

            for k, text in enumerate(b.column(1)):
                t = text.as_py()
                if m.langs and t is not None and has_letter(t):
                    found = buckets_of(t)
                    n_units = len(found) // unit_of(len(found), len(m.langs)) + 1
                    if held and (units + n_units) * len(m.langs) > ENTRIES:
                        flush()
                        units = 0
                    at.append(k)
                    held.append(found)
                    units += n_units
            if at:
                flush()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred), pa.array(score), pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))], names=["doc_id", "lang_pred", "score", "langs", "shares"])

    src = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.mapInArrow(run, "doc_id long, lang_pred string, score double, langs array<string>, shares array<double>")


def language_report(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, langs, shares): learns from the documents that are not held out."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = fit(docs.where(F.coalesce(~held, F.lit(False))).select("lang", "text"))
    out = detect(docs, model)
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "langs", "shares")
