"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item gives one window for each run of ``window`` consecutive words (a
shorter item one window of all its words). A window occurs in a document
where the document's words are the same in order.

Method. A window is the set of its shingles of ``SHINGLE`` words with their places, ordered by rarity: how often each occurs in
all documents, counted in one pass for the whole benchmark. An occurrence agrees on every shingle, so it agrees on the
*prefix*, the rarest one. Documents are searched for prefix shingles only; what they find is shuffled and joined with the
windows on the shingle, may start nowhere but where the window's place of the shingle says (positional bound) and only where the whole
window fits (length bound), and is then verified word by word over a slice of the window's size.

With contain < 1, a window of n words occurs where at least ceil(n * contain) of its words agree in place. Each
word that differs spoils as many shingles as have it, so the prefix grows to one more than that, with shorter shingles where the
window has too few.

Scale. The benchmark is a table like any other: its windows are joined by shuffle and are never collected. Each task holds a bit
filter of at most 2^``FILTER_BITS`` bits (8 MB), whatever the size of the benchmark: it decides which shingles are worth counting or
shuffling, and a fuller filter only lets more through. Documents are folded and hashed a batch at a time in numpy, and only
around prefix shingles are words cut out. The join is salted, as a passage that very many documents share meets on few
shingles; texts are known by their SHA-256, so copies of a text are joined with one finding. Very long texts
need about six bytes of memory for each byte.

Defined cases. Null text has no words, no hits and no items. Items without a word
have no window. Repeated documents each return their row; repeated items of
one id count once. Items with a null id count as one item named ``null``. Extra columns of any name are kept by ``clean``.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, materialise, small_batches
from .hashing import Hasher, TextBatch, mixed

WINDOW = 8
SHINGLE = 3
#: Logarithm of the bits of the filter that each task holds, at most.
FILTER_BITS = 26
#: Parts among which each shingle's occurrences are dealt.
SALTS = 8
#: Runs of ASCII letters and digits and of everything beyond ASCII, after lower-casing A-Z.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Occurrences that are handed on together.
ROWS = 1 << 14

_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_WEIGHTS = tuple(np.uint64(pow(0xD1342543DE82EF95, k + 1, 1 << 64)) for k in range(SHINGLE))


def words(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words, one for each that starts at a word."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(n, np.uint64(width))
    for k in range(width):
        out += h[k : k + n] * _WEIGHTS[k]
    return mixed(out)


def joined(ws: list[bytes]) -> bytes:
    return b" " + b" ".join(ws) + b" "


def prefix_of(n: int, contain: float) -> tuple[int, int]:
    """(words of a shingle, shingles of the prefix) for a window of n words."""
    differ = n - math.ceil(n * contain)
    for width in range(min(SHINGLE, n), 0, -1):
        if width * differ + 1 <= n - width + 1:
            return width, width * differ + 1
    raise ValueError("contain leaves no word to agree")


def windows(bench: DataFrame, window: int, contain: float) -> tuple[DataFrame, DataFrame]:
    """(win, name) and (win, words, size, width, prefix, shingles array<(hash, ahead)>) of the benchmark's distinct windows.

    words are joined by spaces, with one at either end; ahead are the bytes of words before the shingle.
    """
    fields = pa.list_(pa.struct([("hash", pa.int64()), ("ahead", pa.int32())]))
    kinds = (pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), fields)
    names = ["name", "words", "size", "width", "prefix", "shingles"]

    def run(batches):
        hasher = Hasher()
        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ws = words(t.as_py())
                if not ws:
                    continue
                h = hasher.words(b" ".join(ws), np.empty(0, dtype=np.int64))[2]
                n = min(window, len(ws))
                width, prefix = prefix_of(n, contain)
                each = shingles(h, width).view(np.int64)
                ahead = np.cumsum([0, *(len(w) + 1 for w in ws)])
                for lo in range(0, len(ws) - n + 1, ROWS):
                    starts = range(lo, min(lo + ROWS, len(ws) - n + 1))
                    inner = [[{"hash": int(each[j]), "ahead": int(ahead[j] - ahead[k])} for j in range(k, k + n - width + 1)] for k in starts]
                    cols = ([name] * len(starts), [joined(ws[k : k + n]) for k in starts], *([x] * len(starts) for x in (n, width, prefix)), inner)
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], names=names)

    src = small_batches(bench).select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), F.col("text").cast("binary").alias("text"))
    rows = src.mapInArrow(run, "name string, words binary, size int, width int, prefix int, shingles array<struct<hash:long,ahead:int>>")
    rows = rows.withColumn("win", F.unhex(F.sha2("words", 256)))
    rows = materialise(rows, "windows")
    return rows.select("win", "name").distinct(), rows.drop("name").dropDuplicates(["win"])


class Filter:
    """A bit for the top bits of each hash; ``widths`` are the shingle widths in it."""

    def __init__(self, hashes: DataFrame):
        """hashes: (width, hash long). The bits are combined by the executors; at most 2^(FILTER_BITS - 6) words come back."""
        told = hashes.agg(F.count(F.lit(1)).alias("n"), F.collect_set("width").alias("widths")).first()
        self.bits = min(FILTER_BITS, max(16, (told.n << 10).bit_length()))
        self.widths = sorted(told.widths)
        slot = F.shiftrightunsigned("hash", 64 - self.bits)
        rows = hashes.select(F.shiftright(slot, 6).alias("at"), slot.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
        rows = rows.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")).toPandas()
        self.table = np.zeros(1 << (self.bits - 6), dtype=np.uint64)
        self.table[rows["at"].to_numpy(dtype=np.int64)] = rows["mask"].to_numpy(dtype=np.int64).view(np.uint64)

    def holds(self, h: np.ndarray) -> np.ndarray:
        slot = h >> np.uint64(64 - self.bits)
        return (self.table[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


class Batch(TextBatch):
    """The words of a batch of texts, hashed together."""

    def __init__(self, hasher: Hasher, texts: pa.Array):
        super().__init__(hasher, texts, _FOLD)

    def found(self, filters: Filter, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(word number, hash) of the shingles that the filter lets through; none goes over the end of a text."""
        h = shingles(self.hash, width)
        at = np.flatnonzero(filters.holds(h))
        at = at[self.of[at] == self.of[at + width - 1]]
        return at, h[at]


def corpus_counts(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """(hash, n): how often each of the hashes (width, hash) occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(Filter(hashes))

    def run(batches):
        hasher, filters = Hasher(), shared.value
        for b in batches:
            if b.num_rows and filters.widths:
                batch = Batch(hasher, b.column(0))
                h, n = np.unique(np.concatenate([batch.found(filters, w)[1] for w in filters.widths]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "n"])

    rows = small_batches(docs).select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "hash long, n long")
    counted = rows.groupBy("hash").agg(F.sum("n").alias("n"))
    return materialise(hashes.select("hash").distinct().join(counted, "hash"), "rarity")


def occurrences(docs: DataFrame, hashes: DataFrame, window: int) -> DataFrame:
    """For each document one row (doc_id, digest, n_words), and one (digest, pos, hash, before, ahead, around) for each prefix shingle in it.

    around are the words at which a window with the shingle may lie, joined as those of a window are; before and ahead count the
    words and bytes of it that come before the shingle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Filter(hashes))
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    names = ["doc_id", "digest", "n_words", "pos", "hash", "before", "ahead", "around"]

    def run(batches):
        hasher, filters = Hasher(), shared.value
        for b in batches:
            if not b.num_rows:
                continue
            batch = Batch(hasher, b.column(2))
            none = b.num_rows
            rest = [pa.nulls(none, k) for k in kinds[3:]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(batch.n_words.astype(np.int64)), *rest], names=names)
            for width in filters.widths:
                at, h = batch.found(filters, width)
                for i in range(0, len(at), ROWS):
                    p, key = at[i : i + ROWS], h[i : i + ROWS]
                    of = batch.of[p]
                    lo = np.maximum(batch.first[of], p - (window - width))
                    hi = np.minimum(batch.first[of + 1], p + window)
                    cut = lambda k: batch.folded[batch.start[k] : batch.end[k]]
                    around = [joined([cut(k) for k in range(x, y)]) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
                    size = np.r_[0, np.cumsum(batch.end - batch.start + 1)]
                    cols = [pa.nulls(len(p), pa.int64()), b.column(1).take(pa.array(of)), pa.nulls(len(p), pa.int64()), p - batch.first[of], key.view(np.int64), (p - lo).astype(np.int32), (size[p] - size[lo]).astype(np.int32), around]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    src = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest"), F.col("text").cast("binary").alias("text"))
    return materialise(src.mapInArrow(run, "doc_id long, digest binary, n_words long, pos long, hash long, before int, ahead int, around binary"), "occurrences")


def digest(text: Column) -> Column:
    """What a text is known by; null for null."""
    return F.unhex(F.sha2(text, 256))


def search(docs: DataFrame, bench: DataFrame, window: int = WINDOW, contain: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, n_words) of every row of ``docs``, and (digest, items array<string>, runs) of the texts with a window.

    Items are the sorted names of the items that have a window in the text; runs are the hit words as sorted, disjoint
    [lo, hi) ranges of word numbers.
    """
    if not 0 < contain <= 1:
        raise ValueError("contain must lie in (0, 1]")
    names, wins = windows(bench, window, contain)
    places = wins.select("win", "width", "prefix", F.posexplode("shingles").alias("k", "s")).select("win", "width", "prefix", "k", "s.hash", F.col("s.ahead").alias("lead"))
    rarity = corpus_counts(docs, places.select("width", "hash").distinct())
    # A shingle that no document has is the rarest of all: with it, a window cannot occur whole.
    counted = places.join(rarity, "hash", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    ordered = counted.groupBy("win", "width", "prefix").agg(F.sort_array(F.collect_list(F.struct("n", "hash", "k", "lead"))).alias("s"))
    prefix = ordered.select("win", "width", F.explode(F.slice("s", F.lit(1), F.col("prefix"))).alias("s")).select("win", "width", "s.n", "s.hash", "s.k", "s.lead").where("n > 0")
    prefix = materialise(prefix.join(wins.select("win", "words", "size"), "win"), "prefix")
    rows = occurrences(docs, prefix.select("width", "hash").distinct(), window)
    there = rows.where("pos is not null").withColumn("salt", F.pmod(F.xxhash64("digest", "pos"), F.lit(SALTS)))
    each = prefix.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    # A window starts where its place of the shingle says, and has to lie in what is around it.
    met = there.join(each, ["hash", "salt"]).where("before >= k")
    if contain == 1:
        met = met.where(F.substring("around", F.col("ahead") - F.col("lead") + 1, F.length("words")) == F.col("words"))
    else:
        split = lambda c: F.split(F.trim(F.col(c).cast("string")), " ")
        part = F.slice(split("around"), F.col("before") - F.col("k") + 1, F.col("size"))
        same = F.size(F.filter(F.zip_with(part, split("words"), lambda x, y: x == y), lambda x: x))
        met = met.where((F.size(part) == F.col("size")) & (same >= F.ceil(F.col("size") * F.lit(float(contain)))))
    hits = materialise(met.select("digest", (F.col("pos") - F.col("k")).alias("lo"), F.col("size").cast("long").alias("size"), "win").distinct(), "hits")
    items = hits.select("digest", "win").distinct().join(names, "win").groupBy("digest").agg(F.sort_array(F.collect_set("name")).alias("items"))
    order = W.partitionBy("digest").orderBy("lo", "hi")
    spans = hits.select("digest", "lo", (F.col("lo") + F.col("size")).alias("hi")).distinct()
    spans = spans.withColumn("reached", F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1)))
    spans = spans.withColumn("run", F.sum(F.when(F.col("lo") <= F.col("reached"), 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = spans.groupBy("digest", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("runs"))
    found = materialise(items.join(runs, "digest"), "found")
    discard(prefix, hits, rarity)
    return rows.where("pos is null").select("doc_id", "digest", "n_words"), found


def n_hit(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + r["hi"] - r["lo"])


def contaminated_report(docs: DataFrame, bench: DataFrame, min_items: int = 2, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, runs) for every row of ``docs``."""
    rows, found = search(docs, bench, **options)
    names = F.coalesce("items", F.array().cast("array<string>"))
    out = rows.join(found, "digest", "left").withColumn("n_items", F.size(names).cast("long"))
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce(n_hit(F.col("runs")), F.lit(0).cast("long")).alias("n_hit"),
        "n_items",
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.col("n_items") >= min_items).alias("contaminated"),
        "runs",
    )


def enough(n_words: Column, runs: Column, window: int) -> Column:
    """Whether the hit words are evidence: a run of a whole window (long items, or short ones side by side), or half of the document."""
    return F.exists(runs, lambda r: r["hi"] - r["lo"] >= window) | (n_hit(runs) * 2 >= n_words)


def clean(docs: DataFrame, bench: DataFrame, min_items: int = 2, window: int = WINDOW, evidence: bool = False, **options) -> DataFrame:
    """Stage: the rows of ``docs`` with windows of fewer than ``min_items`` items, with their columns.

    With ``evidence``, rows whose hits are too few words also stay (``enough``): the one to seven words of a
    short item stand in clean text, too.
    """
    rows, found = search(docs, bench, window=window, **options)
    hit = found.where(F.size("items") >= min_items)
    if evidence:
        long = rows.select("digest", "n_words").distinct()
        hit = hit.join(long, "digest").where(enough(F.col("n_words"), F.col("runs"), window))
    gone = materialise(hit.select(F.col("digest").alias("__plait_digest")), "contaminated")
    return docs.join(gone, digest(F.col("text")) == F.col("__plait_digest"), "left_anti")
