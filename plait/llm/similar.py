"""Near-dedup by five-word similarity: SimHash and pivot distances propose, exact Jaccard verifies.

A text is the set of its shingles of ``width`` words (lower case, XXH64); two texts are linked when the Jaccard similarity
of their sets is ``percent`` or more, and a component is what links reach. Texts of equal sets are one *node*.

Method. A node has ``PRINTS`` SimHash fingerprints of ``BITS`` bits: each bit is the majority of a bit over the hashes of the set's
shingles, and its *vote* is the majority's lead. Sets of Jaccard similarity 0.8 have fingerprints 15 % of their bits
apart (sets of four and five shingles 19 %), which no cells of equal bits reach. So pairs come from pivots: the Walsh-Hadamard codewords and their
complements under ``ROTATIONS`` random patterns of signs. A node's table holds its distance to every pivot, each bit weighted by its vote (a transform of the votes gives
all), and under each pattern every ``MEET`` of the ``NEAREST`` pivots name a bucket. A pair of
similarity 0.8 shares a bucket under one pattern with probability 0.205 (measured), so it is missed by all 52 with 7e-6; more alike texts less.

A bucket's smallest node is its pivot: nodes whose fingerprint is more than ``radius`` bits from it are discarded, the others verified by Jaccard, which joins the close
copies of a hot group by one pair a node. Buckets whose other nodes are then still of several components are *open*: there all pairs of different components
are looked at. The texts of a hot group share most of their buckets, so the nodes of large buckets that have nodes in common are a *group*, and where that is fewer pairs than its open buckets hold
one by one, the whole group is looked at in their place, each node once. Of a bucket or group that is more than a chunk of about ``CELL_BYTES``, the chunks of its largest component meet those
of the rest, and those of the rest each other, in cells of two. A table of distances to fingerprints of the cell discards pairs whose rows differ by more than the
radius in any coordinate (triangle inequality), and the exact distance discards more. Cells where a pair is left are compared by Jaccard. So every pair that shares a bucket is verified, too far apart or
known to be connected, and no bucket is ever gathered whole or written out as pairs.

Defined cases. Null and blank texts are one node, the empty set. Fewer words than the shingle: one shingle of all words.
"""

from __future__ import annotations

import math
from itertools import chain, combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import discard, materialise, small_batches
from .simhash import SEED, components, keep_rows, text_key

WIDTH = 5
PERCENT = 80
#: Fingerprints, their bits, and patterns of signs for each fingerprint's pivots. Distances between nodes are those of the first.
PRINTS, BITS, ROTATIONS = 4, 512, 13
#: Of the nearest pivots, how many name a bucket together.
NEAREST, MEET = 4, 3
#: Coordinates of the table that discards pairs of an open bucket.
PIVOTS = 16
#: Shingle hashes of one chunk of an open bucket, in bytes, and its nodes at most.
CELL_BYTES = 4 << 20
CELL_ROWS = 1024
#: Nodes beside its pivot up to which a bucket is small.
SMALL_BUCKET = 16
#: Shingles whose bits are counted at a time, in bytes; and texts whose tables are held at a time.
CHUNK = 255
TABLES = 16

_RNG = np.random.default_rng(SEED)
_MULTIPLY = _RNG.integers(0, 1 << 63, PRINTS * BITS // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SIGNS = _RNG.choice(np.array([-1, 1], dtype=np.float32), (PRINTS, ROTATIONS, BITS))
_MIX, _HALF = np.uint64(0xD6E8FEB86659FD93), np.uint64(32)
_TOGETHER = np.array(list(combinations(range(NEAREST), MEET)))
#: Bits that hold one pivot's number.
_NUMBER = (2 * BITS - 1).bit_length()


def _codewords(n: int) -> np.ndarray:
    i = np.arange(n)
    return 1 - 2 * (np.bitwise_count(i[:, None] & i[None, :]) & 1).astype(np.float32)


_ROWS, _COLUMNS = _codewords(16), _codewords(BITS // 16)


def radius_of(percent: int) -> int:
    """Differing bits that a pair of this similarity does not exceed: the expected share, a quarter more for ties in small sets, and seven deviations."""
    j = percent / 100
    share = 1.25 * math.acos(2 * j / (1 + j)) / math.pi
    return math.ceil(BITS * share + 7 * math.sqrt(BITS * share * (1 - share)))


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < width:
        shingles, n = iter((b" ".join(words),)), 1
    else:
        shingles, n = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)), len(words) - width + 1
    return np.unique(np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=n))


def node_of(shingles: np.ndarray) -> int:
    return int(np.uint64(xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64))


def votes(shingles: np.ndarray) -> np.ndarray:
    """The lead of ones over zeros in each bit of each fingerprint of a set."""
    ones = np.zeros(PRINTS * BITS, dtype=np.int32)
    for i in range(0, len(shingles), CHUNK):
        h = shingles[i : i + CHUNK, None] * _MULTIPLY
        for _ in range(2):
            h ^= h >> _HALF
            h *= _MIX
        h ^= h >> _HALF
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, PRINTS * BITS).sum(axis=0, dtype=np.uint8)
    return (2 * ones - len(shingles)).reshape(PRINTS, BITS)


def fingerprints(vote: np.ndarray) -> np.ndarray:
    """The first fingerprint of each set (rows of votes) as rows of signed longs: a bit is 1 if set in over half the hashes."""
    return np.packbits(vote[:, 0] > 0, axis=1, bitorder="little").view("<i8")


def pivot_leads(vote: np.ndarray) -> np.ndarray:
    """By set, fingerprint, pattern and codeword: the votes for the codeword's bits less those against.

    The distance to the codeword, a bit weighing as much as its vote, is half of what all votes' sizes exceed this by; to its complement, half of the sum.
    """
    x = (vote[:, :, None].astype(np.float32) * _SIGNS).reshape(-1, 16, BITS // 16)
    return (_ROWS @ (x @ _COLUMNS)).reshape(len(vote), PRINTS, ROTATIONS, BITS)


def bucket_keys(vote: np.ndarray) -> np.ndarray:
    """Rows of the buckets of each set, those of one pattern side by side."""
    lead = pivot_leads(vote)
    near = np.argpartition(np.abs(lead), BITS - NEAREST, axis=-1)[..., BITS - NEAREST :]
    number = np.sort(2 * near + (np.take_along_axis(lead, near, -1) > 0), axis=-1)[..., _TOGETHER]
    return (number << (_NUMBER * np.arange(MEET))).sum(axis=-1).reshape(len(vote), -1).astype(np.int32)


def apart(prints: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Differing bits between each row of fingerprints and one."""
    return np.bitwise_count((prints ^ one).view(np.uint64)).sum(axis=1, dtype=np.int64)  # of signed ones it counts the absolute value's bits


def distance_table(prints: np.ndarray, radius: int) -> np.ndarray:
    """Rows of distances to fingerprints chosen from among them, each farthest from those before."""
    out = [apart(prints, prints[0])]
    least = out[0]
    while len(out) < PIVOTS and least.max() > radius:
        out.append(apart(prints, prints[least.argmax()]))
        least = np.minimum(least, out[-1])
    return np.stack(out, axis=1)


def partnered(prints: np.ndarray, label: np.ndarray, radius: int) -> bool:
    """Whether two rows of different labels are at most ``radius`` bits apart."""
    names, count = np.unique(label, return_counts=True)
    # Every pair of different labels has a row outside the largest.
    rest = np.flatnonzero(label != names[count.argmax()])
    table = distance_table(prints, radius) if len(rest) else None
    for i in rest:
        at = np.flatnonzero(label != label[i])
        at = at[np.abs(table[at] - table[i]).max(axis=1) <= radius]
        if (apart(prints[at], prints[i]) <= radius).any():
            return True
    return False


def cell_edges(node: np.ndarray, label: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what is linked among nodes of one cell; equal labels are connected already."""
    size = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1] if size.sum() else np.empty(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    start = np.r_[0, np.cumsum(size)]
    label, out = np.unique(label, return_inverse=True)[1], []
    mark = np.zeros(int(ids.max()) + 1 if len(ids) else 0, dtype=bool)
    # Every pair of different labels has a node outside the largest.
    for i in np.flatnonzero(label != np.bincount(label).argmax()):
        if (label == label[0]).all():
            break
        mine = ids[start[i] : start[i + 1]]
        mark[mine] = True
        common = np.bincount(owner[mark[ids]], minlength=len(sets))
        mark[mine] = False
        for j in np.flatnonzero((100 * common >= percent * (size + size[i] - common)) & (label != label[i])):
            if label[j] != label[i]:
                out.append((int(node[i]), int(node[j])))
                label[label == label[j]] = label[i]
    return out


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("n", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.col("n") * 100 >= (F.size("sa") + F.size("sb") - F.col("n")) * percent).select("a", "b")


def _by_cell(batches, n: int):
    """(cell, columns) of rows sorted by cell, their first ``n`` columns."""
    cell, held = None, []
    for b in batches:
        keys = list(zip(*(b.column(k).to_pylist() for k in range(n)), strict=True))
        for k, at in enumerate(keys):
            if at != cell:
                if held:
                    yield cell, list(zip(*held, strict=True))
                cell, held = at, []
            held.append((b.column(n)[k].as_py(), b.column(n + 1)[k].as_py(), b.column(n + 2)[k].values.to_numpy().copy()))
    if held:
        yield cell, list(zip(*held, strict=True))


CELL = ["key", "lo", "hi"]


def _groups(buckets: DataFrame) -> DataFrame | None:
    """(node, root) of the nodes of large buckets: buckets that have a node in common are of one group. None without a large bucket."""
    return components(buckets.where("large").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct())


def _chunks(rows: Column, total: Column) -> Column:
    return F.greatest(F.ceil(rows / F.lit(CELL_ROWS)), F.ceil(total * 8 / F.lit(CELL_BYTES)), F.lit(1)).cast("int")


def _dealt(rows: DataFrame) -> DataFrame:
    """(key, lo, hi, node, label) of rows (key, node, label, rows, total, most): each node once in each cell it is in.

    What fits one chunk is one cell. Else pairs within the largest component are connected already, so its chunks, numbered first, meet only those of the rest.
    """
    main = F.col("label") == F.col("most.label")
    fits = _chunks(F.col("rows"), F.col("total")) == 1
    of_main = _chunks(F.col("most.n"), F.col("most.total"))
    of_rest = _chunks(F.col("rows") - F.col("most.n"), F.col("total") - F.col("most.total"))
    rows = rows.select("key", "node", "label", main.alias("main"), fits.alias("fits"), of_main.alias("of_main"), of_rest.alias("of_rest"))
    at = F.when(F.col("main"), F.pmod(F.xxhash64("node"), F.col("of_main"))).otherwise(F.col("of_main") + F.pmod(F.xxhash64("node"), F.col("of_rest")))
    rows = rows.withColumn("mine", F.when(F.col("fits"), 0).otherwise(at).cast("int"))
    last = F.col("of_main") + F.col("of_rest") - 1
    others = F.when(F.col("main"), F.sequence("of_main", last)).otherwise(F.array_remove(F.sequence(F.lit(0), last), F.col("mine")))
    rows = rows.withColumn("other", F.explode(F.when(F.col("fits"), F.array(F.lit(0))).otherwise(others)))
    return rows.select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "node", "label")


def _open_cells(buckets: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """(key, lo, hi, node, label): the cells of open buckets and groups; None without an open bucket.

    ``buckets`` (key, node, first, large) leaves out each bucket's pivot, all of whose pairs have been looked at. A group goes by the key of one of its buckets.
    """
    groups = _groups(buckets)
    known = labels.join(nodes.select("node", "size"), "node")
    known = known.withColumn("root", F.lit(None).cast("long")) if groups is None else known.join(groups, "node", "left")
    known = materialise(known.select("node", "label", "size", "root"), "known")
    counts = [F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")]
    sums = [F.sum("n").alias("rows"), F.sum("total").alias("total"), F.max(F.struct("n", "total", "label")).alias("most")]
    named = buckets.select("key", "node", "large").join(known, "node")
    each = named.groupBy("key", "large", "label").agg(*counts, F.min("root").alias("low"), F.max("root").alias("high"), F.count("root").alias("rooted"))
    each = each.groupBy("key", "large").agg(*sums, F.min("low").alias("low"), F.max("high").alias("high"), F.sum("rooted").alias("rooted"))
    many = materialise(each.where("rows > most.n"), "open")
    if many.isEmpty():
        discard(known, many)
        return None
    of_group = known.where("root is not null").groupBy("root", "label").agg(*counts).groupBy("root").agg(*sums)
    apart_at = many.where("large").groupBy(F.col("low").alias("root")).agg(F.sum(F.expr("rows * (rows - most.n)")).alias("pairs"), F.min("key").alias("key"))
    whole = materialise(of_group.join(apart_at, "root").where("rows * (rows - most.n) <= pairs"), "groups")
    inside = (F.col("low") == F.col("high")) & (F.col("rooted") == F.col("rows"))
    alone = many.join(whole.select(F.col("root").alias("low"), F.lit(True).alias("held")), "low", "left").where(~F.coalesce(inside & F.col("held"), F.lit(False)))
    columns = ["key", "node", "label", "rows", "total", "most"]
    rows = named.select("key", "node", "label").join(alone.select("key", "rows", "total", "most"), "key").select(columns)
    cells = materialise(_dealt(rows.unionByName(known.join(whole, "root").select(columns))), "cells")
    discard(known, many, whole)
    return cells


def _alive(cells: DataFrame, nodes: DataFrame, radius: int) -> DataFrame:
    """The cells (key, lo, hi) that hold nodes of different components within the radius."""

    def run(batches):
        for cell, (_, label, fp) in _by_cell(batches, len(CELL)):
            if partnered(np.array(fp), np.array(label, dtype=np.int64), radius):
                yield pa.RecordBatch.from_arrays([pa.array([cell[0]], pa.int64()), pa.array([cell[1]], pa.int32()), pa.array([cell[2]], pa.int32())], names=CELL)

    rows = cells.join(nodes.select("node", "print"), "node").select(*CELL, "node", "label", "print")
    return materialise(rows.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(run, "key long, lo int, hi int"), "alive")


def _open_edges(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components within cells."""

    def run(batches):
        for _, (node, label, held) in _by_cell(batches, len(CELL)):
            edges = cell_edges(np.array(node, dtype=np.int64), np.array(label, dtype=np.int64), held, percent)
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])

    rows = cells.join(sets, "node").select(*CELL, "node", "label", "shingles")
    return materialise(rows.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(run, "a long, b long").distinct(), "links")


def _met(batches):
    """(key, node, first) of rows (key, node) sorted by both, for keys of several nodes: first is the smallest."""
    at = first = None
    alone = False
    for b in batches:
        key, node = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(key):
            continue
        new = np.r_[key[0] != at, key[1:] != key[:-1]]
        firsts = np.r_[0 if first is None else first, node[new]][np.cumsum(new)]
        second = np.flatnonzero(~new & np.r_[alone, new[:-1]])
        at, first, alone = key[-1], firsts[-1], bool(new[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[key[~new], key[second]]), pa.array(np.r_[node[~new], firsts[second]]), pa.array(np.r_[firsts[~new], firsts[second]])], names=["key", "node", "first"])


def _beside(batches):
    """(key, node, first, large) of the nodes beside their bucket's pivot, of what ``_met`` gives: large in buckets of more than ``SMALL_BUCKET`` of them."""
    held, goes_on = np.empty((3, 0), dtype=np.int64), -1
    for b in chain(batches, (None,)):
        if b is not None:
            rows = np.stack([b.column(k).to_numpy() for k in range(3)])
            held = np.concatenate([held, rows[:, rows[1] != rows[2]]], axis=1)
        key = held[0]
        if not len(key):
            continue
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.r_[start, len(key)])
        large = (count > SMALL_BUCKET) | (key[start] == goes_on)
        # The last bucket waits for the next rows, unless it is known to be large.
        end = len(key) if b is None or large[-1] else start[-1]
        goes_on = key[-1] if large[-1] else -1
        yield pa.RecordBatch.from_arrays([*map(pa.array, held[:, :end]), pa.array(np.repeat(large, count)[:end])], names=["key", "node", "first", "large"])
        held = held[:, end:]


def _bits_apart(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(BITS // 64)), F.lit(0))


def grouped(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_hash, label) for each row of ``docs``: rows of one component share the label."""
    radius = radius_of(percent)

    def sign(batches):
        for b in batches:
            for i in range(0, b.num_rows, TABLES):
                part = b.slice(i, TABLES)
                sets = [shingle_set(t.as_py(), width) for t in part.column(2)]
                vote = np.array([votes(s) for s in sets])
                both = pa.array(list(fingerprints(vote)), pa.list_(pa.int64())), pa.array(list(bucket_keys(vote)), pa.list_(pa.int32()))
                of = pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *of, *both], names=["doc_id", "text_hash", "node", "size", "print", "keys"])

    def sets_of(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t.as_py(), width).view(np.int64) for t in b.column(1)], pa.list_(pa.int64()))], names=["node", "shingles"])

    src = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_hash"), F.col("text").cast("binary").alias("text"))
    signed = materialise(src.mapInArrow(sign, "doc_id long, text_hash binary, node long, size long, print array<long>, keys array<int>"), "signed")
    rows = signed.groupBy("node").agg(F.min("keys").alias("keys")).select("node", F.posexplode("keys").alias("k", "key"))
    pattern = F.floor(F.col("k") / F.lit(len(_TOGETHER))).cast("long")
    rows = rows.select((pattern * (1 << _NUMBER * MEET) + F.col("key")).alias("key"), "node")
    met = rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(lambda batches: _beside(_met(batches)), "key long, node long, first long, large boolean")
    buckets = materialise(met, "buckets")
    nodes = materialise(signed.groupBy("node").agg(F.min("text_hash").alias("text_hash"), F.min("size").alias("size"), F.min("print").alias("print")), "nodes")
    named = materialise(signed.select("doc_id", "text_hash", "node"), "named")
    discard(signed)

    def sets_for(wanted: DataFrame) -> DataFrame:
        seen = nodes.join(wanted.distinct(), "node", "left_semi").select("node", "text_hash")
        texts = docs.select(text_key(F.col("text")).alias("text_hash"), F.col("text").cast("binary").alias("text"))
        texts = texts.join(seen, "text_hash").groupBy("node").agg(F.first("text").alias("text"))
        return materialise(texts.select("node", "text").mapInArrow(sets_of, "node long, shingles array<long>"), "sets")

    pairs = buckets.select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    pairs = pairs.join(nodes.select(F.col("node").alias("a"), F.col("print").alias("pa")), "a").join(nodes.select(F.col("node").alias("b"), F.col("print").alias("pb")), "b")
    pairs = materialise(pairs.where(_bits_apart("pa", "pb") <= radius).select("a", "b"), "pairs")
    sets = sets_for(pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
    edges = materialise(_verified(pairs, sets, percent), "links")

    def labels(e: DataFrame) -> DataFrame:
        roots = components(e)
        if roots is None:
            return nodes.select("node", F.col("node").alias("label"))
        return nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("label"))

    label = materialise(labels(edges), "labels")
    cells = _open_cells(buckets, label, nodes)
    if cells is not None:
        alive = _alive(cells, nodes, radius)
        live = cells.join(alive, CELL)
        rest = sets_for(live.select("node").join(sets, "node", "left_anti"))
        more = _open_edges(live, sets.unionByName(rest), percent)
        first, label = label, materialise(labels(edges.unionByName(more)), "labels")
        discard(first, cells, alive, rest, more)
    discard(buckets, nodes, pairs, sets, edges)
    # Copies share a node: the side of the documents may be hot, and is what a skewed join splits.
    return named.join(label, "node").select("doc_id", "text_hash", "label")


def keep_similar(docs: DataFrame, **options) -> DataFrame:
    """Stage: of each component of similar texts one row stays, with all columns."""
    return keep_rows(docs, grouped(docs, **options))
