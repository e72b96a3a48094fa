"""SimHash near-dedup with pivot distance tables.

A document's 64-bit fingerprint takes the majority of each bit over the
XXH64 hashes of its word shingles. Two fingerprints are linked when they
differ in at most ``radius`` bits; a component is what links reach.

Method. The references ("pivots") are the 64 Walsh-Hadamard codewords. The
table holds a fingerprint's Hamming distance to every pivot. By the triangle
inequality, a pair whose table rows differ by more than ``radius`` in any
coordinate cannot be linked, so it is discarded on its largest coordinate
difference; survivors are verified by their exact distance. With these pivots
the squares of the coordinate differences of a pair D bits apart sum to 64*D,
so the largest is at least sqrt(D): the table is certain to discard every
pair of 10 or more differing bits when the radius is 3.

A pivot table alone still looks at all pairs, so pairs come from *cells*: the
bits form five blocks, three differing bits leave at least two blocks alike, and
fingerprints meet in one cell for each pair of blocks. A cell of more than
``cell_rows`` fingerprints is divided by quarters of its other bits (a linked
pair agrees on at least one quarter), repeatedly; what still is larger is dealt
into chunks, each pair of chunks a small task. No link is lost and no cell is
ever gathered whole. A cell returns a spanning forest of its links, not all
its pairs, and fingerprints are made distinct first, so groups of copies cost
one row.

Defined cases. Null text has no words: fingerprint zero, linked like any
other. Fewer words than the shingle: one shingle of all words. Repeated rows
and equal doc_ids each return their row. A null doc_id is returned and takes no part in the
component's smallest id (a component of null ids only has a null id). Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import discard, materialise, small_batches

SEED = 42
#: Five blocks of the 64 bits: (first bit, width).
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints that one task compares with each other at most.
CELL_ROWS = 2048
#: Rounds in which cells that are too large are divided by more bits.
REFINE_ROUNDS = 3
#: Shingles hashed at a time, so that a very long text needs little memory.
SHINGLE_CHUNK = 1 << 15


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The unsigned fingerprint of one UTF-8 text."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, SHINGLE_CHUNK):
        part = words[i : i + SHINGLE_CHUNK + width - 1]
        if len(words) < width:
            shingles = iter((b" ".join(words),))
        else:
            shingles = map(b" ".join, zip(*(part[k:] for k in range(width)), strict=False))
        h = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, keyed: bool = False) -> DataFrame:
    """(doc_id, fp), if ``keyed`` with text_hash (binary) between: fp is the fingerprint's 64 bits as a signed long."""
    keys = [F.col("doc_id").cast("long").alias("doc_id"), *([text_key(F.col("text")).alias("text_hash")] if keyed else [])]
    names = ["doc_id", *(["text_hash"] if keyed else []), "fp"]

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(len(names) - 1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], names=names)

    src = small_batches(docs).select(*keys, F.col("text").cast("binary").alias("text"))
    return src.mapInArrow(run, ", ".join(f"{n} {'binary' if n == 'text_hash' else 'long'}" for n in names))


def pivots() -> np.ndarray:
    """The 64 Walsh-Hadamard codewords as unsigned 64-bit references."""
    i = np.arange(64, dtype=np.uint64)
    parity = np.bitwise_count(i[:, None] & i[None, :]) & 1
    return (parity.astype(np.uint64) << i[None, :]).sum(axis=1, dtype=np.uint64)


def distance_table(fp: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Rows of Hamming distances, one column for each reference."""
    return np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int16)


def linked(fp: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs (i, j) are links: discard by the table, a few columns first, then verify."""
    keep = np.arange(len(i))
    for lo, hi in ((0, 8), (8, 24), (24, table.shape[1])):
        gap = np.abs(table[i[keep], lo:hi] - table[j[keep], lo:hi]).max(axis=1, initial=0)
        keep = keep[gap <= radius]
        if not len(keep):
            break
    return keep[np.bitwise_count(fp[i[keep]] ^ fp[j[keep]]) <= radius]


def forest(fp: np.ndarray, table: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among one cell's fingerprints, breadth first."""
    out, left = [], np.arange(len(fp))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = linked(fp, table, np.full(len(left), at), left, radius)
            if len(hit):
                found = left[hit]
                left = np.delete(left, hit)
                queue += found.tolist()
                out += [(at, int(x)) for x in found]
    return out


#: Cells up to this size are compared together, by vectors over many cells.
SMALL_CELL = 8


def cell_links(cell: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of rows that are sorted by cell (numbered): ends as unsigned fingerprints."""
    refs = pivots()
    table = distance_table(fp, refs)
    start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    size = np.diff(np.r_[start, len(cell)])
    a, b = [], []
    of_row = np.repeat(size, size)
    small = of_row <= SMALL_CELL
    end = np.repeat(start + size, size)
    row = np.arange(len(cell))
    for step in range(1, SMALL_CELL):
        i = row[small & (row + step < end)]
        if not len(i):
            break
        hit = linked(fp, table, i, i + step, radius)
        a.append(fp[i[hit]])
        b.append(fp[i[hit] + step])
    for s, n in zip(start[size > SMALL_CELL], size[size > SMALL_CELL], strict=True):
        pairs = forest(fp[s : s + n], table[s : s + n], radius)
        if pairs:
            x, y = np.array(pairs).T
            a.append(fp[s + x])
            b.append(fp[s + y])
    none = np.empty(0, dtype=np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _block(b: int) -> int:
    lo, width = BLOCKS[b]
    return ((1 << width) - 1) << lo


def cell_masks(rounds: int) -> list[list[int]]:
    """Masks of the bits that a cell fixes, by round; mask k of a round has the children 4k to 4k+3 in the next."""
    levels = [[_block(x) | _block(y) for x, y in combinations(range(len(BLOCKS)), 2)]]
    for _ in range(rounds):
        nxt = []
        for mask in levels[-1]:
            free = [b for b in range(64) if not mask >> b & 1]
            nxt += [mask | sum(1 << b for b in free[q::4]) for q in range(4)]
        levels.append(nxt)
    return levels


def links(fps: DataFrame, radius: int = 3, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a, b) long: links among distinct fingerprints, enough of them to connect all that are connected.

    ``fps`` has a column fp without repeats. ``radius`` is 3 or less.
    """
    if not 0 <= radius <= 3:
        raise ValueError("five blocks of which two must agree allow a radius of 3 at most")
    levels = cell_masks(REFINE_ROUNDS)
    keys = [F.struct(F.lit(k).alias("cell"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for k, m in enumerate(levels[0])]
    now = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.cell", "k.bits")
    parts = []
    for level in range(REFINE_ROUNDS + 1):
        counts = materialise(now.groupBy("cell", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "cells")
        last = level == REFINE_ROUNDS
        fit = counts if last else counts.where(F.col("n") <= cell_rows)
        parts.append(now.join(fit, ["cell", "bits"]).select(F.lit(level).alias("level"), "cell", "bits", "fp", "n"))
        large = counts.where(F.col("n") > cell_rows)
        if last or large.isEmpty():
            break
        masks = F.array(*[F.array(*[F.lit(_signed(m)) for m in levels[level + 1][4 * k : 4 * k + 4]]) for k in range(len(levels[level]))])
        now = (
            now.join(large.select("cell", "bits"), ["cell", "bits"])
            .select("fp", "cell", F.posexplode(F.element_at(masks, F.col("cell") + 1)).alias("q", "m"))
            .select("fp", (F.col("cell") * 4 + F.col("q")).alias("cell"), F.col("fp").bitwiseAND(F.col("m")).alias("bits"))
        )
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    q = F.ceil(F.col("n") / F.lit(cell_rows)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("q")).cast("int")
    rows = rows.withColumn("q", q).withColumn("mine", mine)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    rows = rows.select("level", "cell", "bits", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "fp")
    by = ["level", "cell", "bits", "lo", "hi"]

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            cols = [t.column(n).to_numpy() for n in by]
            new = np.zeros(t.num_rows, dtype=bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            ids = np.cumsum(new)
            cut = int(np.searchsorted(ids, ids[-1])) if len(ids) else 0
            held = t.slice(cut)
            if cut:
                yield _edges(ids[:cut], t.column("fp").to_numpy()[:cut], radius)
        if held is not None and held.num_rows:
            yield _edges(np.zeros(held.num_rows, dtype=np.int64), held.column("fp").to_numpy(), radius)

    out = rows.repartition(*by).sortWithinPartitions(*by, "fp").mapInArrow(run, "a long, b long")
    return materialise(out.distinct(), "links")


def _edges(ids: np.ndarray, fp: np.ndarray, radius: int) -> pa.RecordBatch:
    a, b = cell_links(ids, fp.view(np.uint64), radius)
    x, y = a.view(np.int64), b.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame | None:
    """(node, root) for every node of ``edges`` (a, b): nodes of one component share a root. None without edges.

    Each round hooks every node to its smallest neighbour, shortens the paths by
    pointer jumping and contracts the graph, so rounds grow with the logarithm
    of the graph and every step is a join or a map-side combined minimum.
    """
    cur, graph, maps = edges.where("a <> b"), None, []
    while not cur.isEmpty():
        both = cur.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(cur.select(F.col("b").alias("node"), F.col("a").alias("to")))
        held = materialise(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("root")), "hooks")
        up = held
        while True:
            nxt = up.alias("x").join(up.select(F.col("node").alias("root"), F.col("root").alias("top")), "root").select("node", "root", "top")
            nxt = materialise(nxt, "jumps")
            discard(held)
            moved, held = not nxt.where("root <> top").isEmpty(), nxt
            up = nxt.select("node", F.col("top").alias("root"))
            if not moved:
                break
        maps.append(up)
        tops_a = up.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        tops_b = up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        nxt = cur.join(tops_a, "a").join(tops_b, "b").select("ra", "rb").where("ra <> rb")
        cur = materialise(nxt.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "graph")
        if graph is not None:
            discard(graph)
        graph = cur
    if not maps:
        return None
    out = maps[0]
    for m in maps[1:]:
        out = out.join(m.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return out


def _grouped(fps: DataFrame, radius: int, cell_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """(fp, low) and, where there are links, (fp, root) of the linked fingerprints."""
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(distinct.select("fp"), radius, cell_rows))
    return distinct, None if roots is None else roots.withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, fp, component_id), one row for each row of ``docs``."""
    fps = materialise(fingerprints(docs, width), "fingerprints")
    distinct, roots = _grouped(fps, radius, cell_rows)
    if roots is None:
        return fps.join(distinct.withColumnRenamed("low", "component_id"), "fp").select("doc_id", "fp", "component_id")
    joined = distinct.join(roots, "fp")
    lows = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    grouped = joined.join(lows, "root").select("fp", "component_id")
    ids = distinct.join(grouped, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"))
    # Copies share a fingerprint: the side of the documents may be hot, and is what a skewed join splits.
    return fps.join(ids, "fp").select("doc_id", "fp", "component_id")


def text_key(text: Column) -> Column:
    """What a text is known by: its SHA-256."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def keep_rows(docs: DataFrame, keyed: DataFrame) -> DataFrame:
    """One row of each label of ``keyed`` (doc_id, text_hash, label): of its smallest doc_id (null last), then its smallest text hash.

    Rows are told apart by doc_id and text, so an id that is given twice keeps each of its texts that is a component's choice.
    """
    each = keyed.groupBy("label", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("bare"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"), F.col("n").alias("n"))
    keep = each.groupBy("label").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("__plait_id"), F.col("k.text_hash").alias("__plait_text"), F.col("k.n").alias("__plait_n"))
    keep = materialise(keep, "keep")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__plait_id")) & text_key(F.col("text")).eqNullSafe(F.col("__plait_text"))
    # One doc_id with one text on several rows: they are told apart by nothing, so any one of them stays.
    repeated = keep.where("__plait_n > 1")
    if repeated.isEmpty():
        return docs.join(keep, same, "left_semi")
    return docs.join(keep.where("__plait_n = 1"), same, "left_semi").union(docs.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def keep_one(docs: DataFrame, width: int = 3, radius: int = 3, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Stage: of each component one row stays, with all columns (``keep_rows`` says which)."""
    keyed = materialise(fingerprints(docs, width, keyed=True), "fingerprints")
    distinct, roots = _grouped(keyed, radius, cell_rows)
    if roots is None:
        return keep_rows(docs, keyed.select("doc_id", "text_hash", F.col("fp").alias("label")))
    label = distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("label"))
    return keep_rows(docs, keyed.join(label, "fp").select("doc_id", "text_hash", "label"))
