"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Native: Spark expressions only. Each shard owns ``replicas`` virtual nodes on a ring of
2^16 positions; a document's position is a hash of its doc_id, and its first virtual
node clockwise is its home. Shards have capacities; documents that a full shard cannot
take continue clockwise to the next shard with room. With ``headroom`` 0 the capacities
sum to the number of documents, so counts are at most one apart (law ``rows``); with more
headroom h no shard exceeds ceil((1 + h) * mean) and fewer documents leave their home.

Only counts by virtual node (shards * replicas rows, however large the input) are
planned on the driver. The plan gives each arc's documents, in ring order, runs of
ranks with the shard and the first slot. Ranks come from windows over the 2^16 ring
positions; documents are never collected or sorted as a whole, and texts are not shuffled
unless they are columns of what ``assign`` is given. Where a position holds far more rows than others (one doc_id
on very many rows), its rows are ranked in ``PARTS`` parts, one after the other, so no task takes them all.

Defined cases. A null doc_id is placed by its text (size and CRC of null text are those of
an empty one: 1 and 0). Repeated rows get slots of their own. An empty table gives an empty
table. Extra columns are kept by ``measured`` and ``assign``; working columns start with ``__plait_``.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise, same_columns

RING_BITS = 16
RING = 1 << RING_BITS
REPLICAS = 64
#: Parts of a hot position, and the rows (at least, and as a multiple of the mean) from which it is hot.
PARTS = 64
HOT_ROWS, HOT_TIMES = 10_000, 8


def virtual_nodes(spark: SparkSession, shards: int, replicas: int = REPLICAS) -> list[tuple[int, int]]:
    """(ring position, shard), sorted; of nodes that meet on a position the smallest shard owns it."""
    at = F.shiftrightunsigned(F.xxhash64(F.lit("node"), (F.col("id") / replicas).cast("long"), F.col("id") % replicas), 64 - RING_BITS)
    rows = spark.range(shards * replicas).select(at.cast("int").alias("at"), (F.col("id") / replicas).cast("int").alias("shard"))
    return sorted((r.at, r.shard) for r in rows.groupBy("at").agg(F.min("shard").alias("shard")).collect())


def capacities(n: int, shards: int, headroom: float) -> list[int]:
    if headroom <= 0:
        return [n // shards + (k < n % shards) for k in range(shards)]
    return [math.ceil((1 + headroom) * n / shards)] * shards


def plan(owners: list[int], counts: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Runs (arc, from rank, to rank, shard, first slot): bounded loads along the ring.

    Arcs are walked clockwise, twice around: what an arc's shard cannot take is carried to the arcs
    that follow. At each arc its shard takes the arc's own documents first, then what is carried.
    """
    used = [0] * len(room)
    runs, carried = [], []

    def take(arc: int, lo: int, hi: int, shard: int) -> int:
        n = min(hi - lo, room[shard] - used[shard])
        if n > 0:
            runs.append((arc, lo, lo + n, shard, used[shard]))
            used[shard] += n
        return lo + max(n, 0)

    for turn in range(2):
        for arc, shard in enumerate(owners):
            if not turn and counts[arc]:
                lo = take(arc, 0, counts[arc], shard)
                if lo < counts[arc]:
                    carried.append((arc, lo, counts[arc]))
                    continue
            while carried and used[shard] < room[shard]:
                a, lo, hi = carried.pop(0)
                lo = take(a, lo, hi, shard)
                if lo < hi:
                    carried.insert(0, (a, lo, hi))
    if carried:
        raise ValueError("the capacities do not hold all rows")
    return runs


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small plan table as a literal of the query."""
    names = [x.split()[0] for x in schema.split(", ")]
    body = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    fields = ",".join(x.replace(" ", ":") for x in schema.split(", "))
    return spark.range(1).select(F.inline(F.from_json(F.lit(body), f"array<struct<{fields}>>")))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with __plait_key (ring hash), __plait_size, __plait_crc and __plait_part (any part of the rows)."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    key = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")))
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(PARTS)).cast("int")
    return docs.withColumns({"__plait_key": key, "__plait_size": size, "__plait_crc": crc, "__plait_part": part})


def assign(rows: DataFrame, shards: int = 16, headroom: float = 0.0, replicas: int = REPLICAS) -> DataFrame:
    """``rows`` (as ``measured`` gives them, written) with __plait_home, __plait_shard and __plait_slot."""
    spark = rows.sparkSession
    at = F.shiftrightunsigned("__plait_key", 64 - RING_BITS).cast("int")
    nodes = virtual_nodes(spark, shards, replicas)
    # Arc k holds the positions after node k-1 up to node k; positions after the last node belong to arc 0.
    spans = [(k, 0 if k == 0 else nodes[k - 1][0] + 1, p, s) for k, (p, s) in enumerate(nodes)]
    if nodes[-1][0] + 1 < RING:
        spans.append((0, nodes[-1][0] + 1, RING - 1, nodes[0][1]))
    arcs = _table(spark, spans, "arc int, lo int, hi int, home int")
    ring = arcs.select("arc", "home", F.explode(F.sequence("lo", "hi")).alias("__plait_at"))
    # Ranks on an arc go clockwise: the part of arc 0 before position zero comes first.
    turn = F.when((F.col("arc") == 0) & (F.col("__plait_at") > nodes[-1][0]), F.col("__plait_at") - RING).otherwise(F.col("__plait_at"))
    by_part = rows.groupBy(at.alias("__plait_at"), F.col("__plait_part").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    by_part = materialise(by_part, "parts")
    counts = by_part.groupBy("__plait_at").agg(F.sum("n").alias("n"))
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / RING
    hot = counts.where(F.col("n") > max(HOT_ROWS, HOT_TIMES * mean)).select("__plait_at", F.lit(True).alias("hot"))
    # Positions that are not hot are one part; the hot ones are at most an eighth of all positions.
    split = F.coalesce("hot", F.lit(False))
    counts = by_part.join(F.broadcast(hot), "__plait_at", "left").groupBy("__plait_at", F.when(split, F.col("part")).otherwise(-1).alias("part")).agg(F.sum("n").alias("n"))
    before = F.sum("n").over(W.partitionBy("arc").orderBy(turn, "part")) - F.col("n")
    placed = counts.join(F.broadcast(ring), "__plait_at").select("__plait_at", "part", "arc", "home", "n", before.alias("before"))
    placed = materialise(placed, "ring")
    by_arc = {r.arc: r.n for r in placed.groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    room = capacities(sum(by_arc.values()), shards, headroom)
    runs = plan([s for _, s in nodes], [by_arc.get(k, 0) for k in range(len(nodes))], room)
    table = _table(spark, runs, "__plait_run int, __plait_lo bigint, __plait_hi bigint, __plait_shard int, __plait_first bigint")
    hot = placed.where("part >= 0").select(F.col("__plait_at").alias("__plait_hot")).distinct()
    out = rows.withColumn("__plait_at", at).join(F.broadcast(hot), F.col("__plait_at") == F.col("__plait_hot"), "left")
    out = out.withColumn("__plait_in", F.when(F.col("__plait_hot").isNotNull(), F.col("__plait_part")).otherwise(-1))
    order = W.partitionBy("__plait_at", "__plait_in").orderBy("__plait_key", "doc_id", "__plait_crc", "__plait_size")
    out = out.withColumn("__plait_rank", F.row_number().over(order) - 1)
    out = out.join(F.broadcast(placed.select("__plait_at", F.col("part").alias("__plait_in"), F.col("arc").alias("__plait_arc"), F.col("home").alias("__plait_home"), F.col("before").alias("__plait_before"))), ["__plait_at", "__plait_in"])
    rank = F.col("__plait_before") + F.col("__plait_rank")
    out = out.join(F.broadcast(table), (F.col("__plait_arc") == F.col("__plait_run")) & (rank >= F.col("__plait_lo")) & (rank < F.col("__plait_hi")))
    return out.select(*same_columns(rows), "__plait_home", "__plait_shard", (F.col("__plait_first") + rank - F.col("__plait_lo")).alias("__plait_slot"))


def shard_report(docs: DataFrame, shards: int = 16, **options) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, home_shard) for every row of ``docs``."""
    rows = materialise(measured(docs.select("doc_id", "text")).drop("text"), "sizes")
    out = assign(rows, shards, **options)
    return out.select("doc_id", F.col("__plait_size").alias("size"), F.col("__plait_crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("__plait_shard").alias("shard"), F.col("__plait_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("__plait_home").alias("home_shard"))
