"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``cells`` equal arcs.  A text's hash gives its arc, so equal texts share a
shard; a group of equal texts above a 16th of a shard's load is dealt in blocks of
about that size instead, each with an arc of its own, as shards could not balance it whole.  Every shard owns
``vnodes`` points of the ring and takes the arcs that lead to them clockwise, while its
load stays within the capacity (the mean load plus ``slack``); arcs that overflow go on
clockwise to the next shard with room, or to the emptiest shard if none has any.  Larger
arcs arrive first.  So no shard exceeds the capacity by more than one small arc while single
documents are small against it, and one more shard moves little beyond what it takes itself.

Everything on rows is built-in DataFrame work.  Only the loads of the arcs (at most
``cells`` numbers, whatever the input) reach the driver, where the ring is walked.

Cases: a null text counts as no bytes (size 1, checksum 0); null ids are allowed; repeated
rows get a slot each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from skein.llm.common import partitions, scratch

SHARDS = 16
VNODES = 128
CELLS = 1 << 14
SLACK = 0.001
#: A group of equal texts is dealt in blocks of this part of a shard's capacity.
BLOCK = 16
#: Rows that one task makes from the count of rows that agree in id and text.
COPIES = 1 << 16


def ring(shards: int, vnodes: int = VNODES, cells: int = CELLS) -> tuple[list[int], list[int]]:
    """(arc, shard) of every virtual node, by arc; a shard's nodes do not depend on the others."""
    nodes = sorted(
        (int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") % cells, s) for s in range(shards) for v in range(vnodes)
    )
    return [a for a, _ in nodes], [s for _, s in nodes]


def place(loads: dict[int, int], shards: int, vnodes: int = VNODES, cells: int = CELLS, slack: float = SLACK) -> dict[int, int]:
    """Arc -> shard under bounded loads."""
    arcs, owners = ring(shards, vnodes, cells)
    capacity = sum(loads.values()) / shards * (1 + slack)
    held = [0] * shards
    out = {}
    for arc, load in sorted(loads.items(), key=lambda x: (-x[1].bit_length(), x[0])):
        at = bisect_left(arcs, arc)
        seen: list[int] = []
        for step in range(len(owners)):
            shard = owners[(at + step) % len(owners)]
            if shard in seen:
                continue
            if held[shard] + load <= capacity:
                break
            seen.append(shard)
            if len(seen) == shards:  # larger than any room that is left: to the emptiest shard
                shard = min(seen, key=lambda s: held[s])
                break
        held[shard] += load
        out[arc] = shard
    return out


def _plan(spark: SparkSession, counts: dict[int, int], shard_of: dict[int, int], cells: int) -> DataFrame:
    """(arc, shard, offset) as a table of constants: ``offset`` is the shard's rows in earlier arcs."""
    filled: dict[int, int] = {}
    rows = []
    for arc in range(cells):
        shard = shard_of.get(arc, 0)
        rows.append(f"{shard}:{filled.get(shard, 0)}")
        filled[shard] = filled.get(shard, 0) + counts.get(arc, 0)
    constants = spark.range(1).select(F.posexplode(F.split(F.lit(",".join(rows)), ",")).alias("_arc", "_at"))
    return constants.select("_arc", F.split_part("_at", F.lit(":"), F.lit(1)).cast("int").alias("shard"), F.split_part("_at", F.lit(":"), F.lit(2)).cast("long").alias("_offset"))


def shard(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, vnodes: int = VNODES, cells: int = CELLS, slack: float = SLACK,
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row, balanced by bytes."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_group"))
    groups = scratch(base.groupBy("_group").agg(F.sum("size").alias("_bytes")), "groups")
    total = groups.agg(F.sum("_bytes")).first()[0] or 0
    limit = max(1, int(total / shards / BLOCK))
    # every such group holds more than a (shards * BLOCK)th of all bytes, so there are fewer than shards * BLOCK of them
    large = groups.where(F.col("_bytes") > limit).select("_group", F.ceil(F.col("_bytes") / limit).alias("_parts"))
    hot = base.join(F.broadcast(large), "_group").groupBy("doc_id", "size", "text_crc32", "_group", "_parts").agg(F.count("*").alias("_n"))
    pieces = hot.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {COPIES}")))).repartition(partitions(spark), "_group", "doc_id", "_piece")
    copies = pieces.withColumn("_copy", F.explode(F.expr(f"sequence(_piece * {COPIES}, least(_n, (_piece + 1) * {COPIES}) - 1)")))
    bits = 64 - (cells.bit_length() - 1)
    spread = F.shiftrightunsigned(F.xxhash64("_group", F.pmod(F.xxhash64("doc_id", "_copy"), F.col("_parts"))), bits)
    whole = F.shiftrightunsigned(F.xxhash64("_group", F.lit(0).cast("long")), bits)
    columns = ["doc_id", "size", "text_crc32"]
    keyed = base.join(F.broadcast(large), "_group", "left_anti").select(*columns, whole.cast("int").alias("_arc")).unionByName(copies.select(*columns, spread.cast("int").alias("_arc")))
    found = keyed.groupBy("_arc").agg(F.sum("size").alias("load"), F.count("*").alias("n")).collect()  # at most `cells` rows
    placed = place({r._arc: r.load for r in found}, shards, vnodes, cells, slack)
    plan = _plan(spark, {r._arc: r.n for r in found}, placed, cells)
    within = F.row_number().over(Window.partitionBy("_arc").orderBy("doc_id", "text_crc32", "size"))
    return (
        keyed.withColumn("_rank", within).join(F.broadcast(plan), "_arc")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("_offset") + F.col("_rank") - 1).alias("slot"))
    )
