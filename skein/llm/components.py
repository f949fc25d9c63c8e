"""Connected components over a table of links, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import drop_scratch, scratch

#: Tasks that share the links of one node, as a hub may hold a third of all links.
SALTS = 8


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)``; ``root`` is the smallest node reachable.

    Alternates two star operations: each node hands its larger neighbours, then its
    smaller ones, to the smallest neighbour it has.  The number of rounds grows with the
    logarithm of a component's diameter, none for links that are stars already.  Each step is a minimum with a partial
    aggregate and a join on the node, where each node's links are spread over ``SALTS`` tasks; the
    state between the rounds is a table in shared storage, so a lost executor costs a retry.
    Self loops, repeated links and both directions are allowed; an empty table gives no rows.
    """
    now = scratch(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(rounds):
        if _settled(now):
            break
        large = _star(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), keep_larger=True)
        small = _star(large, keep_larger=False)
        after = scratch(small, "links")
        drop_scratch(now)
        now = after
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _star(links: DataFrame, keep_larger: bool) -> DataFrame:
    """Links ``(u, v)`` with ``u > v`` after one star operation."""
    least = links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    copies = least.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = links.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(copies, ["u", "_salt"])
    if keep_larger:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _settled(links: DataFrame) -> bool:
    """Whether the different links ``(u, v)``, ``u > v``, are stars around their least nodes: no ``u`` has two and no ``v`` is a ``u``."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 or up = 1 and down = 1").isEmpty()
