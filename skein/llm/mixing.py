"""Mixing sources to target weights by Sainte-Laguë apportionment.

1. Each source's target: a share of all words by weight, held at ``max_repeats`` times
   what the source has; the excess goes to the others by weight (solved in closed form
   over the sources sorted by size against weight).
2. All words are counted in blocks of equal size (``block`` words, the same at every total; with the one word
   of the default even the smallest source meets its target).  Sources get whole blocks by the highest
   quotients target / 1, 3, 5, ...; within each source its shards (by a hash of the
   id) get the source's blocks in the same way.  A shard has 2 to the power of ``SHARD_BITS`` words or less in the mean, so one
   large source is many shards, up to 16 to the power of ``DIGITS``.
3. In a shard, documents stand in the order of a seeded hash.  Its quota is so many full
   passes and, for the rest, a run of blocks from a seeded start, around the end if need be.
   What a document gives is the passes times its words plus its words in chosen blocks,
   in closed form from its first and last word's position; most are chosen whole or not at all.

Only built-in DataFrame operations are used.  Quotas start at a lower bound in closed form and
only the last few seats are ranked, so the number of blocks does not matter.  Seats up to three times a size come before
all others, so no shard is given more than its repeats allow.  Tables by shard have at most 16 to the power of ``DIGITS``
rows per source; documents are shuffled once, by source and shard.

Cases: a null text has no words; null sources are one source, last in order; null ids are hashed
like empty ones; repeated rows are counted each; an empty table gives no rows; a table without
words has targets of 0; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from skein.llm.common import scratch, small

SEED = "mix-1"
MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
BLOCK = 1
#: Words of a shard in the mean, at most, as a power of two; and the most hexadecimal digits of a shard's name.
SHARD_BITS, DIGITS = 20, 4
#: Fixed value: a word, as the contract states it.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), *parts))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, rank, target, total) from (source, source_size)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", weight).withColumn("most", F.lit(max_repeats) * F.col("source_size"))
    filling = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("most").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (F.sum("source_size").over(everything) - before) / F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    filled = ranked.select("source", "source_size", "rank", "weight", "most", F.sum("source_size").over(everything).alias("total"), level.alias("level"))
    top = F.max("level").over(everything)
    return filled.select("source", "source_size", "rank", "total", F.least(F.col("most").cast("double"), F.col("weight") * top).alias("target"))


def sainte_lague(shares: DataFrame, group: list[str], key: str, weight: str, seats: str) -> DataFrame:
    """``shares`` with a ``quota``: in each group its ``seats`` by the highest quotients weight / 1, 3, 5, ...

    Ties go to the smaller ``key``.  Seats that are certain are given at once; the rest (at most 1.5 per
    row of the group) by rank among a few quotients of each row.
    """
    all_of = Window.partitionBy(*group)
    sized = shares.withColumn("_n", F.count("*").over(all_of)).withColumn("_w", F.sum(F.col(weight).cast("double")).over(all_of))
    share = F.when(F.col("_w") > 0, F.col(weight) / F.col("_w")).otherwise(0.0)
    sure = F.when(F.col(seats) > F.col("_n"), F.floor(share * (F.col(seats) - F.col("_n")) + 0.5)).otherwise(0)
    sure = sized.withColumn("_sure", sure).withColumn("_rest", F.col(seats) - F.sum("_sure").over(all_of)).withColumn("_share", share)
    tries = sure.withColumn("_k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_share") * 1.5 * F.col("_n")).cast("int") + 2)))
    quotient = F.col(weight) / (2 * (F.col("_sure") + F.col("_k")) + 1)
    place = F.row_number().over(all_of.orderBy(quotient.desc(), F.col(key), F.col("_k")))
    won = tries.withColumn("_won", ((place <= F.col("_rest")) & (F.col(weight) > 0)).cast("long"))
    columns = shares.columns
    return won.groupBy(*columns).agg((F.first("_sure") + F.sum("_won")).cast("long").alias("quota"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: int = MAX_REPEATS, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs``."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    return _taken(base, max_repeats, block).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: int = MAX_REPEATS, block: int = BLOCK) -> DataFrame:
    """The mix itself: whole rows of ``docs``, each as often as the words taken from it round to.

    Only the documents at the ends of a shard's chosen run are taken in part; those round up above a limit that
    is random by shard, so that the words stay near the targets.  Documents without words are not in the mix.
    """
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), row.alias("_row"))
    limit = (F.conv(F.substring(_hash(F.lit("limit"), F.col("_source"), F.col("shard")), 1, 4), 16, 10).cast("int") + 0.5) / 65536
    copies = F.coalesce(F.floor(F.try_divide("taken", "size") + 1 - limit), F.lit(0))
    repeated = _taken(base, max_repeats, block).select("_row", F.explode(F.array_repeat(F.lit(0), copies.cast("int"))).alias("_copy"))
    return repeated.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _taken(base: DataFrame, max_repeats: int, block: int) -> DataFrame:
    """``base`` (doc_id, source, size and any more) with source_size, target and taken."""
    doc_id, by_source = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), ["_none", "_source"]
    base = base.withColumn("_h", _hash(doc_id)).withColumn("_none", F.col("source").isNull()).withColumn("_source", F.coalesce("source", F.lit("")))
    fine = scratch(base.groupBy(*by_source, F.substring("_h", 1, DIGITS).alias("_cell")).agg(F.sum("size").alias("_size")), "cells")
    sources = fine.groupBy(*by_source).agg(F.sum("_size").alias("source_size"))
    digits = F.lit(0)
    for d in range(DIGITS):
        digits = digits + (F.col("source_size") > F.lit(1 << (SHARD_BITS + 4 * d))).cast("int")
    sources = scratch(sources.withColumn("_digits", digits), "sources")
    few = small(sources.select(*by_source, "_digits"))
    shard_of = lambda c: F.expr(f"substring({c}, 1, _digits)")
    cells = fine.join(few, by_source).groupBy(*by_source, shard_of("_cell").alias("shard")).agg(F.sum("_size").alias("shard_size"))
    aimed = targets(sources.select(F.when(~F.col("_none"), F.col("_source")).alias("source"), "source_size"), max_repeats=max_repeats)
    aimed = aimed.withColumn("block", F.lit(block).cast("long")).withColumn("_all", F.floor((2 * F.col("total") + F.col("block")) / (2 * F.col("block"))))
    quotas = sainte_lague(aimed.withColumn("_one", F.lit(1)), ["_one"], "rank", "target", "_all")
    quotas = quotas.select(F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_source"), "source_size", "target", "block", F.col("quota").alias("_quota"))
    dealt = sainte_lague(cells.join(quotas, by_source), by_source, "shard", "shard_size", "_quota")
    take = F.least(F.col("quota") * F.col("block"), max_repeats * F.col("shard_size"))
    n = F.expr("(shard_size + block - 1) div block")
    start = F.conv(F.substring(_hash(F.col("_source"), F.col("shard")), 1, 13), 16, 10).cast("long")
    plan = (
        dealt.withColumn("_take", take).withColumn("_n", F.greatest(n, F.lit(1)))
        .withColumn("_passes", F.expr("coalesce(_take div nullif(shard_size, 0), 0)"))
        .withColumn("_rest", F.expr("_take - _passes * shard_size"))
        .withColumn("_pick", F.expr("least((2 * _rest + block) div (2 * block), _n)"))
        .withColumn("_start", F.pmod(start, F.col("_n")))
        .select(*by_source, "shard", "source_size", "target", "_passes", (F.col("_start") * F.col("block")).alias("_from"),
                ((F.col("_start") + F.col("_pick")) * F.col("block")).alias("_to"), ((F.col("_start") + F.col("_pick") - F.col("_n")) * F.col("block")).alias("_wrap"))
    )
    line = Window.partitionBy(*by_source, "shard").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt_out = base.join(few, by_source).withColumn("shard", shard_of("_h"))
    placed = dealt_out.withColumn("_end", F.sum("size").over(line)).join(plan, [*by_source, "shard"])
    return placed.withColumn("taken", F.expr(f"_passes * size + {_words_before('_end')} - {_words_before('(_end - size)')}"))


def _words_before(x: str) -> str:
    """SQL for the words of the chosen run of blocks, which may wrap around, before word ``x`` of a shard."""
    return f"(greatest(0, least({x}, _to) - _from) + least({x}, greatest(0, _wrap)))"


MIX_SQL = r"""
WITH base AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM {docs}),
a AS (SELECT doc_id, size, h, source IS NULL AS none, coalesce(source, '') AS source FROM base),
sources AS (SELECT none, source, CAST(sum(size) AS BIGINT) AS source_size FROM a GROUP BY ALL),
b AS (SELECT doc_id, size, h, none, source, substr(h, 1,
        CASE WHEN source_size <= 1048576 THEN 0 WHEN source_size <= 16777216 THEN 1 WHEN source_size <= 268435456 THEN 2 WHEN source_size <= 4294967296 THEN 3 ELSE 4 END) AS shard
      FROM a JOIN sources USING (none, source)),
cells AS (SELECT none, source, shard, CAST(sum(size) AS BIGINT) AS shard_size FROM b GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (ORDER BY none, source) AS rank FROM sources),
weighed AS (SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS most, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM ranked),
level AS (
  SELECT *, CAST(total - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lev FROM weighed),
aimed AS (
  SELECT none, source, source_size, rank, total, least(CAST(most AS DOUBLE), weight * max(lev) OVER ()) AS target,
         1 AS block FROM level),
seats AS (
  SELECT *, (2 * total + block) // (2 * block) AS seats, count(*) OVER () AS n, sum(target) OVER () AS w FROM aimed),
sure AS (SELECT *, CASE WHEN w > 0 THEN target / w ELSE 0 END AS share,
  CASE WHEN seats > count(*) OVER () THEN CAST(floor(CASE WHEN w > 0 THEN target / w ELSE 0 END * (seats - n) + 0.5) AS BIGINT) ELSE 0 END AS sure FROM seats),
tries AS (
  SELECT *, unnest(generate_series(0, CAST(ceil(share * 1.5 * n) AS BIGINT) + 2)) AS k FROM (SELECT *, seats - sum(sure) OVER () AS rest FROM sure)),
won AS (SELECT *, row_number() OVER (ORDER BY target / (2 * (sure + k) + 1) DESC, rank, k) AS place FROM tries),
quotas AS (SELECT none, source, source_size, target, block, CAST(max(sure) + sum(CASE WHEN place <= rest AND target > 0 THEN 1 ELSE 0 END) AS BIGINT) AS q FROM won GROUP BY ALL),
c1 AS (SELECT c.*, source_size, target, block, q, count(*) OVER (PARTITION BY c.none, c.source) AS n, CAST(sum(shard_size) OVER (PARTITION BY c.none, c.source) AS DOUBLE) AS w
       FROM cells c JOIN quotas USING (none, source)),
c2 AS (SELECT *, CASE WHEN w > 0 THEN shard_size / w ELSE 0 END AS share,
         CASE WHEN q > n THEN CAST(floor(CASE WHEN w > 0 THEN shard_size / w ELSE 0 END * (q - n) + 0.5) AS BIGINT) ELSE 0 END AS sure FROM c1),
c3 AS (SELECT *, unnest(generate_series(0, CAST(ceil(share * 1.5 * n) AS BIGINT) + 2)) AS k FROM (SELECT *, q - sum(sure) OVER (PARTITION BY none, source) AS rest FROM c2)),
c4 AS (SELECT *, row_number() OVER (PARTITION BY none, source ORDER BY shard_size / (2 * (sure + k) + 1) DESC, shard, k) AS place FROM c3),
dealt AS (
  SELECT none, source, shard, shard_size, source_size, target, block,
         CAST(max(sure) + sum(CASE WHEN place <= rest AND shard_size > 0 THEN 1 ELSE 0 END) AS BIGINT) AS quota FROM c4 GROUP BY ALL),
p1 AS (SELECT *, least(quota * block, 3 * shard_size) AS take, greatest((shard_size + block - 1) // block, 1) AS n,
         CAST('0x' || substr(md5('mix-1:' || source || ':' || shard), 1, 13) AS BIGINT) AS h FROM dealt),
p2 AS (SELECT *, coalesce(take // nullif(shard_size, 0), 0) AS passes, h % n AS start FROM p1),
plan AS (SELECT *, least((2 * (take - passes * shard_size) + block) // (2 * block), n) AS pick FROM p2),
line AS (SELECT *, CAST(sum(size) OVER (PARTITION BY none, source, shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS x FROM b),
ends AS (
  SELECT l.doc_id, l.size, l.x, l.x - l.size AS y, source_size, target, passes, start * block AS f, (start + pick) * block AS t, (start + pick - n) * block AS wrap
  FROM line l JOIN plan p USING (none, source, shard))
SELECT doc_id, size, source_size, target,
  CAST(passes * size + greatest(0, least(x, t) - f) + least(x, greatest(0, wrap)) - greatest(0, least(y, t) - f) - least(y, greatest(0, wrap)) AS BIGINT) AS taken FROM ends
"""
