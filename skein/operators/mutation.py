"""Table mutation as functions from DataFrame to DataFrame, and constraint checks as queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` appended by name; columns they lack are NULL, types follow the table."""
    fitted = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema])
    return table.unionByName(fitted)


def update(table: DataFrame, values: dict[str, Column], where: Column | None = None) -> DataFrame:
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return table.select(*[F.when(hit, values[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in values else F.col(f.name) for f in table.schema])


def delete(table: DataFrame, where: Column | None = None) -> DataFrame:
    """Rows where the condition is not true; an unknown condition keeps the row."""
    return table.limit(0) if where is None else table.where(~F.coalesce(where, F.lit(False)))


def one_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows``, but reading them fails if two have the same keys (none of them NULL): they would change one row twice."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    counted = rows.withColumn("_same", F.count("*").over(Window.partitionBy(*keys)))
    alone = F.assert_true((F.col("_same") == 1) | ~known, F.lit(f"several rows with the same {', '.join(keys)} change one row"))
    return counted.where(alone.isNull()).drop("_same")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], replace: bool = True) -> DataFrame:
    """INSERT with ON CONFLICT on ``keys``: existing rows are replaced (given columns only) or left.

    Of new rows with the same keys one is inserted if conflicts are left alone; if they replace, the change fails.
    """
    if not replace:
        fresh = rows.join(table.select(*keys), keys, "left_anti")
        known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        return insert(table, fresh.where(known).dropDuplicates(keys).unionByName(fresh.where(~known)))
    rows = one_each(rows, keys)
    fresh = rows.join(table.select(*keys), keys, "left_anti")
    given = [c for c in rows.columns if c not in keys]
    new = rows.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in given], F.lit(True).alias("_hit"))
    kept = table.join(new, keys, "left")
    changed = kept.select(*[F.when(F.col("_hit"), F.col(f"_new_{f.name}").cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in given else F.col(f.name) for f in table.schema])
    return insert(changed, fresh)


def merge(table: DataFrame, source: DataFrame, keys: list[str], update_set: dict[str, str] | None = None, delete_when: str | None = None, insert_new: bool = True, delete_missing: bool = False) -> DataFrame:
    """MERGE on equal ``keys`` as one full outer join.

    ``update_set`` maps table columns to SQL over ``t.`` and ``s.`` columns; ``delete_when`` is such a condition
    for matched rows.  Several rows of ``source`` with the same keys make it fail.
    """
    source = one_each(source, keys)
    t = table.withColumn("_in_t", F.lit(True)).alias("t")
    s = source.withColumn("_in_s", F.lit(True)).alias("s")
    both = t.join(s, reduce(lambda a, b: a & b, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]), "full")
    matched, new, old = F.col("_in_t") & F.col("_in_s"), F.col("_in_t").isNull(), F.col("_in_s").isNull()
    keep = F.lit(True) if insert_new else ~new
    if delete_when:
        keep = keep & ~F.coalesce(matched & F.expr(delete_when), F.lit(False))
    if delete_missing:
        keep = keep & ~old
    out = []
    for f in table.schema:
        own = F.col(f"t.{f.name}")
        value = F.when(matched, F.expr(update_set[f.name]).cast(f.dataType)).otherwise(own) if update_set and f.name in update_set else own
        there = F.col(f"s.{f.name}").cast(f.dataType) if f.name in source.columns else F.lit(None).cast(f.dataType)
        out.append(F.when(new, there).otherwise(value).alias(f.name))
    return both.where(keep).select(*out)


def null_violations(table: DataFrame, columns: list[str]) -> DataFrame:
    return table.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def unique_violations(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): values that occur more than once; NULLs never collide."""
    known = table.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    return known.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def check_violations(table: DataFrame, condition: str) -> DataFrame:
    """Rows for which the condition is false; unknown passes."""
    return table.where(~F.expr(condition))


def foreign_key_violations(child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str]) -> DataFrame:
    known = child.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))
    keys = parent.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(parent_columns)])
    return known.join(keys, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(columns)]), "left_anti")
