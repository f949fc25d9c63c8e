"""JSON functions as SQL functions of a session, and the ones that need a rewrite of the document."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Registered in each engine session; inlined by the analyser, so they run in generated code.
SQL_FUNCTIONS = {
    "json_value": "(doc STRING, path STRING) RETURNS STRING RETURN CASE WHEN left(ltrim(get_json_object(doc, path)), 1) NOT IN ('{', '[') THEN get_json_object(doc, path) END",
    "json_query": "(doc STRING, path STRING) RETURNS STRING RETURN CASE WHEN left(ltrim(get_json_object(doc, path)), 1) IN ('{', '[') THEN get_json_object(doc, path) END",
    "isjson": "(doc STRING) RETURNS BOOLEAN RETURN doc IS NOT NULL AND try_parse_json(doc) IS NOT NULL",
    "json_path_exists": "(doc STRING, path STRING) RETURNS BOOLEAN RETURN try_variant_get(try_parse_json(doc), path) IS NOT NULL",
}


def register(spark: SparkSession) -> None:
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    spark.udf.register("json_modify", json_modify)


def json_value(doc: Column, path: str) -> Column:
    """The scalar at ``path`` as text; NULL for objects and arrays."""
    found = F.get_json_object(doc, path)
    return F.when(~F.ltrim(found).substr(1, 1).isin("{", "["), found)


def json_query(doc: Column, path: str) -> Column:
    """The object or array at ``path``; NULL for scalars."""
    found = F.get_json_object(doc, path)
    return F.when(F.ltrim(found).substr(1, 1).isin("{", "["), found)


def is_json(doc: Column) -> Column:
    return doc.isNotNull() & F.try_parse_json(doc).isNotNull()


def path_exists(doc: Column, path: str) -> Column:
    """Whether the path is there; a JSON null counts."""
    return F.try_variant_get(F.try_parse_json(doc), path, "variant").isNotNull()


def steps(path: str) -> list[str | int]:
    """``$.a.b[0]`` as keys and indexes."""
    return [int(i) if i else k for k, i in re.findall(r"\.([^.\[\]]+)|\[(\d+)\]", path)]


def modify(doc: str | None, path: str, value: str | None) -> str | None:
    """Set, append (path begins with ``append``) or, for a missing value, delete."""
    if doc is None:
        return None
    append = path.startswith("append ")
    try:
        root = json.loads(doc)
    except ValueError:
        return None
    keys = steps(path.removeprefix("append "))
    at = root
    for k in keys[:-1]:
        try:
            at = at[k]
        except (KeyError, IndexError, TypeError):
            return doc
    try:
        new = json.loads(value) if value is not None and value[:1] in "{[" else value
    except ValueError:
        new = value
    last = keys[-1] if keys else None
    try:
        if append:
            at[last].append(new)
        elif value is None:
            del at[last]
        else:
            at[last] = new
    except (KeyError, IndexError, TypeError, AttributeError):
        return doc
    return json.dumps(root, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(T.StringType())
def json_modify(doc: pd.Series, path: pd.Series, value: pd.Series) -> pd.Series:
    return pd.Series([modify(d, p, v) for d, p, v in zip(doc, path, value, strict=True)])


def open_json(df: DataFrame, column: str) -> DataFrame:
    """(.., key, value, type) per member of an object or array: types 0 null, 1 text, 2 number, 3 boolean, 4 array, 5 object."""
    v = F.try_parse_json(F.col(column))
    keep = [c for c in df.columns if c != column]
    parts = _explode(df.select(*keep, v.alias("_v")), keep)
    kind = F.schema_of_variant("value")
    number = F.when(kind == "VOID", 0).when(kind == "STRING", 1).when(kind == "BOOLEAN", 3).when(kind.startswith("ARRAY"), 4).when(kind.startswith("OBJECT"), 5).otherwise(2)
    text = F.when(kind == "STRING", F.variant_get("value", "$", "string")).otherwise(F.to_json("value"))
    return parts.select(*keep, F.coalesce("key", F.col("pos").cast("string")).alias("key"), F.when(kind != "VOID", text).alias("value"), number.cast("int").alias("type"))


def _explode(df: DataFrame, keep: list[str]) -> DataFrame:
    view = "_skein_open_json"
    df.createOrReplaceTempView(view)
    names = "".join(f"t.`{c}`, " for c in keep)
    return df.sparkSession.sql(f"SELECT {names}e.pos, e.key, e.value FROM {view} t, LATERAL variant_explode(t._v) e")


def open_json_with(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Columns of ``schema`` from an object, or a row per element of an array of objects."""
    keep = [c for c in df.columns if c != column]
    doc = F.when(F.ltrim(F.col(column)).startswith("["), F.col(column)).otherwise(F.concat(F.lit("["), F.col(column), F.lit("]")))
    return df.select(*keep, F.inline(F.from_json(doc, f"array<struct<{schema}>>")))


def for_json(df: DataFrame, order: str) -> DataFrame:
    """All rows as one JSON array of objects (a report: its size is the table's)."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*df.columns).alias("r"))))
    return df.agg(F.to_json(F.transform(pairs, lambda x: x["r"])).alias("json"))
