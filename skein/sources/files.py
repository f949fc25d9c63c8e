"""Parquet, CSV and literal sources, CSV export, snapshots."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet scan; with ``columns`` only those reach the reader."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def column_names(spark: SparkSession, path: str) -> list[str]:
    return spark.read.parquet(path).columns


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet", columns)


def read_csv(spark: SparkSession, path: str, header: bool = True, schema: T.StructType | str | None = None, sep: str = ",") -> DataFrame:
    """A CSV scan.  Without a schema every column is text until all its values parse as whole numbers.

    That test is one distributed pass over the file; give a schema where the types are known.
    """
    reader = spark.read.option("header", header).option("sep", sep)
    if schema is not None:
        return reader.schema(schema).csv(path)
    text = reader.csv(path)
    whole = text.agg(*[F.coalesce(F.bool_and(F.col(c).rlike(r"^\s*[+-]?\d{1,18}\s*$")), F.lit(False)).alias(c) for c in text.columns]).first()
    return text.select(*[F.trim(F.col(c)).cast("long").alias(c) if whole[c] else F.col(c) for c in text.columns])


def star_schema(name: str) -> str:
    """The fixed schema of a table of the star-schema benchmark, for typed CSV reads."""
    return {
        "region": "r_regionkey INT, r_name STRING, r_comment STRING",
        "nation": "n_nationkey INT, n_name STRING, n_regionkey INT, n_comment STRING",
        "supplier": "s_suppkey BIGINT, s_name STRING, s_address STRING, s_nationkey INT, s_phone STRING, s_acctbal DOUBLE, s_comment STRING",
        "customer": "c_custkey BIGINT, c_name STRING, c_address STRING, c_nationkey INT, c_phone STRING, c_acctbal DOUBLE, c_mktsegment STRING, c_comment STRING",
        "part": "p_partkey BIGINT, p_name STRING, p_mfgr STRING, p_brand STRING, p_type STRING, p_size INT, p_container STRING, p_retailprice DOUBLE, p_comment STRING",
        "partsupp": "ps_partkey BIGINT, ps_suppkey BIGINT, ps_availqty INT, ps_supplycost DOUBLE, ps_comment STRING",
        "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate DATE, o_orderpriority STRING, o_clerk STRING, o_shippriority INT, o_comment STRING",
        "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate DATE, l_commitdate DATE, l_receiptdate DATE, l_shipinstruct STRING, l_shipmode STRING, l_comment STRING",
    }[name]


def read_star_csv(spark: SparkSession, path: str, name: str, sep: str = "|") -> DataFrame:
    return read_csv(spark, path, header=False, schema=star_schema(name), sep=sep)


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Literal rows as a table."""
    return spark.createDataFrame(rows, schema)


def one_row(spark: SparkSession) -> DataFrame:
    """The row source of a SELECT without FROM."""
    return spark.range(1).select()


def _resolved(path: str) -> str:
    """``path`` without dots; the scheme and host of a URI stay as they are."""
    scheme, mark, rest = path.partition("://")
    return scheme + mark + posixpath.normpath(rest) if mark else posixpath.normpath(path)


def allowed(path: str, folders: tuple[str, ...]) -> str:
    """``path`` if it lies in one of ``folders`` once its dots are resolved; else an error."""
    clean = _resolved(path)
    if not any(clean == f or clean.startswith(f.rstrip("/") + "/") for f in map(_resolved, folders)):
        raise PermissionError(f"{path} is outside the folders that COPY and BACKUP may use")
    return clean


def copy_to(df: DataFrame, path: str) -> int:
    """Write CSV part files with a header; returns the rows written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("header", True).csv(path)
    return seen.get["n"]


def copy_from(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read what :func:`copy_to` wrote, typed by ``schema``."""
    return read_csv(spark, path, header=True, schema=schema)


def save_snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    """A Parquet copy of each table."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_snapshot(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
