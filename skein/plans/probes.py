"""Registry: one query per operator of the engine, with its SQL oracle where SQL can express it.

``sql`` probes go through the dialect's :class:`Engine`; ``@probe`` ones use the DataFrame operators.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from skein.functions import json_functions, scalar
from skein.operators import approximate, grouping, joins, mutation, similarity, temporal
from skein.plans import clicks, tpch
from skein.plans.engine import Engine
from skein.sources import files
from skein.sources.storage import scratch, shared_dir
from skein.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_ENGINES: dict[tuple[str, str], Engine] = {}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """One engine per application and data directory, so that tables are opened once."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _ENGINES:
        _ENGINES[key] = Engine(spark).attach(sf_dir)
    return _ENGINES[key]


def sql(name: str, text: str, oracle: str | None = None, args: list | None = None) -> None:
    """A query of the dialect; the oracle runs the same text unless told otherwise ("" for none)."""
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir).execute(text, args)
    if oracle != "":
        SQL[name] = oracle or text


def probe(oracle: str | None = None):
    """Register a function over (table, spark, sf_dir); ``table`` opens a table by name."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name, *columns: files.read_table(spark, sf_dir, name, list(columns) or None), spark, sf_dir)

        QUERIES[f.__name__] = run
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


# -- scans, sources, sinks ----------------------------------------------------------------------------

sql("q1_pricing", tpch.QUERIES["tpch_q01"])


@probe("SELECT * FROM nation")
def scan_parquet(t, spark, sf_dir):
    return t("nation")


@probe("SELECT o_orderkey, o_totalprice FROM orders")
def scan_projection(t, spark, sf_dir):
    return t("orders", "o_orderkey", "o_totalprice")


@probe("SELECT o_orderkey AS k, o_custkey AS v FROM orders")
def scan_csv(t, spark, sf_dir):
    path = f"{shared_dir(spark)}/skein-csv-{abs(hash(sf_dir))}"
    t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v")).write.mode("overwrite").option("header", True).csv(path)
    return files.read_csv(spark, path)


@probe("SELECT * FROM supplier")
def copy_roundtrip(t, spark, sf_dir):
    path = f"{shared_dir(spark)}/skein-copy-{abs(hash(sf_dir))}"
    files.copy_to(t("supplier"), path)
    return files.copy_from(spark, path, t("supplier").schema)


@probe("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_typed_csv(t, spark, sf_dir):
    path = f"{shared_dir(spark)}/skein-star-{abs(hash(sf_dir))}"
    t("nation").select("n_nationkey", "n_name", "n_regionkey", F.lit("").alias("n_comment")).write.mode("overwrite").option("sep", "|").csv(path)
    return files.read_star_csv(spark, path, "nation").drop("n_comment")


sql("select_literal", "SELECT 1 AS one, 'a' AS letter, 2.5 + 1 AS number", "SELECT 1 AS one, 'a' AS letter, CAST(3.5 AS DECIMAL(3, 1)) AS number")
sql("values_rows", "SELECT id, name FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS v(id, name)")

# -- projection, filters, predicates ------------------------------------------------------------------

sql("project_expr", "SELECT l_orderkey, l_linenumber AS line, ROUND(l_extendedprice * (1 - l_discount), 4) AS net, lineitem.l_tax FROM lineitem")
sql("select_star", "SELECT * FROM region")
sql("filter_basic", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
for _name, _op in {"eq": "=", "ne": "<>", "lt": "<", "gt": ">", "le": "<=", "ge": ">="}.items():
    sql(f"filter_cmp_{_name}", f"SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity {_op} 25")
sql("filter_cmp", "SELECT COUNT(*) AS n FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 40 AND l_linenumber <> 3 AND l_tax <= 0.05")
sql("filter_string_range", "SELECT p_partkey, p_name FROM part WHERE p_name > 'c' AND p_name <= 'h'")
sql("filter_bool", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'P') AND NOT o_orderpriority = '1-URGENT'")
sql("like_prefix", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'PROMO%'")
sql("like_contains", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%wid%'")
sql("like_underscore", "SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#1_'")
sql("not_like", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT LIKE '%A%'")
sql("filter_between", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal BETWEEN 0 AND 5000")
sql("filter_not_between", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal NOT BETWEEN 0 AND 5000")
sql("filter_in", "SELECT n_nationkey, n_name FROM nation WHERE n_name IN ('NATION_1', 'NATION_5', 'NATION_24')")
sql("filter_not_in", "SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (0, 2)")
sql("filter_multi", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 10 AND l_discount < 0.05 AND l_returnflag = 'R'")
sql("is_null", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000 WHERE o_orderkey IS NULL")
sql("is_not_null", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 WHERE o_orderkey IS NOT NULL")
sql("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders")
sql("case_no_else", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'one' END AS r FROM nation")
sql("in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
sql("not_in_subquery", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
sql("exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
sql("not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
sql("exists_neq", "SELECT l_orderkey, l_suppkey FROM lineitem AS a WHERE EXISTS (SELECT 1 FROM lineitem AS b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey AND b.l_quantity > 45)")
sql("scalar_subquery", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.5 FROM orders)")
sql("corr_scalar_subquery", "SELECT p_partkey, p_retailprice FROM part AS p WHERE p_retailprice > (SELECT AVG(q.p_retailprice) FROM part AS q WHERE q.p_brand = p.p_brand)")


@probe("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT CASE WHEN n_nationkey > 20 THEN NULL ELSE n_nationkey END FROM nation)")
def not_in_null_aware(t, spark, sf_dir):
    keys = t("nation").select(F.when(F.col("n_nationkey") <= 20, F.col("n_nationkey")).alias("k"))
    return joins.not_in(t("supplier", "s_suppkey", "s_nationkey"), "s_nationkey", keys, "k").select("s_suppkey")


#: The oracle's pattern in two halves, as its integers have a sign.
SIGNS = ["CAST(" + " + ".join(f"CASE WHEN embedding[{32 * half + i + 1}] > 0 THEN {1 << i} ELSE 0 END" for i in range(32)) + " AS BIGINT)" for half in (0, 1)]
TARGET = 0x5A5A5A5A5A5A5A5A


@probe(f"SELECT vec_id, label FROM (SELECT vec_id, label, {SIGNS[0]} AS low, {SIGNS[1]} AS high FROM embeddings) AS e WHERE bit_count(xor(low, {TARGET & 0xFFFFFFFF})) + bit_count(xor(high, {TARGET >> 32})) <= 26")
def hamming_filter(t, spark, sf_dir):
    bits = t("embeddings").select("vec_id", "label", similarity.sign_bits(F.col("embedding")).alias("bits"))
    return similarity.within_hamming(bits, "bits", TARGET, 26).drop("bits")


# -- joins --------------------------------------------------------------------------------------------

sql("join_inner", "SELECT o_orderkey, c_name FROM orders INNER JOIN customer ON o_custkey = c_custkey")
sql("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT OUTER JOIN (SELECT * FROM orders WHERE o_orderdate >= DATE '1998-01-01') AS o ON c_custkey = o_custkey")
sql("join_right", "SELECT o_orderkey, c_custkey FROM (SELECT * FROM orders WHERE o_totalprice > 350000) AS o RIGHT OUTER JOIN customer ON o_custkey = c_custkey")
sql("join_full", "SELECT a.k AS ak, b.k AS bk FROM (SELECT n_nationkey AS k FROM nation WHERE n_regionkey < 3) AS a FULL OUTER JOIN (SELECT n_nationkey AS k FROM nation WHERE n_regionkey > 1) AS b ON a.k = b.k")
sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql("join_implicit_multi", "SELECT n_name, COUNT(*) AS n FROM customer, orders, nation, region WHERE c_custkey = o_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE' GROUP BY n_name")
sql("join_or_common", tpch.QUERIES["tpch_q19"])
sql("join_self", "SELECT a.n_name AS x, b.n_name AS y FROM nation AS a, nation AS b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql("derived_table", "SELECT band, COUNT(*) AS n FROM (SELECT CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS band FROM orders) AS x GROUP BY band")
sql("join_theta", "SELECT r.r_name, n.n_name FROM region AS r JOIN nation AS n ON n.n_regionkey > r.r_regionkey")
sql("join_using", "SELECT id, x, y FROM (SELECT n_nationkey AS id, n_name AS x FROM nation) AS a JOIN (SELECT s_nationkey AS id, s_name AS y FROM supplier) AS b USING (id)")


@probe("SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'")
def join_semi(t, spark, sf_dir):
    return joins.semi_join(t("customer", "c_custkey"), t("orders").where("o_orderpriority = '1-URGENT'"), [("c_custkey", "o_custkey")])


@probe("SELECT c_custkey FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') AS o ON c_custkey = o_custkey")
def join_anti(t, spark, sf_dir):
    return joins.anti_join(t("customer", "c_custkey"), t("orders").where("o_orderpriority = '1-URGENT'"), [("c_custkey", "o_custkey")])


@probe("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > c_acctbal * 50")
def join_left_residual(t, spark, sf_dir):
    c, o = t("customer"), t("orders")
    return joins.equi_join(c, o, [("c_custkey", "o_custkey")], "left", o.o_totalprice > c.c_acctbal * 50).select("c_custkey", "o_orderkey")


@probe("SELECT c_nationkey AS key FROM customer INTERSECT SELECT s_nationkey FROM supplier INTERSECT SELECT n_nationkey FROM nation WHERE n_regionkey < 3")
def multiway_intersect(t, spark, sf_dir):
    return joins.intersect_keys([(t("customer"), "c_nationkey"), (t("supplier"), "s_nationkey"), (t("nation").where("n_regionkey < 3"), "n_nationkey")])


@probe("SELECT o_orderkey, lo FROM orders JOIN (SELECT n_nationkey * 1000 AS lo, n_nationkey * 1000 + 400 AS hi FROM nation) AS r ON o_orderkey >= lo AND o_orderkey < hi")
def join_range(t, spark, sf_dir):
    ranges = t("nation").select((F.col("n_nationkey") * 1000).alias("lo"), (F.col("n_nationkey") * 1000 + 400).alias("hi"))
    return joins.range_join(t("orders", "o_orderkey"), "o_orderkey", ranges, "lo", "hi", 400).select("o_orderkey", "lo")


@probe("""SELECT p.event_id, (SELECT max_by(c.event_id, (c.ts, c.event_id)) FROM events c WHERE c.event_type = 'click' AND c.user_id = p.user_id AND c.ts <= p.ts) AS last_click FROM events p WHERE p.event_type = 'purchase'""")
def join_as_of(t, spark, sf_dir):
    e = t("events", "event_id", "ts", "user_id", "event_type")
    clicked = e.where("event_type = 'click'").select("user_id", F.struct("ts", "event_id").alias("at"), F.col("event_id").alias("last_click"))
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", F.struct("ts", F.lit(1 << 62).cast("long").alias("event_id")).alias("at"))
    return joins.as_of_join(bought, clicked, ["user_id"], "at", "at", ["last_click"]).select("event_id", "last_click")


@probe("SELECT event_id, n_name FROM events JOIN nation ON user_id % 25 = n_nationkey")
def join_salted(t, spark, sf_dir):
    e = t("events").select("event_id", (F.col("user_id") % 25).cast("int").alias("n_nationkey"))
    return joins.salted_join(e, t("nation", "n_nationkey", "n_name"), "n_nationkey", 4).select("event_id", "n_name")


# -- aggregation --------------------------------------------------------------------------------------

sql("agg_count", "SELECT COUNT(*) AS n FROM lineitem")
sql("agg_count_col", "SELECT COUNT(o_orderkey) AS n, COUNT(*) AS all_rows FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
sql("agg_count_distinct", "SELECT COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_suppkey) AS supps FROM lineitem")
sql("agg_sum", "SELECT CAST(SUM(o_custkey) AS BIGINT) AS s, ROUND(SUM(o_totalprice), 2) AS t FROM orders")
sql("agg_sum_expr", "SELECT ROUND(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS s FROM lineitem")
sql("agg_avg", "SELECT ROUND(AVG(l_quantity), 6) AS q, ROUND(AVG(l_linenumber), 6) AS l FROM lineitem")
sql("agg_min_max", "SELECT MIN(p_retailprice) AS lo, MAX(p_retailprice) AS hi, MIN(p_name) AS first, MAX(p_name) AS last FROM part")
sql("agg_sum_distinct", "SELECT CAST(SUM(DISTINCT p_size) AS BIGINT) AS s, ROUND(AVG(DISTINCT p_size), 6) AS a, MIN(DISTINCT p_size) AS lo FROM part")
sql("agg_multi", "SELECT COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS s, ROUND(AVG(o_totalprice), 4) AS a, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders")
sql("agg_ratio", "SELECT ROUND(100.0 * SUM(l_discount) / SUM(l_tax), 6) AS r FROM lineitem")
sql("agg_case", "SELECT CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned, ROUND(SUM(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 2) AS open_qty FROM lineitem")
sql("agg_empty", "SELECT COUNT(*) AS n, SUM(o_totalprice) AS s, MIN(o_totalprice) AS lo FROM orders WHERE o_totalprice < 0")
sql("agg_extra", "SELECT ROUND(STDDEV_SAMP(l_quantity), 6) AS sd, ROUND(VAR_POP(l_quantity), 6) AS vp, ROUND(CORR(l_quantity, l_extendedprice), 6) AS c, MEDIAN(l_quantity) AS m FROM lineitem")
sql("group_single", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey")
sql("group_multi", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus")
sql("group_string", "SELECT c_mktsegment, COUNT(*) AS n, ROUND(AVG(c_acctbal), 4) AS a FROM customer GROUP BY c_mktsegment")
sql("group_expr", "SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS y, SUBSTR(o_orderpriority, 1, 1) AS p, COUNT(*) AS n FROM orders GROUP BY EXTRACT(YEAR FROM o_orderdate), SUBSTR(o_orderpriority, 1, 1)")
sql("group_ordinal", "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1")
sql("having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12")
sql("having_subquery", "SELECT l_suppkey, ROUND(SUM(l_quantity), 2) AS q FROM lineitem GROUP BY l_suppkey HAVING SUM(l_quantity) > (SELECT SUM(l_quantity) / COUNT(DISTINCT l_suppkey) FROM lineitem)")
sql("distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
sql("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
sql("count_of_distinct", "SELECT COUNT(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) AS d")
sql("group_order", "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY n DESC, o_orderpriority")

_SETS = "SELECT l_returnflag, l_linestatus, CAST(SUM(l_linenumber) AS BIGINT) AS s, CAST(GROUPING(l_returnflag, l_linestatus) AS BIGINT) AS grouping_id FROM lineitem GROUP BY {}"


@probe(_SETS.format("GROUPING SETS ((l_returnflag), (l_linestatus), ())"))
def grouping_sets(t, spark, sf_dir):
    out = grouping.grouping_sets(t("lineitem"), [["l_returnflag"], ["l_linestatus"], []], ["l_returnflag", "l_linestatus"], F.sum("l_linenumber").alias("s"))
    return out.select("l_returnflag", "l_linestatus", "s", "grouping_id")


@probe(_SETS.format("CUBE (l_returnflag, l_linestatus)"))
def cube(t, spark, sf_dir):
    return grouping.cube(t("lineitem"), ["l_returnflag", "l_linestatus"], F.sum("l_linenumber").alias("s"))


@probe(_SETS.format("ROLLUP (l_returnflag, l_linestatus)"))
def rollup(t, spark, sf_dir):
    return grouping.rollup(t("lineitem"), ["l_returnflag", "l_linestatus"], F.sum("l_linenumber").alias("s"))


@probe("SELECT l_returnflag, ROUND(SUM(l_quantity) FILTER (l_linestatus = 'O'), 2) AS \"O\", ROUND(SUM(l_quantity) FILTER (l_linestatus = 'F'), 2) AS \"F\" FROM lineitem GROUP BY l_returnflag")
def pivot_sum(t, spark, sf_dir):
    return grouping.pivot(t("lineitem"), ["l_returnflag"], "l_linestatus", ["O", "F"], F.round(F.sum("l_quantity"), 2))


@probe("SELECT n_regionkey, nullif(COUNT(*) FILTER (n_nationkey % 3 = 0), 0) AS \"0\", nullif(COUNT(*) FILTER (n_nationkey % 3 = 1), 0) AS \"1\", nullif(COUNT(*) FILTER (n_nationkey % 3 = 2), 0) AS \"2\" FROM nation GROUP BY n_regionkey")
def pivot_count(t, spark, sf_dir):
    return grouping.pivot(t("nation").withColumn("m", F.col("n_nationkey") % 3), ["n_regionkey"], "m", [0, 1, 2], F.count("n_name"))


sql(
    "pivot_avg_min_max",
    "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_tax FROM lineitem) AS x PIVOT (ROUND(AVG(l_tax), 6) AS a, MIN(l_tax) AS lo, MAX(l_tax) AS hi FOR l_linestatus IN ('O', 'F'))",
    "SELECT l_returnflag, " + ", ".join(f"ROUND(AVG(l_tax) FILTER (l_linestatus = '{s}'), 6) AS \"{s}_a\", MIN(l_tax) FILTER (l_linestatus = '{s}') AS \"{s}_lo\", MAX(l_tax) FILTER (l_linestatus = '{s}') AS \"{s}_hi\"" for s in "OF") + " FROM lineitem GROUP BY l_returnflag",
)


@probe("SELECT s_suppkey, 'nation' AS field, s_nationkey::BIGINT AS value FROM supplier UNION ALL SELECT s_suppkey, 'double_key', s_suppkey * 2 FROM supplier")
def unpivot(t, spark, sf_dir):
    wide = t("supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("nation"), (F.col("s_suppkey") * 2).alias("double_key"))
    return grouping.unpivot(wide, ["s_suppkey"], ["nation", "double_key"], "field", "value")


#: Sketches are held to five of their relative standard errors.
WITHIN = 5


def _near(estimate: str, exact: str, error: float):
    return (F.abs(F.col(estimate) - F.col(exact)) <= WITHIN * error * F.col(exact)).alias("within")


@probe("SELECT unnest(['orders', 'parts']) AS what, TRUE AS within")
def agg_approx_distinct(t, spark, sf_dir):
    """Whether estimates of distinct counts are within their bound.

    Each estimate has an aggregate of its own: beside a distinct count, Spark keeps a whole sketch per value.
    """
    lines = t("lineitem")

    def one(what, c):
        exact = lines.agg(F.count_distinct(c).alias("x"))
        return lines.agg(approximate.approx_distinct(c).alias("e")).join(F.broadcast(exact), F.lit(True)).select(F.lit(what).alias("what"), _near("e", "x", approximate.HLL_ERROR))

    return one("parts", "l_partkey").unionByName(one("orders", "l_orderkey"))


@probe("SELECT l_returnflag, TRUE AS within FROM lineitem GROUP BY l_returnflag")
def agg_merged_sketches(t, spark, sf_dir):
    """Whether merged sketches of parts by flag and status give the parts by flag."""
    lines = t("lineitem")
    merged = approximate.merge_sketches(approximate.distinct_sketch(lines, ["l_returnflag", "l_linestatus"], "l_partkey"), ["l_returnflag"])
    exact = lines.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("x"))
    return merged.join(exact, "l_returnflag").select("l_returnflag", _near("n_distinct", "x", approximate.HLL_ERROR))


@probe("SELECT l_linenumber, TRUE AS within FROM lineitem GROUP BY l_linenumber")
def agg_count_min(t, spark, sf_dir):
    """Whether the sketch's counts are not below the true ones and not above them by more than its share of all rows."""
    lines = t("lineitem")
    exact = lines.groupBy("l_linenumber").agg(F.count("*").alias("x"))
    values = [r.l_linenumber for r in exact.select("l_linenumber").collect()]  # a handful
    found = approximate.count_min_estimates(approximate.count_min(lines, "l_linenumber"), values, "l_linenumber")
    rows = lines.agg(F.count("*").alias("n"))
    return exact.join(found, "l_linenumber").join(F.broadcast(rows), F.lit(True)).select("l_linenumber", F.col("estimate").between(F.col("x"), F.col("x") + 0.001 * F.col("n")).alias("within"))


@probe("SELECT TRUE AS within")
def approx_avg(t, spark, sf_dir):
    """Whether a mean that is asked for within 0.5 is that near."""
    found = engine(spark, sf_dir).execute("SELECT AVG(l_quantity) AS q APPROXIMATE WITHIN 0.5 CONFIDENCE 0.95 FROM lineitem").first().q
    return t("lineitem").agg((F.abs(F.avg("l_quantity") - found) <= 0.5).alias("within"))


@probe("SELECT TRUE AS within")
def approx_hll_using(t, spark, sf_dir):
    found = engine(spark, sf_dir).execute("SELECT COUNT(DISTINCT l_partkey) AS n FROM lineitem USING HYPERLOGLOG")
    return found.join(F.broadcast(t("lineitem").agg(F.count_distinct("l_partkey").alias("x"))), F.lit(True)).select(_near("n", "x", approximate.HLL_ERROR))


@probe("SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS low, quantile_cont(l_quantity, 0.9) AS high FROM lineitem GROUP BY l_returnflag")
def agg_percentile(t, spark, sf_dir):
    return t("lineitem").groupBy("l_returnflag").agg(F.percentile("l_quantity", 0.25).alias("low"), F.percentile("l_quantity", 0.9).alias("high"))


@probe("SELECT TRUE AS within")
def agg_approx_percentile(t, spark, sf_dir):
    """Whether an approximate percentile has its rank within a thousandth."""
    lines = t("lineitem")
    found = lines.agg(F.approx_percentile("l_extendedprice", 0.75, 10_000).alias("p")).first().p
    return lines.agg((F.abs(F.avg((F.col("l_extendedprice") <= found).cast("double")) - 0.75) <= 0.001).alias("within"))


sql("agg_string_agg", "SELECT n_regionkey, LISTAGG(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql("agg_array_agg", "SELECT n_regionkey, ARRAY_JOIN(SORT_ARRAY(COLLECT_LIST(n_nationkey)), '-') AS keys FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(array_agg(n_nationkey)), '-') AS keys FROM nation GROUP BY n_regionkey")
sql("fn_text", "SELECT c_custkey, UPPER(c_mktsegment) AS u, LOWER(c_name) AS l, LENGTH(c_name) AS n, REPLACE(c_name, 'Customer', 'C') AS r, TRIM('  x ') AS t FROM customer")
sql("fn_null", "SELECT c_custkey, COALESCE(NULLIF(c_mktsegment, 'BUILDING'), 'none') AS seg, ROUND(ABS(c_acctbal), 1) AS a FROM customer")
sql("fn_date_trunc", "SELECT CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS month, COUNT(*) AS n FROM orders GROUP BY CAST(DATE_TRUNC('month', o_orderdate) AS DATE)")
sql("fn_regexp", "SELECT c_custkey, REGEXP_REPLACE(c_name, '[0-9]+', 'N') AS masked FROM customer WHERE REGEXP_LIKE(c_name, '7$')", "SELECT c_custkey, regexp_replace(c_name, '[0-9]+', 'N') AS masked FROM customer WHERE regexp_matches(c_name, '7$')")
sql("extensions_ignored", "SELECT COUNT(*) AS n FROM orders TIER L3 CONSISTENCY STRONG MEMORY BUDGET 1000000 ENERGY BUDGET 5 JOULES", "SELECT COUNT(*) AS n FROM orders")

# -- windows ------------------------------------------------------------------------------------------

_O = "PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey"
sql("win_row_number", f"SELECT o_orderkey, CAST(ROW_NUMBER() OVER ({_O}) AS BIGINT) AS n FROM orders")
sql("win_rank", "SELECT event_id, CAST(RANK() OVER (PARTITION BY event_type ORDER BY user_id) AS BIGINT) AS r FROM events")
sql("win_dense_rank", "SELECT event_id, CAST(DENSE_RANK() OVER (PARTITION BY event_type ORDER BY user_id) AS BIGINT) AS r FROM events")
sql("win_running_sum", "SELECT event_id, CAST(SUM(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM events")
sql("win_count", "SELECT event_id, COUNT(*) OVER (PARTITION BY event_type) AS n, COUNT(*) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM events")
sql("win_lag", f"SELECT o_orderkey, LAG(o_orderkey, 1, -1) OVER ({_O}) AS x FROM orders", f"SELECT o_orderkey, LAG(o_orderkey, 1, CAST(-1 AS BIGINT)) OVER ({_O}) AS x FROM orders")
sql("win_lead", f"SELECT o_orderkey, LEAD(o_orderkey, 2) OVER ({_O}) AS x FROM orders")
sql("win_first_value", f"SELECT o_orderkey, FIRST_VALUE(o_totalprice) OVER ({_O}) AS x FROM orders")
sql("win_multi_key", "SELECT o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey ASC) AS BIGINT) AS n FROM orders")
sql("win_frame_rows", "SELECT event_id, CAST(SUM(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM events")
sql("win_frame_range", "SELECT event_id, COUNT(*) OVER (PARTITION BY event_type ORDER BY user_id RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM events")
sql("win_extra", f"SELECT o_orderkey, NTILE(3) OVER ({_O}) AS t, LAST_VALUE(o_orderkey) OVER ({_O} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, MAX(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders", f"SELECT o_orderkey, CAST(NTILE(3) OVER ({_O}) AS INT) AS t, LAST_VALUE(o_orderkey) OVER ({_O} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, MAX(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders")

# -- sort, limit --------------------------------------------------------------------------------------

sql("sort_multi", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey DESC, o_totalprice + 0, o_orderkey")
sql("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
sql("limit_topk", "SELECT event_id FROM events ORDER BY event_id LIMIT 7")
sql("offset", "SELECT event_id FROM events ORDER BY event_id LIMIT 5 OFFSET 10")
sql("fetch_first", "SELECT event_id FROM events ORDER BY event_id OFFSET 3 ROWS FETCH FIRST 4 ROWS ONLY", "SELECT event_id FROM events ORDER BY event_id LIMIT 4 OFFSET 3")
sql("sort_nulls", "SELECT c_custkey, x FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS x FROM customer) AS c ORDER BY x DESC NULLS LAST, c_custkey")
sql("sort_string", "SELECT p_name, p_partkey FROM part ORDER BY p_name, p_partkey DESC")

# -- sets, common table expressions, views ----------------------------------------------------------------

sql("union_all", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT s_nationkey FROM supplier")
sql("union", "SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey FROM supplier")
sql("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
sql("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
sql("except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
sql("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
sql("set_precedence", "SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 0 UNION SELECT n_nationkey FROM nation INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000")
sql("cte", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000) SELECT o_orderstatus, COUNT(*) AS n FROM big GROUP BY o_orderstatus")
sql("cte_multi", "WITH a AS (SELECT c_custkey, c_nationkey FROM customer), b (nk, n) AS (SELECT c_nationkey, COUNT(*) FROM a GROUP BY c_nationkey) SELECT n_name, n FROM b JOIN nation ON nk = n_nationkey")
sql("cte_recursive", "WITH RECURSIVE s AS (SELECT n_nationkey AS k, 0 AS depth FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n_nationkey, depth + 1 FROM nation JOIN s ON n_nationkey = k * 2 + 1 OR n_nationkey = k * 2 + 2) SELECT k, depth FROM s")
sql("cte_recursive_limit", "WITH RECURSIVE s AS (SELECT 1 AS x UNION ALL SELECT x + 1 FROM s) SELECT x FROM s OPTION (MAXRECURSION 8)", "WITH RECURSIVE s AS (SELECT 1 AS x UNION ALL SELECT x + 1 FROM s WHERE x < 9) SELECT x FROM s")


def _script(name: str, statements: list[str], oracle: str | None = None) -> None:
    """A probe that runs statements on an engine of its own; the last one's result."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = Engine(spark).attach(sf_dir)
        for s in statements[:-1]:
            own.execute(s)
        return own.execute(statements[-1])

    QUERIES[name] = run
    if oracle:
        SQL[name] = oracle


_script("view", ["CREATE VIEW rich AS SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 5000", "SELECT COUNT(*) AS n, MIN(s_acctbal) AS lo FROM rich"], "SELECT COUNT(*) AS n, MIN(s_acctbal) AS lo FROM supplier WHERE s_acctbal > 5000")
_script("matview", ["CREATE MATERIALIZED VIEW m AS SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey", "REFRESH MATERIALIZED VIEW m", "SELECT o_custkey, n FROM m"], "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey")
_script("procedure", ["CREATE PROCEDURE of_nation AS SELECT COUNT(*) AS n FROM customer WHERE c_nationkey = @1", "EXEC of_nation 7"], "SELECT COUNT(*) AS n FROM customer WHERE c_nationkey = 7")
_script("transaction", ["CREATE TABLE t AS SELECT n_nationkey AS k, n_regionkey AS r FROM nation", "BEGIN", "DELETE FROM t WHERE r = 1", "SAVEPOINT a", "DELETE FROM t", "ROLLBACK TO SAVEPOINT a", "COMMIT", "SELECT k, r FROM t"], "SELECT n_nationkey AS k, n_regionkey AS r FROM nation WHERE n_regionkey <> 1")

# -- scalar functions -----------------------------------------------------------------------------------

sql("arith", "SELECT l_orderkey, l_partkey, l_linenumber % 3 AS m, -l_linenumber AS neg, ROUND(l_quantity / l_linenumber, 6) AS q, l_linenumber * 2 + 1 AS t FROM lineitem")
sql("arith_zero", "SELECT n_nationkey, n_nationkey / n_regionkey AS q FROM nation", "SELECT n_nationkey, n_nationkey / nullif(n_regionkey, 0) AS q FROM nation")
sql("concat", "SELECT s_suppkey, s_name || '-' || CAST(s_nationkey AS VARCHAR) AS x FROM supplier")
sql("substr", "SELECT c_custkey, SUBSTR(c_name, 2, 5) AS a, SUBSTRING(c_mktsegment, 1, 3) AS b FROM customer")
sql("extract_ymd", "SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS y, CAST(EXTRACT(MONTH FROM o_orderdate) AS INT) AS m, CAST(EXTRACT(DAY FROM o_orderdate) AS INT) AS d FROM orders")
sql("date_filter", "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-07-01'")
sql("cast", "SELECT l_orderkey, l_partkey, CAST(l_linenumber AS DOUBLE) AS f, CAST(l_returnflag AS VARCHAR) AS s, CAST(TRUNC(l_quantity) AS INT) AS i FROM lineitem", "SELECT l_orderkey, l_partkey, CAST(l_linenumber AS DOUBLE) AS f, CAST(l_returnflag AS VARCHAR) AS s, CAST(TRUNC(l_quantity) AS INT) AS i FROM lineitem")
QUERIES["cast"] = lambda spark, sf_dir: engine(spark, sf_dir).execute("SELECT l_orderkey, l_partkey, CAST(l_linenumber AS DOUBLE) AS f, CAST(l_returnflag AS VARCHAR(1)) AS s, CAST(l_quantity AS INT) AS i FROM lineitem")
sql("try_cast", "SELECT c_custkey, CAST(c_mktsegment AS INT) AS bad, TRY_CAST(SUBSTR(c_name, -3, 3) AS INT) AS tail, TRY_CONVERT(FLOAT, '2.5') AS x FROM customer", "SELECT c_custkey, TRY_CAST(c_mktsegment AS INT) AS bad, TRY_CAST(SUBSTR(c_name, -3, 3) AS INT) AS tail, CAST(2.5 AS DOUBLE) AS x FROM customer")
sql("iif", "SELECT n_nationkey, IIF(n_regionkey > 2, 'high', 'low') AS x FROM nation", "SELECT n_nationkey, CASE WHEN n_regionkey > 2 THEN 'high' ELSE 'low' END AS x FROM nation")
sql("params", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = $2 AND n_nationkey > $1", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1 AND n_nationkey > 3", args=[3, 1])


@probe("SELECT o_orderkey, CAST(o_orderdate AS DATE) + 10 AS plus, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days FROM orders")
def date_arith(t, spark, sf_dir):
    day = F.to_date("o_orderdate")
    return t("orders").select("o_orderkey", F.date_add(day, 10).alias("plus"), scalar.days_between(day, F.lit("1995-01-01").cast("date")).cast("long").alias("days"))


@probe("SELECT o_orderkey, dayofweek(o_orderdate) AS dow, isodow(o_orderdate) AS isodow, dayofyear(o_orderdate) AS doy, quarter(o_orderdate) AS q, CAST(epoch(CAST(o_orderdate AS DATE)) AS BIGINT) AS epoch FROM orders")
def date_parts(t, spark, sf_dir):
    day = F.col("o_orderdate")
    parts = [scalar.extract(f, day).cast("long").alias(a) for f, a in (("DOW", "dow"), ("ISODOW", "isodow"), ("DOY", "doy"), ("QUARTER", "q"), ("EPOCH", "epoch"))]
    return t("orders").select("o_orderkey", *parts)


@probe("SELECT o_orderkey, CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS m, CAST(o_orderdate + INTERVAL 2 YEAR AS DATE) AS y, CAST(o_orderdate - INTERVAL 36 HOUR AS DATE) AS h FROM orders")
def interval(t, spark, sf_dir):
    at = F.col("o_orderdate").cast("timestamp")
    return t("orders").select("o_orderkey", *[scalar.add_interval(at, s).cast("date").alias(a) for s, a in (("1 month", "m"), ("2 years", "y"), ("-36 hours", "h"))])


sql("json_value", "SELECT event_id, JSON_VALUE(props, '$.k') AS k, JSON_VALUE(props, '$.none') AS n FROM events", "SELECT event_id, props->>'$.k' AS k, CAST(NULL AS VARCHAR) AS n FROM events")
_NESTED = "'{\"id\": ' || CAST(n_nationkey AS VARCHAR) || ', \"tags\": [\"a\", \"b\"], \"o\": {\"n\": \"' || n_name || '\", \"z\": null}}'"
sql("json_query", f"SELECT n_nationkey, JSON_QUERY(doc, '$.tags') AS a, JSON_QUERY(doc, '$.o') AS o, JSON_QUERY(doc, '$.id') AS i, JSON_VALUE(doc, '$.tags[1]') AS t, JSON_VALUE(doc, '$.o') AS v FROM (SELECT n_nationkey, {_NESTED} AS doc FROM nation) AS d",
    "SELECT n_nationkey, '[\"a\",\"b\"]' AS a, '{\"n\":\"' || n_name || '\",\"z\":null}' AS o, CAST(NULL AS VARCHAR) AS i, 'b' AS t, CAST(NULL AS VARCHAR) AS v FROM nation")
sql("is_json", "SELECT event_id, ISJSON(props) AS a, ISJSON(event_type) AS b FROM events", "SELECT event_id, json_valid(props) AS a, json_valid(event_type) AS b FROM events")
sql("json_exists", f"SELECT n_nationkey, JSON_PATH_EXISTS(doc, '$.o.n') AS a, JSON_PATH_EXISTS(doc, '$.o.z') AS z, JSON_PATH_EXISTS(doc, '$.none') AS n FROM (SELECT n_nationkey, {_NESTED} AS doc FROM nation) AS d", "SELECT n_nationkey, true AS a, true AS z, false AS n FROM nation")


@probe("SELECT event_id, 'k' AS key, props->>'$.k' AS value, CAST(2 AS INT) AS type FROM events")
def openjson(t, spark, sf_dir):
    return json_functions.open_json(t("events", "event_id", "props"), "props")


@probe("SELECT event_id, CAST(props->>'$.k' AS INT) AS k FROM events")
def openjson_schema(t, spark, sf_dir):
    return json_functions.open_json_with(t("events", "event_id", "props"), "props", "k int")


@probe("SELECT CAST(to_json(list({'r_regionkey': r_regionkey, 'r_name': r_name} ORDER BY r_regionkey)) AS VARCHAR) AS json FROM region")
def for_json(t, spark, sf_dir):
    return json_functions.for_json(t("region", "r_regionkey", "r_name"), "r_regionkey")


@probe("SELECT event_id, '{\"k\":' || (props->>'$.k') || ',\"new\":\"x\"}' AS doc FROM events")
def json_modify(t, spark, sf_dir):
    return t("events").select("event_id", json_functions.json_modify(F.col("props"), F.lit("$.new"), F.lit("x")).alias("doc"))


# -- changes ----------------------------------------------------------------------------------------------


@probe("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 100, 'X', NULL UNION ALL SELECT 101, NULL, 2")
def dml_insert(t, spark, sf_dir):
    return mutation.insert(t("nation"), files.values(spark, [(100, "X", None), (101, None, 2)], "n_nationkey int, n_name string, n_regionkey int"))


@probe("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT r_regionkey + 1000, r_name, NULL FROM region")
def dml_insert_select(t, spark, sf_dir):
    return mutation.insert(t("nation"), t("region").select((F.col("r_regionkey") + 1000).alias("n_nationkey"), F.col("r_name").alias("n_name")))


@probe("SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN n_name || '!' ELSE n_name END AS n_name, n_regionkey FROM nation")
def dml_update(t, spark, sf_dir):
    return mutation.update(t("nation"), {"n_name": F.concat("n_name", F.lit("!"))}, F.col("n_regionkey") == 2)


@probe("SELECT * FROM supplier WHERE NOT (s_acctbal < 0)")
def dml_delete(t, spark, sf_dir):
    return mutation.delete(t("supplier"), F.col("s_acctbal") < 0)


@probe("SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'new' ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT CAST(s + 25 AS INT), 'new', NULL FROM range(0, 5) r(s)")
def upsert(t, spark, sf_dir):
    rows = spark.range(0, 30).where("id < 5 or id >= 25").select(F.col("id").cast("int").alias("n_nationkey"), F.lit("new").alias("n_name"))
    return mutation.upsert(t("nation"), rows, ["n_nationkey"])


_script("merge_upsert", [
    "CREATE TABLE target AS SELECT s_suppkey AS id, s_acctbal AS val FROM supplier",
    "MERGE INTO target AS t USING (SELECT s_suppkey * 2 AS id, s_acctbal AS val FROM supplier) AS s ON t.id = s.id WHEN MATCHED THEN UPDATE SET val = t.val + s.val WHEN NOT MATCHED THEN INSERT (id, val) VALUES (s.id, s.val)",
    "SELECT id, ROUND(val, 4) AS val FROM target",
], "SELECT coalesce(a.s_suppkey, b.id) AS id, ROUND(CASE WHEN a.s_suppkey IS NULL THEN b.val WHEN b.id IS NULL THEN a.s_acctbal ELSE a.s_acctbal + b.val END, 4) AS val FROM supplier a FULL JOIN (SELECT s_suppkey * 2 AS id, s_acctbal AS val FROM supplier) b ON a.s_suppkey = b.id")


@probe("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000) ")
def merge_delete(t, spark, sf_dir):
    source = t("supplier").where("s_acctbal > 8000").select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    return mutation.merge(t("nation"), source, ["n_nationkey"], delete_when="true", insert_new=False)


_NATIONS = "CREATE TABLE n AS SELECT n_nationkey AS k, n_name AS v, n_regionkey AS r FROM nation"
_script("sql_insert", [_NATIONS, "INSERT INTO n (k, v) VALUES (100, 'see__a'), (101, NULL)", "INSERT INTO n SELECT k + 200, v, r FROM n WHERE r = 1", "SELECT k, v, r FROM n"],
        "SELECT n_nationkey AS k, n_name AS v, n_regionkey AS r FROM nation UNION ALL SELECT 100, 'see__a', NULL UNION ALL SELECT 101, NULL, NULL UNION ALL SELECT n_nationkey + 200, n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
_script("sql_update", [_NATIONS, "UPDATE n SET v = v || '!', r = NULL WHERE r = 2 OR k < 3", "SELECT k, v, r FROM n"],
        "SELECT n_nationkey AS k, CASE WHEN n_regionkey = 2 OR n_nationkey < 3 THEN n_name || '!' ELSE n_name END AS v, CASE WHEN n_regionkey = 2 OR n_nationkey < 3 THEN NULL ELSE n_regionkey END AS r FROM nation")
_script("sql_delete", [_NATIONS, "UPDATE n SET r = NULL WHERE k = 7", "DELETE FROM n WHERE r < 2", "SELECT k, v FROM n"], "SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_regionkey >= 2 OR n_nationkey = 7")
_script("sql_on_conflict", ["CREATE TABLE u (k INT PRIMARY KEY, v INT)", "INSERT INTO u SELECT n_nationkey, n_regionkey FROM nation", "INSERT INTO u VALUES (3, 50), (70, 51), (70, 52) ON CONFLICT (k) DO NOTHING",
        "INSERT INTO u SELECT n_nationkey + 10, 9 FROM nation ON CONFLICT (k) DO UPDATE SET v = u.v * 100 + excluded.v", "SELECT k, v FROM u WHERE k <> 70"],
        "SELECT coalesce(a.k, b.k) AS k, CAST(CASE WHEN a.k IS NULL THEN 9 WHEN b.k IS NULL THEN a.v ELSE a.v * 100 + 9 END AS INTEGER) AS v FROM (SELECT n_nationkey AS k, n_regionkey AS v FROM nation) a FULL JOIN (SELECT n_nationkey + 10 AS k FROM nation) b ON a.k = b.k")
_script("sql_returning", [_NATIONS, "UPDATE n SET r = r + 10 WHERE k > 20 RETURNING k, r"], "SELECT n_nationkey AS k, n_regionkey + 10 AS r FROM nation WHERE n_nationkey > 20")
_script("sql_merge_delete", [_NATIONS, "MERGE INTO n USING (SELECT DISTINCT s_nationkey AS k, 'see__a' AS w FROM supplier WHERE s_acctbal > 8000) AS s ON n.k = s.k WHEN MATCHED AND n.r = 1 THEN DELETE WHEN MATCHED THEN UPDATE SET v = s.w WHEN NOT MATCHED BY SOURCE THEN UPDATE SET r = 0",
        "SELECT k, v, r FROM n"], "SELECT n_nationkey AS k, CASE WHEN s.k IS NULL THEN n_name ELSE 'see__a' END AS v, CASE WHEN s.k IS NULL THEN 0 ELSE n_regionkey END AS r FROM nation LEFT JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 8000) s ON n_nationkey = s.k WHERE s.k IS NULL OR n_regionkey <> 1")


@probe("SELECT n_nationkey AS k, n_regionkey AS r FROM nation")
def sql_system_time(t, spark, sf_dir):
    """Rows as of a moment between two changes of a versioned table."""
    moments = iter((100, 200, 300))
    own = Engine(spark, clock=lambda: next(moments)).attach(sf_dir)
    own.execute("CREATE TABLE v (k INT, r INT) WITH (SYSTEM_VERSIONING = ON)")
    own.execute("INSERT INTO v SELECT n_nationkey, n_regionkey FROM nation")
    own.execute("UPDATE v SET r = 99 WHERE k < 10")
    own.execute("DELETE FROM v WHERE k > 15")
    return own.execute("SELECT k, r FROM v FOR SYSTEM_TIME AS OF 150")


def _history(t, spark) -> DataFrame:
    """Nations over three moments: at 200 region 1 goes, at 300 region 2 is renamed."""
    first = temporal.start(t("nation"), 100)
    second = temporal.apply(first, t("nation").where("n_regionkey <> 1"), 200)
    third = mutation.update(t("nation").where("n_regionkey <> 1"), {"n_name": F.lit("renamed")}, F.col("n_regionkey") == 2)
    return temporal.apply(second, third, 300)


@probe("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 1")
def temporal_as_of(t, spark, sf_dir):
    return temporal.as_of(_history(t, spark), 250)


@probe("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT n_nationkey, 'renamed', n_regionkey FROM nation WHERE n_regionkey = 2")
def temporal_between(t, spark, sf_dir):
    return temporal.between(_history(t, spark), 220, 400).drop(temporal.FROM, temporal.TO)


@probe("SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN CAST(2 AS BIGINT) ELSE 1 END AS n_versions FROM nation")
def temporal_all(t, spark, sf_dir):
    return temporal.version_counts(_history(t, spark), ["n_nationkey"])


@probe("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)")
def check_fk_violations(t, spark, sf_dir):
    return mutation.foreign_key_violations(t("orders", "o_orderkey", "o_custkey"), ["o_custkey"], t("customer").where("c_custkey % 10 <> 0"), ["c_custkey"])


@probe("SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1")
def check_unique(t, spark, sf_dir):
    return mutation.unique_violations(t("lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@probe("SELECT s_suppkey FROM supplier WHERE s_acctbal < 0")
def check_condition(t, spark, sf_dir):
    return mutation.check_violations(t("supplier", "s_suppkey", "s_acctbal"), "s_acctbal >= 0").select("s_suppkey")


_script("alter_add_column", ["CREATE TABLE t AS SELECT r_regionkey, r_name FROM region", "ALTER TABLE t ADD COLUMN w INT DEFAULT 7", "ALTER TABLE t RENAME COLUMN r_name TO name", "SELECT * FROM t"], "SELECT r_regionkey, r_name AS name, 7 AS w FROM region")
_script("create_table_as", ["CREATE TABLE c AS SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey", "SELECT * FROM c"], "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey")
_script("truncate", ["CREATE TABLE t AS SELECT * FROM nation", "TRUNCATE TABLE t", "SELECT COUNT(*) AS n FROM t"], "SELECT CAST(0 AS BIGINT) AS n")


@probe("SELECT TRUE AS filtered, TRUE AS pruned")
def explain(t, spark, sf_dir):
    """Whether the plan has the filter and reads no other columns."""
    plan = engine(spark, sf_dir).execute("EXPLAIN SELECT n_name FROM nation WHERE n_regionkey = 1")
    return plan.agg(F.bool_or(F.col("plan").contains("Filter") & F.col("plan").contains("n_regionkey")).alias("filtered"), (~F.bool_or(F.col("plan").contains("Aggregate"))).alias("pruned"))


@probe("SELECT COUNT(*) AS n, TRUE AS timed FROM orders WHERE o_totalprice > 100000")
def analyze(t, spark, sf_dir):
    return engine(spark, sf_dir).execute("ANALYZE SELECT o_orderkey FROM orders WHERE o_totalprice > 100000").select(F.col("rows").alias("n"), (F.col("execution_time_ms") > 0).alias("timed"))


@probe("SELECT column_name FROM (DESCRIBE lineitem)")
def parquet_metadata(t, spark, sf_dir):
    return files.values(spark, [(c,) for c in files.column_names(spark, f"{sf_dir}/lineitem.parquet")], "column_name string")


_script("vacuum", [_NATIONS, "UPDATE n SET r = r + 1", "DELETE FROM n WHERE k = 3", "VACUUM", "SELECT k, v, r FROM n"], "SELECT n_nationkey AS k, n_name AS v, n_regionkey + 1 AS r FROM nation WHERE n_nationkey <> 3")
_script("similar_to", ["CREATE TABLE bits AS SELECT s_suppkey AS id, s_suppkey * 37 AS b FROM supplier", "SELECT id FROM bits SIMILAR TO b x'FF' WITHIN HAMMING DISTANCE 3"], "SELECT s_suppkey AS id FROM supplier WHERE bit_count(xor(s_suppkey * 37, 255)) <= 3")
_script("sql_function", ["CREATE FUNCTION twice(@x INT, y INT) RETURNS INT AS BEGIN RETURN @x * 2 + y END", "SELECT n_nationkey, twice(n_nationkey, n_regionkey) AS t FROM nation"], "SELECT n_nationkey, n_nationkey * 2 + n_regionkey AS t FROM nation")
_script("session_context", ["SET segment = 'BUILDING'", "SELECT c_custkey, SESSION_CONTEXT('none') AS x FROM customer WHERE c_mktsegment = SESSION_CONTEXT('segment')"], "SELECT c_custkey, CAST(NULL AS VARCHAR) AS x FROM customer WHERE c_mktsegment = 'BUILDING'")


@probe("SELECT n_name FROM nation JOIN (VALUES (3), (7)) AS p(a) ON n_nationkey = a")
def table_type(t, spark, sf_dir):
    own = Engine(spark).attach(sf_dir)
    own.execute("CREATE TYPE wanted AS TABLE (a INT, b VARCHAR(5))")
    own.table_value("wanted", "p", [(3, "x"), (7, None)])
    return own.execute("SELECT n_name FROM nation JOIN p ON n_nationkey = a")


@probe("SELECT n_nationkey AS k, n_name AS v, n_regionkey AS r FROM nation WHERE n_regionkey <> 1")
def backup_restore(t, spark, sf_dir):
    """The tables as saved at 200, between two changes."""
    folder = f"{shared_dir(spark)}/skein-backup-{uuid.uuid4().hex}"
    moments = iter((100, 200, 300, 400, 500, 600))
    own = Engine(spark, (folder,), clock=lambda: next(moments)).attach(sf_dir)
    for statement in (_NATIONS, f"BACKUP TO '{folder}'", "DELETE FROM n WHERE r = 1", f"BACKUP TO '{folder}'", "DELETE FROM n", f"BACKUP TO '{folder}'", f"RESTORE FROM '{folder}' AS OF TIMESTAMP 250"):
        own.execute(statement)
    return own.execute("SELECT k, v, r FROM n")


@probe("SELECT c_custkey, upper(c_mktsegment) AS loud FROM customer")
def scalar_udf(t, spark, sf_dir):
    own = Engine(spark).attach(sf_dir)
    own.register_function("loud", F.arrow_udf(pc.utf8_upper, "string", ArrowUDFType.SCALAR), "string")
    return own.execute("SELECT c_custkey, loud(c_mktsegment) AS loud FROM customer")


@probe("SELECT n_regionkey, MAX(n_nationkey) - MIN(n_nationkey) AS spread FROM nation GROUP BY n_regionkey")
def aggregate_udf(t, spark, sf_dir):
    own = Engine(spark).attach(sf_dir)
    own.register_function("spread", F.arrow_udf(_spread, "int", ArrowUDFType.GROUPED_AGG), "int")
    return own.execute("SELECT n_regionkey, spread(n_nationkey) AS spread FROM nation GROUP BY n_regionkey")


def _spread(values):
    ends = pc.min_max(values)
    return ends["max"].as_py() - ends["min"].as_py()


class _Pieces:
    """Each piece of a text between marks, with its position."""

    def eval(self, text: str, mark: str):
        for at, piece in enumerate((text or "").split(mark)):
            yield at, piece


@probe("SELECT n_nationkey, CAST(pos AS INT) AS pos, piece FROM (SELECT n_nationkey, generate_subscripts(string_split(n_name, '_'), 1) - 1 AS pos, unnest(string_split(n_name, '_')) AS piece FROM nation) AS x")
def table_udf(t, spark, sf_dir):
    own = Engine(spark).attach(sf_dir)
    own.register_table_function("pieces", F.udtf(_Pieces, returnType="pos int, piece string"))
    return own.execute("SELECT n_nationkey, pos, piece FROM nation, LATERAL pieces(n_name, '_')")


_script("show_tables", ["CREATE TABLE a (id INT)", "CREATE VIEW b AS SELECT id FROM a", "SHOW TABLES"], "SELECT unnest(['a', 'b']) AS table_name")

# -- suites and streaming ---------------------------------------------------------------------------------

for _name, _text in {**tpch.QUERIES, **clicks.QUERIES}.items():
    sql(_name, _text)


def _with_partsupp(text: str) -> Query:
    """A query that reads ``partsupp``, a table that the data lacks: it is made from ``lineitem`` once per engine and written."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = engine(spark, sf_dir)
        if "partsupp" not in own.catalog.tables:
            own.register("partsupp", scratch(own.execute(f"SELECT * FROM {tpch.SUPPLY} AS ps"), "partsupp"))
        return own.execute(text.replace(tpch.SUPPLY, "partsupp"))

    return run


for _name, _text in tpch.QUERIES.items():
    if tpch.SUPPLY in _text:
        QUERIES[_name] = _with_partsupp(_text)


@probe("SELECT event_type, CAST(time_bucket(INTERVAL 1 DAY, ts) AS DATE) AS day, COUNT(*) AS n, ROUND(SUM(value), 2) AS s FROM events GROUP BY ALL")
def stream_tumbling(t, spark, sf_dir):
    return windows.tumbling(t("events"), "1 day").select("event_type", F.col("start").cast("date").alias("day"), "n", F.round("s", 2).alias("s"))


@probe("SELECT event_type, w AS start, COUNT(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS w FROM events) AS x GROUP BY ALL")
def stream_sliding(t, spark, sf_dir):
    return windows.sliding(t("events"), "12 hours", "6 hours").select("event_type", "start", "n")


@probe("""SELECT user_id, MIN(ts) AS start, COUNT(*) AS n FROM (SELECT *, SUM(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
    SELECT *, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 1 DAY THEN 1 ELSE 0 END AS gap FROM events)) AS x GROUP BY user_id, s""")
def stream_session(t, spark, sf_dir):
    return windows.session(t("events"), "1 day").select("user_id", "start", "n")


@probe("SELECT event_type, CAST(time_bucket(INTERVAL 1 DAY, ts) AS DATE) AS day, COUNT(*) AS n, ROUND(SUM(value), 2) AS s FROM events GROUP BY ALL")
def stream_run(t, spark, sf_dir):
    """The tumbling query as a stream over the event file, run until nothing is left."""
    out = windows.run_stream(spark, sf_dir, "events.parquet", lambda e: windows.tumbling(e, "1 day"), "skein_stream")
    return out.select("event_type", F.col("start").cast("date").alias("day"), "n", F.round("s", 2).alias("s"))


