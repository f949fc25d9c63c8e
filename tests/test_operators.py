"""DataFrame operators on NULLs, ties and empty tables."""

from pyspark.sql import functions as F

from skein.functions import json_functions, scalar
from skein.operators import approximate, grouping, joins, mutation, similarity, temporal
from skein.plans import probes
from skein.sources import files


def test_not_in_is_null_aware(spark, rows):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    some, none, empty = (spark.createDataFrame(x, "b int") for x in ([(1,)], [(1,), (None,)], []))
    assert rows(joins.not_in(left, "a", some, "b")) == [(2,)]
    assert rows(joins.not_in(left, "a", none, "b")) == []
    assert rows(joins.not_in(left, "a", empty, "b")) == [(None,), (1,), (2,)]


def test_range_and_as_of(spark, rows):
    points = spark.createDataFrame([(0,), (5,), (9,), (10,), (None,)], "p int")
    ranges = spark.createDataFrame([(0, 5), (4, 10), (7, 7)], "lo int, hi int")
    for width in (1, 3, 100):
        assert rows(joins.range_join(points, "p", ranges, "lo", "hi", width)) == [(0, 0, 5), (5, 4, 10), (9, 4, 10)]
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (3, 1, "c")], "k int, t int, v string")
    assert rows(joins.as_of_join(left, right, ["k"], "t", "t", ["v"])) == [(1, 1, None), (1, 5, "b"), (2, 9, None)]


def test_salted_join_matches_join(spark, rows):
    large = spark.createDataFrame([(i % 3, i) for i in range(40)], "k int, v int")
    small = spark.createDataFrame([(0, "x"), (1, "y")], "k int, w string")
    assert rows(joins.salted_join(large, small, "k", 5)) == rows(large.join(small, "k"))


def test_grouping_sets_with_a_real_null(spark, rows):
    df = spark.createDataFrame([(1, None, 10), (1, 2, 5)], "a int, b int, v int")
    out = grouping.grouping_sets(df, [["a"], ["a", "b"]], ["a", "b"], F.sum("v").alias("s"))
    assert rows(out) == [(1, None, 10, 0), (1, None, 15, 1), (1, 2, 5, 0)]


def test_pivot_and_unpivot(spark, rows):
    df = spark.createDataFrame([(1, 1, 100), (1, 2, 200), (2, 1, 150)], "d int, q int, v int")
    assert rows(grouping.pivot(df, ["d"], "q", [1, 2], F.sum("v"))) == [(1, 100, 200), (2, 150, None)]
    assert rows(grouping.pivot(df, ["d"], "q", [1, 2], F.sum("v"), missing=0)) == [(1, 100, 200), (2, 150, 0)]
    wide = spark.createDataFrame([(1, 100, 200)], "d int, Q1 int, Q2 int")
    assert rows(grouping.unpivot(wide, ["d"], ["Q1", "Q2"], "quarter", "amount")) == [(1, "Q1", 100), (1, "Q2", 200)]


def test_mutations(spark, rows):
    t = spark.createDataFrame([(1, 10), (2, None)], "id int, v int")
    assert rows(mutation.update(t, {"v": F.lit(0)}, F.col("v") > 5)) == [(1, 0), (2, None)]
    assert rows(mutation.delete(t, F.col("v") > 5)) == [(2, None)]
    new = spark.createDataFrame([(2, 7), (3, 8)], "id int, v int")
    assert rows(mutation.upsert(t, new, ["id"])) == [(1, 10), (2, 7), (3, 8)]
    assert rows(mutation.upsert(t, new, ["id"], replace=False)) == [(1, 10), (2, None), (3, 8)]
    assert rows(mutation.merge(t, new, ["id"], {"v": "coalesce(t.v, 0) + s.v"}, delete_missing=True)) == [(2, 7), (3, 8)]
    assert rows(mutation.unique_violations(t.union(t), ["id"])) == [(1, 2), (2, 2)]
    assert mutation.check_violations(t, "v > 0").isEmpty()


def test_versions_keep_repeated_rows(spark, rows):
    t = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, v string")
    v = temporal.apply(temporal.start(t, 1), spark.createDataFrame([(1, "a"), (3, "c")], "id int, v string"), 2)
    assert rows(temporal.as_of(v, 1)) == [(1, "a"), (1, "a"), (2, "b")]
    assert rows(temporal.current(v)) == [(1, "a"), (3, "c")]


def test_approximations_keep_their_bounds(spark):
    df = spark.range(50_000).select(F.pmod(F.xxhash64("id"), F.lit(1000)).alias("v"))
    exact = df.agg(F.avg("v")).first()[0]
    row = approximate.approx_mean(df, "v", 10.0, 0.95).first()
    assert abs(row.estimate - exact) <= 10 and row.bound <= 10
    assert abs(df.agg(approximate.approx_distinct("v")).first()[0] - 1000) < 40
    sketches = approximate.distinct_sketch(df.withColumn("g", F.col("v") % 2), ["g"], "v").withColumn("all", F.lit(1))
    assert abs(approximate.merge_sketches(sketches, ["all"]).first().n_distinct - 1000) < 40


def test_no_sketch_is_kept_per_value(spark, tmp_path, rows, monkeypatch):
    keys = spark.range(3000).select(F.when(F.col("id") % 7 > 0, F.col("id") % 900).alias("l_orderkey"), (F.col("id") % 11).alias("l_partkey"))
    keys.write.parquet(str(tmp_path / "lineitem.parquet"))
    df = probes.QUERIES["agg_approx_distinct"](spark, str(tmp_path))
    sketches = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "approx_count_distinct(" in line]
    assert sketches and all("keys=[]" in line for line in sketches)
    assert rows(df) == [("orders", True), ("parts", True)]
    monkeypatch.setattr(approximate, "approx_distinct", F.count)
    assert rows(probes.QUERIES["agg_approx_distinct"](spark, str(tmp_path))) == [("orders", False), ("parts", False)]


def test_hamming(spark, rows):
    df = spark.createDataFrame([(1, -1), (2, 0), (3, None)], "id int, b long")
    assert rows(similarity.within_hamming(df, "b", (1 << 64) - 1, 3).select("id")) == [(1,)]
    v = spark.createDataFrame([([1.0, -1.0, 2.0],), (None,)], "e array<float>")
    assert [r[0] for r in v.select(similarity.sign_bits(F.col("e"), 64)).collect()] == [5, 0]


def test_json(spark, rows):
    assert json_functions.modify('{"tags":["work"]}', "append $.tags", "personal") == '{"tags":["work","personal"]}'
    assert json_functions.modify('{"name":"A","age":30}', "$.age", None) == '{"name":"A"}'
    assert json_functions.modify("no", "$.a", "1") is None
    df = spark.createDataFrame([(1, '{"a":1,"b":"x","c":null,"d":[1],"e":{"f":true}}')], "id int, doc string")
    assert rows(json_functions.open_json(df, "doc")) == [(1, "a", "1", 2), (1, "b", "x", 1), (1, "c", None, 0), (1, "d", "[1]", 4), (1, "e", '{"f":true}', 5)]
    two = spark.createDataFrame([('[{"id":1,"name":"Alice"},{"id":2,"name":"Bob"}]',)], "doc string")
    assert rows(json_functions.open_json_with(two, "doc", "id int, name string")) == [(1, "Alice"), (2, "Bob")]


def test_scalars(spark):
    df = spark.sql("SELECT DATE '2024-01-31' AS d")
    assert str(df.select(scalar.add_interval(F.col("d").cast("timestamp"), "1 month").cast("date")).first()[0]) == "2024-02-29"
    assert df.select(scalar.extract("DOW", F.col("d")), scalar.extract("ISODOW", F.col("d"))).first()[:] == (3, 3)
    assert spark.sql("SELECT 'Yes' AS x").select(scalar.try_boolean(F.col("x"))).first()[0] is True


def test_csv_types(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,7y\n")
    df = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.dtypes == [("id", "bigint"), ("name", "string")] and rows(df) == [(1, "x"), (2, "7y")]
    (tmp_path / "b.tbl").write_text("1|N|2|note\n")
    assert rows(files.read_star_csv(spark, str(tmp_path / "b.tbl"), "nation")) == [(1, "N", 2, "note")]
