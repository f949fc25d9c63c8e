"""Whole sorts: every row, in order, nulls where the query puts them."""

from skein.plans import probes


def test_sort_nulls_returns_all_rows_nulls_last(spark, sf_dir):
    got = [(r.c_custkey, r.x) for r in probes.QUERIES["sort_nulls"](spark, sf_dir).collect()]
    assert len(got) == spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    assert any(x is None for _, x in got)
    assert got == sorted(got, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))


def test_sort_string_returns_all_rows(spark, sf_dir):
    got = [(r.p_name, r.p_partkey) for r in probes.QUERIES["sort_string"](spark, sf_dir).collect()]
    assert len(got) == spark.read.parquet(f"{sf_dir}/part.parquet").count()
    assert got == sorted(got, key=lambda r: (r[0].encode(), -r[1]))
