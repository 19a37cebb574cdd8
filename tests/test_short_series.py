"""The indicators of all suppliers: one narrow shuffle of the line items, nothing stored."""

import pytest
from pyspark.sql import functions as F
from test_operators import close, rows

from sparkwick.operators import scan as S
from sparkwick.plans import QUERIES

SF = "/root/testdata/sf0.001"


def run(spark, sf=SF):
    return QUERIES["i00_all_indicators"](spark, sf)


def test_short_series_are_shuffled_once_and_not_stored(spark):
    plan = run(spark)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "ExistingRDD" not in plan
    assert plan.count("Exchange ") == 1


@pytest.mark.parametrize("limit", [580, 10], ids=["some_long", "all_long"])
def test_long_series_give_the_same(spark, monkeypatch, limit):
    want = rows(run(spark), "symbol", "bar_idx")
    sizes = spark.read.parquet(f"{SF}/lineitem.parquet").groupBy("l_suppkey").count()
    n_long = sizes.where(sizes["count"] > limit).count()
    assert n_long == sizes.count() if limit == 10 else 0 < n_long < sizes.count()
    monkeypatch.setattr(S, "SHORT_SERIES", limit)
    close(rows(run(spark), "symbol", "bar_idx"), want)


@pytest.mark.parametrize("limit", [S.SHORT_SERIES, 580])
def test_items_without_supplier_or_date_change_nothing(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(S, "SHORT_SERIES", limit)
    items = spark.read.parquet(f"{SF}/lineitem.parquet")
    odd = items
    for name, kind in (("l_suppkey", "bigint"), ("l_shipdate", dict(items.dtypes)["l_shipdate"])):
        odd = odd.unionByName(items.limit(5).withColumn(name, F.lit(None).cast(kind)))
    odd.write.parquet(str(tmp_path / "lineitem.parquet"))
    close(rows(run(spark, str(tmp_path)), "symbol", "bar_idx"), rows(run(spark), "symbol", "bar_idx"))


def test_no_items(spark, tmp_path):
    items = spark.read.parquet(f"{SF}/lineitem.parquet")
    items.where("false").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert run(spark, str(tmp_path)).count() == 0
