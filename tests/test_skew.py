from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from curbspark.operators.skew import hot_keys, lookup_join, unique_join
from tests.support import spark_rows


@pytest.fixture(scope="module")
def sides(spark):
    # Key 1 holds a third of the rows, another third has no key.
    facts = spark.range(3000).select(
        F.col("id").alias("row"),
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, None).otherwise(F.col("id") % 40).cast("long").alias("k"),
    )
    lookup = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    return facts, lookup


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(sides, how):
    facts, lookup = sides
    plain = facts.join(lookup, ["k"], how)
    salted = lookup_join(facts, lookup, ["k"], how, salt_by=["row"], max_broadcast_bytes=-1, hot_rows=100, salts=7)
    small = lookup_join(facts, lookup, ["k"], how, salt_by=["row"])
    cut = lookup_join(facts, lookup, ["k"], how, salt_by=["row"], lookup_bytes=1 << 99)
    assert spark_rows(salted) == spark_rows(plain) == spark_rows(small) == spark_rows(cut)


def test_hot_rows_spread_over_partitions(spark, sides):
    facts, lookup = sides
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        salted = lookup_join(facts, lookup, ["k"], "left", salt_by=["row"], max_broadcast_bytes=-1, hot_rows=100, salts=64)
        sizes = [r["count"] for r in salted.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(sizes) == 8 and max(sizes) < 3000 / 4
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_hot_keys(sides):
    facts, _ = sides
    assert [r.k for r in hot_keys(facts, ["k"], 100).collect()] == [1]


@pytest.mark.parametrize("how", ["left", "full"])
def test_unique_join_equals_plain_join(spark, how):
    state = spark.range(20).select(F.col("id").alias("k"), (F.col("id") * 2).alias("old"))
    news = spark.range(15, 30).select(F.col("id").alias("k"), F.lit("n").alias("new"))
    plain = spark_rows(state.join(news, ["k"], how))
    assert spark_rows(unique_join(state, news, ["k"], how)) == plain
    assert spark_rows(unique_join(state, news, ["k"], how, max_broadcast_bytes=-1)) == plain


def test_small_news_do_not_move_the_state(spark, tmp_path):
    spark.range(50000).select("id", F.col("id").cast("string").alias("wide")).write.parquet(str(tmp_path / "state"))
    state = spark.read.parquet(str(tmp_path / "state"))
    news = spark.range(10).select("id", F.lit(1).alias("new"))
    text = unique_join(state, news, ["id"], "full")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in text.splitlines() if "FileScan" in line]
    assert len(scans) == 2 and any("[id#" in s and "wide" not in s.split("Batched")[0] for s in scans)
    assert "FullOuter" not in text and text.count("BroadcastHashJoin") >= 2


def test_join_kinds_are_checked(sides):
    facts, lookup = sides
    with pytest.raises(ValueError):
        lookup_join(facts, lookup, ["k"], "full", salt_by=["row"])
    with pytest.raises(ValueError):
        lookup_join(facts, lookup, ["k"], "left", salt_by=["row"], condition=F.col("v") > 1)
