"""An import run computes nothing twice: earlier tables are stored, offered rows kept, feeds spread before the parse."""

from __future__ import annotations

from pyspark.sql import functions as F

import registered
from curbspark.plans import city
from curbspark.sources.feed import spread
from tests.test_feed import at, city_feeds, tables


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def base_tables(spark, folder) -> str:
    made = {
        "part": spark.range(1, 400).selectExpr("id AS p_partkey", "'Brand' || id % 5 AS p_brand", "cast(id % 50 AS int) AS p_size"),
        "nation": spark.range(25).selectExpr("cast(id AS int) AS n_nationkey", "'N' || id AS n_name"),
        "supplier": spark.range(1, 60).selectExpr("id AS s_suppkey", "cast(id % 25 AS int) AS s_nationkey"),
    }
    for name, df in made.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_earlier_tables_are_stored(spark, tmp_path):
    """A run reads its earlier tables several times; none of them may parse the feed again."""
    d = base_tables(spark, tmp_path)
    stored = registered._earlier_tables(spark, d)
    for name in ("blocks", "meters", "locations"):
        assert "from_json" not in plan_of(stored[name]), name
    planned = registered._earlier_tables(spark, d, stored=False)
    for name, df in stored.items():
        assert df.dtypes == planned[name].dtypes
        assert sorted(map(repr, df.collect())) == sorted(map(repr, planned[name].collect())), name


def test_edited_rows(spark):
    rows = [("14", "a"), ("16", "b"), ("18", "c"), ("", "d"), (None, "e"), ("8", None), ("5", None), ("18", "c"), ("6", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, k string, v string")
    edited = registered._edited(df, "k", "v", "X")
    assert edited.columns == df.columns
    assert sorted(map(repr, map(tuple, edited.collect()))) == sorted(
        map(repr, [
            (1, "16", "Old"), (2, "18", "c"), (2, "X18", "c"), (3, "", "d"), (5, "8", None), (5, "X8", None), (6, "5", None),
            (7, "18", "c"), (7, "X18", "c"), (8, "6", "Old"),
        ])
    )
    assert plan_of(edited).count("LogicalRDD") == 1


def test_offered_rows_are_kept(spark, tmp_path, monkeypatch):
    """The write and the comparison both read the winners of the feed, which are picked once."""
    seen = {}
    monkeypatch.setattr(city, "offer_changes", lambda offers, f=city.offer_changes: seen.update(offers) or f(offers))
    city.run_import(spark, city_feeds(spark), tables(spark), str(tmp_path / "out"), at())
    for name in ("blocks", "meters", "locations"):
        assert "Aggregate" not in plan_of(seen[name].new), name


def test_a_feed_in_one_split_is_parsed_by_many_tasks(spark, tmp_path):
    one = spark.range(0, 200_000, 1, 1).select(F.col("id").alias("feed_pos"), F.sha2(F.col("id").cast("string"), 512).alias("raw"))
    assert one.rdd.getNumPartitions() == 1
    dealt = spread(one)
    assert dealt.rdd.getNumPartitions() > 1
    told = [F.count(F.lit(1)), F.sum("feed_pos"), F.bit_xor(F.xxhash64("feed_pos", "raw"))]
    assert dealt.agg(*told).first() == one.agg(*told).first()
    run = city.run_import(spark, city_feeds(spark), tables(spark), str(tmp_path / "out"), at(), only=["meters"], dry_run=True)
    assert "RebalancePartitions" in plan_of(run["counts.meters"])
