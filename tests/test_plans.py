"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from curbspark.operators import serving
from curbspark.sources.tables import read_table, write_located
from registered import QUERIES
from tests.support import DATA

SF = f"{DATA}/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def details(df) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.fixture(scope="module")
def located(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("spots") / "spots")
    spots = spark.range(20000).select(
        "id",
        (F.lit(37.0) + F.col("id") % 141 / 141).alias("latitude"),
        (F.lit(-122.0) + F.col("id") % 137 / 137).alias("longitude"),
        F.lit("FREE").alias("parking_type"),
        F.current_timestamp().alias("updated_at"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    write_located(spots, path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return path


def test_box_reaches_the_scan(spark, located):
    spots = read_table(spark, located)
    text = details(serving.in_box(spots, 37.5, -121.5, 2000).select("id"))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", text).group(1)
    for bound in ("GreaterThanOrEqual(latitude", "LessThanOrEqual(latitude", "GreaterThanOrEqual(longitude", "LessThanOrEqual(longitude"):
        assert bound in pushed
    assert "ReadSchema: struct<id:bigint,latitude:double,longitude:double>" in text


def test_unclipped_radius_reaches_the_scan_too(spark, located):
    text = details(serving.within_radius(read_table(spark, located), 37.5, -121.5, 1.0, clip_box=False).select("id"))
    assert "GreaterThanOrEqual(latitude" in text and "LessThanOrEqual(longitude" in text


def test_files_hold_narrow_ranges(spark, located):
    files = spark.read.parquet(located).groupBy(F.input_file_name()).agg(
        (F.max("latitude") - F.min("latitude")).alias("span")
    )
    spans = [r.span for r in files.collect()]
    assert len(spans) > 1 and max(spans) < 0.6


def test_top_k_does_not_sort_everything(spark, located):
    spots = read_table(spark, located)
    for df in (serving.latest_spots(spots), serving.nearest(spots, 37.5, -121.5, 1.0)):
        assert "TakeOrderedAndProject" in plan(df)


def test_the_fallback_gate_holds_one_row(spark):
    text = plan(QUERIES["nearby_with_fallback"](spark, SF))
    assert text.count("BroadcastNestedLoopJoin") == text.count("LeftAnti") == 1
    assert "GlobalLimit 1" in text
