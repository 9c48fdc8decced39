from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from curbspark import schemas
from curbspark.operators import counts
from curbspark.plans import city, ingest, normalize
from curbspark.sources import feed, registry
from curbspark.sources.seed import read_seed
from tests.support import spark_rows

AT = "2024-02-01 00:00:00"


def at():
    return F.lit(AT).cast("timestamp_ntz")


def feed_of(spark, records):
    rows = [(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "feed_pos long, raw string")


def mapped(spark, records):
    df = ingest.map_meters(feed_of(spark, records), "s", at())
    return [r.asDict() for r in df.orderBy("feed_pos").collect()]


def test_pages_in_feed_order(spark, tmp_path):
    (tmp_path / "page-0000.json").write_text('[{"a":1},{"a":2}]')
    (tmp_path / "page-0001.json").write_text('[{"a":"x, ]"}]')
    rows = feed.read_pages(spark, str(tmp_path)).orderBy("feed_pos").collect()
    assert [r.raw for r in rows] == ['{"a":1}', '{"a":2}', '{"a":"x, ]"}']
    first = feed.limit_rows(feed.read_pages(spark, str(tmp_path)), 2).collect()
    assert [r.raw for r in first] == ['{"a":1}', '{"a":2}']


def test_a_page_that_is_no_array_fails(spark, tmp_path):
    (tmp_path / "page-0000.json").write_text('{"error":true}')
    with pytest.raises(Exception, match="expected a JSON array"):
        feed.read_pages(spark, str(tmp_path)).collect()


def test_lines_in_feed_order(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"n":4}\n')
    (tmp_path / "a.jsonl").write_text("".join(f'{{"n":{i}}}\n' for i in range(4)) + "\n")
    rows = feed.read_lines(spark, str(tmp_path)).repartition(3).orderBy("feed_pos").collect()
    assert [json.loads(r.raw)["n"] for r in rows] == [0, 1, 2, 3, 4]
    mapped = ingest.map_meters(feed.read_lines(spark, str(tmp_path)), "s", at())
    assert mapped.count() == 5


def test_split_files_keep_their_order(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(f'{{"n":{i}}}\n' for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        lines = feed.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 1
        assert [json.loads(r.raw)["n"] for r in lines.orderBy("feed_pos").collect()] == list(range(5000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_row_limit():
    assert feed.row_limit() is None
    assert feed.row_limit(full=True) is None
    assert feed.row_limit(7, full=True) == 7
    assert feed.row_limit(10**9) == 10**9
    assert feed.row_limit(full=True, default=30) is None
    assert feed.row_limit(default=30) == 30
    assert feed.row_limit(5, default=30) == 5
    assert feed.row_limit(default=-1) is None
    for bad in (0, -3, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            feed.row_limit(bad)


def test_dataset_selection():
    assert feed.select_datasets() == ["blocks", "meters", "regulations"]
    assert feed.select_datasets(["regulations", " blocks"]) == ["blocks", "regulations"]
    with pytest.raises(ValueError, match="spots"):
        feed.select_datasets(["spots"])


@pytest.mark.parametrize(
    "record, reason",
    [
        ({"post_id": "1", "latitude": "37.1", "longitude": "-122"}, None),
        ({"post_id": "1", "latitude": 37.1, "lng": -122}, None),
        ({"post_id": "1", "y": "37.1", "x": "-122"}, None),
        ({"post_id": "1", "latitude": "37.1"}, "invalid_coordinates"),
        ({"post_id": "1", "y": "137.1", "x": "-122"}, "missing_coordinates"),
        ({"post_id": "1", "shape": {"coordinates": [-122, 37]}}, None),
        ({"post_id": "1", "shape": {"coordinates": [-122, 37, 5]}}, "missing_coordinates"),
        ({"post_id": "1", "shape": {"coordinates": [-122, 137]}}, "missing_coordinates"),
        ({"post_id": "1", "latitude": "bad", "longitude": "-122", "shape": {"coordinates": [-122, 37]}}, None),
        ({"post_id": "1", "location": {"latitude": 37.5, "longitude": -122.5}}, None),
        ({"post_id": "1", "location": {"latitude": "37.5", "longitude": "-122.5"}}, "missing_coordinates"),
        ({"post_id": "1", "latitude": 37.5, "location": {"longitude": -122.5}}, None),
        ({"post_id": "1", "latitude": "90", "longitude": "180"}, None),
        ({"post_id": "1", "latitude": "-90", "longitude": "-180"}, None),
        ({"post_id": "1", "latitude": "90.0001", "longitude": "0"}, "invalid_coordinates"),
        ({"post_id": "1", "latitude": "Infinity", "longitude": "0"}, "invalid_coordinates"),
        ({"latitude": "37.1", "longitude": "-122"}, "missing_meter_id"),
        ({"post_id": " ", "objectid": 9, "latitude": "37.1", "longitude": "-122"}, None),
        ({"latitude": "137", "longitude": "-122"}, "invalid_coordinates"),
        ("not json", "missing_coordinates"),
        ("[]", "missing_coordinates"),
    ],
)
def test_meter_verdicts(spark, record, reason):
    assert mapped(spark, [record])[0]["skip_reason"] == reason


def test_shape_replaces_both_coordinates(spark):
    row = mapped(spark, [{"post_id": "1", "latitude": "1", "shape": {"coordinates": [-122.5, 37.5]}}])[0]
    assert (row["latitude"], row["longitude"]) == (37.5, -122.5)


def test_location_fills_only_the_missing_side(spark):
    row = mapped(spark, [{"post_id": "1", "latitude": "1", "location": {"latitude": 2.0, "longitude": 3.0}}])[0]
    assert (row["latitude"], row["longitude"]) == (1.0, 3.0)


def test_meter_fields(spark):
    point = {"latitude": 1, "longitude": 2}
    rows = mapped(
        spark,
        [
            {**point, "postid": " P1 ", "streetname": "Oak", "street_num": "5", "status": "Y", "blockface": " B "},
            {**point, "meter_id": "M", "street": "Oak", "streetnum": "7"},
            {**point, "id": 3, "neighborhood": "Hill"},
            {**point, "id": 4, "address": "Somewhere"},
            {**point, "id": 5, "location": {"latitude": 1.0}},
        ],
    )
    assert [r["external_id"] for r in rows] == ["P1", "M", "3", "4", "5"]
    assert [r["post_id"] for r in rows] == ["P1", "M", "3", "4", "5"]
    # An object under `location` has no text form and gives no street.
    assert [r["street_name"] for r in rows] == ["Oak", "7 Oak", "Hill", "Somewhere", None]
    assert rows[0]["blockface_id"] == "B" and rows[0]["active_meter_flag"] == "Y"


def test_accepted_and_rejected_make_up_the_feed(spark):
    records = [{"post_id": str(i % 3), "latitude": i * 20, "longitude": 0} for i in range(9)]
    feed_rows = ingest.map_meters(feed_of(spark, records), "s", at())
    row = counts.skip_counts(feed_rows, ingest.METER_SKIPS).collect()[0]
    assert row.fetched == 9 and row.ready + row.skipped == 9
    assert row.skipped == row.skipped_missing_coordinates + row.skipped_missing_meter_id + row.skipped_invalid_coordinates
    kept = ingest.meter_rows(feed_rows).select("external_id", "latitude").collect()
    assert {r.external_id: r.latitude for r in kept} == {"0": 60.0, "1": 80.0, "2": 40.0}


def test_blocks(spark):
    records = [
        {"objectid": 1, "blockface_id": "A", "num_spaces": "4", "location": {"latitude": 1.5, "longitude": 2.5}},
        {"blockface": "B", "spaces": "2.5"},
        {":id": "r1"},
        {"name": "Oak"},
    ]
    df = ingest.map_blocks(feed_of(spark, records), "s", at())
    rows = [r.asDict() for r in df.orderBy("feed_pos").collect()]
    assert [r["external_id"] for r in rows][:3] == ["1", "B", "row-r1"]
    assert rows[3]["external_id"].startswith("row-") and len(rows[3]["external_id"]) == 68
    assert [r["skip_reason"] for r in rows] == [None, "invalid_spaces_count", None, None]
    assert (rows[0]["spaces_count"], rows[0]["latitude"], rows[0]["longitude"]) == (4, 1.5, 2.5)
    again = [r.external_id for r in ingest.map_blocks(feed_of(spark, records), "s", at()).orderBy("feed_pos").collect()]
    assert again == [r["external_id"] for r in rows]


def test_regulations(spark):
    blocks = ingest.block_rows(
        ingest.map_blocks(feed_of(spark, [{"objectid": 1, "blockface_id": "A"}, {"objectid": 2, "blockface_id": "B"}]), "s", at())
    )
    regs = [
        {"blockface": "A", "regulation": "first", "hrlimit": "1"},
        {"name": "A", "regulation": "second", "hrlimit": "2"},
        {"blockface": "A", "regulation": "fraction", "hrlimit": "1.5"},
        {"blockface": "Z", "regulation": "nowhere"},
        {"regulation": "keyless"},
    ]
    matched = ingest.match_regulations(ingest.map_regulations(feed_of(spark, regs)), blocks)
    count = ingest.match_counts(matched).collect()[0]
    assert (count.matched, count.unmatched) == (2, 3)
    merged = {r.external_id: r for r in ingest.merge_regulations(blocks, matched, at()).collect()}
    assert (merged["1"].regulation_type, merged["1"].hour_limit) == ("second", 2)
    assert merged["2"].regulation_type is None


def test_duplicate_blockfaces_resolve_the_same_way(spark):
    blocks = spark.createDataFrame([("a", "F", "2"), ("b", "F", "1"), ("c", None, "0")], "id string, blockface_id string, external_id string")
    assert [tuple(r) for r in ingest.blockface_index(blocks).collect()] == [("F", "b")]


def test_newest_import_wins(spark):
    rows = [("m1", "P", "2024-01-01"), ("m2", "P", "2024-01-03"), ("m3", "P", "2024-01-02")]
    meters = spark.createDataFrame(rows, "external_id string, post_id string, imported string").select(
        F.col("external_id").alias("id"), "*", F.lit("x").alias("source_id"), F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"),
        *[F.lit(None).cast("string").alias(c) for c in ("blockface_id", "street_name", "street_num", "meter_type", "cap_color", "on_offstreet_type", "active_meter_flag", "jurisdiction")],
        F.col("imported").cast("timestamp_ntz").alias("imported_at"),
    )
    sources = registry.source_rows(spark, ["meters"])
    row = normalize.normalize(meters, sources, at()).collect()
    assert len(row) == 1
    raw = json.loads(row[0].raw_source)
    assert raw["external_id"] == "m2" and raw["provider"] is None and len(raw) == 10


def tables(spark):
    def empty(schema):
        kinds = {"timestamp": "timestamp_ntz"}
        columns = [f"{f.name} {kinds.get(f.dataType.simpleString(), f.dataType.simpleString())}" for f in schema.fields]
        return spark.createDataFrame([], ", ".join(columns))

    return {
        "sources": empty(schemas.SOURCES),
        "blocks": empty(schemas.BLOCKS),
        "meters": empty(schemas.METERS),
        "locations": empty(schemas.LOCATIONS),
    }


NAMES = ("sources", "blocks", "meters", "locations")


def city_feeds(spark):
    meters = [{"post_id": f"P{i}", "lat": 37, "lng": -122, "blockface": "A"} for i in range(5)] + [{}]
    return {
        "blocks": feed_of(spark, [{"objectid": 1, "blockface_id": "A"}]),
        "meters": feed_of(spark, meters),
        "regulations": feed_of(spark, [{"blockface": "A", "regulation": "RPP"}, {"blockface": "Z"}]),
    }


def test_run_import_writes_and_reruns(spark, tmp_path):
    feeds = city_feeds(spark)
    first = city.run_import(spark, feeds, tables(spark), str(tmp_path / "one"), at())
    assert first["counts.meters"].collect()[0].skipped == 1
    assert first["counts.regulations"].collect()[0].matched == 1
    assert first["quality"].collect()[0].passed
    block = first["tables.blocks"].collect()[0]
    assert block.regulation_type == "RPP"
    assert {r.block_id for r in first["tables.meters"].collect()} == {block.id}
    sources = {r.source_key: r.last_row_count for r in first["tables.sources"].collect()}
    assert sources == {"datasf_metered_blocks": 1, "datasf_parking_meters": 5, "datasf_parking_regulations": 1}
    raw = json.loads(first["tables.locations"].collect()[0].raw_source)
    assert raw["source_display_name"] == "Parking Meters"
    audit = first["audit.meters"].collect()[0]
    assert (audit.rows_fetched, audit.rows_inserted, audit.rows_updated, audit.rows_skipped) == (6, 5, 0, 1)

    kept = {n: first[f"tables.{n}"] for n in NAMES}
    second = city.run_import(spark, feeds, kept, str(tmp_path / "two"), at())
    for name in NAMES:
        assert spark_rows(second[f"tables.{name}"]) == spark_rows(first[f"tables.{name}"])
    audit = second["audit.meters"].collect()[0]
    assert (audit.rows_inserted, audit.rows_updated, audit.status) == (0, 5, "partial")

    # Blocks imported alone keep the regulations they already have.
    third = city.run_import(spark, feeds, kept, str(tmp_path / "three"), at(), only=["blocks"])
    assert third["tables.blocks"].collect()[0].regulation_type == "RPP"
    assert "counts.meters" not in third


def test_dry_run_writes_nothing(spark, tmp_path):
    out = tmp_path / "out"
    result = city.run_import(spark, city_feeds(spark), tables(spark), str(out), at(), dry_run=True)
    assert result["counts.meters"].collect()[0].ready == 5
    assert result["counts.regulations"].collect()[0].matched == 1
    assert not out.exists()


def test_a_changed_feed_is_not_imported(spark, tmp_path):
    fields = {"meters": ["post_id", "lat", "lng", "blockface", "jurisdiction"], "blocks": ["objectid", "blockface_id"]}
    result = city.run_import(spark, city_feeds(spark), tables(spark), str(tmp_path / "out"), at(), expected=fields)
    assert result["drift.meters"].collect()[0].missing_fields == "jurisdiction"
    assert "drift.blocks" not in result and result["tables.meters"].count() == 0
    assert result["tables.blocks"].count() == 1
    assert {r.source_key for r in result["tables.sources"].collect()} == {"datasf_metered_blocks", "datasf_parking_regulations"}


def test_seed(spark, tmp_path):
    (tmp_path / "seed.csv").write_text(
        "street_name,address,latitude,longitude,status,parking_type,price,time_limit,source\n"
        "Oak St,1 Oak St,37.1,-122.1,AVAILABLE,METERED,$2.00/hr,2 hours,MOCK\n"
        "Elm St,,37.2,-122.2,OCCUPIED,FREE,,,MOCK\n"
        "Bad St,,37.3,-122.3,TAKEN,FREE,,,MOCK\n"
    )
    spots, rejected = read_seed(spark, str(tmp_path / "seed.csv"), at())
    assert sorted(r.street_name for r in spots.collect()) == ["Elm St", "Oak St"]
    assert [r.violations for r in rejected.collect()] == [["status not allowed"]]
    assert spark_rows(spots) == spark_rows(read_seed(spark, str(tmp_path / "seed.csv"), at())[0])


def test_drift(spark):
    row = city.schema_drift(feed_of(spark, [{"a": 1}, {"b": 2, "z": 3}]), ["a", "b", "c"]).collect()[0]
    assert (row.missing_fields, row.unexpected_fields, row.unexpected_names, row.drifted) == ("c", 1, "z", True)
    assert not city.schema_drift(feed_of(spark, [{"a": 1}]), ["a"]).collect()[0].drifted


def test_an_empty_location_table_passes(spark):
    from curbspark.operators.quality import verify_locations

    row = verify_locations(tables(spark)["locations"]).collect()[0]
    assert (row.row_count, row.passed) == (0, True)
