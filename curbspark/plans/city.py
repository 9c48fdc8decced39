"""The city pipeline end to end, as plans and as a run that writes tables."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbspark.operators.counts import skip_counts
from curbspark.operators.diff import KINDS, change_counts, diff_tables
from curbspark.operators.quality import verify_locations
from curbspark.operators.upsert import CHANGE, upsert
from curbspark.plans import ingest, normalize, shape
from curbspark.sources.feed import limit_rows, select_datasets, spread
from curbspark.sources.registry import (
    DEFINITIONS,
    PROVIDER,
    record_imports,
    register_sources,
    source_id,
    source_rows,
)
from curbspark.sources.tables import write_located


def _feed_source(name: str) -> str:
    return source_id(DEFINITIONS[name][0])


@dataclass
class CityPlan:
    """Feeds to normalized locations in one lineage, for dry runs and reports.

    Each result is planned when first asked for and never run by itself.
    """

    meter_feed: DataFrame
    block_feed: DataFrame
    regulation_feed: DataFrame
    sources: DataFrame
    at: Column

    @cached_property
    def mapped_meters(self) -> DataFrame:
        return ingest.map_meters(self.meter_feed, _feed_source("meters"), self.at)

    @cached_property
    def imported_blocks(self) -> DataFrame:
        return ingest.block_rows(ingest.map_blocks(self.block_feed, _feed_source("blocks"), self.at))

    @cached_property
    def matched_regulations(self) -> DataFrame:
        return ingest.match_regulations(ingest.map_regulations(self.regulation_feed), self.imported_blocks)

    @cached_property
    def blocks(self) -> DataFrame:
        return ingest.merge_regulations(self.imported_blocks, self.matched_regulations, self.at)

    @cached_property
    def meter_rows(self) -> DataFrame:
        return ingest.meter_rows(self.mapped_meters)

    @cached_property
    def meters(self) -> DataFrame:
        return ingest.attach_blocks(self.meter_rows, self.imported_blocks)

    @cached_property
    def locations(self) -> DataFrame:
        """Does not depend on blocks: a location carries no block id."""
        return normalize.normalize(self.meter_rows, self.sources, self.at)

    def quality(self) -> DataFrame:
        return verify_locations(self.locations)

    def meter_counts(self) -> DataFrame:
        return skip_counts(self.mapped_meters, ingest.METER_SKIPS)


def import_audit(
    upserted: DataFrame, mapped: DataFrame, source: str, dataset: str, target: str, started_at: Column, finished_at: Column
) -> DataFrame:
    """One audit row: rows fetched, inserted, updated and skipped by an import.

    `upserted` is an upsert result with `_change`; `mapped` has `skip_reason`.
    The two one-row counts meet by union and a last sum.
    """
    zero = F.lit(0).cast("bigint")
    written = upserted.agg(
        F.count_if(F.col(CHANGE) == "inserted").alias("rows_inserted"),
        F.count_if(F.col(CHANGE) == "updated").alias("rows_updated"),
    ).select(zero.alias("rows_fetched"), "rows_inserted", "rows_updated", zero.alias("rows_skipped"))
    read = mapped.agg(
        F.count(F.lit(1)).alias("rows_fetched"), F.count("skip_reason").alias("rows_skipped")
    ).select("rows_fetched", zero.alias("rows_inserted"), zero.alias("rows_updated"), "rows_skipped")
    totals = written.unionByName(read).agg(
        *[F.sum(c).alias(c) for c in ("rows_fetched", "rows_inserted", "rows_updated", "rows_skipped")]
    )
    return totals.select(
        F.lit(source).alias("source"),
        F.lit(dataset).alias("source_dataset"),
        F.lit(target).alias("target_table"),
        F.when(F.col("rows_skipped") > 0, "partial").otherwise("success").alias("status"),
        started_at.alias("started_at"),
        finished_at.alias("finished_at"),
        "*",
        zero.alias("rows_deleted"),
    )


#: Columns that say when or by which run a row was written; what changed is told by the others.
BOOKKEEPING = ("id", "imported_at", "updated_at", "created_at", "last_synced_at", "raw_source")


@dataclass(frozen=True)
class Offer:
    """What a feed brings for one target: the rows there were, the rows it offers, and all it fetched."""

    dataset: str
    target: str
    keys: tuple[str, ...]
    old: DataFrame
    new: DataFrame
    fetched: DataFrame
    skipped: Column


def offer_changes(offers: dict[str, Offer]) -> DataFrame:
    """(target, key, change) for all offers: the names of `offers` are the targets."""
    return diff_tables(
        {n: o.old for n, o in offers.items()},
        {n: o.new for n, o in offers.items()},
        {n: list(o.keys) for n, o in offers.items()},
        BOOKKEEPING,
    )


def import_log(
    changes: DataFrame, offers: dict[str, Offer], started_at: Column, finished_at: Column, whole: bool = True
) -> DataFrame:
    """One audit row for each offer, those without any row included.

    `changes` are the offers' changes.  `rows_deleted` are rows of the table that
    the feed no longer brings; a feed that was cut short (not `whole`) says nothing
    about them, so they then count as 0.  Rows of a key that the table holds
    more than once count as `rows_repeated`.
    """
    names = list(offers)
    zero = F.lit(0).cast("bigint")
    counted = [*KINDS, "fetched", "skipped"]

    def row(df: DataFrame, **given: Column) -> DataFrame:
        return df.select("target", *[given.get(c, zero).alias(c) for c in counted])

    read = [
        row(
            o.fetched.agg(F.count(F.lit(1)).alias("_fetched"), F.count_if(o.skipped).alias("_skipped")).withColumn(
                "target", F.lit(n)
            ),
            fetched=F.col("_fetched"),
            skipped=F.col("_skipped"),
        )
        for n, o in offers.items()
    ]
    diffed = row(change_counts(changes), **{k: F.col(k) for k in KINDS})
    totals = reduce(DataFrame.unionByName, [*read, diffed]).groupBy("target").agg(*[F.sum(c).alias(c) for c in counted])

    def named(attribute: str) -> Column:
        pairs = [F.lit(x) for n in names for x in (n, getattr(offers[n], attribute))]
        return F.element_at(F.create_map(*pairs), F.col("target"))

    return totals.select(
        F.lit(PROVIDER).alias("source"),
        named("dataset").alias("source_dataset"),
        named("target").alias("target_table"),
        F.when(F.col("skipped") + F.col("repeated") > 0, "partial").otherwise("success").alias("status"),
        started_at.alias("started_at"),
        finished_at.alias("finished_at"),
        F.col("fetched").alias("rows_fetched"),
        F.col("inserted").alias("rows_inserted"),
        F.col("changed").alias("rows_updated"),
        F.col("unchanged").alias("rows_unchanged"),
        (F.col("deleted") if whole else zero).alias("rows_deleted"),
        F.col("skipped").alias("rows_skipped"),
        F.col("repeated").alias("rows_repeated"),
        F.lit(None).cast("string").alias("error_message"),
    )


def failed_import(
    why: DataFrame, fetched: DataFrame, dataset: str, target: str, started_at: Column, finished_at: Column
) -> DataFrame:
    """The audit row of a feed that was stopped: what it held, nothing written, and why (one row, `error_message`)."""
    zero = F.lit(0).cast("bigint")
    held = fetched.agg(F.count(F.lit(1)).alias("rows_fetched")).select(
        "rows_fetched", F.lit(None).cast("string").alias("error_message")
    )
    both = held.unionByName(why.select(zero.alias("rows_fetched"), "error_message")).agg(
        F.sum("rows_fetched").alias("rows_fetched"), F.max("error_message").alias("error_message")
    )
    return both.select(
        F.lit(PROVIDER).alias("source"),
        F.lit(dataset).alias("source_dataset"),
        F.lit(target).alias("target_table"),
        F.lit("failed").alias("status"),
        started_at.alias("started_at"),
        finished_at.alias("finished_at"),
        "rows_fetched",
        *[zero.alias(f"rows_{c}") for c in ("inserted", "updated", "unchanged", "deleted", "skipped", "repeated")],
        "error_message",
    )


def schema_drift(feed: DataFrame, expected: Iterable[str]) -> DataFrame:
    """One row: expected fields no record has, fields nobody expected, `drifted`.

    Looks at every record.  Field names combine on the map side, so the
    exchange carries one row per name and task.
    """
    wanted = sorted(set(expected))
    seen = feed.select(F.explode(F.json_object_keys("raw")).alias("field")).distinct()
    listed = F.col("field").isin(*wanted)
    found = F.array_sort(F.collect_set(F.when(listed, F.col("field"))))
    return (
        seen.agg(
            F.array_except(F.array(*[F.lit(w) for w in wanted]), found).alias("missing"),
            F.count_if(~listed).alias("unexpected_fields"),
            F.array_join(F.array_sort(F.collect_set(F.when(~listed, F.col("field")))), ",").alias("unexpected_names"),
        )
        .select(
            F.concat_ws(",", "missing").alias("missing_fields"), "unexpected_fields", "unexpected_names"
        )
        .withColumn("drifted", (F.col("missing_fields") != "") | (F.col("unexpected_fields") > 0))
    )


def drift_fields(feed: DataFrame, expected: Iterable[str]) -> DataFrame:
    """(field, state, records): a row for each expected field that no record has and each field nobody expected."""
    wanted = F.array(*[F.lit(w) for w in sorted(set(expected))])
    named = feed.sparkSession.range(1).select(F.explode(wanted).alias("field"), F.lit(True).alias("_wanted"))
    seen = feed.select(F.explode(F.json_object_keys("raw")).alias("field")).groupBy("field").agg(
        F.count(F.lit(1)).alias("_records")
    )
    state = F.when(F.col("_records").isNull(), "missing").when(F.col("_wanted").isNull(), "unexpected")
    return (
        seen.join(named, "field", "full")
        .select("field", state.alias("state"), F.coalesce("_records", F.lit(0)).alias("records"))
        .where("state is not null")
    )


class _Stage:
    """Writes each step of an import once and reads it back, or neither when dry.

    Rows, rejects and counters then come from the written step: the parse is
    not repeated for each of them, and a lost executor costs no earlier step.
    """

    def __init__(self, spark: SparkSession, out: str, dry_run: bool) -> None:
        self.spark, self.out, self.dry_run = spark, out.rstrip("/"), dry_run

    def keep(self, df: DataFrame, name: str, located: bool = False) -> DataFrame:
        if self.dry_run:
            return df
        path = f"{self.out}/{name}"
        if located:
            write_located(df, path)
        else:
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


def run_import(
    spark: SparkSession,
    feeds: dict[str, DataFrame],
    tables: dict[str, DataFrame],
    out: str,
    at: Column,
    only: Iterable[str] | None = None,
    limit: int | None = None,
    dry_run: bool = False,
    expected: dict[str, Iterable[str]] | None = None,
    shapes: dict[str, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Import the chosen feeds in order; returns tables, counters and audit rows.

    `feeds` has blocks, meters and regulations; `tables` the current sources,
    blocks, meters and locations.  The result has the next state of each as
    `tables.<name>`, counters as `counts.<feed>`, an audit row per keyed write
    as `audit.<feed>` and the verdict on the locations as `quality`.  Tables
    are written under `out`, which must differ from where the current ones
    lie; a dry run writes nothing.

    With `expected` field names a feed whose fields have changed is not
    imported: its last good data stay, and `drift.<feed>` says what changed.

    With `shapes`, sketches of the last good feeds (see `plans/shape.py`), a feed
    that has lost a field or holds another kind of value in one is not imported
    either.  `shape.<feed>` is the sketch of this one.

    `log` has an audit row for every target the run touched (regulations and
    locations too) and for every feed that drift stopped; `changes` says of each
    key whether it was inserted, changed, left as it was or is gone from its feed.
    """
    stage = _Stage(spark, out, dry_run)
    results: dict[str, DataFrame] = {}
    state = dict(tables)
    written: list[DataFrame] = []
    offers: dict[str, Offer] = {}
    log: list[DataFrame] = []
    chosen = []

    def stopped(name: str, why: DataFrame) -> None:
        target = "blocks" if name == "regulations" else name
        log.append(failed_import(why, feeds[name], DEFINITIONS[name][2], f"city_parking_{target}", at, at))

    for name in select_datasets(only):
        if expected and name in expected:
            drift = schema_drift(feeds[name], expected[name])
            if drift.first().drifted:
                results[f"drift.{name}"] = drift
                names = [F.lit("missing: "), F.col("missing_fields"), F.lit("; unexpected: "), F.col("unexpected_names")]
                stopped(name, drift.select(F.concat(*names).alias("error_message")))
                continue
        if shapes and name in shapes:
            # Kept first, so that the feed is parsed once for the verdict and the message.
            sketch = stage.keep(shape.shape_sketch(feeds[name]), f"shapes/{name}")
            results[f"shape.{name}"] = sketch
            drift = stage.keep(shape.shape_drift(shapes[name], sketch), f"drift/{name}")
            if not drift.where("state in ('missing', 'retyped')").isEmpty():
                results[f"drift.{name}"] = drift
                stopped(name, shape.drift_message(drift))
                continue
        chosen.append(name)

    def feed(name: str) -> DataFrame:
        return spread(limit_rows(feeds[name], limit))

    def written_rows(name: str, rows: DataFrame) -> None:
        written.append(rows.select(F.lit(_feed_source(name)).alias("id"), "last_row_count"))

    def keyed_write(name: str, rows: DataFrame, mapped: DataFrame) -> None:
        keys = ["source_id", "external_id"]
        # Kept, as the write and the comparison both read them.
        rows = stage.keep(rows, f"stage/{name}_rows")
        own = state[name].where(F.col("source_id") == _feed_source(name))
        offers[name] = Offer(
            DEFINITIONS[name][2], f"city_parking_{name}", tuple(keys), own, rows, mapped, F.col("skip_reason").isNotNull()
        )
        merged = upsert(state[name], rows, keys, at=at, keep=["id"], with_change=True)
        merged = stage.keep(merged, name)
        state[name] = merged.drop(CHANGE)
        results[f"audit.{name}"] = import_audit(
            merged, mapped, PROVIDER, DEFINITIONS[name][2], f"city_parking_{name}", at, at
        )
        written_rows(
            name, merged.agg(F.count_if(F.col(CHANGE) != "unchanged").alias("last_row_count"))
        )

    if "blocks" in chosen:
        mapped = stage.keep(ingest.map_blocks(feed("blocks"), _feed_source("blocks"), at), "stage/blocks")
        results["counts.blocks"] = skip_counts(mapped, (ingest.INVALID_SPACES,))
        keyed_write("blocks", ingest.block_rows(mapped), mapped)
    if "meters" in chosen:
        mapped = stage.keep(ingest.map_meters(feed("meters"), _feed_source("meters"), at), "stage/meters")
        results["counts.meters"] = skip_counts(mapped, ingest.METER_SKIPS)
        keyed_write("meters", ingest.attach_blocks(ingest.meter_rows(mapped), state["blocks"]), mapped)
    if "regulations" in chosen:
        matched = ingest.match_regulations(ingest.map_regulations(feed("regulations")), state["blocks"])
        matched = stage.keep(matched, "stage/regulations")
        offers["regulations"] = Offer(
            DEFINITIONS["regulations"][2],
            "city_parking_blocks",
            ("id",),
            ingest.regulated(tables["blocks"]),
            ingest.last_patches(matched),
            matched,
            ~F.col("matched"),
        )
        state["blocks"] = stage.keep(
            ingest.merge_regulations(state["blocks"], matched, at), "blocks_with_regulations"
        )
        results["counts.regulations"] = ingest.match_counts(matched)
        written_rows(
            "regulations", results["counts.regulations"].select(F.col("matched").alias("last_row_count"))
        )
    registered = register_sources(state["sources"], source_rows(spark, chosen), at) if chosen else state["sources"]
    if written:
        registered = record_imports(registered, reduce(DataFrame.unionByName, written), at)
    state["sources"] = stage.keep(registered, "sources")
    if "meters" in chosen:
        mapped = normalize.map_locations(normalize.with_source(state["meters"], state["sources"]), at)
        mapped = stage.keep(mapped, "stage/locations")
        results["counts.locations"] = skip_counts(mapped, normalize.NORMALIZE_SKIPS)
        rows = stage.keep(normalize.location_rows(mapped), "stage/locations_rows")
        keys = ["source_type", "source_id"]
        offers["locations"] = Offer(
            DEFINITIONS["meters"][2],
            "normalized_parking_locations",
            tuple(keys),
            state["locations"].where(F.col("source_type") == normalize.SOURCE_TYPE),
            rows,
            mapped,
            F.col("skip_reason").isNotNull(),
        )
        merged = upsert(
            state["locations"],
            rows,
            keys,
            at=at,
            keep=["id"],
            defaults={"created_at": at},
        )
        state["locations"] = stage.keep(merged, "locations", located=True)
        results["quality"] = verify_locations(state["locations"])
    if offers:
        results["changes"] = stage.keep(offer_changes(offers), "changes")
        log.append(import_log(results["changes"], offers, at, at, whole=limit is None))
    if log:
        results["log"] = stage.keep(reduce(DataFrame.unionByName, log), "log")
    results.update({f"tables.{name}": df for name, df in state.items()})
    return results
