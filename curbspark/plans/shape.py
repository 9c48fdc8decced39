"""The shape of a feed's records: what kinds of values each field holds, and how it drifts.

A sketch is a table of (field, shape, records): how many records hold a value of
that shape under that field.  A shape is a kind (STRING, NUMBER, BOOLEAN, OBJECT,
ARRAY, NULL) with all that is nested in it, as in `OBJECT<coordinates:
ARRAY<NUMBER>, type: STRING>`.  One row without a field counts all records and one
more those that are no JSON object.  Sketches of parts of a feed add up to the
sketch of the whole, so that each import keeps its own and none is read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shapes of the two rows without a field.
ALL, UNREADABLE = "RECORDS", "UNREADABLE"
#: A field is sparser if the share of records that hold a value fell by more than this.
SPARSER_BY = 0.1


def _shape(value: Column) -> Column:
    """Whole numbers, decimals and doubles are one kind, as feeds write 12 and 12.5 in one field."""
    raw = F.schema_of_variant(value)
    numbers = F.regexp_replace(raw, r"\b(BIGINT|DOUBLE|DECIMAL\(\d+,\s*\d+\))", "NUMBER")
    return F.when(value.isNull() | (raw == "VOID"), "NULL").otherwise(numbers)


def shape_sketch(feed: DataFrame) -> DataFrame:
    """Sketch of a feed of raw JSON records, each parsed once.

    Rows combine on the map side: the exchange carries one row per field, shape
    and task.  A record that is null or no object counts as unreadable; of a name
    that an object repeats the last value counts.  An empty feed has no rows.
    """
    parsed = feed.select(F.from_json("raw", "map<string,variant>", {"mode": "PERMISSIVE"}).alias("_fields"))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(ALL).alias("shape")))
    broken = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(UNREADABLE).alias("shape")))
    held = F.transform(
        F.map_entries("_fields"), lambda e: F.struct(e["key"].alias("field"), _shape(e["value"]).alias("shape"))
    )
    rows = parsed.select(F.inline(F.concat(whole, F.when(F.col("_fields").isNull(), broken).otherwise(held))))
    return rows.groupBy("field", "shape").agg(F.count(F.lit(1)).alias("records"))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """The union of several sketches as one."""
    return sketches.groupBy("field", "shape").agg(F.sum("records").alias("records"))


def kind_of(shape: Column) -> Column:
    return F.regexp_extract(shape, "^[A-Z]+", 0)


def field_summary(sketch: DataFrame) -> DataFrame:
    """Per field: `kinds` in order, `records` that have it, `filled` ones (not null), `shapes` and `depth` of nesting."""
    depth = F.aggregate(
        F.split("shape", ""),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("most")),
        lambda s, c: F.struct(
            (s["at"] + F.when(c == "<", 1).when(c == ">", -1).otherwise(0)).alias("at"),
            F.greatest(s["most"], s["at"] + F.when(c == "<", 1).otherwise(0)).alias("most"),
        ),
        lambda s: s["most"],
    )
    kind = kind_of(F.col("shape"))
    return (
        sketch.where(F.col("field").isNotNull())
        .withColumns({"_kind": kind, "_depth": depth})
        .groupBy("field")
        .agg(
            F.array_join(F.array_sort(F.collect_set("_kind")), ",").alias("kinds"),
            F.sum("records").alias("records"),
            F.sum(F.when(F.col("_kind") != "NULL", F.col("records")).otherwise(0)).alias("filled"),
            F.count(F.lit(1)).alias("shapes"),
            F.max("_depth").alias("depth"),
        )
    )


def shape_drift(before: DataFrame, now: DataFrame, sparser_by: float = SPARSER_BY) -> DataFrame:
    """(field, state, kinds_before, kinds_now): a row for each field that is no longer what it was.

    `missing`: no record has it; `unexpected`: no record had it; `retyped`: it holds
    a kind that it did not (null is no kind); `sparser`: fewer records hold a
    value, by share.  A retyped field is not called sparser as well.  Against an
    empty sketch every field is unexpected or missing.
    """

    def side(sketch: DataFrame, name: str) -> DataFrame:
        return field_summary(sketch).select(
            "field", F.col("kinds").alias(f"kinds_{name}"), F.col("filled").alias(f"_filled_{name}")
        )

    def total(sketch: DataFrame) -> Column:
        return sketch.where((F.col("shape") == ALL) & F.col("field").isNull()).agg(F.sum("records")).scalar()

    joined = side(before, "before").join(side(now, "now"), "field", "full")
    news = F.array_except(F.split("kinds_now", ","), F.concat(F.split("kinds_before", ","), F.array(F.lit("NULL"))))
    share_before, share_now = F.col("_filled_before") / total(before), F.col("_filled_now") / total(now)
    state = (
        F.when(F.col("kinds_now").isNull(), "missing")
        .when(F.col("kinds_before").isNull(), "unexpected")
        .when(F.size(news) > 0, "retyped")
        .when(share_before - share_now > sparser_by, "sparser")
    )
    return joined.select("field", state.alias("state"), "kinds_before", "kinds_now").where("state is not null")


def drift_message(drift: DataFrame) -> DataFrame:
    """One row, `error_message`: the drifted fields by state and name, null if there are none."""
    named = F.concat_ws(" ", "state", "field", F.concat(F.lit("("), F.concat_ws(" to ", "kinds_before", "kinds_now"), F.lit(")")))
    told = F.array_join(F.array_sort(F.collect_set(named)), "; ")
    return drift.agg(F.nullif(told, F.lit("")).alias("error_message"))
