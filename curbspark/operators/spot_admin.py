"""Create, update, delete and availability operations on the spot inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbspark.functions.text import non_blank
from curbspark.operators.skew import lookup_join, unique_join

FIELDS = ("address", "latitude", "longitude", "available", "price", "restrictions")
REJECT = "reject_reason"


def _field_problem() -> Column:
    """Why a create or update is refused, by its fields alone."""
    return F.when(F.col("op").isin("create", "update"), F.coalesce(
        F.when(F.col("latitude").isNull(), "latitude_required"),
        F.when(F.col("longitude").isNull(), "longitude_required"),
        F.when(non_blank(F.col("address")).isNull(), "address_required"),
        F.when(F.col("price") <= 0, "price_not_positive"),
    ))


def check_operations(spots: DataFrame, operations: DataFrame, **join_options) -> DataFrame:
    """Operations (id, op, seq and spot fields) with `reject_reason`.

    A spot lives from its creation, or from before the log, to its first
    delete; ids are never given out twice.  Operations outside that span are
    refused as `not_found`, a create on a living or former spot as
    `id_taken`.
    """
    checked = operations.withColumn(REJECT, _field_problem())
    sound = checked.where(F.col(REJECT).isNull())
    touched = operations.groupBy("id").agg(
        F.min(F.when((F.col("op") == "create") & _field_problem().isNull(), F.col("seq"))).alias("_created")
    )
    known = spots.select("id", F.lit(True).alias("_known"))
    starts = lookup_join(touched, known, ["id"], "left", salt_by=["id"], **join_options).select(
        "id",
        F.when(F.col("_known").isNull(), F.col("_created")).alias("_born"),
        F.coalesce("_known", F.lit(False)).alias("_known"),
    )
    deletes = sound.where(F.col("op") == "delete").select("id", "seq")
    ends = (
        lookup_join(deletes, starts, ["id"], "inner", salt_by=["seq"], **join_options)
        .where(F.col("_known") | (F.col("seq") > F.col("_born")))
        .groupBy("id")
        .agg(F.min("seq").alias("_died"))
    )
    spans = starts.join(ends, "id", "left")
    dated = lookup_join(checked, spans, ["id"], "left", salt_by=["seq"], **join_options)
    seq, born, died = F.col("seq"), F.col("_born"), F.col("_died")
    known_before = F.coalesce(F.col("_known"), F.lit(False))
    exists = (known_before | F.coalesce(seq > born, F.lit(False))) & (died.isNull() | (seq <= died))
    taken = (F.col("op") == "create") & (known_before | F.coalesce(seq > born, F.lit(False)))
    absent = (F.col("op") != "create") & ~exists
    reason = F.coalesce(
        F.col(REJECT), F.when(taken, "id_taken"), F.when(absent, "not_found")
    )
    return dated.select(*operations.columns, reason.alias(REJECT))


def apply_operations(spots: DataFrame, checked: DataFrame, **join_options) -> DataFrame:
    """Spots after the accepted operations of `check_operations`.

    Creates and updates replace the six fields; an availability operation
    changes only `available`.
    """
    accepted = checked.where(F.col(REJECT).isNull())
    whole = F.col("op").isin("create", "update")
    fold = accepted.groupBy("id").agg(
        F.max_by(F.struct(*FIELDS), F.when(whole, F.col("seq"))).alias("_row"),
        F.max_by("available", F.when(F.col("op") != "delete", F.col("seq"))).alias("_available"),
        F.bool_or(F.col("op") == "delete").alias("_deleted"),
    )
    joined = unique_join(spots, fold, ["id"], "full", **join_options).where(
        ~F.coalesce(F.col("_deleted"), F.lit(False))
    )
    rewritten = F.col("_row").isNotNull()
    values = []
    for name in spots.columns:
        if name == "available":
            values.append(F.coalesce("_available", name).alias(name))
        elif name in FIELDS:
            values.append(F.when(rewritten, F.col(f"_row.{name}")).otherwise(F.col(name)).alias(name))
        else:
            values.append(F.col(name))
    return joined.select(*values)
