"""Row-change feeds applied to keyed state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbspark.operators.skew import lookup_join, unique_join

OPS = ("INSERT", "UPDATE", "DELETE")


def fold_changes(feed: DataFrame, key: str = "id", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """One row per key: last insert, last delete, last written row.

    INSERT replaces or adds, UPDATE replaces a present row, DELETE removes.
    Three maxima decide the outcome (see `apply_fold`), so folding is an
    aggregate: heavy keys combine on the map side, and folds of consecutive
    batches combine again with `merge_folds`.
    """
    position = F.struct(*order)
    op = F.col("op")
    payload = [c for c in feed.columns if c not in (key, "op", *order)]
    is_write = op.isin("INSERT", "UPDATE")
    return feed.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.max(F.when(op == "INSERT", position)).alias("last_insert"),
        F.max(F.when(op == "DELETE", position)).alias("last_delete"),
        F.max(F.when(is_write, position)).alias("last_write"),
        F.max_by(F.struct(*payload), F.when(is_write, position)).alias("row"),
    )


def merge_folds(folds: DataFrame, key: str = "id") -> DataFrame:
    """Folds of several batches as one fold per key."""
    return folds.groupBy(key).agg(
        F.max("last_insert").alias("last_insert"),
        F.max("last_delete").alias("last_delete"),
        F.max("last_write").alias("last_write"),
        F.max_by("row", "last_write").alias("row"),
    )


def _is_present(in_snapshot: Column) -> Column:
    inserted, deleted = F.col("last_insert"), F.col("last_delete")
    return F.when(deleted.isNull(), in_snapshot | inserted.isNotNull()).otherwise(
        F.coalesce(inserted > deleted, F.lit(False))
    )


def apply_fold(snapshot: DataFrame, fold: DataFrame, key: str = "id", **join_options) -> DataFrame:
    """State after the folded changes.

    A key is present if its last insert follows its last delete, or if it was
    never deleted and either was inserted or stood in the snapshot.  A present
    key then shows its last written row: nothing between a delete and the next
    insert can be last, as that insert is itself a write.  Columns the feed
    does not carry keep their snapshot value.  Applying a fold twice gives the
    same state, so a replayed batch does no harm.
    """
    written_names = fold.schema["row"].dataType.fieldNames()
    unknown = sorted(set(written_names).difference(snapshot.columns))
    if unknown:
        raise ValueError(f"change feed has columns the table lacks: {', '.join(unknown)}")
    state = snapshot.withColumn("_in_snapshot", F.lit(True))
    joined = unique_join(state, fold, [key], "full", **join_options)
    in_snapshot = F.coalesce(F.col("_in_snapshot"), F.lit(False))
    wrote = F.col("last_write").isNotNull()
    return joined.where(_is_present(in_snapshot)).select(
        *[
            F.when(wrote, F.col(f"row.{c}")).otherwise(F.col(c)).alias(c) if c in written_names else F.col(c)
            for c in snapshot.columns
        ]
    )


def apply_changes(
    snapshot: DataFrame,
    feed: DataFrame,
    key: str = "id",
    order: tuple[str, ...] = ("ts", "seq"),
    **join_options,
) -> DataFrame:
    """State of a keyed table after a batch of row changes."""
    return apply_fold(snapshot, fold_changes(feed, key, order), key, **join_options)


def update_messages(operations: DataFrame, spots: DataFrame, key: str = "id", **join_options) -> DataFrame:
    """Typed messages: CREATE, UPDATE and AVAILABILITY_UPDATE carry the spot.

    DELETE carries the id only.  Messages about spots that do not exist are
    not sent.  A streaming `operations` is joined batch by batch as it is; in
    a table one spot may have most of the operations, so that join is salted.
    """
    embedded = spots.select(key, F.struct(*spots.columns).alias("spot"))
    if operations.isStreaming:
        joined = operations.join(embedded, key, "left")
    else:
        joined = lookup_join(operations, embedded, [key], "left", salt_by=operations.columns, **join_options)
    is_delete = F.col("update_type") == "DELETE"
    return joined.where(is_delete | F.col("spot").isNotNull()).select(
        "update_type", key, F.when(~is_delete, F.col("spot")).alias("spot")
    )


def visible_changes(feed: DataFrame, condition: Column) -> DataFrame:
    """Changes a viewer subscribes to; deletes always pass, as they carry no row."""
    return feed.where((F.col("op") == "DELETE") | F.coalesce(condition, F.lit(False)))
