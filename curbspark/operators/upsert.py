"""Keyed writes as joins that yield the next state of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbspark.operators.skew import absent_from, unique_join

CHANGE = "_change"
_IN_TARGET, _IN_BATCH = "_in_target", "_in_batch"
_COPIES = "_copies"


def upsert(
    target: DataFrame,
    batch: DataFrame,
    keys: list[str],
    *,
    at: Column | None = None,
    keep: list[str] = (),
    defaults: dict[str, Column] | None = None,
    guard: Column | None = None,
    insert_new: bool = True,
    with_change: bool = False,
    **join_options,
) -> DataFrame:
    """Next state of `target` after writing `batch`, which has one row per key.

    New keys are inserted.  For known keys only columns present in `batch` are
    overwritten, except those in `keep` and `created_at`.  Every overwritten
    row gets `updated_at = at`, whatever the batch says; an inserted row keeps
    the time it brings.  `guard` is a condition on target columns that must
    hold for a row to be overwritten.  `with_change` adds a `_change` column:
    inserted, updated or unchanged.

    Both sides hold a key once, so the join cannot skew; a small batch is
    broadcast and the target is not exchanged.
    """
    defaults = defaults or {}
    kept = {*keep, "created_at"}
    new_names = [c for c in batch.columns if c not in keys]
    state = target.withColumn(_IN_TARGET, F.lit(True)).withColumn(
        "_open", F.lit(True) if guard is None else F.coalesce(guard, F.lit(False))
    )
    news = batch.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in new_names]).withColumn(
        _IN_BATCH, F.lit(True)
    )
    joined = unique_join(state, news, keys, "full" if insert_new else "left", **join_options)
    written = F.coalesce(F.col(_IN_BATCH), F.lit(False))
    known = F.coalesce(F.col(_IN_TARGET), F.lit(False))
    overwritten = known & written & F.coalesce(F.col("_open"), F.lit(False))

    def value(name: str) -> Column:
        if name in keys:
            return F.col(name)
        old = F.col(name)
        offered = F.col(f"_new_{name}") if name in new_names else None
        default = defaults.get(name, F.lit(None))
        inserted = default if offered is None else F.coalesce(offered, default)
        if name == "updated_at" and at is not None:
            stamped = at
            inserted = at if offered is None else F.coalesce(offered, at)
        elif offered is None or name in kept:
            stamped = old
        else:
            stamped = offered
        return F.when(overwritten, stamped).when(known, old).otherwise(inserted).alias(name)

    columns = [value(name) for name in target.columns]
    if with_change:
        columns.append(
            F.when(overwritten, "updated").when(known, "unchanged").otherwise("inserted").alias(CHANGE)
        )
    return joined.select(*columns)


def insert_if_absent(
    target: DataFrame, batch: DataFrame, keys: list[str], order: list[str], **join_options
) -> tuple[DataFrame, DataFrame]:
    """Split a batch into rows to append and rows whose key is already taken.

    Within the batch exactly one row of a key gets in: the first by `order`, where
    null comes last, and of rows alike in it the first by all their columns.  All
    the others are reported as already there, like rows whose key is in `target`;
    of equal rows one is the first and the rest are not.
    """
    columns = batch.columns
    place = [x for c in [*order, *columns] for x in (F.col(c).isNull(), F.col(c))]
    different = batch.groupBy(*columns).agg(F.count(F.lit(1)).alias(_COPIES))
    winner = F.min_by(F.struct(*columns), F.struct(*(x.alias(f"_{k}") for k, x in enumerate(place))))
    first = different.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(winner.alias("_row")).select("_row.*")
    inserted = absent_from(target, first, keys, **join_options)
    marked = different.unionByName(inserted.withColumn(_COPIES, F.lit(-1).cast("long")))
    left = marked.groupBy(*columns).agg(F.sum(_COPIES).alias(_COPIES)).where(F.col(_COPIES) > 0)
    already = left.withColumn(_COPIES, F.explode(F.sequence(F.lit(1).cast("long"), F.col(_COPIES)))).select(*columns)
    return inserted, already
