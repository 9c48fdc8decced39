"""Joins that neither gather a hot key in one task nor move a large table needlessly.

A key may hold a third of all rows, and rows without a key all meet in one
shuffle partition.  `lookup_join` therefore broadcasts the lookup side only
when its size is known to be small.  Small facts first cut a large lookup down
to the keys they use.  With both sides large, the heavy keys of the facts are
spread over several partitions, repeating just those lookup rows.

`unique_join` is for two sides that hold a key once, a large state and its
news: small news are broadcast, so that the state stays where it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_BYTES = 16 * 1024 * 1024
HOT_ROWS = 1_000_000
HOT_SHARE = 10_000
SALTS = 64
UNKNOWN_BYTES = 1 << 63

_SALT = "_salt"
_HOT = "_hot"


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; filters never raise it.  Unknown counts as large."""
    if not hasattr(df, "_jdf"):
        return UNKNOWN_BYTES
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with at least `hot_rows` rows and a ten-thousandth of all rows.

    Counting combines on the map side.  The share bounds the list, and with it
    the broadcast, to 10,000 keys by arithmetic.
    """
    least = df.select((F.count(F.lit(1)) / HOT_SHARE).alias("_least")).scalar()
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where((F.col("_n") >= hot_rows) & F.expr(" and ".join(f"`{k}` is not null" for k in keys)))
        .where(F.col("_n") >= least)
        .select(*keys, F.lit(True).alias(_HOT))
    )


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    how: str = "left",
    *,
    salt_by: list[str],
    condition: Column | None = None,
    lookup_bytes: int | None = None,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Equi join, kind inner, left, left_semi or left_anti, safe for hot keys.

    `salt_by` names columns of `facts` that differ between rows of one key;
    hashing them keeps retried tasks on the same rows.  `condition` is an
    extra filter for inner joins.  `lookup_bytes` replaces Catalyst's estimate
    where the lookup explodes its rows, which the estimate does not see.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"join kind {how} keeps lookup rows and cannot be salted")
    if condition is not None and how != "inner":
        raise ValueError("an extra condition is for inner joins")
    size = plan_bytes(lookup) if lookup_bytes is None else lookup_bytes
    if size <= max_broadcast_bytes:
        joined = facts.join(F.broadcast(lookup), keys, how)
    elif plan_bytes(facts) <= max_broadcast_bytes:
        joined = facts.join(_known_of(facts, lookup, keys), keys, how)
    else:
        joined = _salted(facts, lookup, keys, how, salt_by, hot_rows, salts)
    return joined if condition is None else joined.where(condition)


def _known_of(few: DataFrame, many: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a large table under the keys of a small one; the large one stays put."""
    return many.join(F.broadcast(few.select(*keys).distinct()), keys, "left_semi")


def absent_from(
    state: DataFrame, news: DataFrame, keys: list[str], *, max_broadcast_bytes: int = MAX_BROADCAST_BYTES
) -> DataFrame:
    """Rows of the news, one per key, whose key the state lacks."""
    known = state.select(*keys)
    if plan_bytes(news) <= max_broadcast_bytes:
        known = _known_of(news, known, keys)
    return news.join(known, keys, "left_anti")


def unique_join(
    state: DataFrame,
    news: DataFrame,
    keys: list[str],
    how: str = "left",
    *,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Left or full join of two sides without repeated keys.

    With small news even the full join needs no exchange of the state: known
    keys come from a left join, and the keys of the news that it lacks from a
    scan of its key columns.  Rows a full join adds have null state columns.
    """
    if how not in ("left", "full"):
        raise ValueError(f"unsupported join kind {how}")
    if plan_bytes(news) > max_broadcast_bytes:
        return state.join(news, keys, how)
    known = state.join(F.broadcast(news), keys, "left")
    if how == "left":
        return known
    fresh = absent_from(state, news, keys, max_broadcast_bytes=max_broadcast_bytes)
    return known.unionByName(fresh, allowMissingColumns=True)


def _salted(
    facts: DataFrame, lookup: DataFrame, keys: list[str], how: str, salt_by: list[str], hot_rows: int, salts: int
) -> DataFrame:
    hot = hot_keys(facts, keys, hot_rows)
    spread = F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int")
    keyless = F.expr(" or ".join(f"`{k}` is null" for k in keys))
    left = (
        facts.join(F.broadcast(hot), keys, "left")
        .withColumn(_SALT, F.when(keyless | F.col(_HOT), spread).otherwise(F.lit(0)))
        .drop(_HOT)
    )
    copies = F.when(F.col(_HOT), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = (
        lookup.join(F.broadcast(hot), keys, "left").withColumn(_SALT, F.explode(copies)).drop(_HOT)
    )
    return left.join(right, [*keys, _SALT], how).drop(_SALT)
