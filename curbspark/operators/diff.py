"""Keyed snapshots compared by content digest: inserted, changed, unchanged, deleted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What may have become of a key; `repeated` is one that either snapshot holds more than once.
KINDS = ("inserted", "changed", "unchanged", "deleted", "repeated")
_MICROS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "ignoreNullFields": "false",
}


def _text(name: str, kind: T.DataType) -> Column:
    """The value as text that begins with its length; null is no text, an empty one is."""
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        text = F.to_json(F.struct(name), _MICROS)
    elif isinstance(kind, T.BinaryType):
        text = F.hex(name)
    elif isinstance(kind, T.TimestampType):
        text = F.unix_micros(name).cast("string")
    else:
        text = F.col(name).cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _digests(df: DataFrame, content: list[str]) -> tuple[Column, Column]:
    """Two 64-bit hashes from different seeds. They are fixed-width, so that a hash aggregate can hold them."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    text = F.concat(*[_text(c, kinds[c]) for c in content]) if content else F.lit("")
    return F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(1), text).alias("_h2")


def _sides(old: DataFrame, new: DataFrame, keys: list[Column], own: list[str], ignore: tuple[str, ...]) -> DataFrame:
    content = sorted(set(old.columns).intersection(new.columns).difference(own, ignore))
    return reduce(
        DataFrame.unionByName,
        [df.select(*keys, F.lit(is_new).alias("_new"), *_digests(df, content)) for df, is_new in ((old, False), (new, True))],
    )


def _changes(sides: DataFrame, keys: list[str]) -> DataFrame:
    per_key = sides.groupBy(*keys).agg(
        F.count_if(~F.col("_new")).alias("_old"),
        F.count_if("_new").alias("_now"),
        *[f(c).alias(f"_{f.__name__}{c}") for c in ("_h1", "_h2") for f in (F.min, F.max)],
    )
    same = (F.col("_min_h1") == F.col("_max_h1")) & (F.col("_min_h2") == F.col("_max_h2"))
    change = (
        F.when((F.col("_old") > 1) | (F.col("_now") > 1), "repeated")
        .when(F.col("_old") == 0, "inserted")
        .when(F.col("_now") == 0, "deleted")
        .when(same, "unchanged")
        .otherwise("changed")
    )
    return per_key.select(*keys, change.alias("change"))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], ignore: tuple[str, ...] = ()) -> DataFrame:
    """keys and `change` of every key of either snapshot.

    Content is what both have beside keys and ignored columns.  Only keys and
    digests are shuffled, and rows of a key combine before that.  A null key is
    a key like others; a key held twice on one side is `repeated`, whatever its
    rows hold.  An empty snapshot makes every key inserted or deleted.
    """
    columns = [F.col(k) for k in keys]
    return _changes(_sides(old, new, columns, keys, ignore), keys)


def diff_tables(
    old: dict[str, DataFrame], new: dict[str, DataFrame], keys: dict[str, list[str]], ignore: tuple[str, ...] = ()
) -> DataFrame:
    """(target, key, change) over several tables in one exchange; `key` is the key's columns as JSON."""
    parts = []
    for target, now in new.items():
        own = keys[target]
        named = [F.lit(target).alias("target"), F.to_json(F.struct(*own), _MICROS).alias("key")]
        parts.append(_sides(old[target], now, named, own, ignore))
    return _changes(reduce(DataFrame.unionByName, parts), ["target", "key"])


def change_counts(changes: DataFrame) -> DataFrame:
    """Per target how many keys each kind of change has; a target without keys has no row."""
    return changes.groupBy("target").agg(*[F.count_if(F.col("change") == k).alias(k) for k in KINDS])
