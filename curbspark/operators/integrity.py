"""Constraint checks and delete propagation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbspark.operators.skew import lookup_join
from curbspark.schemas import RULES, TableRules


def violations(rules: TableRules, columns: Sequence[str]) -> Column:
    """Texts of the NOT NULL and value-list rules a row breaks, in rule order."""
    missing = [
        F.when(F.col(c).isNull(), f"{c} is null") for c in rules.required if c in columns
    ]
    foreign = [
        F.when(~F.col(c).isin(*allowed), f"{c} not allowed")
        for c, allowed in rules.domains.items()
        if c in columns
    ]
    return F.array_compact(F.array(*missing, *foreign))


def with_violations(df: DataFrame, rules: TableRules) -> DataFrame:
    return df.withColumn("violations", violations(rules, df.columns))


def split_by_rules(df: DataFrame, rules: TableRules) -> tuple[DataFrame, DataFrame]:
    """(rows that may be stored, rejected rows with `violations`)."""
    checked = with_violations(df, rules)
    broken = F.size("violations") > 0
    return checked.where(~broken).drop("violations"), checked.where(broken)


def orphans(
    child: DataFrame, parent: DataFrame, foreign_key: str, parent_key: str = "id", *, salt_by: list[str], **join_options
) -> DataFrame:
    """Child rows whose parent does not exist; a null reference is no orphan."""
    known = parent.select(F.col(parent_key).alias(foreign_key)).distinct()
    return lookup_join(
        child.where(F.col(foreign_key).isNotNull()),
        known,
        [foreign_key],
        "left_anti",
        salt_by=salt_by,
        **join_options,
    )


def cascade_delete(
    child: DataFrame, deleted: DataFrame, foreign_key: str, *, salt_by: list[str], **join_options
) -> DataFrame:
    """Child rows that survive the deletion of parents (`deleted` has column id)."""
    gone = deleted.select(F.col("id").alias(foreign_key)).distinct()
    return lookup_join(child, gone, [foreign_key], "left_anti", salt_by=salt_by, **join_options)


def set_null_on_delete(
    child: DataFrame, deleted: DataFrame, foreign_key: str, *, salt_by: list[str], **join_options
) -> DataFrame:
    """Child rows with references to deleted parents blanked."""
    gone = deleted.select(F.col("id").alias(foreign_key)).distinct().withColumn("_gone", F.lit(True))
    joined = lookup_join(child, gone, [foreign_key], "left", salt_by=salt_by, **join_options)
    blanked = F.when(F.col("_gone").isNull(), F.col(foreign_key)).alias(foreign_key)
    return joined.select(*[blanked if c == foreign_key else F.col(c) for c in child.columns])


def duplicate_keys(df: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Keys held by several rows with their row `count`, worst first."""
    found = df.groupBy(*keys).count().where(F.col("count") > 1)
    if limit is None:
        return found
    return found.orderBy(F.desc("count"), *[F.asc(k) for k in keys]).limit(limit)


def unique_report(tables: dict[str, tuple[DataFrame, list[list[str]]]]) -> DataFrame:
    """One row per declared unique key: how many keys repeat and the worst count."""
    parts = [
        duplicate_keys(df, keys).agg(
            F.lit(name).alias("table_name"),
            F.lit(",".join(keys)).alias("key_columns"),
            F.count(F.lit(1)).alias("duplicate_keys"),
            F.coalesce(F.max("count"), F.lit(0)).alias("worst_count"),
        )
        for name, (df, key_lists) in tables.items()
        for keys in key_lists
    ]
    return reduce(DataFrame.unionByName, parts)


def declared_key_report(tables: dict[str, DataFrame], rules: dict[str, TableRules] = RULES) -> DataFrame:
    """`unique_report` for every unique key that the schema declares for the given tables.

    A table that the schema does not know, or that lacks a column of a declared
    key, is an error: a check that was left out must not look like one passed.
    """
    checked = {}
    for name, df in tables.items():
        if name not in rules:
            raise ValueError(f"no rules for table {name}")
        lacking = sorted({c for key in rules[name].unique for c in key}.difference(df.columns))
        if lacking:
            raise ValueError(f"{name} lacks key columns: {', '.join(lacking)}")
        checked[name] = (df, [list(key) for key in rules[name].unique])
    return unique_report(checked)
