"""Waitlist signups and user profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbspark.functions.text import non_blank, normalize_email, valid_email
from curbspark.operators.upsert import insert_if_absent, upsert

# Length of a profile name.
NAME_MIN, NAME_MAX = 2, 100


def clean_signups(signups: DataFrame) -> DataFrame:
    """Signups with `is_valid`, e-mail normalized, blank name and interest null."""
    return signups.withColumns(
        {
            "is_valid": valid_email(F.col("email")),
            "email": normalize_email(F.col("email")),
            "full_name": non_blank(F.col("full_name")),
            "interest": non_blank(F.col("interest")),
        }
    )


def join_waitlist(waitlist: DataFrame, signups: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signups to append, signups already there, invalid signups)."""
    cleaned = clean_signups(signups)
    valid = cleaned.where("is_valid").drop("is_valid")
    inserted, already = insert_if_absent(waitlist, valid, ["email"], order)
    return inserted, already, cleaned.where("not is_valid").drop("is_valid")


def signup_profiles(users: DataFrame) -> DataFrame:
    """Profile rows for new users; the name comes from the signup metadata."""
    return users.select(
        "id", F.get_json_object("raw_user_meta_data", "$.full_name").alias("full_name"), "email", "created_at"
    )


def add_profiles(profiles: DataFrame, users: DataFrame) -> DataFrame:
    """Profile rows to append: exactly one per user who has none yet, also where times are equal or null."""
    inserted, _ = insert_if_absent(profiles, signup_profiles(users), ["id"], ["created_at"])
    return inserted


def check_profile_updates(updates: DataFrame) -> DataFrame:
    """Updates (caller_id, id, full_name, ...) with `reject_reason`."""
    name = F.col("full_name")
    return updates.withColumn(
        "reject_reason",
        F.when(~F.coalesce(F.col("caller_id") == F.col("id"), F.lit(False)), "not_own_profile")
        .when(non_blank(name).isNull(), "full_name_required")
        .when(~F.length(name).between(NAME_MIN, NAME_MAX), "full_name_length"),
    )


def update_profiles(profiles: DataFrame, latest: DataFrame, at: Column) -> DataFrame:
    """Profiles after accepted name changes, one per id."""
    return upsert(profiles, latest.select("id", "full_name"), ["id"], at=at, insert_new=False)
