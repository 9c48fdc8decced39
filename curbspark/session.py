"""Session defaults for applications and tests; the library itself takes any session."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(
    app_name: str = "curbspark",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **conf: str,
) -> SparkSession:
    """A session in UTC with adaptive execution on.

    `master` and `shuffle_partitions` stay unset on a cluster, where the
    submit command and adaptive coalescing choose them.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder under `spark.checkpoint.dir`, visible to every executor.

    Only a local session may go without the setting: there one machine holds
    the driver and all tasks, so a temporary folder is shared by definition.
    """
    # A SparkConf value is not always visible through the SQL runtime conf.
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="curbspark-", dir=os.environ.get("TMPDIR"))
    return f"{base.rstrip('/')}/curbspark/{purpose}-{uuid.uuid4().hex}"
