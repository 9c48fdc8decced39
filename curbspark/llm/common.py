"""What the operators of this subpackage share: word classes, table reads, staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words, as a Java regex class body.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def shielded(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but the used ones renamed, so that none clashes with what an operator adds,
    and a function that gives the columns of docs back."""
    inner = {c: c if c in used else f"__{i}" for i, c in enumerate(docs.columns)}
    back = lambda df: df.select(*(F.col(n).alias(c) for c, n in inner.items()))
    return docs.select(*(F.col(c).alias(n) for c, n in inner.items())), back


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    A local session without one gets a temporary folder; a cluster without one is refused.
    """
    # Some sessions show core settings in the context's configuration only.
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="curbspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and lost executors cost no upstream work."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
