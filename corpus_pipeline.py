"""The corpus pipeline: quality rules, exact dedup, near-duplicate join, mixing, BPE coding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept.
Between stages the documents are written as Parquet into the shared folder and
read again, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from curbspark.llm.bpe import bpe_stage
from curbspark.llm.common import staged, table
from curbspark.llm.exact_dedup import dedup_stage
from curbspark.llm.jaccard_join import join_stage
from curbspark.llm.mixing import mixing_stage
from curbspark.llm.quality import quality_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", dedup_stage),
    ("jaccard_join", join_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]
#: Hashed n-gram ratios, the join and the coding have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and token_ids of each document of the mix, once for each time it is taken."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
