"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources weigh 5, 2, 1, repeating, in code point order, null last, and share
150 % of all words. A target stops at twice its source's words; the excess is
shared again by weight. Whole epochs of a source come first. The rest of its
target is drawn without replacement: each document has an exponential key,
scaled down by its quality weight (the share of distinct words in its words), and
documents are taken in order of the key until the words are used up; the last
one may be taken in part.

Keys come from a hash of doc_id and text, so reruns agree and rows that share an
id, or have none, have keys of their own. Rows alike in both share a key: they are
taken one after the other, in whatever order, until the words are used up, so that
taken stays within one document of the target. Null texts have size 0; nothing is
taken of them. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbspark.llm.common import shielded, staged, table, whole_text, words_of

#: Weights of the sources in order.
WEIGHTS = (5, 2, 1)
#: Share of all words that the mix takes, and the most epochs of one source.
SHARE = 1.5
MAX_EPOCHS = 2
#: Up to so many sources, the table of one row a source is broadcast; beyond, it is joined by shuffle.
MAX_BROADCAST_SOURCES = 100_000
#: Least quality weight.
MIN_QUALITY = 0.05
#: Key buckets for each power of e. None holds over 0.2 % of a source unless documents share their key.
BUCKETS_PER_E = 256


def sampling_key(doc_id: Column, text: Column, quality: Column) -> Column:
    """-ln(u) / quality with u from the first 52 bits of a hash of id and text."""
    hashed = F.sha2(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.sha2(text, 256)), 256)
    bits = F.conv(F.substring(hashed, 1, 13), 16, 10)
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 52))) / quality


def keyed(docs: DataFrame) -> DataFrame:
    """docs with size, sampling_key and a number for each row, the place of its partition first."""
    return (
        docs.withColumn("_words", words_of(whole_text()))
        .withColumns(
            {
                "size": F.size("_words").cast("long"),
                "_quality": F.greatest(
                    F.lit(MIN_QUALITY),
                    F.coalesce(F.try_divide(F.size(F.array_distinct("_words")), F.size("_words")), F.lit(1.0)),
                ),
            }
        )
        .drop("_words")
        .withColumn("sampling_key", sampling_key(F.col("doc_id"), whole_text(), F.col("_quality")))
        .drop("_quality")
        .withColumn("_row", F.monotonically_increasing_id())
    )


def source_targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target: one row a source.

    In order of size over weight, the first sources stop at their limit. The
    level that the others share the rest at follows from sums over those before.
    """
    alike = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(alike) - 1) % len(WEIGHTS) + 1)
    before = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = F.min_by(
        F.col("_level"), F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "source"))
    ).over(every)
    return (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("_weight", weight)
        .withColumn("_ratio", MAX_EPOCHS * F.col("source_size") / F.col("_weight"))
        .withColumn(
            "_level",
            (
                SHARE * F.sum("source_size").over(every)
                - F.coalesce(F.sum(MAX_EPOCHS * F.col("source_size")).over(before), F.lit(0))
            )
            / (F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0))),
        )
        .withColumn("target", F.least(MAX_EPOCHS * F.col("source_size").cast("double"), level * F.col("_weight")))
        .select("source", "source_size", "target")
    )


def source_cuts(sized: DataFrame) -> DataFrame:
    """source, source_size, target, epochs, and where the fractional selection ends: the key and number of the
    last row taken, and how many words of it; null where it takes all.

    Sums find the cut in steps: the bucket of keys, the key in the bucket, then among the rows that share that
    key the partition and the row. Each step reads the rows of the place that the step before found.
    """
    steps = {
        "_bucket": F.floor(BUCKETS_PER_E * F.log("sampling_key")).cast("int"),
        "_key": F.col("sampling_key"),
        "_part": F.shiftright("_row", 33),
        "_number": F.col("_row"),
    }
    placed = sized.select("source", "size", *(c.alias(n) for n, c in steps.items()))
    targets = (
        source_targets(sized)
        .withColumn(
            "epochs", F.floor(F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))).cast("long")
        )
        .withColumn("_left", F.floor(F.col("target") + 0.5).cast("long") - F.col("epochs") * F.col("source_size"))
    )
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    ends, found = targets.select("source", "_left"), []
    for step in steps:
        here = same
        for name in found:
            here = here & (F.col(f"a.{name}") == F.col(f"b.{name}"))
        found.append(step)
        sums = (
            placed.alias("a")
            .join(ends.alias("b"), here)
            .groupBy(*(f"a.{n}" for n in ("source", *found)), "b._left")
            .agg(F.sum("size").alias("_sum"))
        )
        order = Window.partitionBy("source").orderBy(step)
        ends = (
            sums.withColumn("_upto", F.sum("_sum").over(order))
            .where((F.col("_upto") > F.col("_left")) & (F.col("_upto") - F.col("_sum") <= F.col("_left")) & (F.col("_sum") > 0))
            .select("source", *found, (F.col("_left") - F.col("_upto") + F.col("_sum")).alias("_left"))
        )
    return (
        targets.alias("a")
        .join(ends.alias("b"), same, "left")
        .select(
            "a.source",
            "source_size",
            "target",
            "epochs",
            F.col("_key").alias("cut_key"),
            F.col("_number").alias("cut_row"),
            F.col("b._left").alias("cut_words"),
        )
    )


def taken(sized: DataFrame, cuts: DataFrame) -> DataFrame:
    """sized with source_size, target and taken."""
    key, cut_key, row, cut_row = (F.col(c) for c in ("sampling_key", "cut_key", "_row", "cut_row"))
    share = (
        F.when(cut_key.isNull() | (key < cut_key) | ((key == cut_key) & (row < cut_row)), F.col("size"))
        .when((key == cut_key) & (row == cut_row), F.col("cut_words"))
        .otherwise(0)
    )
    cuts = staged(cuts, "mixing")
    if cuts.count() <= MAX_BROADCAST_SOURCES:
        cuts = F.broadcast(cuts)
    return (
        sized.alias("a")
        .join(cuts.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
        .withColumn("taken", F.col("epochs") * F.col("size") + share)
        .select("a.*", "source_size", "target", "taken")
    )


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sized = staged(keyed(docs).drop("text"), "mixing")
    return taken(sized, source_cuts(sized)).select("doc_id", "size", "source_size", "target", "taken")


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; one taken in part counts as whole if half of it is taken.

    docs is read twice. Its rows must come in the same order each time, as rows of Parquet files do.
    """
    inner, back = shielded(docs, "doc_id", "source", "text")
    sized = keyed(inner)
    narrow = staged(sized.select("doc_id", "source", "size", "sampling_key", "_row"), "mixing")
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    return back(
        taken(sized, source_cuts(narrow))
        .where("taken > 0")
        .withColumn("_copies", copies)
        .where("_copies > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    )


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, source, text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), d AS (
  SELECT doc_id, source, len(words)::BIGINT AS size,
         greatest(0.05, coalesce(len(list_distinct(words))::DOUBLE / nullif(len(words), 0), 1)) AS quality,
         ('0x' || sha256(coalesce(doc_id::VARCHAR, '') || ':' || sha256(coalesce(text, '')))[1:13])::BIGINT::DOUBLE AS bits
  FROM w
), k AS (
  SELECT doc_id, source, size, -ln((bits + 0.5) / 4503599627370496.0::DOUBLE) / quality AS key FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM k GROUP BY source
), r AS (
  SELECT *, 2 * source_size / weight::DOUBLE AS ratio FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE
             - coalesce(sum(2 * source_size) OVER before, 0)::DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM r
  WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size,
         least(2.0::DOUBLE * source_size,
               (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1) * weight) AS target
  FROM l
), e AS (
  SELECT *, floor(coalesce(target / nullif(source_size, 0), 0))::BIGINT AS epochs FROM t
), p AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs,
         floor(e.target + 0.5)::BIGINT - e.epochs * e.source_size AS rest,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS UNBOUNDED PRECEDING) - k.size AS earlier
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, rest - earlier)))::BIGINT AS taken
FROM p
"""
