"""Quality rules: counts of every text, and n-gram likelihood against a trusted target.

Tokens are runs of ASCII punctuation and runs of anything else between white
space. Token unigrams and bigrams are hashed into buckets. The raw multinomial
is counted over every document, the target one over trusted labelled documents.
A text's score is the mean log ratio of the two over its n-grams, so it does not
depend on the length of the text; every document is held against one threshold.

Nulls count as empty texts. A text without tokens scores 0. Repeated rows are
judged alike, one result row each. With no trusted rows at all every ratio is 0
and only the base rules reject. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbspark.llm.common import SPACE, shielded, table, whole_text, words_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: More than so many of 100 words in repeated windows fail a text.
MAX_REPEAT_PERCENT = 50
#: Buckets of hashed n-grams; a power of two.
BUCKETS = 1 << 14
#: Count added to every bucket of both multinomials.
SMOOTHING = 1.0
#: Most trusted documents that the target multinomial is fitted on.
MAX_TRUSTED = 20_000
#: A text whose mean log ratio is lower goes.
MIN_SCORE = -0.25

#: Each ASCII punctuation character is a token of its own.
_PUNCT = r"([\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E])"


def with_pairs(docs: DataFrame) -> DataFrame:
    """docs without text, a row for each token: _pos, and _pair of the token (t) and its successor (next).

    The last token has no successor, its pair is the token alone. A text without
    tokens gives one row of nulls. Rows keep the work in generated code; lambdas
    over arrays cost several times as much.
    """
    return (
        docs.withColumn("_tokens", words_of(F.regexp_replace(whole_text(), _PUNCT, " $1 ")))
        .withColumn(
            "_pairs",
            F.arrays_zip(F.col("_tokens").alias("t"), F.expr("slice(_tokens, 2, size(_tokens))").alias("next")),
        )
        .drop("_tokens", "text")
        .select("*", F.posexplode_outer("_pairs").alias("_pos", "_pair"))
        .drop("_pairs")
    )


def bucket(*ngram: Column) -> Column:
    return F.xxhash64(*ngram).bitwiseAND(BUCKETS - 1).cast("int")


def log_ratios(docs: DataFrame, labels: DataFrame) -> list[float]:
    """log(target / raw) of each bucket.

    Raw counts cover every document. The target is the labelled rows of quality
    1, at most MAX_TRUSTED of them, picked by hash of the id: that bounds the
    broadcast. What reaches the driver is one row for each of BUCKETS buckets.
    """
    trusted = (
        labels.where("quality = 1 and doc_id is not null")
        .select("doc_id")
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(MAX_TRUSTED)
        .withColumn("_trusted", F.lit(1))
    )
    counts = (
        with_pairs(docs.select("doc_id", "text").join(F.broadcast(trusted), "doc_id", "left"))
        .where("_pos is not null")
        .select("_trusted", F.explode(F.array(bucket("_pair.t"), bucket("_pair.t", "_pair.next"))).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.count("_trusted").alias("target"))
        .withColumns({"n_raw": F.expr("sum(raw) over ()"), "n_target": F.expr("sum(target) over ()")})
        .select(
            "bucket",
            F.when(
                F.col("n_target") > 0,
                F.log((F.col("target") + SMOOTHING) / (F.col("n_target") + SMOOTHING * BUCKETS))
                - F.log((F.col("raw") + SMOOTHING) / (F.col("n_raw") + SMOOTHING * BUCKETS)),
            )
            .otherwise(0.0)
            .alias("ratio"),
        )
    )
    ratios = [0.0] * BUCKETS
    for row in counts.collect():
        ratios[row.bucket] = row.ratio
    return ratios


def measured(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = whole_text()
    lines = docs.withColumns(
        {
            "_words": words_of(text),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))).cast("long"),
            "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]")),
        }
    )
    # The text form of a struct of words is unambiguous, as no word holds a space, and made without a lambda.
    windows = lines.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_windows": F.arrays_zip(
                *(F.expr(f"slice(_words, {k}, greatest(size(_words) - 2, 0))").alias(f"w{k}") for k in (1, 2, 3))
            ).cast("array<string>"),
        }
    )
    ordered = windows.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    repeated = ordered.withColumn(
        "_starts",
        F.sort_array(
            F.transform(
                F.filter(
                    "_sorted",
                    lambda p, k: F.coalesce(p.h == F.get(F.col("_sorted"), k + 1).h, F.lit(False))
                    | F.coalesce(p.h == F.get(F.col("_sorted"), k - 1).h, F.lit(False)),
                ),
                lambda p: p.i,
            )
        ),
    )
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("words")),
        lambda a, i: F.struct(i.alias("last"), (a.words + F.least(F.lit(3), i - a.last)).alias("words")),
        lambda a: a.words,
    )
    counted = repeated.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    return counted.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    ).drop("_words", "_lines", "_windows", "_sorted", "_starts")


def judged(docs: DataFrame, labels: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, text_hash, the measures, score and kept of every row of docs."""
    # One literal array; a list literal would cross to the JVM element by element.
    ratios = F.split(F.lit(",".join(f"{x:.6g}" for x in log_ratios(docs, labels))), ",").cast("array<double>")
    measures = measured(docs.select("doc_id", "text", F.xxhash64(whole_text()).alias("text_hash")))
    ratio = lambda *ngram: F.get(ratios, bucket(*ngram))
    known = F.col("_pos").isNotNull()
    total = F.sum(F.when(known, ratio("_pair.t") + ratio("_pair.t", "_pair.next")))
    return (
        with_pairs(measures)
        .groupBy([c for c in measures.columns if c != "text"])
        .agg(
            F.coalesce(F.try_divide(total, 2 * F.count("_pos")), F.lit(0.0)).alias("score"),
            # Rows that agree in all of these meet in one group and come out as often as they went in.
            F.count(F.when(F.coalesce("_pos", F.lit(0)) == 0, 1)).alias("_rows"),
        )
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= min_score))
        .withColumn("_rows", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
        .drop("_rows")
    )


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are kept, columns as they came."""
    inner, back = shielded(docs, "doc_id", "text")
    # Verdicts are narrow, and equal texts of one id get the same one.
    verdict = F.explode(F.array("kept")).alias("_verdict")
    good = (
        judged(docs, table(spark, sf_dir, "labels"))
        # A plain filter would be pushed below the measures, with every expression of theirs copied into it.
        .select(F.col("doc_id").alias("_id"), "text_hash", verdict)
        .where("_verdict")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(whole_text()) == F.col("text_hash"))
    return back(inner.join(good, same, "left_semi"))
