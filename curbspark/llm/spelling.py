"""Spelling variant grouping by reduced-alphabet generation.

Letters are hashed to a few symbols. The full one-edit neighbourhood of every
reduced word (the word itself, deletions, replacements, insertions) is joined
with the reduced vocabulary; words under a pair of reduced words are verified on
the original strings. No two words within one edit are missed: an edit of a word
is at most one edit of its reduction.

Reduced words travel as 64-bit polynomial hashes, whose neighbours follow from
prefix sums; a collision adds a candidate that verification drops. Two reduced
words that both stand for more than MAX_BUCKET words are not compared word by
word: all words under such reduced words go through the same generation once
more with every letter its own symbol, where each bucket holds one word.

A null text has no words, a null doc_id counts as empty text, repeated rows count
each time, empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbspark.llm.common import staged, table, whole_text

#: Code points and occurrences that a word of the vocabulary has at least.
MIN_LENGTH = 6
MIN_COUNT = 5
#: A form is at least so many times as frequent as its variant.
FORM_RATIO = 5
#: Symbols of the reduced alphabet, and of the one in which letters keep apart (every letter is below U+0100).
SYMBOLS = 12
ALL_LETTERS = 256
#: Two reduced words with more words than this each are compared over the whole alphabet.
MAX_BUCKET = 2048
#: Rows of a neighbourhood that a worker holds at a time.
CHUNK_ROWS = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def corpus_words(docs: DataFrame, altered: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """word, n of the runs of letters in all texts, A-Z lower-cased; altered(run, id text) may change each run."""
    text = F.translate(whole_text(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
        F.explode(F.split(text, r"[^a-zÀ-ÿ]+")).alias("_run"),
    ).where(F.length("_run") >= MIN_LENGTH)
    word = F.col("_run") if altered is None else altered(F.col("_run"), F.col("_id"))
    return (
        runs.select(word.alias("word"))
        .where(F.length("word") >= MIN_LENGTH)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= MIN_COUNT)
    )


def one_in_199_shortened(run: Column, doc_id: Column) -> Column:
    """The run without one code point where 199 divides the hash of id and run."""
    h = F.crc32(F.concat(doc_id, F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(
        h % 199 == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2, F.length(run)))
    ).otherwise(run)


def _by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of words of one length, and their letters as a matrix."""
    data = [w.encode("latin-1") for w in words.to_pylist()]
    lengths = np.array([len(w) for w in data], np.int64)
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        step = max(1, CHUNK_ROWS // max(1, length))
        for k in range(0, len(at), step):
            part = at[k : k + step]
            yield part, np.frombuffer(b"".join(data[p] for p in part.tolist()), np.uint8).reshape(len(part), length)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


def _sums(letters: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Reduced words, their prefix hashes and the powers of the base."""
    reduced = letters.astype(_U) % _U(symbols) + _U(1)
    powers = _powers(letters.shape[1] + 1)
    sums = np.zeros((len(letters), letters.shape[1] + 1), _U)
    np.cumsum(reduced * powers[:-1], axis=1, out=sums[:, 1:])
    return reduced, sums, powers


def _neighbours(letters: np.ndarray, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and key of every different neighbour of each reduced word, once, in bounded pieces."""
    rows, length = letters.shape
    width = max(1, CHUNK_ROWS // (length * symbols * 2 + 1))
    for r in range(0, rows, width):
        part = letters[r : r + width]
        reduced, sums, powers = _sums(part, symbols)
        whole = sums[:, -1]
        number = np.arange(r, r + len(part))
        yield number, whole
        all_symbols = np.arange(1, symbols + 1, dtype=_U)
        # What comes before each place; 0 is no symbol.
        before = np.concatenate((np.zeros((len(part), 1), _U), reduced), axis=1)
        step = max(1, CHUNK_ROWS // (symbols * len(part)))
        for i in range(0, length + 1, step):
            j = min(i + step, length)
            here, base = reduced[:, i:j], powers[i:j]
            keys = whole[:, None, None] + (all_symbols - here[:, :, None]) * base[None, :, None]
            keep = all_symbols != here[:, :, None]
            yield np.broadcast_to(number[:, None, None], keep.shape)[keep], keys[keep]
            keys = sums[:, i:j] + (whole[:, None] - sums[:, i + 1 : j + 1]) * _U(_INVERSE)
            keep = here != before[:, i:j]
            yield np.broadcast_to(number[:, None], keep.shape)[keep], keys[keep]
            j = min(i + step, length + 1)
            keys = (sums[:, i:j] + (whole[:, None] - sums[:, i:j]) * _U(_BASE))[:, :, None] + all_symbols * powers[
                i:j, None
            ]
            keep = all_symbols != before[:, i:j, None]
            yield np.broadcast_to(number[:, None, None], keep.shape)[keep], keys[keep]


def _reduced_words(symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                key = np.zeros(batch.num_rows, _U)
                for at, letters in _by_length(batch.column("word")):
                    key[at] = _sums(letters, symbols)[1][:, -1]
                yield pa.record_batch(
                    [batch.column("word"), batch.column("n"), pa.array(key.view(np.int64))], names=["word", "n", "key"]
                )

    return run


def _neighbourhoods(symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                own = batch.column("key").to_numpy(zero_copy_only=False)
                for at, letters in _by_length(batch.column("word")):
                    for row, key in _neighbours(letters, symbols):
                        yield pa.record_batch(
                            [pa.array(own[at[row]]), pa.array(key.astype(_U).view(np.int64))], names=["key", "near_key"]
                        )

    return run


def near_words(words: DataFrame, symbols: int = SYMBOLS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """word, n, near, near_n: every two words of (word, n) that differ by one edit, in both orders.

    words must hold each word once, of code points below U+0100.
    """
    keyed = staged(words.select("word", "n").mapInArrow(_reduced_words(symbols), "word string, n long, key long"), "spelling")
    buckets = staged(keyed.groupBy("key").agg(F.min("word").alias("word"), F.count("*").alias("held")), "spelling")
    around = buckets.select("word", "key").mapInArrow(_neighbourhoods(symbols), "key long, near_key long")
    sizes = buckets.select("key", "held")
    reduced_pairs = around.join(sizes.select(F.col("key").alias("near_key"), F.col("held").alias("near_held")), "near_key")
    crowded = sizes.where(F.col("held") > max_bucket)
    some_crowded = symbols < ALL_LETTERS and not crowded.isEmpty()
    if some_crowded:
        reduced_pairs = reduced_pairs.join(sizes, "key").where((F.col("held") <= max_bucket) | (F.col("near_held") <= max_bucket))
    pairs = staged(reduced_pairs.select("key", "near_key"), "spelling")
    left = keyed.join(pairs, "key").select("word", "n", "near_key")
    right = keyed.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("key").alias("near_key"))
    near = (
        left.join(right, "near_key")
        .where((F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1))
        .select("word", "n", "near", "near_n")
    )
    if some_crowded:
        near = near.unionByName(near_words(keyed.join(crowded.select("key"), "key", "left_semi"), ALL_LETTERS))
    # Keys are hashes: two neighbours of a word that collide would give a pair twice.
    return near.distinct()


def _roots(links: DataFrame) -> DataFrame:
    """word, root for links (word, form). Each form is FORM_RATIO times as frequent, so a chain is short;
    every round doubles the steps followed."""
    current = staged(links.select("word", F.col("form").alias("root")), "spelling")
    while True:
        further = current.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = staged(
            current.join(further, "root", "left").select(
                "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")
            ),
            "spelling",
        )
        if step.where("_moved").isEmpty():
            return step.select("word", "root")
        current = step.select("word", "root")


def spelling_variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for a vocabulary (word, n)."""
    words = staged(words.select("word", "n"), "spelling")
    best = F.min(F.struct((-F.col("near_n")).alias("_n"), "near"))
    formed = (
        near_words(words)
        .groupBy("word", "n")
        .agg(F.count("*").alias("n_near"), best.alias("_best"))
        .withColumn("_is_form", -F.col("_best._n") >= FORM_RATIO * F.col("n"))
        .select(
            "word",
            "n_near",
            F.when(F.col("_is_form"), F.col("_best.near")).alias("form"),
            F.when(F.col("_is_form"), -F.col("_best._n")).alias("form_n"),
        )
    )
    formed = staged(formed, "spelling")
    roots = _roots(formed.where("form IS NOT NULL"))
    return (
        words.join(formed, "word", "left")
        .join(roots, "word", "left")
        .select(
            "word",
            "form",
            F.coalesce("root", "word").alias("root"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            "form_n",
        )
    )


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling_variants(corpus_words(docs, one_in_199_shortened))


OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)
              ORDER BY i) AS entries
  FROM (SELECT unnest(range(256)) AS i)
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS r FROM documents)
), counted AS (
  SELECT id, run, count(*) AS c FROM runs WHERE length(run) >= 6 GROUP BY ALL
), hashed AS (
  SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(id || ':' || run, ''),
           lambda l: CASE WHEN unicode(l) < 128 THEN [unicode(l)::BIGINT] ELSE [195::BIGINT, unicode(l)::BIGINT - 64] END))),
           lambda s, b: xor(s >> 8, entries[xor(s & 255, b) + 1]))) AS h
  FROM counted, crc
), vocabulary AS (
  SELECT word, sum(c)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, c FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5
), cut AS (
  SELECT word, i, word[:i] AS head, word[i + 2:] AS tail FROM (SELECT word, unnest(range(length(word))) AS i FROM vocabulary)
), near AS (
  SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT c.word, v.word FROM cut c JOIN vocabulary v ON v.word = c.head || c.tail
  UNION SELECT v.word, c.word FROM cut c JOIN vocabulary v ON v.word = c.head || c.tail
), ranked AS (
  SELECT near.word, near.near, b.n AS near_n, a.n,
         count(*) OVER (PARTITION BY near.word) AS n_near,
         row_number() OVER (PARTITION BY near.word ORDER BY b.n DESC, near.near) AS place
  FROM near JOIN vocabulary a ON a.word = near.word JOIN vocabulary b ON b.word = near.near
), formed AS (
  SELECT v.word, v.n, coalesce(r.n_near, 0)::BIGINT AS n_near,
         CASE WHEN r.near_n >= 5 * v.n THEN r.near END AS form, CASE WHEN r.near_n >= 5 * v.n THEN r.near_n END AS form_n
  FROM vocabulary v LEFT JOIN ranked r ON r.word = v.word AND r.place = 1
), followed AS (
  SELECT word, word AS at, form AS next FROM formed
  UNION ALL SELECT followed.word, formed.word, formed.form FROM followed JOIN formed ON formed.word = followed.next
)
SELECT f.word, f.form, t.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN followed t ON t.word = f.word AND t.next IS NULL
"""
