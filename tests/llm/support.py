"""Edge rows, brute-force forms and a comparison with DuckDB for the tests of this folder."""

from __future__ import annotations

import collections
import pathlib
import re

import duckdb

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

EDGE_TEXTS = [
    None,
    "",
    " \t\n ",
    "one",
    "one two three four",
    "one two three four five",
    "one  two\tthree\nfour\x0bfive",
    "one two three four five",
    "é🙂 ñ   x y",
    "ΟΔΥΣΣΕΥΣ İ <|endoftext|> it's",
    "a\nb\n\na\n  \na b c a b c a b c",
    "x" * 30_000,
    "word " * 5_000,
    "9" * 30_000,
    "a@" + "b." * 10_000 + "c",
]


def edge_docs(spark, extra: bool = False):
    """Edge texts under ids that repeat and are null, each text twice, sources with null; extra columns on demand."""
    rows = [(k if k % 5 else None, t, "en", f"s{k % 3}" if k % 4 else None, 0) for k, t in enumerate(EDGE_TEXTS)]
    rows += [(100 + k, t, "en", "s1", 0) for k, t in enumerate(EDGE_TEXTS)] + [(7, "one two three four five", None, None, None)] * 2
    docs = spark.createDataFrame(rows, DOCS)
    if extra:
        for c in ("size", "kept", "score", "_words", "_range", "_first", "taken", "token_ids", "digest", "n_words"):
            docs = docs.selectExpr("*", f"'x' AS {c}")
    return docs


def write_edge_tables(spark, folder) -> str:
    edge_docs(spark).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 1, 1), (None, 1, 1), (9, 0, None)], "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet"
    )
    return str(folder)


def write_empty_tables(spark, folder) -> str:
    for name in ("documents", "labels", "conversations", "pages", "embeddings"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def assert_same(spark, sf_dir: str, query, sql: str) -> None:
    """The query's rows are the SQL's, as multisets."""
    con = duckdb.connect()
    for path in pathlib.Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    got, wanted = query(spark, sf_dir), con.sql(sql)
    columns = sorted(wanted.columns)
    assert sorted(got.columns) == columns
    rounded = lambda row: tuple(round(x, 6) if isinstance(x, float) else x for x in row)
    left = collections.Counter(rounded(r) for r in got.select(columns).collect())
    right = collections.Counter(rounded(r) for r in con.sql(f"SELECT {', '.join(columns)} FROM wanted").fetchall())
    assert left == right


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def repeat_words(text: str | None) -> int:
    w = words(text)
    counts = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    return len({i + k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if counts[x] > 1 for k in range(3)})


def shingles(text: str | None) -> frozenset:
    w = words(text)
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def normalised(text: str | None) -> str:
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
