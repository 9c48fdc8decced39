"""Spelling variants, language spans and hard negatives."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbspark.llm import hard_negatives as negatives
from curbspark.llm import language, spelling
from tests.llm.support import SMALL, assert_same, edge_docs, write_empty_tables

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>, label int"


# Spelling variants.


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def random_words(n: int, letters: str, seed: int) -> list[tuple[str, int]]:
    pick = random.Random(seed)
    out = {"".join(pick.choice(letters) for _ in range(pick.randint(6, 9))) for _ in range(n)}
    return [(w, pick.randint(5, 500)) for w in sorted(out)]


@pytest.mark.parametrize("symbols, max_bucket", [(12, 2048), (2, 2048), (2, 1), (3, 0), (256, 5)])
def test_near_words_are_all_pairs_within_one_edit(spark, symbols, max_bucket):
    words = random_words(250, "abé", 3) + [("a" * 3000, 5), ("a" * 2999 + "b", 7), ("ÿ" * 2998, 6)]
    got = spelling.near_words(spark.createDataFrame(words, "word string, n long"), symbols, max_bucket).collect()
    wanted = {(a, n, b, m) for a, n in words for b, m in words if one_edit(a, b)}
    assert len(got) == len(wanted) > 100 and {tuple(r) for r in got} == wanted


def test_neighbourhoods_hold_every_reduced_word_once():
    letters = np.frombuffer("aabbcaÿÿ".encode("latin-1"), np.uint8)[None, :]
    reduced = [x % 3 + 1 for x in letters[0].tolist()]
    key = lambda s: sum(x * pow(spelling._BASE, i, 1 << 64) for i, x in enumerate(s)) % (1 << 64)
    around = {tuple(reduced)}
    for i in range(len(reduced) + 1):
        around |= {(*reduced[:i], t, *reduced[i:]) for t in (1, 2, 3)}
        around |= {(*reduced[:i], t, *reduced[i + 1 :]) for t in (1, 2, 3)} | {(*reduced[:i], *reduced[i + 1 :])}
    with np.errstate(over="ignore"):
        got = [int(k) for _, keys in spelling._neighbours(letters, 3) for k in keys]
    assert sorted(got) == sorted(map(key, around))


def test_forms_are_followed_to_the_root(spark):
    words = [("aaaaaa", 5), ("aaaaab", 25), ("aaaabb", 125), ("aaabbb", 625), ("zzzzzz", 9), ("tttttt", 5), ("ttttta", 30), ("tttttb", 30)]
    got = {r["word"]: r for r in spelling.spelling_variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert {w: (r["form"], r["root"]) for w, r in got.items()} == {
        "aaaaaa": ("aaaaab", "aaabbb"),
        "aaaaab": ("aaaabb", "aaabbb"),
        "aaaabb": ("aaabbb", "aaabbb"),
        "aaabbb": (None, "aaabbb"),
        "zzzzzz": (None, "zzzzzz"),
        "tttttt": ("ttttta", "ttttta"),
        "ttttta": (None, "ttttta"),
        "tttttb": (None, "tttttb"),
    }
    assert (got["zzzzzz"]["n_near"], got["zzzzzz"]["form_n"], got["aaaaab"]["n_near"], got["aaaaab"]["form_n"]) == (0, None, 2, 125)


def test_words_and_their_shortening(spark):
    runs = [f"abcdefé{chr(97 + a)}{chr(97 + b)}" for a in range(26) for b in range(26)]
    docs = spark.createDataFrame([(None, " ".join(runs)), (7, "×".join(runs).upper().replace("É", "é"))] * 5, "doc_id long, text string")
    wanted: dict[str, int] = {}
    for id_, run in itertools.product(("", "7"), [*runs, *(["×".join(runs)])]):
        if id_ == "" and "×" in run or id_ == "7" and "×" not in run:
            continue
        h = zlib.crc32(f"{id_}:{run}".encode())
        word = run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]
        wanted[word] = wanted.get(word, 0) + 5
    got = spelling.corpus_words(docs, spelling.one_in_199_shortened).collect()
    assert {r["word"]: r["n"] for r in got} == wanted
    assert any(len(w) == 8 for w in wanted)


def test_spelling_edge_rows_agree_with_sql(spark, tmp_path):
    words = [w for w, _ in random_words(60, "abÀé", 5)]
    pick = random.Random(6)
    rows = [(k if k % 4 else None, " ".join(pick.choices(words, k=60)), "en", None, 0) for k in range(40)]
    docs = edge_docs(spark).unionByName(spark.createDataFrame(rows + rows[:5], edge_docs(spark).schema))
    docs.selectExpr("*", "'x' AS word", "1 AS n", "2 AS key").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    assert_same(spark, str(tmp_path), spelling.op11_spelling_variants, spelling.OP11_SQL)


def test_empty_tables(spark, tmp_path):
    folder = write_empty_tables(spark, tmp_path)
    for query in (spelling.op11_spelling_variants, language.op12_language_id, negatives.op13_hard_negatives):
        assert query(spark, folder).collect() == []


# Language spans.


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    greek = "Η γλώσσα είναι ένα σύστημα επικοινωνίας και η μετάφραση της είναι δύσκολη για όλους τους ανθρώπους "
    more = spark.createDataFrame([(-k, greek * 3, "el", None, 0) for k in range(20)], docs.schema)
    return language.Model(language.training_rows(docs.unionByName(more).where("doc_id % 3 <> 1")))


def test_held_out_documents_are_told_apart(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = language.op12_language_id(spark, SF).join(docs, "doc_id")
    held = got.where("held_out")
    assert got.where("score < 0 OR score > 1").isEmpty() and held.count() > 250
    assert held.where("lang = lang_pred").count() >= 0.98 * held.count()


def test_spans_of_mixed_texts(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 3 = 1 AND length(text) > 1500")
    of = {lang: docs.where(F.col("lang") == lang).orderBy("doc_id").first()["text"][:600] for lang in ("en", "fr", "de")}
    order = ["fr", "en", "de", "fr"]
    text = "\n".join(of[x] for x in order) + "\n" + "Η γλώσσα είναι δύσκολη για όλους τους ανθρώπους"
    spans = language.labelled_spans(spark.createDataFrame([(text,)], "text string"), model).first()["language_spans"]
    assert [s["lang"] for s in spans] == [*order, "el"]
    for span, border in zip(spans, (0, 601, 1202, 1803, 2404), strict=True):
        assert abs(span["start"] - border) < 60
    assert all(a["end"] <= b["start"] for a, b in itertools.pairwise(spans))
    assert sum(s["letters"] for s in spans) == sum(c.isalpha() for c in text)


def test_scripts_narrow_the_candidates(spark, model):
    texts = ["ωω ξξ", "zz qq ωωω", "日本", "12 34", "", None, "́́ !", "a" * 2_000_000, "ab " * 100_000]
    rows = language.predicted(
        language.labelled_spans(
            spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "k int, text string, language_spans string, score int"), model
        )
    )
    got = {r["k"]: r for r in rows.collect()}
    assert got[0]["lang_pred"] == "el" and [s["lang"] for s in got[1]["language_spans"]][-1] == "el"
    assert got[2]["lang_pred"] in model.names
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (3, 4, 5, 6))
    assert all(0 < got[k]["score"] <= 1 for k in (0, 1, 2, 7, 8))


def test_paths_are_the_best_ones():
    pick = np.random.default_rng(4)
    counts = [5, 0, 1, 6, 3]
    first = np.concatenate(([0], np.cumsum(counts)))
    scores = pick.normal(0, 12, (first[-1], 3))
    labels = language._paths(scores, first)
    value = lambda path, s: s[np.arange(len(path)), path].sum() - language.SWITCH_PENALTY * np.count_nonzero(np.diff(path))
    for a, b in itertools.pairwise(first):
        best = max(value(np.array(p, int), scores[a:b]) for p in itertools.product(range(3), repeat=b - a))
        assert value(labels[a:b], scores[a:b]) == pytest.approx(best)


def test_languages_learn_from_labelled_rows_only(spark, tmp_path):
    edge_docs(spark, extra=True).withColumn("lang", F.when(F.col("doc_id") == 103, "en")).withColumn(
        "language_spans", F.lit(1)
    ).write.parquet(f"{tmp_path}/documents.parquet")
    got = language.op12_language_id(spark, str(tmp_path)).collect()
    assert len(got) == edge_docs(spark).count()
    assert {r["lang_pred"] for r in got} <= {"en", "und"}
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 3 == 1)


# Hard negatives.


def mined(spark, rows, **sizes):
    vectors = negatives.usable_vectors(spark.createDataFrame(rows, VECTORS), F.col("label"))
    return vectors, negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0, **sizes)


def brute_force(vectors):
    rows = vectors.collect()
    width = max((len(r["components"]) for r in rows), default=0)
    whole = [[int(x) for x in r["components"]] + [0] * (width - len(r["components"])) for r in rows]
    out = []
    for a, anchor in enumerate(rows):
        if anchor["vec_id"] is None or anchor["vec_id"] % 50:
            continue
        scored = []
        for b, other in enumerate(rows):
            if a != b:
                id_ = other["vec_id"]
                scored.append((-sum(x * y for x, y in zip(whole[a], whole[b], strict=True)), id_ is None, id_ or 0, other))
        scored.sort(key=lambda x: x[:3])
        for p in [s for s in scored if s[3]["label"] == anchor["label"]][:5]:
            fits = [s for s in scored if s[3]["label"] != anchor["label"] and -50 * p[0] <= -100 * s[0] <= -95 * p[0]][:3]
            for rank, n in enumerate(fits, 1):
                out.append((anchor["vec_id"], p[3]["vec_id"], rank, n[3]["vec_id"], -p[0], -n[0]))
    return sorted(out, key=repr)


def collected(found):
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_negatives_agree_with_sql(spark):
    for folder in (SMALL, SF):
        assert_same(spark, folder, negatives.op13_hard_negatives, negatives.OP13_SQL)


def test_negatives_of_clustered_anchors_in_small_tiles(spark):
    pick = np.random.default_rng(8)
    centres = pick.normal(0, 1, (6, 8))
    rows = [(k * 10, (centres[k % 6] + pick.normal(0, 0.2, 8)).tolist(), int(k % 4)) for k in range(1200)]
    vectors, found = mined(spark, rows, tile=60, block=150)
    got = collected(found)
    assert got == brute_force(vectors) and len(got) > 2000


def test_negatives_of_odd_rows(spark, tmp_path):
    pick = np.random.default_rng(9)
    vector = lambda n=4: pick.integers(-2, 3, n).astype(float).tolist()
    rows = [(k, vector(), k % 3) for k in range(160)]
    rows += [(k, rows[k][1], rows[k][2]) for k in (0, 50, 100, 7, 8)]
    rows += [(50, vector(), 1), (None, vector(), 1), (None, vector(), 2), (150, [0.0] * 4, 0), (200, [], 1), (250, [1.0], 2)]
    rows += [(300, None, 1), (350, vector(), None), (400, [None, 1.0], 1), (450, [float("nan")] * 4, 1), (500, [float("inf")] * 4, 0)]
    vectors, found = mined(spark, rows, tile=2, block=40)
    assert vectors.count() == len(rows) - 5
    assert collected(found) == brute_force(vectors)
    even = [r for r in rows if r[1] is None or len(r[1]) in (2, 4)]
    spark.createDataFrame(even, VECTORS).selectExpr("*", "1 AS row", "2 AS tile", "3 AS score").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert_same(spark, str(tmp_path), negatives.op13_hard_negatives, negatives.OP13_SQL)


def test_negatives_beyond_what_doubles_hold(spark):
    rows = [(k * 50, [float(2**22 + k), float(2**21 - 3 * k)], k % 2) for k in range(12)]
    vectors, found = mined(spark, rows)
    assert collected(found) == brute_force(vectors)


def test_a_hot_vector_is_split_over_parts(spark):
    rows = [(k * 50, [1.0, 0.5, 0.25], 1) for k in range(300)]
    vectors = negatives.usable_vectors(spark.createDataFrame(rows, VECTORS), F.col("label"))
    tiled = negatives.tiled(vectors, members=50, tile=100)
    assert tiled.groupBy("part").count().agg(F.max("count")).first()[0] < 100
    assert tiled.select("tile").distinct().count() > 1
