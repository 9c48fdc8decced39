"""Quality rules, exact dedup, PII, chat formatting and mixing."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from curbspark.llm import chat, exact_dedup, mixing, pii, quality
from tests.llm.support import SMALL, assert_same, edge_docs, normalised, repeat_words, words, write_edge_tables, write_empty_tables


def rows(df):
    return df.collect()


# Quality rules


def check_measures(got, texts):
    for r in got:
        text = texts[r.doc_id] or ""
        lines = [x for x in text.split("\n") if x.encode().split()]
        w = words(text)
        n_repeat = repeat_words(text)
        assert (r.n_words, r.word_chars) == (len(w), sum(len(x.decode()) for x in w))
        assert r.n_symbols == sum(text.count(c) for c in quality.SYMBOLS)
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == n_repeat
        assert r.base_failed == (len(w) < 50 or 100 * n_repeat > 50 * len(w))
        assert r.kept == (not r.base_failed and r.score >= quality.MIN_SCORE)


def test_quality_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = rows(quality.op8_quality_rules(spark, SMALL))
    assert len(got) == len(texts)
    check_measures(got, texts)
    trusted = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1").collect()}
    ratios = quality.log_ratios(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    # The same multinomials from plain tokens, buckets by Spark's hash.
    tokens = {k: re.sub(quality._PUNCT, r" \1 ", t).encode().split() for k, t in texts.items()}
    grams = {k: [(x,) for x in t] + list(zip(t, [*t[1:], None], strict=True)) for k, t in tokens.items()}
    every = sorted({g for gs in grams.values() for g in gs}, key=str)
    frame = spark.createDataFrame([(i, g[0].decode(), len(g), g[-1].decode() if g[-1] else None) for i, g in enumerate(every)], "i int, a string, n int, b string")
    hashed = {r.i: r.h for r in frame.select("i", F.when(F.col("n") == 1, quality.bucket(F.col("a"))).otherwise(quality.bucket(F.col("a"), F.col("b"))).alias("h")).collect()}
    bucket = {g: hashed[i] for i, g in enumerate(every)}
    raw, target = collections.Counter(), collections.Counter()
    for k, gs in grams.items():
        raw.update(bucket[g] for g in gs)
        if k in trusted:
            target.update(bucket[g] for g in gs)
    import math

    n, m = sum(raw.values()), sum(target.values())
    for b in range(quality.BUCKETS):
        wanted = math.log((target[b] + 1) / (m + quality.BUCKETS)) - math.log((raw[b] + 1) / (n + quality.BUCKETS))
        assert ratios[b] == pytest.approx(wanted if b in raw else 0.0, abs=1e-9)
    for r in got:
        gs = grams[r.doc_id]
        assert r.score == pytest.approx(sum(ratios[bucket[g]] for g in gs) / len(gs) if gs else 0.0, abs=1e-4)


def test_quality_keeps_trusted_and_drops_junk(spark):
    got = {r.doc_id: r for r in quality.op8_quality_rules(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    judged = [(got[r.doc_id].kept, r.quality) for r in labels if not got[r.doc_id].base_failed]
    assert all(kept for kept, q in judged if q == 1)
    assert not any(kept for kept, q in judged if q == 0)


def test_quality_edges(spark, tmp_path):
    folder = write_edge_tables(spark, tmp_path / "edge")
    got = quality.op8_quality_rules(spark, folder).collect()
    assert len(got) == edge_docs(spark).count()
    known = {r.doc_id: r.text for r in edge_docs(spark).where("doc_id >= 100").collect()}
    check_measures([r for r in got if r.doc_id in known], known)
    empty = write_empty_tables(spark, tmp_path / "empty")
    assert quality.op8_quality_rules(spark, empty).count() == 0
    docs = edge_docs(spark, extra=True)
    assert quality.quality_stage(spark, docs, folder).columns == docs.columns


# Exact dedup


@pytest.mark.parametrize("ranges", [None, 1, 3, 40])
def test_dedup_groups(spark, ranges):
    """Few and many ranges, so that groups lie inside ranges and across borders."""
    docs = edge_docs(spark).unionByName(spark.range(1000, 1200).selectExpr("id AS doc_id", "'same  text' AS text", "'' AS lang", "'' AS source", "0L AS n_chars"))
    got = exact_dedup.exact_groups(docs, ranges).collect()
    groups = collections.defaultdict(list)
    for r in docs.collect():
        groups[normalised(r.text)].append(r.doc_id)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(got) == sum(map(len, groups.values()))
    kept = collections.Counter()
    for r in got:
        ids = by_digest[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == min(i for i in ids if i is not None)
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


@pytest.mark.parametrize("ranges", [1, 8])
def test_dedup_with_long_white_space(spark, ranges):
    """Equal texts whose white space outruns any prefix, and texts that sort between their first characters."""
    texts = []
    for space in (" " * 200, "\n" * 200, " \t" * 100):
        texts += [f"Title{space}body text of some length", f"{space}one two three four five", f"a{space}b{space}c"]
    texts += ["Title body text of some length", " one two three four five", "a b c"]
    texts += [f"Title {c}" for c in "abc"] + [f" {c} x" for c in "abmn"] + [f"a {c}" for c in "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = collections.defaultdict(list)
    for k, t in enumerate(texts):
        groups[normalised(t)].append(k)
    wanted = {k: (ids[0], len(ids), k == ids[0]) for ids in groups.values() for k in ids}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs, ranges).collect()}
    assert got == wanted
    assert {r.doc_id for r in exact_dedup.without_copies(docs, ranges).collect()} >= {ids[0] for ids in groups.values()}
    assert exact_dedup.without_copies(docs, ranges).count() == len(groups)


def test_dedup_agrees_with_sql(spark):
    assert_same(spark, SMALL, exact_dedup.op2_exact_dedup, exact_dedup.OP2_SQL)


def test_dedup_stage(spark, tmp_path):
    docs = edge_docs(spark, extra=True)
    got = exact_dedup.dedup_stage(spark, docs, SMALL)
    assert got.columns == docs.columns
    assert collections.Counter(normalised(r.text) for r in got.collect()) == collections.Counter({normalised(r.text) for r in docs.collect()})
    assert exact_dedup.op2_exact_dedup(spark, write_empty_tables(spark, tmp_path)).count() == 0


# PII

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def standing(text: str | None) -> list[tuple[int, int, int]]:
    out = []
    for k, rule in enumerate((EMAIL, IP, CARD, PHONE)):
        for m in rule.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                k == 0
                or k == 1 and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))
                or k == 2 and 13 <= len(digits) <= 19 and luhn(digits)
                or k == 3 and 9 <= len(digits) <= 15
            ):
                out.append((k, m.start(), m.end()))
    return out


def test_pii_base_spans(spark):
    texts = [
        "a@b.c_x@e.f 1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.4 é🙂x@y.z",
        "+1 (702) 555-0742+49 30 123456789 4111 1111 1111 1111 4111-1111-1111-1112",
        "+" + "(" * 3000,
        "a@b.c" * 300,
        "4111111111111111 4111111111111111  4111111111111111 5500 0000 0000 0004",
        "user [at] host [dot] org, call (702) 555-0742, 10.0.0.1@x.y.z-",
    ]
    docs = edge_docs(spark).select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(texts, 500)), "doc_id long, text string"))
    docs = docs.unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id + 10000 AS doc_id", "text"))
    got = collections.Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.spans(docs).collect())
    wanted = collections.Counter()
    for r in docs.collect():
        base = standing(r.text)
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        wanted[(r.doc_id, *(sum(x[0] == k for x in base) for k in range(4)), hashlib.sha256(listed.encode()).hexdigest())] += 1
    assert got == wanted


def test_pii_hints_hold_for_every_match(spark):
    """A text with a strict or loose match of a kind meets that kind's hint; such a match is proposed wherever it stands."""
    rng = random.Random(9)
    parts = ["1", "23", "456", "7890", "a", "x.y", "@", "[at]", "(at)", "[dot]", "+", "00", *"().,:_-/ ", "  ", "- "]
    texts = ["10-0-0-1", "10,0,0,1", "4111.1111.1111.1111", "4111  1111  1111  1111", "4111 - 1", "+1-2", "+12345", "123456", "1(((((2"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(3, 30))) for _ in range(4000)]
    texts += ["".join(rng.choice("0123456789./_- ") for _ in range(40)) for _ in range(1000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for kind, g in pii.GENERATORS.items():
        for pattern in (g.strict, g.loose):
            passed = pii.stands(F.lit(kind), F.regexp_extract("text", pattern, 0)) if pattern == g.strict else F.lit(True)
            missed = docs.where(F.col("text").rlike(pattern) & passed & ~F.col("text").rlike(g.hint))
            assert [r.text for r in missed.limit(5).collect()] == [], (kind, pattern)
    found = {(r.doc_id, r.kind) for r in pii.matches(docs.where("doc_id < 4")).where("not strict").collect()}
    assert found >= {(0, "ip"), (1, "ip"), (2, "card"), (3, "card")}


def test_pii_copies_do_not_fill_the_sample(spark, monkeypatch):
    monkeypatch.setattr(pii, "MAX_TRAINING", 150)
    texts = [t for k in range(100) for t in (f"write to user{k}@mail.org now", f"row {1000003 * (k + 7)} of it")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = pii.candidates(docs).where("loose").orderBy("_pick").first().doc_id
    copies = spark.createDataFrame([(1000 + k, texts[first]) for k in range(400)], "doc_id long, text string")
    assert pii.trained(pii.candidates(docs.unionByName(copies))) is not None


def test_pii_learns_from_every_example(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "concat('row ', 1000003 * (id + 7), ' of it') AS text")
    rows = pii.candidates(docs)
    different = rows.where("loose").select("_pick", *pii.FEATURES).distinct().count()
    assert different > 5000 and pii.examples(rows).count() == different


def test_pii_empty(spark, tmp_path):
    assert pii.op3_pii(spark, write_empty_tables(spark, tmp_path)).count() == 0


# Chat formatting


def test_chat_agrees_with_sql(spark):
    assert_same(spark, SMALL, chat.op5_chat_formatting, chat.OP5_SQL)


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "\\", "\\l\\k\\b", "<", "</s", "[/OUT]\\</s>", "<s>[ROLE]x[SAYS]", "", None, "a\nb"]
    turns = [(c, t, role, text) for c in range(3) for t, (role, text) in enumerate(zip(["system", "user", "assistant", "to]ol", None] * 2, hard, strict=True))]
    turns += [(9, 0, "user", "x"), (9, 0, "user", "x"), (9, None, "assistant", "</s>"), (None, 1, "user", "n")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(frame)).collect()}
    for c in (0, 1, 2, 9, None):
        mine = sorted((t for t in turns if t[0] == c), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        assert [(t.role, t.text) for t in got[c].turns] == [(t[2] or "", t[3] or "") for t in mine]
        loss = [s.text for s in got[c].segments if s.loss]
        assert len(loss) == sum(t[2] == "assistant" for t in mine)
        assert "".join(s.text for s in got[c].segments) == got[c].formatted
        assert not got[c].valid_order


def test_chat_empty(spark, tmp_path):
    assert [r.conv_id for r in chat.op5_chat_formatting(spark, write_empty_tables(spark, tmp_path)).collect()] == [-1]


# Mixing


def test_mixing_agrees_with_sql(spark):
    assert_same(spark, SMALL, mixing.op10_mixing, mixing.OP10_SQL)


def test_mixing_meets_targets(spark):
    got = mixing.op10_mixing(spark, "/root/testdata/sf0.01").toPandas()
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source").toPandas()
    both = got.merge(source, on="doc_id")
    assert (got.taken <= 2 * got["size"]).all() and (got.taken >= 0).all()
    sums = both.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), own=("source_size", "first"))
    assert (sums["size"] == sums.own).all()
    assert ((sums.taken - sums.target).abs() <= 1).all()
    assert sums.target.sum() == pytest.approx(1.5 * sums["size"].sum())


def test_mixing_edges(spark, tmp_path):
    folder = write_edge_tables(spark, tmp_path / "edge")
    got = mixing.op10_mixing(spark, folder).collect()
    assert len(got) == edge_docs(spark).count()
    assert all(r.taken == 0 for r in got if r.size == 0)
    docs = edge_docs(spark, extra=True)
    staged = mixing.mixing_stage(spark, docs, folder)
    assert staged.columns == docs.columns and staged.count() > 0
    assert mixing.op10_mixing(spark, write_empty_tables(spark, tmp_path / "empty")).count() == 0


@pytest.mark.parametrize("ids", ["unique", "null", "shared", "alike"])
def test_mixing_meets_targets_whatever_the_ids(spark, tmp_path, ids):
    """Words of a source taken are within one document of the target; rows alike in all share what is left."""
    rows = []
    for k in range(300):
        number = 0 if ids == "alike" else k
        doc_id = {"unique": k, "null": None, "shared": 7, "alike": 7}[ids]
        rows.append((doc_id, " ".join(f"w{number}x{j}" for j in range(10)), "a" if k % 3 == 0 else "b"))
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op10_mixing(spark, str(tmp_path)).collect()
    assert len(got) == 300 and all(r["taken"] <= 2 * r["size"] for r in got)
    for source_size in (1000, 2000):
        mine = [r for r in got if r["source_size"] == source_size]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 1
    assert_same(spark, str(tmp_path), mixing.op10_mixing, mixing.OP10_SQL)


def planted_texts():
    """(text, spans) with one span each that no strict expression matches, and texts with numbers that are none."""
    pick = random.Random(12)
    digits = lambda n: "".join(pick.choice("0123456789") for _ in range(n))

    def luhn(n: int) -> str:
        body = "4" + digits(n - 2)
        total = sum(sum(divmod(int(c) * (2 - k % 2), 10)) for k, c in enumerate(reversed(body), 0))
        return body + str(-total % 10)

    out = []
    for k in range(40):
        area, middle, last = digits(3), digits(3), digits(4)
        octets = [str(pick.randint(1, 255)) for _ in range(4)]
        card = luhn(16)
        groups = [card[i : i + 4] for i in range(0, 16, 4)]
        name = pick.choice(["anna", "bo.li", "user", "k_w"]) + str(k)
        host = pick.choice(["host", "mail", "site-a"])
        for kind, span in (
            ("phone", f"({area}) {middle}-{last}" if k % 2 else f"{area}-{middle}-{last}"),
            ("email", f"{name} [at] {host} [dot] org" if k % 2 else f"{name}(at){host}.net"),
            ("ip", ("-" if k % 2 else ",").join(octets)),
            ("card", ("." if k % 2 else "/").join(groups)),
        ):
            out.append((f"the house is nice, {span} and so is the garden.", kind, span))
        wrong = groups[:3] + [groups[3][:3] + str((int(groups[3][3]) + 1) % 10)]
        for text in (
            f"order {digits(12)} of item",
            "/".join(wrong),
            f"{pick.randint(256, 999)}-{octets[0]}-{octets[1]}-{octets[2]}",
            f"file {digits(18)} and {digits(7)}",
            f"he said @ {name}",
        ):
            out.append((f"the house is nice, {text} and so is the garden.", None, None))
    return out


def test_pii_finds_rewritten_spans(spark):
    planted = planted_texts()
    first = 10_000_000
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(first + k, t) for k, (t, _, _) in enumerate(planted)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.spans(docs.unionByName(more)).collect()}
    right = wrong = 0
    missed = collections.Counter()
    for k, (text, kind, span) in enumerate(planted):
        found = [x for x in got[first + k].split(",") if x]
        wanted = f"{kind}:{text.index(span)}:{text.index(span) + len(span)}" if kind else None
        right += wanted in found
        wrong += len([x for x in found if x != wanted])
        missed[kind] += bool(kind) and wanted not in found
    assert right >= 0.9 * 160 and wrong <= 0.05 * right, (right, wrong, missed)
    # Documents of the table have no rewritten span.
    base = {r["doc_id"]: r["base"] for r in pii.spans(docs).selectExpr("doc_id", "n_email + n_ip + n_card + n_phone AS base").collect()}
    assert sum(len([x for x in got[d].split(",") if x]) - n for d, n in base.items()) <= 0.02 * sum(base.values())
