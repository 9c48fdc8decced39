"""Toxicity, BPE, HTML, the Jaccard join, secrets, and the pipeline."""

from __future__ import annotations

import base64
import collections
import hashlib
import html
import random
import re
import time
import unicodedata
import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from curbspark.llm import bpe, components, html_text, jaccard_join, secrets, shingles, toxicity
from tests.llm.support import EDGE_TEXTS, SMALL, edge_docs, shingles as plain_shingles, write_edge_tables, write_empty_tables

# Toxicity


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op1_toxicity(spark, sf).toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    both = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    both = both[both.held_out]
    recall = both[both.toxic == 1].predicted.mean()
    false = both[both.toxic == 0].predicted.mean()
    assert recall >= 0.9 and false <= 0.02


def test_toxicity_grammar():
    g = toxicity.Grammar(words={"idiot": 1.0}, stems={"lowei": 1.0})
    use = lambda clause: {k: v for k, v in zip(toxicity.USES, g.uses(clause), strict=True) if v}
    assert use("what an idiot") == {"plain": 1.0}
    assert use("you are an idiot") == {"targeted": 1.0}
    assert use("you are not an idiot") == {"negated": 1.0}
    assert use("they said he is an idiot and idiot") == {"reported": 2.0}
    assert use("loweisch das") == {"plain": 1.0}
    assert use("i will kill time") == {} and use("you i will kill") == {"threat": 1.0}
    assert list(g.clauses("fine. an idiot here! idiotic; end")) == [" an idiot here"]
    assert g.score("you idiot") > g.score("an idiot") > g.score("not an idiot") > g.score("")


def test_toxicity_composition_is_one_transducer_after_the_other():
    """The sums of a clause against its path through the parts, symbol by symbol, with weights."""
    heavy = toxicity.Transducer({k: (s, o, 0.5 + len(o or "") / 4) for k, (s, o, _) in toxicity.TARGET.arcs.items()})
    parts = (toxicity.NEGATION, heavy, toxicity.REPORTED)
    whole = toxicity.composed(toxicity.composed(*parts[:2], toxicity.CLASSES), parts[2], toxicity.CLASSES)
    for symbols in itertools.product(toxicity.CLASSES, repeat=5):
        states, at = [p.start for p in parts], whole.start
        for symbol in symbols:
            out, weight = symbol, 1.0
            for i, part in enumerate(parts):
                if out is not None:
                    states[i], out, w = part.step(states[i], out)
                    weight *= w
            at, got, got_weight = whole.step(at, symbol)
            assert (got, got_weight) == (out, pytest.approx(weight))
            assert got is None or got in toxicity.USES


def test_toxicity_training_rows_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_TRAINING", 3)
    docs = spark.sql("select id % 5 as doc_id, concat('text ', id) as text from range(500)")
    labels = spark.sql("select id as doc_id, 1 as toxic, 'x' as extra from range(5)")
    got = toxicity.training_rows(docs, labels).collect()
    assert 1 <= len(got) <= 3 and len({r.text for r in got}) == len(got)


def test_toxicity_contexts_count_alike_on_both_sides(spark):
    """Ten times the same texts teach the same lexicon; an insult in 300 contexts is no rarer for it."""
    rows = spark.sql(
        "select concat('w', id, if(id % 2 = 0, ' grobian ', ' freund '), 'v', id) as text, cast(id % 2 = 0 as int) as toxic"
        " from range(600)"
    )
    once = toxicity.learned_entries(rows)
    copied = toxicity.learned_entries(rows.crossJoin(spark.range(10)).select("text", "toxic"))
    assert once == copied and "grobian" in once[0] and "freund" not in once[0]


def test_toxicity_edges(spark, tmp_path):
    got = toxicity.op1_toxicity(spark, write_edge_tables(spark, tmp_path / "edge")).collect()
    assert len(got) == edge_docs(spark).count()
    assert toxicity.op1_toxicity(spark, write_empty_tables(spark, tmp_path / "empty")).count() == 0


# BPE


def test_bpe_is_the_library():
    library = Tokenizer.from_file(bpe.vocabulary())
    own = bpe.loaded(bpe.vocabulary())
    rng = random.Random(5)
    texts = [t or "" for t in EDGE_TEXTS] + ["".join(rng.choice("abc dEé'<|>1́ß ") for _ in range(80)) for _ in range(300)]
    texts += ["a\x1cb\x1fc\x85d\xa0e", "<|startoftext|><|endoftext|>x", "日本語 🙂👍🏽", "abcdefghij" * 400]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.coded(t) == (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)), t[:50]


def test_bpe_cuts_never_split_a_token():
    own = bpe.loaded(bpe.vocabulary())
    for token in list(own.tokens.values())[:5000]:
        if token.endswith("</w>") and token.isascii() and token[:-4].isalpha():
            assert own.cuts(token[:-4].encode()) == []


def test_bpe_query(spark, tmp_path):
    library = Tokenizer.from_file(bpe.vocabulary())
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in bpe.op4_bpe(spark, SMALL).collect():
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256) == (len(ids), digest(" ".join(map(str, ids))))
        assert r.decoded_sha256 == digest(library.decode(ids, skip_special_tokens=False))
    assert bpe.op4_bpe(spark, write_empty_tables(spark, tmp_path)).count() == 0
    encoded = bpe.encoded(edge_docs(spark, extra=True), bpe.vocabulary())
    assert encoded.where("text is null").first().token_ids == []


# HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("<p>a<p>b</p></p>c", "a\n\nb\n\nc"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>", "- a\n- b\n  3. x\n  4. y"),
        ("<table><tr><th>Name<th>Qty<tr><td>apple<td>10</table>", "Name   Qty\napple  10"),
        ("<table><tr><td colspan=2>long heading<tr><td>a<td>b</table>", "long heading\na  b"),
        ("x<div hidden>no</div><span style='Display : none'>no</span><script>'</p>'</script>y", "xy"),
        ("<pre>a\n  b</pre>", "a\n  b"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<details><summary>s</summary>no</details><details open>yes</details>", "s\nyes"),
        ("&lt;b&gt; &copy; <!-- no --> a < b", "<b> © a < b"),
        ("<title>no</title><h1>H</h1>t", "H\n\nt"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        ("<p>open <b>bold", "open bold"),
    ],
)
def test_html_layout(page, text):
    assert html_text.visible_text(page or "") == text


def test_html_query(spark, tmp_path):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in html_text.op6_html_extraction(spark, SMALL).collect():
        # Every word outside markup is there, in order, if it is visible.
        visible = re.sub(r"(?s)<head>.*?</head>|<!--.*?-->|<[^>]*>", " ", pages[r.page_id])
        assert re.findall(r"\w+", r.text) == re.findall(r"\w+", html.unescape(visible))
    assert html_text.op6_html_extraction(spark, write_empty_tables(spark, tmp_path)).count() == 0


# Jaccard join


def brute_links(rows):
    sets = [plain_shingles(r.text) for r in rows]
    index = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            index[g].append(i)
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, n in collections.Counter(j for g in s for j in index[g] if j > i).items():
            if 9 * n >= 4 * (len(s) + len(sets[j])):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return links, [find(i) for i in range(len(rows))]


def near_docs(spark, n: int):
    """A large group of near copies, each with words of its own, and texts that share a passage only."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for k in range(n):
        t = base[:]
        for _ in range(rng.randrange(6)):
            t[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(t)))
    for k in range(n, n + 200):
        rows.append((k, " ".join([f"y{rng.randrange(10**6)}" for _ in range(120)] + base[:100])))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("small_blocks", [False, True])
def test_join_finds_all_links_of_a_large_group(spark, monkeypatch, small_blocks):
    if small_blocks:
        monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 100)
        monkeypatch.setattr(jaccard_join, "SMALL_BUCKET", 50)
    docs = near_docs(spark, 400)
    rows = docs.orderBy("doc_id").collect()
    got = jaccard_join.joined(docs).orderBy("doc_id").collect()
    links, classes = brute_links(rows)
    # Classes follow from what links, so they agree; no link inside a class is lost.
    assert [r.n_links for r in got] == links
    assert [r.class_id for r in got] == classes


def test_join_query_is_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()
    got = jaccard_join.op7_jaccard_join(spark, "/root/testdata/sf0.01").orderBy("doc_id").collect()
    links, classes = brute_links(rows)
    found = sum(r.n_links for r in got)
    assert found >= jaccard_join.TARGET_RECALL * sum(links)
    assert all(r.n_links <= n for r, n in zip(got, links, strict=True))
    assert sum(r.class_id == rows[c].doc_id for r, c in zip(got, classes, strict=True)) >= 0.99 * len(rows)


def test_join_edges(spark, tmp_path):
    docs = edge_docs(spark)
    got = jaccard_join.joined(docs).collect()
    assert len(got) == docs.count()
    five = [r for r in got if r.doc_id in (106, 107)]
    # The five words stand in ten rows, in three spellings of white space.
    assert {r.class_id for r in five} == {6} or {r.class_id for r in five} == {5, 6} or len({r.class_id for r in five}) == 1
    assert all(r.n_links == 0 and r.class_id == r.doc_id for r in got if r.doc_id in (101, 102))
    with_extra = edge_docs(spark, extra=True)
    assert jaccard_join.join_stage(spark, with_extra, SMALL).columns == with_extra.columns
    assert jaccard_join.op7_jaccard_join(spark, write_empty_tables(spark, tmp_path)).count() == 0


def test_join_keeps_sets_with_null_and_shared_ids_apart(spark):
    """Families of near copies under null ids, one shared id and ids of their own, against brute force."""
    rng = random.Random(8)
    rows = []
    for k in range(24):
        base = [f"v{k}w{rng.randrange(5000)}" for _ in range(120)]
        near = base[:-1] + ["changed"]
        other = ["begins", *base[1:]]
        # Null alone; null with null; a null row whose near copy has an id; all of one shared id; a shared id and a lower one.
        ids = [(None,), (None, None, None), (None, 100 + k), (7, 7), (7, k % 5)][k % 5]
        rows += [(i, " ".join(t)) for i, t in zip(ids, (base, near, other), strict=False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rows = docs.collect()
    links, classes = brute_links(rows)
    members = collections.defaultdict(list)
    for r, c in zip(rows, classes, strict=True):
        members[c].append(r)
    least = {c: min((r.doc_id for r in m if r.doc_id is not None), default=None) for c, m in members.items()}
    wanted = collections.Counter((r.doc_id, least[c], n) for r, c, n in zip(rows, classes, links, strict=True))
    assert collections.Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.joined(docs).collect()) == wanted
    stay = jaccard_join.join_stage(spark, docs, SMALL).collect()
    of_text = {r.text: c for r, c in zip(rows, classes, strict=True)}
    assert sorted(of_text[r.text] for r in stay) == sorted(members)
    assert all(r.doc_id == least[of_text[r.text]] for r in stay)


def test_join_sees_links_between_groups_of_a_bucket():
    """Two members that other sets hold already are similar to each other only; and random buckets against all pairs."""
    rng = np.random.default_rng(6)

    def connected(sig):
        n = len(sig)
        group = pa.table({"set_id": pa.array(range(n), pa.int64()), "signature": pa.array(sig.tolist(), pa.list_(pa.int32()))})
        out = jaccard_join._hang_together(group)
        root = {i: i for i in range(n)} | (dict(zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True)) if out else {})
        return [root[i] for i in range(n)]

    p, q, x, y = np.arange(256, dtype=np.int32).reshape(4, 64)
    p[23:], y[:41] = x[23:], x[:41]
    q[23:] = y[23:]
    bucket = np.array([p, q, x, y])
    assert (bucket[:, None] == bucket[None]).sum(2).tolist() == [[64, 18, 41, 18], [18, 64, 18, 41], [41, 18, 64, 41], [18, 41, 41, 64]]
    assert connected(bucket) == [0, 0, 0, 0]
    for _ in range(40):
        centres = rng.integers(0, 1 << 30, (6, 64), dtype=np.int32)
        sig = centres[rng.integers(0, 6, 60)]
        mixed = rng.random(sig.shape) < rng.choice([0.1, 0.25, 0.4], (60, 1))
        sig = np.where(mixed, centres[rng.integers(0, 6, (60, 1)), np.arange(64)], sig)
        wanted = list(range(60))
        near = (sig[:, None] == sig[None]).sum(2) >= jaccard_join.LEAST_EQUAL
        for _ in range(60):
            wanted = [min(wanted[j] for j in np.flatnonzero(near[i])) for i in range(60)]
        assert connected(sig) == wanted


def test_shingle_sets_follow_words():
    texts = [t if t is not None and len(t) < 5000 else "" for t in EDGE_TEXTS] + ["b a"] * 2
    got = list(shingles.shingle_sets(pa.array(texts)))
    for i, a in enumerate(texts):
        assert len(got[i]) == len(plain_shingles(a))
        for j, b in enumerate(texts):
            assert (plain_shingles(a) == plain_shingles(b)) == np.array_equal(got[i], got[j])


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(80)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in nodes}


# Secrets


def plain_spans(text):
    assign = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def test_secret_base_spans(spark):
    rng = random.Random(4)
    parts = ["password", "PassWD", "ſecret", "token", "api_key", "APIKEY", "=", ":", '"', "'", " ", "AKIA", "akia", "0f" * 20, "aB3", "é", "abcdefgh", "ABCDEFGH12345", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(25)) for _ in range(2000)] + [t or "" for t in EDGE_TEXTS]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.scanned(docs).collect():
        base = plain_spans(texts[r.doc_id])
        listed = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[1] == k for x in base) for k in range(3)]
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_secret_checksums():
    body = "Zq" * 15
    value, tail = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, rest = divmod(value, 62)
        tail = secrets._BASE62[rest] + tail
    kinds = lambda t: [secrets.KINDS[k] for _, k, _ in secrets.spans_of(t)]
    assert kinds(f"x ghp_{body}{tail} y") == ["repo_token"]
    assert kinds(f"x ghp_{body}000000 y") == []
    assert kinds(f"npm_{body}{tail}") == ["package_token"]
    assert kinds("eyJhbGciOiJIUzI1NiJ9.eyJhIjoxfQ.c2ln") == ["web_token"]
    assert kinds("eyJnonsense.aa.bb") == []


def test_secret_empty(spark, tmp_path):
    assert secrets.op9_secret_scans(spark, write_empty_tables(spark, tmp_path)).count() == 0


# Registration


def test_one_query_for_each_operator():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "jaccard_join", "mixing", "bpe"]


# Pipeline


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf)
        if name != "bpe":
            assert after.columns == columns
            assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
        after = corpus_pipeline.staged(after, "test")
        if name == "jaccard_join":
            links, _ = brute_links(after.collect())
            assert not any(links)
        before = after
    run = corpus_pipeline.run(spark, sf)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(run) == key(before)


def test_pipeline_on_edges_and_nothing(spark, tmp_path):
    corpus_pipeline.run(spark, write_edge_tables(spark, tmp_path / "edge")).count()
    assert corpus_pipeline.run(spark, write_empty_tables(spark, tmp_path / "empty")).count() == 0


def test_bpe_orders_marks_as_the_library():
    """100,000 short texts of marks, letters, controls and any other character."""
    own = bpe.loaded(bpe.vocabulary)
    library = tokenizers.Tokenizer.from_file(bpe.vocabulary())
    library.no_truncation()
    library.no_padding()
    points = [chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    kinds = [
        [c for c in points if unicodedata.category(c)[0] == "M"],
        [c for c in points if unicodedata.category(c)[0] == "L"],
        [c for c in points if unicodedata.category(c) in ("Cc", "Cf", "Zs", "Zl", "Zp")],
        points,
        [*"aeiouAEIOUcs ΣİÅ"],
    ]
    pick = random.Random(5)
    texts = ["".join(pick.choice(pick.choices(kinds, [5, 3, 1, 1, 4])[0]) for _ in range(pick.randint(1, 8))) for _ in range(100_000)]
    texts += ["᷋\U00011f42", "︭᫈", "͛\U0001e4ee"]
    for text, wanted in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.coded(text)[0] == " ".join(map(str, wanted.ids)), ascii(text)


def test_bpe_token_ids_are_those_of_the_digest(spark):
    for r in bpe.coded(edge_docs(spark), bpe.vocabulary).collect():
        assert len(r["token_ids"]) == r["n_tokens"]
        assert hashlib.sha256(" ".join(map(str, r["token_ids"])).encode()).hexdigest() == r["ids_sha256"]


def test_repeated_web_token_heads_take_linear_time():
    text = "eyJ" * 100_000
    begin = time.perf_counter()
    assert secrets.spans_of(text + "." + text + " EYJeyJx.eyJ.") == []
    assert time.perf_counter() - begin < 5
    token = base64.urlsafe_b64encode(b'{"alg":"none"}').decode().rstrip("=") + ".e30.c2ln"
    assert [(s, e) for s, k, e in secrets.spans_of("eyJx " + token + " EYJeyJ") if secrets.KINDS[k] == "web_token"] == [(5, 5 + len(token))]


def test_html_keeps_text_around_odd_markup():
    cases = {
        "<p title=it's>Hello</p><p>It's fine <b>x</b></p>": "Hello\n\nIt's fine x",
        "<table><tr><td rowspan=2>A<td>b<tr><td>c</table>": "A  b\n   c",
        "<table><tr><td>a<td rowspan=3>B<td>c<tr><td>d<td>e<tr><td>f<tr><td>g<td>h</table>": "a  B  c\nd     e\nf\ng  h",
        '<div style="visibility:hidden">no <b style="visibility: visible">yes</b> no</div>after': "yes\nafter",
        '<div style="display:none">no <b style="visibility:visible">no</b></div>yes': "yes",
        "<p a=b c = 'd>' e=\"f>\" g>x": "x",
        "x<a href='open": "x",
        "a<!-->b<!--->c<!-- d --!>e</>f</ g>h<": "abcefh<",
        "<script>if (a </scripty>) b</script x>c": "c",
        "<p =x=y>z": "z",
        "1 < 2 <3": "1 < 2 <3",
    }
    for page, text in cases.items():
        assert html_text.visible_text(page) == text, page


@pytest.mark.parametrize("piece", ["<a ", '<p x="', "<p x='", "</script ", "<!--", "<![CDATA[", "</", "<a b=", "<b a='\"", "<td>", "<p>", "&amp", "<textarea><"])
def test_html_takes_linear_time(piece):
    for head in ("", "<script>", "<table>", "<ul>"):
        begin = time.perf_counter()
        html_text.visible_text(head + piece * (1_000_000 // len(piece)))
        assert time.perf_counter() - begin < 20, head
    begin = time.perf_counter()
    html_text.visible_text("<a " * 350_000)
    assert time.perf_counter() - begin < 1
