"""Split pages against a plain JSON reader, at many sizes of byte ranges."""

from __future__ import annotations

import json
import random

import pytest

from curbspark.sources.pages import read_split_pages

TEXTS = ['a "quoted" word', "brace } in text", "},{", '\\"}', "\\", "[]", "é ü 漢", "", '{"not": "nested"}', "\n}\n"]


def _record(rng: random.Random, depth: int = 0) -> dict:
    value = lambda: rng.choice(
        [rng.choice(TEXTS), rng.random(), None, [rng.choice(TEXTS), {"in": rng.choice(TEXTS)}], {}]
        + ([_record(rng, depth + 1)] if depth < 2 else [])
    )
    return {rng.choice(TEXTS) + str(i): value() for i in range(rng.randint(0, 4))}


@pytest.fixture
def ranges_of(spark):
    def of(size: int):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))

    yield of
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("size", [300, 2000, 1 << 20])
def test_records_and_order_at_any_range(spark, tmp_path, ranges_of, size):
    ranges_of(size)
    rng = random.Random(size)
    expected = []
    for n, (indent, ascii_only) in enumerate([(None, True), (2, False), (None, False)]):
        page = [_record(rng) for _ in range(12)]
        page.append({"long": "x } { \" " * 30, "n": n})
        expected += page
        (tmp_path / f"page-{n}.json").write_text(json.dumps(page, indent=indent, ensure_ascii=ascii_only), encoding="utf-8")
    (tmp_path / "page-8.json").write_text(" [ \n ]\n")
    (tmp_path / "page-9.json").write_text("")
    rows = read_split_pages(spark, str(tmp_path)).orderBy("feed_pos").collect()
    assert [json.loads(r.raw) for r in rows] == expected
    if size == 300:
        assert len({(r.feed_pos.page, r.feed_pos.split_start) for r in rows}) > 6


def test_ranges_shorter_than_a_record(spark, tmp_path, ranges_of):
    ranges_of(9)
    text = json.dumps([{"a": '"},{"', "b": {"c": [{}, "}"]}}, {"é": "\\\\"}, {}])
    (tmp_path / "page.json").write_text(text)
    rows = read_split_pages(spark, str(tmp_path)).orderBy("feed_pos").collect()
    assert [json.loads(r.raw) for r in rows] == json.loads(text)


@pytest.mark.parametrize(
    "page",
    ['[{"a": 1}', '[{"a": 1} {"a": 2}]', '{"a": 1}', '[{"a": 1}, 7]', '[{"a": "1}]', '[{"a": 1}][{"a": 1}]', '[{"a": 1},,{"a": 2}]'],
)
@pytest.mark.parametrize("size", [8, 1 << 20])
def test_broken_pages_fail(spark, tmp_path, ranges_of, page, size):
    ranges_of(size)
    (tmp_path / "page.json").write_text(page)
    with pytest.raises(Exception, match="expected a JSON array of objects"):
        read_split_pages(spark, str(tmp_path)).collect()
