"""Nested validation, deep pages and ordered ranges on small rows."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from sitemill.operators import calendar as CAL, catalog as C, files as FS, nested as N, ordered as O

SPEC = {
    "title": ("text", {"max": 5, "required": True}), "kind": ("select", {"options": ["a", "b"]}), "n": ("int", {"min": 1, "max": 9}), "when": ("date", {}),
    "seo": ("group", {"fields": {"image": ("media", {"required": True}), "deep": ("group", {"fields": {"x": ("bool", {})}})}}),
    "rows": ("rows", {"max": 2, "fields": {"label": ("text", {"max": None, "required": True}), "inner": ("rows", {"fields": {"k": ("key", {"required": True})}})}}),
}
CASES = [
    ({"title": "ok", "seo": {"image": "media:m"}}, []),
    ({"title": "toolong", "seo": {"image": "media:m"}, "id": 1, "": 2}, [("title", "invalid-text"), ("id", "unsupported-field"), ("", "unsupported-field")]),
    ({"title": 5, "kind": "c", "n": 2.5, "when": "2026-02-30"}, [("title", "invalid-text"), ("kind", "invalid-select"), ("n", "invalid-int"), ("when", "invalid-date"), ("seo.image", "required")]),
    ({"title": None, "seo": []}, [("title", "required"), ("seo", "expected-object")]),
    ({"title": "t", "seo": {"image": "media:gone", "deep": {"x": "yes", "y": 1}}}, [("seo.deep.x", "invalid-bool"), ("seo.deep.y", "unsupported-field"), ("seo.image", "media-missing")]),
    ({"title": "t", "seo": {"image": "m"}, "rows": {}}, [("seo.image", "invalid-media"), ("rows", "invalid-rows")]),
    ({"title": "t", "seo": {"image": "media:m"}, "rows": [{"label": "x" * 9000, "inner": [{"k": "a"}, {"k": "a b"}, 3, {}]}, None]}, [("rows[0].inner[1].k", "invalid-key"), ("rows[0].inner[2]", "expected-object"), ("rows[0].inner[3].k", "required"), ("rows[1]", "expected-object")]),
    ({"title": "t", "seo": {"image": "media:m"}, "rows": [{}, {}, {}]}, [("rows", "invalid-rows")]),
    ({"title": "t", "seo": {"image": "media:m"}, "rows": [], "n": 3, "kind": "b", "when": "2026-03-01"}, []),
]


@pytest.fixture
def small_ranges(spark):
    """Ranges as small as the shuffle makes them: otherwise little data is one range."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, "true")


def test_every_broken_place_is_named(spark):
    texts = [json.dumps(value) for value, _ in CASES] + ["[1]", "no json", None, '"text"']
    want = {(k, *issue) for k, (_, issues) in enumerate(CASES) for issue in issues} | {(k, None, "invalid-json") for k in range(len(CASES), len(texts))}
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, data string")
    clean, issues = N.validate_nested(rows, SPEC, bundle=spark.createDataFrame([("m",)], "key string"))
    assert {tuple(r) for r in issues.collect()} == want and issues.count() == len(want)
    assert {r.key for r in clean.collect()} == set(range(len(texts))) - {w[0] for w in want} and clean.columns == rows.columns
    _, without = N.validate_nested(rows, SPEC)
    assert {tuple(r) for r in without.collect()} == {w for w in want if w[2] != "media-missing"}
    with pytest.raises(ValueError, match="unknown kind"):
        N.validate_nested(rows, {"x": ("nothing", {})})


def test_limits_can_be_left_out(spark):
    from sitemill.operators.validate import field_problem

    rows = spark.createDataFrame([("x" * 600,), ("",)], "t string")
    found = rows.select(field_problem(F.col("t"), "text"), field_problem(F.col("t"), "text", max=None), field_problem(F.col("t"), "text", max=0)).collect()
    assert [tuple(r) for r in found] == [("invalid-text", None, "invalid-text"), (None, None, None)]


def test_deep_pages(spark, monkeypatch, small_ranges):
    rng = random.Random(1)
    rows = [(rng.randrange(40), k, rng.choice([True, True, None, False])) for k in range(3000)]
    df = spark.createDataFrame(rows, "name long, id long, published boolean").repartition(5)
    order = [F.col("name").desc(), F.col("id")]
    want = sorted(((-n, i) for n, i, p in rows if p))
    monkeypatch.setattr(C, "HEAD_ROWS", 100)
    laid = C.sorted_rows(df, order)
    assert sum(held for _, held in laid.counts) == len(want) and len(laid.counts) > 1
    for page in (1, 3, 20, 70, len(want) // 24 + 1, 1000):
        found = [(-r.name, r.id) for r in C.scan_page(df, order, page, 24).collect()]
        assert found == want[24 * (page - 1) : 24 * page]
        assert [(-r.name, r.id) for r in laid.rows(spark, 24 * (page - 1), 24).collect()] == found
    assert C.scan_page(df.limit(0), order, 50).count() == 0


def test_ranges_of_a_dense_stretch(spark, small_ranges):
    rng = random.Random(3)
    rows = [("hot", rng.choice([1.0, 1.25, 1.5]) + rng.random() / 1000) for _ in range(801)] + [("even", 1.0), ("even", 2.0), ("one", 7.0), ("hot", -100.0)]
    got = {r.route: r for r in FS.metric_summary(spark.createDataFrame(rows, "route string, value double"), 1.5).collect()}
    for route in ("hot", "even", "one"):
        values = sorted(v for name, v in rows if name == route)
        middle = (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2
        assert (got[route].median, got[route].maximum, got[route].samples, got[route].under) == (middle, values[-1], len(values), sum(v < 1.5 for v in values))
    chunks = O.range_chunks(spark.createDataFrame(rows, "route string, value double"), [F.col("value")]).groupBy("chunk").agg(F.min("value").alias("a"), F.max("value").alias("b")).orderBy("chunk").collect()
    assert len(chunks) > 1 and all(x.b <= y.a for x, y in zip(chunks[:-1], chunks[1:], strict=True))


def test_months_by_polish_title(spark):
    from datetime import datetime

    at = datetime(2026, 5, 5, 10)
    rows = [("k1", at, 0, "zebra"), ("k2", at, 0, "łódź"), ("k3", at, 0, "lato"), ("k4", at, 0, "żaba"), ("k5", at, 1, "a"), ("k6", datetime(2026, 5, 1), 2, "z"), ("k7", at, 0, "lato")]
    got = CAL.month_groups(spark.createDataFrame(rows, "key string, starts_at timestamp_ntz, kind_rank int, title string")).collect()
    assert [r.key for r in sorted(got, key=lambda r: r.position)] == ["k6", "k3", "k7", "k2", "k1", "k4", "k5"] and {r.month for r in got} == {"2026-05"}
