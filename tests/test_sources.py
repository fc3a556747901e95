from __future__ import annotations

import hashlib
import tempfile

import pytest

from sitemill.operators import routes as R
from sitemill.sources import readers as S, writers as W


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="sitemill-test-")


def sha(text, charset="utf-8"):
    return hashlib.sha256(text.encode(charset)).hexdigest()


def test_captures(spark, folder):
    spark.createDataFrame([("u1", "ł"), ("u2", "é"), ("u3", "x"), ("u5", "x")], "url string, html string").write.json(f"{folder}/pages")
    spark.createDataFrame([("u1", "u1", 2, sha("ł"), "utf-8"), ("u2", "u2", 1, sha("é", "latin-1"), "iso-8859-1"), ("u3", "u3", 9, sha("x"), None), ("u4", "u4", 1, sha("x"), None)],
                          "url string, final_url string, bytes long, sha256 string, charset string").write.json(f"{folder}/manifest")
    pages, rejects = S.read_captures(spark, f"{folder}/pages", f"{folder}/manifest")
    assert {r.url for r in pages.collect()} == {"u1", "u2"}
    assert {(r.url, r.code) for r in rejects.collect()} == {("u3", "capture-integrity"), ("u4", "capture-missing"), ("u5", "capture-not-listed")}


def test_bundle_round_trip(spark, folder):
    entities = spark.createDataFrame([("products", "b", "{}", None), ("categories", "a", "{}", None), ("nope", "c", "{}", None)], "collection string, key string, data string, relations map<string, array<string>>")
    W.write_bundle(entities, f"{folder}/entities")
    spark.createDataFrame([(1, "demo", "z", "2026-01-01", True)], "version int, kind string, manifestHash string, capturedAt string, complete boolean").write.json(f"{folder}/source")
    spark.createDataFrame([("m", "a/b.jpg", "x", None, None)], "key string, path string, sha256 string, alt string, url string").write.json(f"{folder}/media")
    tables, issues = S.read_bundle(spark, folder)
    assert tables["entities"].count() == 3 and sorted(r.code for r in issues.collect()) == ["manifest-hash", "unsupported-collection"]


def test_projection_and_lists(spark):
    raw = spark.createDataFrame([("page", 1, 1), ("page", 1, 0), ("page", 2, None), ("page", -3, 1), ("trip", 1, 1)], "kind string, id long, published int")
    clean, rejects = S.routing_projection(raw)
    assert {(r.kind, r.id, r.published) for r in clean.collect()} == {("page", 2, False), ("trip", 1, True)}
    assert {(r.kind, r.id) for r in rejects.collect()} == {("page", 1), ("page", -3)}
    with pytest.raises(ValueError):
        S.routing_projection(raw.selectExpr("*", "'x' AS email"))
    url = lambda *urls: spark.createDataFrame([(u,) for u in urls], "url string")
    crawl = S.crawl_addresses(url("a"), url("b"), url("c"), url("d"))
    assert {(r.url, r.capture_state) for r in crawl.collect()} == {("a", "captured"), ("b", "failed"), ("c", "pending"), ("d", "excluded")}
    report = spark.createDataFrame([("missing-title", "https://shop.example.com/a", ""), ("conflicting-source-content", None, "https://shop.example.com/b | https://x.example/c"), ("other", None, "https://shop.example.com/d")], "code string, url string, detail string")
    assert {(r.code, r.url) for r in S.conversion_issues(report, r"shop\.example\.com").collect()} == {("missing-title", "https://shop.example.com/a"), ("conflicting-source-content", "https://shop.example.com/b")}
    rows, flag = S.scan_all(spark.range(5), 3)
    assert rows.count() == 3 and flag.first().truncated


def test_writers(spark, folder):
    paths = spark.createDataFrame([(f"/p{i}.html",) for i in range(25)] + [("/a&b.html",), ("/login",)], "path string")
    W.write_sitemaps(R.sitemap_entries(paths, "https://shop.example.com"), f"{folder}/maps", shard=10)
    files = [r.value for r in spark.read.text(f"{folder}/maps", wholetext=True).collect()]
    assert all(text.count("<loc>") <= 10 and text.startswith("<?xml") for text in files) and sum(text.count("<loc>") for text in files) == 26
    assert any("/a%26b.html" in text for text in files)
    current = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    merged = W.upsert_snapshot(current, spark.createDataFrame([(2, "x"), (3, "y")], "id int, v string"), "id", {"run": "r1"})
    assert {(r.id, r.v, r.run) for r in merged.collect()} == {(1, "a", None), (2, "x", "r1"), (3, "y", "r1")}
    W.append_new(current, None, f"{folder}/new", "id")
    W.append_new(spark.createDataFrame([(2, "b"), (3, "c")], "id int, v string"), spark.read.parquet(f"{folder}/new"), f"{folder}/new2", "id")
    assert [r.id for r in spark.read.parquet(f"{folder}/new2").collect()] == [3]
    watched, seen = W.with_progress(current, "copy")
    watched.write.parquet(f"{folder}/copy")
    assert seen.get["rows"] == 2
    listing = S.read_file_inventory(spark, f"{folder}/copy", "*.parquet")
    assert listing.count() >= 1 and S.read_file_digests(spark, f"{folder}/copy").where("length(sha256) = 64").count() >= 1
