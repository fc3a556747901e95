from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sitemill.operators import calendar as CAL, catalog as CT, cdc as D, commerce as C, files as FS, media as M, ordered as O, pages as G, routes as R, validate as V

T0 = datetime(2026, 1, 1)


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def timeline(n, keys, rng):
    """Rows with one hot key that holds a third of them."""
    return [(0 if rng.random() < 0.34 else rng.randrange(keys), T0 + timedelta(minutes=rng.randrange(6000)), i, rng.randrange(1, 9)) for i in range(n)]


def test_ordered_helpers_match_brute_force(spark):
    rows = timeline(400, 6, random.Random(1))
    df = spark.createDataFrame(rows, "k int, at timestamp_ntz, id long, v long").withColumn("chunk", F.col("at").cast("date"))
    order = [F.col("at"), F.col("id")]
    total, before, after = {}, {}, {}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        for i, r in enumerate(mine):
            total[r[2]] = sum(x[3] for x in mine[: i + 1])
            before[r[2]] = mine[i - 1][3] if i else None
            after[r[2]] = next((x[2] for x in mine[i + 1:] if x[3] % 3 == 0), None)
    assert {r.id: r.s for r in O.running_sum(df, ["k"], "chunk", order, F.col("v"), "s").collect()} == total
    assert {r.id: r.p for r in O.previous_value(df, ["k"], "chunk", order, F.col("v"), "p").collect()} == before
    assert {r.id: r.n for r in O.next_marked(df, ["k"], "chunk", order, F.col("v") % 3 == 0, F.col("id"), "n").collect()} == after
    assert O.top_k(df, ["k"], order, 2).count() == 12


def test_stock_ledger_matches_one_by_one(spark):
    rng = random.Random(2)
    rows = timeline(300, 8, rng)
    stock = {key: (None if key == 5 else rng.randrange(0, 120)) for key in range(8)}
    left, expected = dict(stock), {}
    for key, at, line, qty in sorted(rows, key=lambda r: (r[1], r[2])):
        if left[key] is None:
            expected[line] = "review"
        elif qty <= left[key]:
            left[key] -= qty
            expected[line] = "reserved"
        else:
            expected[line] = "rejected"
    df = spark.createDataFrame(rows, "key int, at timestamp_ntz, line long, qty long").withColumn("chunk", F.col("at").cast("date"))
    got = C.stock_ledger(df, spark.createDataFrame(list(stock.items()), "key int, stock long"))
    assert {r.line: r.verdict for r in got.collect()} == expected


def test_stock_corrections_match_one_by_one(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(3), T0 + timedelta(minutes=rng.randrange(5000)), i, rng.choice([None, 0, 1, 2]), rng.randrange(0, 3)) for i in range(200)]
    state, expected = {0: 1, 1: None, 2: 0}, {}
    for key, at, number, wanted, value in sorted(rows, key=lambda r: (r[1], r[2])):
        expected[number] = "accepted" if state[key] == wanted else "stale"
        if state[key] == wanted:
            state[key] = value
    df = spark.createDataFrame(rows, "key int, at timestamp_ntz, id long, expected long, stock long").withColumn("chunk", F.col("at").cast("date"))
    got = C.stock_corrections(df, spark.createDataFrame([(0, 1), (1, None), (2, 0)], "key int, stock long"))
    assert {r.id: r.verdict for r in got.collect()} == expected


def test_page_views_and_seats(spark):
    views = [(1, T0 + timedelta(hours=i), i, p) for i, p in enumerate("aabbbacca")]
    df = spark.createDataFrame(views, "visitor int, at timestamp_ntz, id long, path string").withColumn("chunk", F.date_trunc("hour", "at"))
    assert sorted(r.id for r in C.clean_page_views(df).collect()) == [0, 2, 5, 6, 8]
    signups = spark.createDataFrame([(1, T0, 1, "a"), (1, T0 + timedelta(hours=1), 2, "a"), (1, T0 + timedelta(days=1), 3, "b"), (1, T0 + timedelta(days=2), 4, "c")], "session_id int, at timestamp_ntz, id long, person string").withColumn("chunk", F.col("at").cast("date"))
    sessions = spark.createDataFrame([(1, 3, 1)], "session_id int, capacity int, reserved int")
    assert rows_of(C.seat_ledger(signups, sessions)) == {(1, "seated"), (2, "repeat"), (3, "seated"), (4, "full")}


def test_payments(spark):
    events = spark.createDataFrame([
        (1, T0, "k1", "A", "d", "paid", 5), (2, T0 + timedelta(minutes=1), "k1", "A", "d", "paid", 5), (3, T0 + timedelta(minutes=2), "k1", "A", "e", "paid", 5),
        (4, T0, "k2", "B", "d", "paid", 6), (5, T0 + timedelta(hours=2), "k3", "B", "d", "paid", 5), (6, T0, "k4", "Z", "d", "paid", 5), (7, T0 + timedelta(minutes=5), "k5", "A", "d", "failed", 5),
    ], "id long, at timestamp_ntz, event_key string, attempt string, digest string, outcome string, amount_cents long")
    attempts = spark.createDataFrame([("A", 5, T0 + timedelta(hours=1)), ("B", 5, T0 + timedelta(hours=1))], "attempt string, amount_cents long, expires_at timestamp_ntz")
    assert rows_of(C.payment_verdicts(events, attempts)) == {
        (1, "accepted"), (2, "duplicate"), (3, "digest-mismatch"), (4, "amount-mismatch"), (5, "terminal-review"), (6, "unknown-attempt"), (7, "terminal-state")
    }
    attempts = spark.createDataFrame([("A", "p", "r1", "raw1", None, "ready"), ("B", "p", "pending-1", None, "mk", "initializing"), ("C", "p", "old", None, "mc", "ready")],
                                     "attempt string, provider string, reference string, provider_reference string, merchant_key string, initialization string")
    events = spark.createDataFrame([(1, "p", "raw1", None), (2, "p", "new", "mk"), (3, "p", "new", "mc"), (4, "p", "old", "other"), (5, "p", "zzz", None), (6, "q", "raw1", None)], "id long, provider string, reference string, merchant_key string")
    assert {(r.id, r.verdict) for r in C.bind_attempts(events, attempts).collect()} == {(1, "matched"), (2, "bind"), (3, "reference-mismatch"), (4, "key-mismatch"), (5, "unknown-payment"), (6, "unknown-payment")}


def test_cart_variants(spark):
    products = spark.createDataFrame([(1, 1000, 900, 5, True), (2, 500, None, None, True), (3, 0, None, 5, True), (4, 100, None, 5, False)], "id long, price_cents long, sale_price_cents long, stock long, published boolean")
    variants = spark.createDataFrame([(2, "v1", "S1", "red", 3, 700), (2, "v2", "S2", "red", 3, None)], "product_id long, variant_id string, sku string, label string, stock long, price_cents long")
    cart = spark.createDataFrame([
        (1, 1, 1, None, None, 2), (1, 2, 2, "v1", None, 1), (2, 1, 2, "S2", None, 2), (3, 1, 2, None, "red", 1), (4, 1, 3, None, None, 1), (5, 1, 4, None, None, 1), (6, 1, 1, "x", None, 1), (7, 1, 1, None, None, 6), (8, 1, 1, None, None, 100), (9, 1, 1, None, None, 3), (9, 2, 1, None, None, 3),
    ], "order_id int, pos int, product_id long, variant_id string, variant string, qty long")
    priced = C.price_lines(cart, products, variants)
    got = {(r.order_id, r.pos): (r.unit_price_cents, r.reject) for r in priced.collect()}
    assert got == {
        (1, 1): (900, None), (1, 2): (700, None), (2, 1): (500, None), (3, 1): (None, "variant-not-matched"), (4, 1): (None, "price-unconfirmed"), (5, 1): (None, "product-unavailable"),
        (6, 1): (None, "product-has-no-variants"), (7, 1): (None, "stock-insufficient"), (8, 1): (None, "quantity-out-of-range"), (9, 1): (900, None), (9, 2): (900, None),
    }
    quoted = rows_of(C.quote_orders(priced))
    assert {row for row in quoted if row[3] is None} == {(1, 2, 2500, None), (2, 1, 1000, None)}
    assert {row[0] for row in quoted} == {order for order, _ in got} and (3, None, None, "line-rejected") in quoted


def test_no_order_is_lost(spark):
    schema = "order_id long, product_id long, variant_id string, qty long, unit_price_cents long, stock long, reject string"
    rows = [(1, k, None, 1, 5, 9, None) for k in range(51)] + [(2, 1, None, 60, 5, 500, None)] * 2 + [(3, 1, None, 6, 5, 9, None)] * 2 + [(4, 1, None, 99, 10**9, 500, None)]
    assert rows_of(C.quote_orders(spark.createDataFrame(rows, schema))) == {(1, None, None, "too-many-lines"), (2, None, None, "quantity-out-of-range"), (3, None, None, "stock-insufficient"), (4, None, None, "total-too-large")}


def test_conflict_cascade_drops_all_claimants(spark):
    claims = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "claim string, owner int")
    needs = spark.createDataFrame([(4, 1), (5, 4), (6, 99)], "id int, needs_id int")
    ids = spark.createDataFrame([(i,) for i in range(1, 8)], "id int")
    assert rows_of(G.conflict_cascade(claims, needs, ids)) == {(1, "conflict"), (2, "conflict"), (4, "dependency"), (5, "dependency"), (6, "dependency")}


def test_preferred_address_uses_a_single_hint(spark):
    pages = spark.createDataFrame([("g", "/long.html", None), ("g", "/a", "/long.html"), ("h", "/b", "/other"), ("h", "/bb.html", None)], "grp string, path string, hint string")
    got = {r.grp: (r.preferred, r.spelling) for r in G.preferred_addresses(pages, ["grp"]).collect()}
    assert got == {"g": ("/long.html", "/long.html"), "h": ("/b", "/bb.html")}


def test_page_verdicts(spark):
    import hashlib

    sha = lambda text: hashlib.sha256(text).hexdigest()
    pages = spark.createDataFrame([
        (1, "https://shop.example.com/a", "ł", sha("ł".encode()), None), (2, "https://shop.example.com/a", "ł", sha("ł".encode()), "utf-8"), (3, "https://shop.example.com/b", "é", sha(b"\xe9"), "iso-8859-1"),
        (4, "https://shop.example.com/c", "ł", sha("ł".encode()), "iso-8859-1"), (5, "https://x.example.com/a", "x", sha(b"x"), None), (6, "https://shop.example.com/d", "x", "zz", None), (7, "https://shop.example.com/e", "x", sha(b"x"), "klingon"),
    ], "page_id long, url string, html string, sha256 string, charset string")
    judged = G.judge_pages(pages, ["shop.example.com"])
    assert {r.page_id: r.reject_code for r in judged.collect()} == {1: None, 2: None, 3: None, 4: "integrity-mismatch", 5: "out-of-scope-url", 6: "invalid-page-record", 7: "integrity-mismatch"}
    assert rows_of(G.distinct_captures(judged).select("path", "page_id", "captures")) == {("/a", 1, 2), ("/b", 3, 1)}
    assert {r.over_limit for r in G.frontier(spark.createDataFrame([("a",), ("b",), ("c",)], "route string"), spark.createDataFrame([("a",)], "route string"), 1).collect()} == {False, True}


def test_validation_reports_every_field(spark):
    df = spark.createDataFrame([("k1", "ok", 5, "2026-01-01", "/a"), ("k2", None, -1, "x", "/a/../b")], "key string, name string, stock long, date string, path string")
    clean, issues = V.validate_fields(df, {"name": ("text", {"required": True}), "stock": ("stock", {}), "date": ("date", {}), "path": ("path", {})})
    assert [r.key for r in clean.collect()] == ["k1"]
    assert rows_of(issues) == {("k2", "name", "required"), ("k2", "stock", "invalid-stock"), ("k2", "date", "invalid-date"), ("k2", "path", "invalid-path")}
    products = spark.createDataFrame([("a", 10.0, 1000, None, None, 3, [("k", None, "L"), ("k", None, "l")]), ("b", 10.0, 999, None, None, None, [])],
                                     "key string, price double, price_cents long, sale_price double, sale_price_cents long, stock long, variants array<struct<legacy_key:string,sku:string,label:string>>")
    assert {(r.key, r.code) for r in V.row_rules(products, V.product_rules())[1].collect()} == {("a", "duplicate-variant-key"), ("a", "duplicate-variant-label"), ("a", "stock-is-derived"), ("b", "price-disagrees")}
    assert spark.range(1).select(V.unknown_fields(F.lit('{"a":1,"zz":2}'), ["a"])).first()[0] == ["zz"]
    pages = spark.createDataFrame([("p", "/a", "news", True, 1, None, 3, [("/a.html",)])], "key string, path string, kind string, listing boolean, listing_from int, listing_to int, listing_total int, listing_links array<struct<path:string>>")
    assert {r.code for r in V.row_rules(pages, V.page_rules())[1].collect()} == {"listing-needs-page-kind", "listing-range-incomplete", "listing-link-to-self"}
    settings = spark.createDataFrame([("s", "x", "https://evil.example/facebook.com", "https://www.youtube.com/c")], "key string, email string, facebook string, youtube string")
    assert {r.code for r in V.row_rules(settings, V.settings_rules())[1].collect()} == {"email-invalid", "facebook-host"}
    routes = spark.createDataFrame([(1, "/a", "/b", 301), (2, "/a", "/a", 302)], "record_id long, from_path string, to_path string, status int")
    gate = V.handoff_gate(routes, spark.createDataFrame([], "code string")).first()
    assert (gate.routes, gate.rule_issues, gate.repeated, gate.safe) == (2, 2, 1, False)
    files = spark.createDataFrame([("a/Straße", 1), ("a/STRASSE", 2), ("a/.env", 3)], "path string, size long")
    assert rows_of(V.file_set_issues(files, 2, 5)) == {("a/Straße", "name-collision"), ("a/STRASSE", "name-collision"), ("a/.env", "unsafe-path"), (None, "too-many-files"), (None, "too-many-bytes")}


def test_change_detection(spark):
    incoming = spark.createDataFrame([(1, "h1"), (2, "h2"), (3, "h3"), (4, "h4"), (5, "h5"), (6, "h6")], "key int, source_hash string")
    stored = spark.createDataFrame([(2, "h2", "c", "c"), (3, "old", "c", "c"), (4, "h4", "c", "edited"), (5, "old", "c", "edited"), (6, None, None, "c")], "key int, stored_source_hash string, stored_content_hash string, content_hash string")
    assert {(r.key, r.action) for r in D.decide(incoming, stored).collect()} == {(1, "created"), (2, "unchanged"), (3, "updated"), (4, "preserved"), (5, "conflicts"), (6, "conflicts")}
    a = spark.createDataFrame([(1, "x", None, [])], "id int, title string, listing boolean, links array<string>")
    b = a.withColumn("listing", F.lit(False))
    project = lambda df: df.select(D.content_projection(df, ["title", "listing", "links"], ["listing", "links"])).first()[0]
    assert project(a) == project(b) != project(a.withColumn("listing", F.lit(True)))
    rows = spark.range(20).withColumn("v", F.col("id") * 2)
    assert D.table_digest(rows, ["id", "v"]).first() == D.table_digest(rows.repartition(5).orderBy(F.col("id").desc()), ["id", "v"]).first()
    check = lambda *v: spark.range(1).select(D.source_verification(*[F.lit(x) if x is not None else F.lit(None).cast("string") for x in v])).first()[0]
    h = "a" * 64
    assert [check("demo", True, h, h), check("joomla-dump", False, h, h), check("joomla-dump", True, h, None), check("joomla-dump", True, h, "b" * 64), check("joomla-dump", True, h, h)] == [
        "not-a-database-dump", "declared-incomplete", "manifest-not-verified", "manifest-mismatch", "verified"]
    runs = spark.createDataFrame([("r", 1, "failed"), ("r", 2, "done")], "run_key string, attempt int, status string")
    assert {(r.status, r.age) for r in D.attempt_history(runs).collect()} == {("done", 0), ("failed", 1)}


def test_migration_special_cases(spark):
    docs = spark.createDataFrame([
        ("product", 1, "/p.html", "p", None, True), ("page", 2, None, None, "a/b", True), ("page", 3, "/kontakt.html", None, "kontakt", True), ("course", 4, None, "owd", None, True), ("category", 5, "/p.html", "c", None, True), ("page", 6, "/hid", None, "hid", False),
    ], "kind string, id long, legacy_path string, slug string, path string, published boolean")
    redirects = spark.createDataFrame([(1, True, "/old", "/p.html"), (2, True, "/l1", "/l2"), (3, True, "/l2", "/l1"), (4, True, "/bad", "/api/x"), (5, True, "/hop", "/old"), (6, True, "/%C5%82", "/p.html")], "id long, published boolean, src string, dst string")
    documents = spark.createDataFrame([(9, "/f.pdf", "/api/documents/file/" + "a" * 64 + ".pdf")], "id long, legacy_path string, url string")
    o = "https://shop.example.com"
    paths = ["/p.html", "/P", "/a/b.html", "/kontakt.html", "/kontakt", "/kursy-nurkowania/owd.html", "/old", "/l1", "/bad", "/hop", "/f.pdf", "/index.php", "/nothing", "/koszyk", "/account.html", "/x?y=1", "/ł", "/hid", "/media/x"]
    crawl = spark.createDataFrame([(o + p, None, "captured", i) for i, p in enumerate(paths)] + [("http://shop.example.com/p.html", None, "captured", 99), (o + "/p.html", None, "failed", 100)], "url string, final_url string, capture_state string, position long")
    got = {r.old_url.removeprefix(o): r for r in R.migration_map(crawl, docs, redirects, documents, hosts=["shop.example.com"]).collect()}
    view = {k: (r.disposition, r.resolved_kind, r.redirect_hops, sorted(r.issues)) for k, r in got.items()}
    assert view["/p.html"] == ("retained200", "product", 0, []) and got["/p.html"].capture_state == "captured"
    assert view["/P"][0] == "unresolved404"
    assert view["/a/b.html"] == ("retained200", "page", 0, [])
    assert view["/kontakt.html"] == ("retained200", "fixed", 0, []) and view["/kontakt"] == ("retained200", "fixed", 0, ["served-alias-canonical-elsewhere"])
    assert view["/kursy-nurkowania/owd.html"] == ("retained200", "course", 0, [])
    assert view["/old"] == ("redirect301", "product", 1, []) and view["/ł"][0] == "redirect301" or view["/ł"][0] == "unresolved404"
    assert view["/l1"][0] == "review" and view["/l1"][3] == ["redirect-loop"] and got["/l1"].current_status is None
    assert view["/bad"][3] == ["unsafe-redirect-target"]
    assert view["/hop"] == ("review", "product", 2, ["existing-redirect-chain-needs-flattening"])
    assert view["/f.pdf"] == ("retained200", "document", 0, []) and got["/f.pdf"].record_id == 9
    assert view["/index.php"][:3] == ("redirect301", "home", 1)
    assert got["/koszyk"].reason == "private-or-application-route-needs-review" and got["/account.html"].current_status == 404
    assert got["/x?y=1"].reason == "source-query-needs-explicit-route-mapping" and view["/media/x"][3] == ["application-route-destination"]
    assert got["http://shop.example.com/p.html"].reason == "outside-safe-source-url-scope"
    assert view["/hid"][0] == "unresolved404"
    assert {r.path for r in R.sitemap_paths(docs).collect()} >= {"/", "/p.html", "/a/b.html", "/kontakt.html", "/kursy-nurkowania/owd.html", "/galeria.html"}


def test_captured_redirects(spark):
    o = "https://shop.example.com"
    captures = spark.createDataFrame([(o + a, o + b) for a, b in [("/a", "/b"), ("/b", "/live"), ("/c", "/x"), ("/c", "/y"), ("/live", "/z"), ("/l1", "/l2"), ("/l2", "/l1"), ("/s", "/s.html"), ("/q", "/r?x=1")]], "url string, final_url string")
    live = spark.createDataFrame([("live",)], "route string")
    resolved, issues = R.captured_redirects(captures, live, ["shop.example.com"])
    assert rows_of(resolved) == {("a", "live"), ("b", "live")}
    assert rows_of(issues) == {("captured-redirect-conflict", "/c"), ("captured-redirect-shadowed", "/live"), ("captured-redirect-cycle", "/l1"), ("captured-redirect-cycle", "/l2"), ("captured-redirect-rejected", o + "/q")}
    pairs = spark.createDataFrame([("/n", "/live"), ("/m", "/gone"), ("/api/x", "/live"), ("/live", "/other"), ("/k", "/live"), ("/k", "/w"), ("/st", "/live"), ("/via", "/st")], "source string, target string")
    live = spark.createDataFrame([("live",), ("other",), ("",)], "route string")
    stored = spark.createDataFrame([("/st", "/live")], "src string, dst string")
    got = {r.source: (r.verdict, r.to_route) for r in R.redirect_rules_from_captures(pairs, live, stored).collect()}
    assert got == {"/n": ("new-rule", "live"), "/m": ("source-http-redirect-target-unresolved", None), "/api/x": ("source-http-redirect-app-route", None), "/live": ("source-http-redirect-shadowed", None),
                   "/k": ("source-http-redirect-conflict", None), "/st": ("already-stored", None), "/via": ("new-rule", "live")}


def _counting(df, seen):
    """df, which counts its rows each time it is computed."""
    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(count, df.schema)


def test_captures_and_crawls_are_read_once(spark):
    o = "https://shop.example.com"
    captures = spark.createDataFrame([(o + f"/a{k}", o + (f"/b{k}" if k % 2 else f"/b{k}?x=1")) for k in range(10)], "url string, final_url string")
    seen = spark.sparkContext.accumulator(0)
    resolved, issues = R.captured_redirects(_counting(captures, seen), spark.createDataFrame([("live",)], "route string"), ["shop.example.com"])
    assert rows_of(resolved) == {(f"a{k}", f"b{k}") for k in range(1, 10, 2)}
    assert rows_of(issues) == {("captured-redirect-rejected", o + f"/a{k}") for k in range(0, 10, 2)}
    assert seen.value == 10

    docs = spark.createDataFrame([("product", 1, "/p.html", "p", None, True)], "kind string, id long, legacy_path string, slug string, path string, published boolean")
    redirects = spark.createDataFrame([(1, True, "/old", "/p.html")], "id long, published boolean, src string, dst string")
    crawl = spark.createDataFrame([(o + p, None, "captured", k) for k, p in enumerate(["/p.html", "/old", "/none"])], "url string, final_url string, capture_state string, position long")
    seen = spark.sparkContext.accumulator(0)
    rows = R.migration_map(_counting(crawl, seen), docs, redirects, hosts=["shop.example.com"])
    assert {(r.old_path, r.disposition, r.new_path) for r in rows.collect()} == {("/p.html", "retained200", "/p.html"), ("/old", "redirect301", "/p.html"), ("/none", "unresolved404", None)}
    assert seen.value == 3


def test_relation_spec_is_not_joined_by_a_shuffle(spark):
    edges = spark.createDataFrame([(1, "products", "images", 0, "media:1"), (1, "products", "images", 1, "media:1"), (2, "products", "other", 0, "media:1"), (3, "products", "category", 0, "media:1")], "src_id long, collection string, field string, pos int, dst_id string")
    spec = spark.createDataFrame([("products", "images", "media", True), ("products", "category", "categories", False)], "collection string, field string, target string, many boolean")
    issues = V.relation_issues(edges, spec)
    assert "SortMergeJoin" not in issues._jdf.queryExecution().executedPlan().toString()
    assert rows_of(issues) == {(1, "images", "duplicate-reference"), (2, "other", "unsupported-relation"), (3, "category", "wrong-target")}


def test_task_shares_are_bounded_unless_the_session_says_so(spark):
    from sitemill.session import TASK_SIZES, configure

    other = spark.newSession()
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    assert {key: configure(other).conf.get(key) for key in TASK_SIZES} == TASK_SIZES
    own = spark.newSession()
    own.conf.set(name, "8mb")
    assert configure(own).conf.get(name) == "8mb"


def test_redirect_chains_beyond_20_hops(spark):
    o = "https://shop.example.com"
    chain = [(f"/c{k}", f"/c{k + 1}") for k in range(30)] + [("/c30", "/p.html")]
    ring = [("/t", "/r0")] + [(f"/r{k}", f"/r{(k + 1) % 25}") for k in range(25)]
    captures = spark.createDataFrame([(o + a, o + b) for a, b in chain + ring], "url string, final_url string")
    resolved, issues = R.captured_redirects(captures, spark.createDataFrame([("p",)], "route string"), ["shop.example.com"])
    assert rows_of(resolved) == {(f"c{k}", "p") for k in range(31)}
    assert rows_of(issues) == {("captured-redirect-cycle", a) for a, _ in ring} | {("captured-redirect-too-long", f"/c{k}") for k in range(11)}

    pairs = spark.createDataFrame([("/n", "/c0")], "source string, target string")
    verdicts = R.redirect_rules_from_captures(pairs, spark.createDataFrame([("p",)], "route string"), spark.createDataFrame(chain, "src string, dst string"))
    assert [(r.verdict, r.to_route) for r in verdicts.collect()] == [("new-rule", "p")]

    docs = spark.createDataFrame([("product", 1, "/p.html", "p", None, True)], "kind string, id long, legacy_path string, slug string, path string, published boolean")
    redirects = spark.createDataFrame([(k, True, a, b) for k, (a, b) in enumerate(chain + ring)], "id long, published boolean, src string, dst string")
    crawl = spark.createDataFrame([(o + a, None, "captured", k) for k, (a, _) in enumerate(chain + ring)], "url string, final_url string, capture_state string, position long")
    got = {r.old_path: r for r in R.migration_map(crawl, docs, redirects, None, hosts=["shop.example.com"]).collect()}
    for k in range(31):
        row = got[f"/c{k}"]
        assert (row.new_path, row.redirect_hops, "redirect-chain-too-long" in row.issues) == ("/p.html", 31 - k, 31 - k > 20), row
    assert all(got[a].issues == ["redirect-loop"] and got[a].redirect_hops == (26 if a == "/t" else 25) for a, _ in ring)


def test_media_and_files(spark):
    mains = spark.createDataFrame([("/", "h"), ("/strona-glowna/a", "h"), ("/strona-glowna/b", "x"), ("/strona-glowna/c", "h")], "path string, main_hash string")
    assert rows_of(M.home_aliases(mains, spark.createDataFrame([("strona-glowna/c",)], "route string"))) == {("/strona-glowna/a", "/", "h")}
    wanted = spark.createDataFrame([("m1", "d1"), ("m2", "d2"), ("m3", None)], "media_key string, sha256 string")
    cache = spark.createDataFrame([("m1", "d1"), ("m2", "other")], "media_key string, sha256 string")
    assert rows_of(M.reuse_cache(wanted, cache, spark.createDataFrame([("m3", "d")], "media_key string, sha256 string"))) == {("m1", "cache"), ("m2", "fetch"), ("m3", "archive")}
    attached = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "x", 1), (2, "y", 2), (2, "z", 3)], "entity_id int, media_key string, pos int")
    lists, over = M.ordered_lists(attached, 2)
    assert [(r.entity_id, r.media) for r in lists.collect()] == [(1, ["a", "b"])] and rows_of(over) == {(2, 3)}
    plan = M.staging_plan(spark.createDataFrame([("a", "p"), ("b", "q"), ("c", "q"), ("d", "r"), ("e", "s")], "media_key string, path string"), spark.createDataFrame([("a",)], "media_key string"), spark.createDataFrame([("d",)], "media_key string"))
    assert {(r.media_key, r.state) for r in plan.collect()} == {("a", "reuse"), ("b", "path-conflict"), ("c", "path-conflict"), ("d", "known-failure"), ("e", "missing")}
    paths = spark.createDataFrame([("a/.env.local",), ("x/.bash_history",), ("db/dump.sql.gz",), ("shop_image/images/a.jpg",)], "p string")
    assert [r[0] for r in paths.select(FS.skip_reason(F.col("p"))).collect()] == ["secret-path", "shell-history", None, None]
    assert [r[0] for r in paths.select(FS.snapshot_priority(F.concat(F.lit("/"), "p"))).collect()] == [3, 3, 0, 2]


def test_calendar_and_catalogue(spark):
    sessions = spark.createDataFrame([(1, 10, T0 + timedelta(days=1)), (2, 10, T0 + timedelta(days=1)), (3, 10, T0 - timedelta(days=1)), (4, 11, T0)], "id int, course_id int, starts_at timestamp_ntz")
    assert {(r.course_id, r.id) for r in CAL.next_sessions(sessions, F.lit(T0).cast("timestamp_ntz")).collect()} == {(10, 1), (11, 4)}
    courses = spark.createDataFrame([("c1", "Kurs", datetime(2026, 3, 31, 22, 30)), ("c2", "B", None)], "key string, name string, next_date timestamp_ntz")
    sessions, rows = CAL.course_terms(courses, spark.createDataFrame([("2026-03",)], "month string"))
    assert sessions.count() == 1 and rows.count() == 1  # the local month is April
    assert CAL.course_terms(courses, spark.createDataFrame([("2026-04",)], "month string"))[1].count() == 0
    plain = spark.createDataFrame([(i, f"n{i}", i == 9 and False, True) for i in range(6)], "id int, name string, featured boolean, published boolean")
    assert [r.id for r in CT.featured_or_fallback(plain).orderBy("id").collect()] == [0, 1, 2, 3]
    variants = spark.createDataFrame([(1, i, f"v{i}", "x", None if i % 2 else i, None) for i in range(501)] + [(2, 0, "a", "y", 3, 70), (2, 1, "b", "z", None, None)], "product_id int, pos int, variant_id string, label string, stock long, price_cents long")
    products = spark.createDataFrame([(1, 100, None, 5), (2, 100, 90, 5), (3, 0, None, None)], "id int, price_cents long, sale_price_cents long, stock long")
    assert {(r.id, len(r.variants), r.too_many_variants) for r in CT.product_facts(products, variants).collect()} == {(1, 501, True), (2, 2, False), (3, 0, False)}
    assert {tuple(r) for r in CT.variant_totals(products, variants).collect()} == {(1, 100, 100, sum(range(0, 501, 2)), None), (2, 70, 90, 3, None), (3, None, None, None, None)}
    slices = spark.range(1).select(CT.album_slice(F.array(*[F.lit(str(i)) for i in range(5)]), F.lit(9), 2).alias("s")).first().s
    assert (slices.rows, slices.page, slices.pages, slices.total) == (["4"], 3, 3, 5)
    children = spark.createDataFrame([(1, [3, 2, 7])], "id int, members array<int>")
    docs = spark.createDataFrame([(2, "b"), (3, "c")], "id int, name string")
    assert [d.name for d in CT.populate_many(children, "id", "members", docs).first().members] == ["c", "b"]


def test_results_do_not_depend_on_partitions(spark):
    rows = timeline(200, 5, random.Random(9))
    df = spark.createDataFrame(rows, "key int, at timestamp_ntz, line long, qty long").withColumn("chunk", F.col("at").cast("date"))
    stock = spark.createDataFrame([(k, 40) for k in range(5)], "key int, stock long")
    one, eight = C.stock_ledger(df.coalesce(1), stock), C.stock_ledger(df.repartition(8).orderBy(F.rand(1)), stock)
    assert rows_of(one) == rows_of(eight)
