from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sitemill.functions import dates as D, documents as J, hashing as H, money as M, paths as P, text as T, unicode as U

HOSTS = ["shop.example.com"]


def one(spark, column, **values):
    row = spark.range(1).withColumns({name: F.lit(value) for name, value in values.items()} or {"_": F.lit(1)})
    return row.select(column.alias("r")).first()["r"]


def many(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [row["r"] for row in df.select("i", make(F.col("v")).alias("r")).orderBy("i").collect()]


def test_safe_page_path(spark):
    values = ["/a", "/a/", "/szczegół.html", "/szczegól", "/x%2Fy", "/x%zz", "/a+b", "/a%FF", "/a/../b", "/a​b", "//a", "/", "", None, "/a?b", "/a b", "/%C5%82", "/a//b", "/%25"]
    expected = ["/a", "/a/", "/szczegół.html", "/szczegól", None, None, "/a+b", None, None, None, None, "/", None, None, None, None, "/ł", None, None]
    assert many(spark, values, P.safe_page_path) == expected


def test_route_key_collapses_spellings(spark):
    assert many(spark, ["/x", "/x/", "/x.html", "/X.HTML", "//x//", "/a/b.html"], P.route_key) == ["x", "x", "x", "X", "x", "a/b"]


def test_normalize_segments(spark):
    rows = many(spark, ["a/b.html", "a/%C5%82", "a/..", "/".join("x" * 13), "/".join(["x"] * 13), "a//b", "a%2Fb", ".html", "x" * 201], P.normalize_segments)
    assert rows[0]["segments"] == ["a", "b"] and rows[0]["path"] == "a/b" and rows[0]["requested"] == "/a/b.html"
    assert rows[1]["requested"] == "/a/ł"
    assert rows[2] is None and rows[4:] == [None] * 5


@pytest.mark.parametrize("url,expected", [
    ("https://shop.example.com/a.html", "/a.html"), ("http://shop.example.com:80/a", "/a"), ("https://other.example.com/a", None), ("https://shop.example.com/a?x=1", None),
    ("https://u:p@shop.example.com/a", None), ("https://shop.example.com:8443/a", None), ("https://shop.example.com", "/"), ("//shop.example.com/a", None), ("data:x", None), ("https://shop.example.com/a#top", "/a"),
])
def test_site_path(spark, url, expected):
    assert many(spark, [url], lambda c: P.site_path(c, HOSTS)) == [expected]


def test_slugs_and_keys(spark):
    assert many(spark, ["a", "a/b", "ż-1", "a b", ".a", "a..b", "a/", "", "x" * 201], P.is_safe_slug) == [True, True, True, False, False, True, False, False, False]
    assert many(spark, ["a/b"], lambda c: P.is_safe_slug(c, nested=False)) == [False]
    assert many(spark, ["vm:1", "a/../b", "a b", "ł_.:/-", "x" * 301], P.is_key) == [True, False, False, True, False]
    key = many(spark, ["a b"], lambda c: P.entity_key("page", c))[0]
    assert key.startswith("page-sha256:") and len(key) == len("page-sha256:") + 40


def test_public_addresses(spark):
    values = ["/", "/a.html", "/api/x", "/koszyk.html", "/login", "/component/users", "/a?b", "/a/b/", "/index.php", "/%C5%82.html"]
    assert many(spark, values, P.public_seo_path) == ["/", "/a.html", None, None, None, None, None, "/a/b", None, "/ł.html"]
    assert many(spark, ["/a?strona=2", "/a?strona=1", "/a?strona=1001", "/a?q=1", "/a"], P.public_canonical) == ["/a?strona=2", "/a", None, None, "/a"]
    assert many(spark, ["a", "/a.html", "a/", "http://x", "//x", " b "], P.content_href) == ["/a.html", "/a.html", "/a/", None, None, "/b.html"]
    assert many(spark, ["/old.html/", "bad path", None, "/"], lambda c: P.canonical_path(F.lit("/built.html"), c)) == ["/old.html", "/built.html", "/built.html", "/"]
    assert many(spark, ["/a/b?x", "/api/x", "/token", "/a/%2e%2e/b", "rel", "/ok"], P.measurement_path) == ["/a/b", None, None, None, None, "/ok"]


def test_media_verdict(spark):
    base = "https://shop.example.com/"
    cases = {
        "": "media-empty", "data:image/png;base64,x": "media-inline-data", base + "a.jpg?x": "media-query", base + "a%2Fb.jpg": "media-encoded-separator", base + "a/../b.jpg": "media-traversal",
        "ftp://shop.example.com/a.jpg": "media-scheme", "https://u@shop.example.com/a.jpg": "media-userinfo", "https://cdn.example.org/a.jpg": "media-external-host", "https://shop.example.com:81/a.jpg": "media-port",
        base + ".env/a.jpg": "media-hidden-or-empty-segment", base + "a.pdf": "media-extension", base + "templates/a.jpg": "media-template-asset", base + "img/a.JPG": None,
        base + "components/com_virtuemart/shop_image/product/a.jpg": None, "relative.jpg": "media-unsafe",
    }
    got = many(spark, list(cases), lambda c: P.media_verdict(c, HOSTS)["code"])
    assert dict(zip(cases, got)) == cases


def test_prices(spark):
    values = ["1 299,00 zł", "1 299,00 ZŁ", "0,00 zł", "12,5 zł", "1.299 pln", "od 10 zł", None, "10 zł 20 zł"]
    assert many(spark, values, M.parse_pln_cents) == [129900, 129900, 0, None, 129900, None, None, None]
    assert many(spark, [1.005, -1.0, 0.0, 2_000_000.0], M.legacy_cents, "double") == [101, None, 0, None]
    price = one(spark, M.product_price(F.lit(1000), F.lit(900)))
    assert (price["base"], price["sale"], price["current"]) == (1000, 900, 900)
    assert one(spark, M.product_price(F.lit(0), F.lit(None).cast("long")))["current"] is None
    assert one(spark, M.product_price(F.lit(1000), F.lit(1000)))["sale"] is None
    assert one(spark, M.variant_price(F.lit(1000), F.lit(900), F.lit(700)))["current"] == 700
    assert one(spark, M.format_money(F.lit(12345678))).replace(" ", " ") == "123 456,78 zł"
    assert one(spark, M.clamp_qty(F.lit(150.7), F.lit(None).cast("long"))) == 99 and one(spark, M.clamp_qty(F.lit(0.2), F.lit(5))) == 1


def test_stock_is_three_valued(spark):
    kind = "array<struct<stock:bigint>>"
    values = [[], [(None,), (None,)], [(0,), (None,)], [(2,), (None,)], [(0,), (0,)], [(1,), (2,)]]
    assert many(spark, values, lambda c: M.known_stock(F.lit(7).cast("long"), c), kind) == [7, None, None, 2, 0, 3]
    assert many(spark, values, lambda c: M.stored_stock(F.lit(7).cast("long"), c), kind) == [7, None, None, None, 0, 3]
    assert many(spark, [None, 0, 3], M.stock_state, "bigint") == ["unknown", "out", "in"]
    assert many(spark, [None, 0, 5], lambda c: M.seats_left(c, F.lit(7)), "bigint") == [None, None, 0]


def test_local_time(spark):
    make = lambda c: D.instant_of_local(c.cast("timestamp_ntz"))
    values = ["2026-03-29 02:30:00", "2026-10-25 02:30:00", "2026-07-01 10:00:00", "2026-01-01 10:00:00"]
    assert many(spark, values, make) == [None, None, datetime(2026, 7, 1, 8), datetime(2026, 1, 1, 9)]
    bounds = one(spark, D.month_range(F.lit("2026-03-01").cast("date")))
    assert (bounds["start"], bounds["end"]) == (datetime(2026, 2, 28, 23), datetime(2026, 3, 31, 22))
    assert many(spark, ["2026-07", "1999-01", "2026-13", "x"], D.parse_month)[1:] == [None, None, None]
    assert one(spark, D.format_datetime(F.lit("2026-11-14 08:00:00").cast("timestamp_ntz"))) == "14 listopada 2026, 09:00"
    assert one(spark, D.warsaw_instant(F.lit(2026), F.lit(2), F.lit(30), F.lit(1), F.lit(0))) is None


def test_event_dates(spark):
    values = [
        "Od Piątek, 2. październik 2026 - 16:00\nDo Niedziela, 4. październik 2026 - 21:00", "Środa, 26. sierpień 2026, 19:00 - 20:00", "Piątek, 24. kwiecień 2026, 09:00",
        "Sobota, 24. kwiecień 2026, 09:00", "Piątek, 24. kwietnia 2026, 09:00", "Od Piątek, 24. kwiecień 2026", "Piątek, 24. kwiecień 2026, 09:00 - 08:00", "jutro",
    ]
    rows = many(spark, values, D.event_dates)
    assert rows[0]["starts_at"] == datetime(2026, 10, 2, 14) and rows[0]["ends_at"] == datetime(2026, 10, 4, 19)
    assert [row["code"] for row in rows] == [None, None, None, "event-date-weekday-mismatch", "event-date-month-unknown", "event-date-missing-time", "event-date-end-before-start", "event-date-unparsed"]


def test_dates_bind_their_text_once(spark):
    """A long text expression is not copied into every match and every field read from it."""
    plan = lambda c: spark.range(1).select(c.alias("d"))._jdf.queryExecution().analyzed().toString()
    text = F.concat(F.lit("mark"), F.col("id").cast("string"))
    for function in (D.event_dates, D.course_next_date):
        assert plan(function(text)).count("mark") == 1
    rows = many(spark, [None, "Od Piątek, 2. październik 2026 - 16:00\nDo Sobota, 4. październik 2026 - 21:00", "Niedziela, 25. październik 2026, 02:30", "Piątek, 31. luty 2026, 10:00", "Piątek, 2. październik 2026, 24:00"], D.event_dates)
    assert [row["code"] for row in rows] == ["event-date-unparsed", "event-date-weekday-mismatch"] + ["event-date-invalid"] * 3


def test_course_dates(spark):
    phrase = "Najbliższy kurs rozpoczyna się"
    rows = many(spark, [f"{phrase}: 2026-10-12 o godz. 18:30.", f"{phrase} wkrótce", f"{phrase}: 2026-10-25 o godz. 02:30", f"{phrase}: 2026-02-30 o godz. 10:00", "nic", f"{phrase}: 2026-10-12 o godz. 18:30 {phrase}"], D.course_next_date)
    assert rows[0]["starts_at"] == datetime(2026, 10, 12, 16, 30)
    assert [row["starts_at"] for row in rows[1:]] == [None] * 5 and rows[4]["reason"] is None
    assert "ambiguous" in rows[2]["reason"] and "calendar" in rows[3]["reason"] and rows[5]["reason"].startswith("2 ")


def test_text(spark):
    assert many(spark, ["<p>a&amp;b</p><script>x</script>c"], T.plain_text) == ["a&b c"]
    assert many(spark, ["short", "one two three four five", "abcdefghijklmnop"], lambda c: T.excerpt(c, 12)) == ["short", "one two thr…", "abcdefghijk…"]
    parts = many(spark, ["22 826 47 73, +48 604 123 456 lub wew. 5"], T.phone_parts)[0]
    assert [p["href"] for p in parts] == ["tel:+48228264773", "tel:+48604123456", None]
    assert many(spark, [" A@B.pl ", "a@b", "a b@c.pl"], T.valid_email) == ["a@b.pl", None, None]
    assert many(spark, ["<a href='x'>&\""], T.xml_escape) == ["&lt;a href=&apos;x&apos;&gt;&amp;&quot;"]
    assert many(spark, ["😀a", "ab"], U.utf16_length) == [3, 2]
    assert many(spark, ["ŻÓŁĆ  ﬁ"], T.catalog_search_text) == ["żółć fi"]
    assert many(spark, ["Straße", "STRASSE"], U.collision_key) == ["strasse", "strasse"]
    assert many(spark, ["a\x07", "ok", "x" * 6], lambda c: U.text_problem(c, 5)) == ["contains control characters", None, "longer than 5 characters (6)"]


def test_hashes(spark):
    assert many(spark, ["", "a", "foobar", "a😀"], H.fnv1a32) == ["811c9dc5", "e40c292c", "bf9cf968", "1c8ecbf9"]
    a, b = one(spark, H.stable_hash(F.lit(None).cast("string").alias("x"), F.lit(1).alias("y"))), one(spark, H.stable_hash(F.lit("null").alias("x"), F.lit(1).alias("y")))
    assert a != b


def test_documents(spark):
    raws = ['{"v":1,"analytics":true}', '{"v":1,"analytics":false}', '{"v":2,"analytics":true}', '{"analytics":true}', "x", None, '{"v":1,"analytics":"true"}']
    rows = many(spark, raws, J.parse_consent)
    assert [(r["decided"], r["analytics"]) for r in rows] == [(True, True), (True, False)] + [(False, False)] * 5
    good = '{"items":[{"product":1,"name":"a","qty":1,"unitPriceCents":5,"lineTotalCents":5}],"subtotalCents":5,"deliveryCents":0,"totalCents":5,"currency":"PLN","deliveryMethod":"x","deliveryMethods":[]}'
    assert many(spark, [good, good.replace('"qty":1', '"qty":"a"'), "{}"], lambda c: J.parse_quote(c)["totalCents"]) == [5, None, None]
    assert one(spark, J.seo_url(F.lit("/ł a.html"), "https://x.example")) is None
    assert one(spark, J.seo_url(F.lit("/ł.html"), "https://x.example")) == "https://x.example/%C5%82.html"
    meta = one(spark, J.page_meta(F.lit("T"), F.lit(""), F.lit(None).cast("string"), F.lit("<p>lead</p>"), F.lit("body"), F.lit("a/b"), F.lit(None).cast("string")))
    assert tuple(meta) == ("T", "lead", "/a/b.html")


def test_plain_addresses_take_the_short_way_to_the_same_path(spark):
    from itertools import product

    heads = ["https://shop.example.com", "http://shop.example.com", "HTTPS://shop.example.com", "https://Shop.example.com", "https://u@shop.example.com", "https://shop.example.com:443", "https://shop.example.com:8080", "https://o.example", "//shop.example.com", "ftp://shop.example.com", ""]
    tails = ["", "/", "/a", "/a/", "/a/b.html", "/a//b", "/.", "/./a", "/a/..", "/a/..b", "/.a", "/...", "/a?", "/a?b=1", "/a#f", "/a b", "/%61", "/a%2Fb", "/\u00e9", "/e\u0301", "/a\n", "/a,b", "/A_~-9", "/" + "x" * 5000, "/x" * 1500, "/a\\b"]
    rows = [(h + t,) for h, t in product(heads, tails)] + [(None,)]
    df = spark.createDataFrame(rows, "u string").repartition(4)
    for ports, hosts, pattern in ((("", "80", "443"), None, r"\Ashop\.example\.com\z"), (("",), ["shop.example.com"], None), (("443",), None, None)):
        both = df.select("u", P._site_path(F.col("u"), ports, hosts, pattern).alias("a"), P._judged_site_path(F.col("u"), ports, hosts, pattern).alias("b"))
        assert both.where("NOT a <=> b").collect() == []
        assert both.where("a IS NOT NULL").count() > 5
    assert {r["u"] for r in df.where(F.col("u").rlike(P._PLAIN_URL)).collect()} >= {"https://shop.example.com/a/b.html", "http://shop.example.com/.a", "https://o.example/a"}
