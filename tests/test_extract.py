from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sitemill.functions import paths as P
from sitemill.operators import containers, extract as X

SITE = "https://shop.example.com"
HOST = r"shop\.example\.com"
OWN = r"\Ashop\.example\.com\z"

PAGES = {
    "article": (SITE + "/a/news.html", """<html><head><title> A &amp; B </title><meta name="Description" content=" d  e "><link rel="canonical" href="/a/canon.html"></head><body>
<nav><a href="/menu">menu</a></nav><div class="item-page"><div class="page-header">skip</div><h1>The <b>title</b></h1><p>One<br>two &lt;x&gt;</p><h1 class="x"></h1></div></body></html>"""),
    "old": (SITE + "/b.html", """<div class="portal-real-content"><h2 class="contentheading">Old title</h2><div class="article-content"><h1>callout</h1><p>text <a href="/c.html?x=1">gone</a> <a href="d.html">kept</a>
<a href="https://other.example/">out</a><a href="javascript:x">js</a></p><img src="img/a.jpg" alt=" x  y "><img src="/t.gif" width="1"><iframe src="http://www.youtube.com/embed/1"></iframe><script>bad()</script><p> </p></div></div>"""),
    "two": (SITE + "/two.html", '<div class="item-page"><h1>a</h1></div><div class="item-page"><h1>b</h1></div>'),
    "product": (SITE + "/12-maski/3625-maska.html", """<div class="breadcrumbs"><a href="/">Home</a><a href="/sklep-nurkowy.html">Sklep</a><a href="/80-maski.html">Maski</a><a href="/80-maski/139-nurkowe.html">Nurkowe</a></div>
<div class="ProductContainer"><h1>Maska</h1><div id="productPrice77"><span class="PricesalesPrice">1 299,00 zł</span></div><div class="product-short-description">Krótki  opis</div>
<select name="size"><option value="">Wybierz</option><option value="1">S</option><option value="2">M</option></select><div class="main-image"><a href="/images/big.jpg"><img src="/images/small.jpg" alt="foto"></a></div>
<div class="product-related-products"><h1>Other</h1><span class="PricesalesPrice">5,00 zł</span></div></div>"""),
    "badproduct": (SITE + "/x.html", '<div class="ProductContainer"><h1>A</h1><input name="virtuemart_product_id" value="5"><input name="virtuemart_product_id[]" value="6"><span class="PricesalesPrice">1,00 zł</span></div>'),
    "listing": (SITE + "/list.html", """<link rel="search" href="/index.php?option=com_search&amp;view=category&amp;virtuemart_category_id=80"><h1 class="shop-kateory-title">Maski</h1><div class="browse-view"><div class="display-number">Wyników 1 - 2 z 9</div>
<div class="browseProductContainer"><h2 class="browseProductTitle"><a href="/1-a.html">A</a></h2><span class="price-red">10,00 zł</span></div><div class="browseProductContainer"><h2 class="browseProductTitle"><a href="/2-b.html">B</a></h2></div>
<div class="vm-pagination"><a href="/list-2.html">2</a></div></div>"""),
    "event": (SITE + "/kalendarz/eventdetail/12/-/kurs.html", """<link rel="search" href="/index.php?option=com_jevents&amp;evid=12"><div id="jevents_body" class="jeventpage"><table><tr><td><h1>Kurs</h1></td><td><p><span>Piątek, 24. kwiecień 2026, 09:00</span><span>Basen</span><span>tel</span></p></td></tr></table>
<div>tekst</div><p><a class="jev_back" href="#">Wróć</a></p></div>"""),
    "calendar": (SITE + "/kalendarz.html", """<table><tr><td><a class="cal_daylink" href="/kalendarz/eventsbyday/2026/7/5/-.html">5</a><a class="cal_titlelink" href="/kalendarz/e.html">10:00 Nurkowanie</a></td>
<td><div class="jevdaydata">""" + "".join(f'<div class="jev_daynum"><a class="cal_daylink" href="/kalendarz/eventsbyday/2026/7/{d}/-.html">{d}</a></div>' for d in range(6, 13)) + """</div>
<div class="jeveventrow"><div class="jevblocks2"></div><div class="jevblocks3"><a class="cal_titlelink" href="/k">18:30 Kurs</a></div><div class="jevblocks2"></div></div></td><td><a class="cal_titlelink" href="/k">bez daty</a></td></tr></table>"""),
    "gallery": (SITE + "/galeria/x.html", '<div class="phocagallery"><a href="/images/1.jpg" title="T"><img src="/thumbs/1.jpg" alt="one"></a><img src="/images/2.jpg" alt="two"><img src="/images/1.jpg"><img src="x.bmp"></div>'),
    "error": (SITE + "/err.html", "<b>jos-Error</b> trace"),
    "company": (SITE + "/", '<div class="custombox4">ul. Testowa 1 NIP: PL1234567890 Regon: 123456789 tel. +48 22 826 47 73 e-mail: a@b.pl</div>'),
    "account": (SITE + "/acc.html", '<div class="portal-real-content"><div class="login">x</div></div>'),
    "blog": (SITE + "/blog.html", '<div class="portal-real-content"><div class="blog"><h1>B</h1></div></div>'),
    "broken": (SITE + "/broken.html", "<p>a<p>b</div><li>c<li>d<td>e<td>f 😀" + "<b>" * 600 + "deep"),
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(name, url, html) for name, (url, html) in PAGES.items()] + [("none", None, None)]
    return X.tokenize_pages(spark.createDataFrame(rows, "name string, url string, html string"), "name").cache()


def row(df, name):
    return df.where(F.col("name") == name).first()


def test_head_and_text(parsed):
    r = row(X.head_facts(parsed), "article")
    assert (r.title, r.description, r.canonical, r.base) == ("A & B", "d e", SITE + "/a/canon.html", SITE + "/a/news.html")
    text = X.visible_text(parsed)
    assert row(text, "article").text == "menu skip The title One two <x>"
    assert row(text, "broken").text == "a b c d e f 😀deep" and row(text, "none").text == ""


def test_links(parsed):
    links = X.link_verdicts(X.page_links(parsed.where("name = 'old'"), "name"), host_pattern=OWN)
    assert {(r.label, r.verdict, r.kept) for r in links.collect()} == {("gone", "unresolved", None), ("kept", "keep", "/d.html"), ("out", "keep", "https://other.example/"), ("js", "drop", None)}


def test_main_content_and_body(parsed):
    body = X.clean_body(X.main_content(parsed), HOST)
    r = row(body, "old")
    assert (r.layout, r.main_title, r.main_code) == ("article-content", "Old title", None)
    assert r.body == ('<h2>callout</h2><p>text gone <a href="/d.html">kept</a>\n<a href="https://other.example/">out</a>js</p><img src="https://shop.example.com/img/a.jpg" alt="x y">'
                      '<p><a href="https://www.youtube.com/embed/1">Zobacz nagranie</a></p>')
    assert row(body, "two").main_code == "ambiguous-main-content" and row(body, "error").main_code == "no-main-content"
    r = row(body, "article")
    assert r.main_code == "ambiguous-title" and r.layout == "item-page"


def test_product(parsed):
    r = row(X.product_facts(parsed), "product").product
    assert (r.code, r.vm_id, r.name, r.price_cents, r.short) == (None, 77, "Maska", 129900, "Krótki opis")
    assert [(v.value, v.label) for v in r.variants] == [("1", "S"), ("2", "M")]
    assert row(X.product_facts(parsed), "badproduct").product.code == "product-vmid-conflict"
    crumbs = X.breadcrumbs(parsed.where("name = 'product'"), "name", host_pattern=OWN)
    assert {(r.slug, r.label, r.parent) for r in crumbs.collect()} == {("80-maski", "Maski", None), ("80-maski/139-nurkowe", "Nurkowe", "80-maski")}
    images = X.page_images(parsed.where("name = 'product'"), "name", host_pattern=OWN).collect()
    assert [(i.path, i.alt, i.code) for i in images] == [("images/big.jpg", "foto", None)]


def test_listing_event_calendar(parsed):
    r = row(X.listing_facts(parsed, OWN), "listing").listing
    assert (r.title, r.first, r.last, r.total) == ("Maski", 1, 2, 9)
    assert [(c.title, c.path, c.price_cents) for c in r.cards] == [("A", "/1-a.html", 1000), ("B", "/2-b.html", None)]
    assert [(l.path, l.label) for l in r.pagination] == [("/list-2.html", "2")]
    found = X.search_metadata(parsed, HOST)
    assert row(found, "listing").search[0]["virtuemart_category_id"] == "80"
    events = X.event_detail(found, P.site_path(F.col("url"), host_pattern=OWN))
    e = row(events, "event").event
    assert (e.code, e.event_id, e.title, e.starts_at, e.place) == (None, "12", "Kurs", datetime(2026, 4, 24, 7), "Basen") and row(events, "article").event is None
    cells = X.calendar_cells(parsed, "name", host_pattern=OWN).collect()
    assert {(c.title, c.day, c.starts_at) for c in cells} == {("Nurkowanie", "2026/7/5", datetime(2026, 7, 5, 8)), ("Kurs", "2026/7/8", datetime(2026, 7, 8, 16, 30)), (None, None, None)}


def test_gallery_company_and_classes(parsed):
    photos = X.gallery_photos(parsed.where("name = 'gallery'"), "name", host_pattern=OWN).orderBy("pos").collect()
    assert [p.path for p in photos] == ["images/1.jpg", "images/2.jpg"]
    assert row(X.company_block(parsed), "company").company.nip == "PL1234567890" and row(X.company_block(parsed), "blog").company is None
    path = P.site_path(F.col("url"), host_pattern=OWN)
    ready = X.event_detail(X.search_metadata(X.listing_facts(X.product_facts(parsed), OWN), HOST), path)
    got = {r.name: r["class"] for r in X.page_class(ready.withColumn("path", path), F.col("path")).collect()}
    assert got == {"article": "content", "old": "content", "two": "content", "product": "product", "badproduct": "product", "listing": "listing", "event": "event", "calendar": "content", "gallery": "album",
                   "error": "source-error", "company": "home", "account": "account", "blog": "blog", "broken": "content", "none": "content"}


def columns(html):
    return X._Columns(SITE + "/x.html", html)


def test_nesting_has_no_limit():
    page = columns("<div>" * 5000 + "<p id='in'>deep" + "</div>" * 4999 + "<i>after</i>")
    inner = page.id.index("in")
    assert page.tag[page.last[inner]] == "#end" and page.text[page.last[inner]] == "p" and page.last[inner] == inner + 2
    assert page.parent[page.tag.index("i")] == 0


def test_implied_ends():
    page = columns("<table><tr><td>a<td><p>b<table><tr><td>c</table>d<tr><td>e</table><ul><li>f<ul><li>g</ul>h<li>i</ul>")
    at = {text: k for k, text in enumerate(page.text) if page.tag[k] == "#text"}
    depth = lambda k: 0 if page.parent[k] < 0 else 1 + depth(page.parent[k])
    assert depth(at["a"]) == depth(at["e"]) == 3 and depth(at["c"]) == 6 and page.tag[page.parent[at["d"]]] == "td"
    assert page.parent[page.parent[at["f"]]] == page.parent[page.parent[at["i"]]] and page.parent[at["f"]] == page.parent[at["h"]]


def test_time_grows_with_the_page():
    import time

    def seconds(links):
        html = "<div class='x'><ul>" + "<li><a href='/a'>one <b>two</b></a>" * links + "</ul></div>"
        start = time.process_time()
        assert columns(html).labels().count("one two") == links
        return time.process_time() - start

    seconds(200)
    assert seconds(20_000) < 40 * max(seconds(2_000), 0.02)


@pytest.mark.parametrize(("html", "chrome"), [
    ('<div class="portal-real-content"><div class="fr right-sitebar"><div><div class="article-content">TEXT</div></div></div></div>', False),
    ('<div class="portal-real-content"><div class="right-sitebar"><div class="moduletable"><div class="article-content">TEXT</div></div></div></div>', True),
    ('<div class="right-sitebar"><div class="item-page">TEXT</div></div>', True),
    ('<div class="sidebar-left"><h2 class="contentheading">T</h2><div class="article-content">TEXT</div></div>', False),
    ('<div class="sidebar-left"><div class="article-content">TEXT</div><h2 class="contentheading">T</h2></div>', True),
    ('<section class="sidebar-left"><h2 class="contentheading">T</h2><div class="article-content">TEXT</div></section>', True),
    ('<div class="center-sitebar"><p>TEXT</p></div>', False),
])
def test_columns_named_by_side(html, chrome):
    page = columns(html)
    assert page.chrome[page.text.index("TEXT")] is chrome


def items(html, *kinds):
    page = columns(html)
    return [row for row in containers.Sweep(page, *page.run).items() if not kinds or row[0] in kinds]


def test_items_belong_to_their_innermost_container():
    html = """<div class=ProductContainer><div class=ProductContainer><h1>in</h1></div><h1>out</h1><div class="related-x"><h1>no</h1><div class=main-image><img src=/r.jpg></div></div><div class=neighbours id=productPrice7></div></div>
<div class=ProductContainer><h1>second</h1></div>"""
    found = items(html, "product", "name", "vm-id", "image")
    boxes = [row[2] for row in found if row[0] == "product"]
    assert len(boxes) == 2 and [(row[3], boxes.index(row[1])) for row in found if row[0] == "name"] == [("in", 0), ("out", 0), ("second", 1)]
    assert [row[5] for row in found if row[0] == "vm-id"] == ["7"] and not [row for row in found if row[0] == "image"]


def test_menu_entries_know_the_entry_around_them():
    html = "<ul><li class=VmOpen><ul><li class=VmClose><a href=/2-b>B</a></ul><a href=/1-a>A</a><li class=VmClose>none<li><a href=/x>x</a></ul>"
    assert [(row[3], row[5]) for row in items(html, "menu")] == [("A", None), ("B", SITE + "/1-a")]


def test_error_pages():
    assert [row[5] for row in items("<b>" * 900 + "jos-Error" + "</b>" * 900, "mark")] == ["source-error"]
    assert not items("<b>jos-Error</b><div class=portal-real-content>", "mark") and not items("<b>a jos-Error</b>", "mark")


@pytest.mark.parametrize("unit", [
    "<div class=browseProductContainer><h2 class=browseProductTitle><a href=/1-a>A b</a></h2><span class=price-red>1,00</span></div>",
    "<td><a class=cal_daylink href=/kalendarz/eventsbyday/2026/7/5/-.html>5</a><a class=cal_titlelink href=/k>10:00 x</a>",
    "<li class=VmOpen><a href=/1-a>a</a>", "<div class=gallery><a href=/b.jpg><img src=/a.jpg></a></div>", "<b>jos-Erro</b>", "<div class=ProductContainer><h1>x</h1></div>",
])
def test_the_sweep_is_linear(unit):
    import time

    def seconds(times):
        page = columns("<div class=browse-view><table><tr>" + unit * times)
        run = page.run
        start = time.process_time()
        assert len(list(containers.Sweep(page, *run).items())) >= (0 if "Erro" in unit else times)
        return time.process_time() - start

    seconds(100)
    assert seconds(16_000) < 40 * max(seconds(1_600), 0.02)


def test_product_images_and_menu(parsed):
    images = X.product_images(parsed.where("name = 'product'"), "name", host_pattern=OWN).collect()
    assert [(i.n, i.path, i.alt, i.code) for i in images] == [(0, "images/big.jpg", "foto", None)]
    assert row(X.product_facts(parsed, OWN), "product").product.images == ["images/big.jpg"]


def test_plain_markup_is_read_as_the_parser_reads_it():
    from sitemill.operators import extract as X

    bits = ["<div class='a b' id=left>", "</div>", "<a href='/x?a=1&amp;b'>", "<A HREF=/q/>", "<a href='/n'>", "</a>", "t &amp; u", "<br/>", "<img src='/i.png'/>", "<!-- c -->", "<p class>", "<a b='c'd>", "<a href='x>", "'", "<", "<script>", "</script>", "&#65;", "<title>", "</title>", "</A >"]
    for first in bits:
        for second in bits:
            for third in ("", "<b x=\"1\" x='2'>", "'>z"):
                html = first + second + third
                parser = X._Events()
                parser.feed(html)
                parser.close()
                wanted = [(c, None, None) if t is None else (None, None, t) if c is None else (None, X._element(t, c, o), None) for t, c, o in parser.found]
                assert list(X._events(html)) == wanted, html
    # a tag met again is not taken apart again
    before = X._start_tag.cache_info().hits
    list(X._events("<div class='once'></div><div class='once'></div>"))
    assert X._start_tag.cache_info().hits > before


def test_made_pages_are_dealt_and_read_once(spark, sf):
    from sitemill.plans import layouts

    plan = lambda name: layouts.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan("product_images").count("MapInArrow") == 1
    for name, key in (("page_menus", "c_custkey"), ("page_trails", "c_custkey"), ("product_pages", "p_partkey")):
        below = plan(name).split("MapInArrow")[1]
        assert f"Exchange hashpartitioning({key}" in below


def test_rejected_images_keep_their_number(spark):
    from sitemill.operators import extract as X

    html = "<div class='ProductContainer'><div class='main-image'><img src='https://o.example/a.jpg' alt='x'><img src='/images/b.jpg' alt='y'><img src='/images/b.jpg' alt='z'></div></div>"
    pages = spark.createDataFrame([(1, "https://shop.example.com/p.html", html)] * 2, "id long, url string, html string")
    parsed = X.tokenize_pages(pages, "id", want=("items",))
    rows = X.product_images(parsed, "id", host_pattern=r"\Ashop\.example\.com\z").collect()
    assert sorted((r["n"], r["path"] or "", r["alt"], r["code"] or "") for r in rows) == [(0, "", "x", "media-external-host")] * 2 + [(1, "images/b.jpg", "y", "")]


def test_cards_are_judged_once(spark, sf):
    from sitemill.plans import layouts

    plan = layouts.listing_cards(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "_good" in plan  # a column of its own below the fields that ask for it


def test_listing_pages_cost_what_they_are_asked_for(spark, sf):
    """Lines meet as small rows, and of a page's items only those of the browse view are looked for."""
    from sitemill.plans import layouts

    plan = layouts.listing_cards(spark, sf)._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Exchange hashpartitioning(l_orderkey")[1]
    assert "browseProductContainer" in plan and "browseProductContainer" not in below
    html = "<h1 class=shop-kateory-title>T</h1><div class=browse-view><div class=browseProductContainer></div></div><img src='/i.png'>"
    parsed = X.tokenize_pages(spark.createDataFrame([(1, SITE + "/x.html", html)], "id long, url string, html string"), "id", want=("items",), passes=("listing",))
    assert [r["kind"] for r in X.page_items(parsed).collect()] == ["heading", "view", "card"]


def test_holders_are_those_of_a_whole_pass():
    import random

    rng = random.Random(5)
    for _ in range(200):
        tags = [rng.choice(["<div class=x>", "<p>", "</div>", "</p>", "<br class=x>", "t", "<li class=x>", "<i class=x/>"]) for _ in range(40)]
        page = columns("".join(tags))
        sweep = containers.Sweep(page, *page.run)
        places = [k for k, element in enumerate(page.element) if element]
        for outermost in (False, True):
            whole = sweep.around(sweep.with_class("x"), outermost)
            assert sweep.holders(sweep.with_class("x"), places, outermost) == {k: whole[k] for k in places}


def test_one_address_is_that_of_the_page():
    for head in ("", "<base href='/sub/'>", "<a href='/q'>q</a><base href='https://o.example/z/'>"):
        html = head + "".join(f"<a href='{a}'>x</a><img src='{a}'>" for a in ("/a.html", "b", "//h/c", "/x//y", "/[", "", " /s ", "/p/./q", "http://o.example/d", "#e"))
        alone, whole = columns(html), columns(html).url
        assert [alone.address(k) for k in range(len(whole))] == whole


def test_plain_pages_cost_a_few_calls_a_token():
    """Counted, not timed: Python calls for a page of cards, most of them the parts of its markup."""
    import sys

    html = "<div class=browse-view>" + "<div class=browseProductContainer><h2 class=browseProductTitle><a href='/1-a.html'>A b</a></h2><span class=price-red>1,00</span></div>" * 50 + "</div>"
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    columns(html)
    sys.setprofile(count)
    try:
        page = columns(html)
    finally:
        sys.setprofile(None)
    assert len(page.tag) > 500 and calls < 12 * len(page.tag)
