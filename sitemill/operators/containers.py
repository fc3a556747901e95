"""Items of a page and the containers that hold them, found in one sweep over the page's tokens.

For each kind of container that a page has, a pass from the first token to the last carries the innermost open one down from a token's
parent to the token, so what an item belongs to is a look-up and no item is compared with another. The time is the number of tokens
times the number of kinds that occur. An item is one row: kind, box (place of its container, -1 for the page), pos, text, target,
value, n and texts; what these mean is said at each kind below.

vm-id     box product; value: the number
scope     box product; value: number of a productPrice element, or '' for a .product-price one
price     box product; text; value, n: innermost productPrice number around it, 1 inside a .product-price
name, short  box product; text
select    box product
option    box select or -1; text: own text; value
image     box product; target, value: source and the address of the link around it; text: alt; n: order
view      the browse view; heading (box -1), range (box view): text
card      box view; text, target: of the title link; n: number of title links; texts: prices
page-link box view; text, target
crumb     box trail; text, target
menu      box: the menu entry around it; text, target: of its first link; value: target of the first link of the entry around it
entry     calendar entry: box cell; text, target; value: its day (y/m/d) or none
img       every image: box gallery holder or -1; target, value: source and the address of the link around it; text: alt
mark      value: what the page class asks for (names of areas, or source-error)
main      value: item-page, article-content, article or article-any (the outermost ones outside page frame)"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

# --- fixed values: class names and ids of the source's layouts
RELATED = re.compile(r"(?i)related|neighbou?rs?|browse|recommend|similar")
GALLERY = re.compile(r"(?i)phocagallery|sigplus|sige|gallery|galeria|joomgallery|^jg_")
CONTENT_AREAS = ("portal-real-content", "portal-center-site-bar", "center-sitebar")
PAGE_MARKS = ("reset", "remind", "registration", "login", "blog", "contact")
PRODUCT_INPUTS = ("virtuemart_product_id", "virtuemart_product_id[]")
IMAGE_HOLDERS = {"main-image", "additional-images"}
CRUMBS = {"breadcrumb", "breadcrumbs"}
MENU_ENTRIES = {"VmOpen", "VmClose"}
_PRICE_ID = re.compile(r"productPrice([0-9]+)")
_DAY = re.compile(r"/kalendarz/eventsbyday/([0-9]{4}/[0-9]{1,2}/[0-9]{1,2})/-\.html\Z")
_WIDTH = re.compile(r"jevblocks([0-7])")
_RUN = re.compile(r"\s+")
ERROR_TEXT = "jos-Error"

FIELDS = [("kind", "string"), ("box", "int"), ("pos", "int"), ("text", "string"), ("target", "string"), ("value", "string"), ("n", "int"), ("texts", "array<string>")]
SCHEMA = "array<struct<" + ",".join(f"{name}:{kind}" for name, kind in FIELDS) + ">>"

# what finds the items, in their order
PASSES = ("products", "listing", "trails", "menu", "calendar", "images", "marks", "mains")


class Sweep:
    """page: the columns tag, parent, last, classes, id, attrs, url, text, chrome; shown: the page's visible text, at: each token's place in it."""

    def __init__(self, page, shown: str, at: list[int]):
        self.page, self.shown, self.at = page, shown, at
        self.size = len(page.element)
        self.named: dict[str, list[int]] = {}
        self.by_tag: dict[str, list[int]] = {}
        for k, element in enumerate(page.element):
            if element is not None:
                self.by_tag.setdefault(element.tag, []).append(k)
                for name in element.classes if len(element.classes) < 2 else set(element.classes):
                    self.named.setdefault(name, []).append(k)

    def with_class(self, *names: str) -> list[int]:
        if len(names) == 1:
            return list(self.named.get(names[0], ()))
        return sorted({k for name in names for k in self.named.get(name, ())})

    def like(self, pattern: re.Pattern) -> list[int]:
        return sorted({k for name, places in self.named.items() if pattern.search(name) for k in places})

    def around(self, opening: list[int] | set[int], outermost: bool = False) -> list[int]:
        """For each token the innermost of the opening elements around it, or -1; with outermost, those inside another one do not count."""
        near = [-1] * self.size
        if opening:
            opens = set(opening)
            for k, up in enumerate(self.page.parent):
                if up >= 0:
                    near[k] = up if up in opens and not (outermost and near[up] >= 0) else near[up]
        return near

    def holders(self, openers: list[int], places: list[int], outermost: bool = False) -> dict[int, int]:
        """around() for some elements only, both in page order: a step for each of them instead of one for each token."""
        last, found, open_, at = self.page.last, {}, [], 0
        for k in places:
            while at < len(openers) and openers[at] < k:
                while open_ and last[open_[-1]] < openers[at]:
                    open_.pop()
                if not (outermost and open_):
                    open_.append(openers[at])
                at += 1
            while open_ and last[open_[-1]] < k:
                open_.pop()
            found[k] = open_[-1] if open_ else -1
        return found

    def text(self, k: int) -> str:
        return " ".join(self.shown[self.at[k + 1] : self.at[self.page.last[k]]].split())

    def own_texts(self, elements: list[int]) -> dict[int, str]:
        """The text directly in each of the elements."""
        found: dict[int, list[str]] = {k: [] for k in elements}
        if found:
            for k in range(self.size):
                if self.page.tag[k] == "#text" and self.page.parent[k] in found:
                    found[self.page.parent[k]].append(self.page.text[k])
        return {k: _RUN.sub(" ", "".join(parts)).strip() for k, parts in found.items()}

    def _alt(self, k: int) -> str:
        return _RUN.sub(" ", self.page.attrs[k].get("alt", "")).strip()

    def items(self, passes: tuple[str, ...] = PASSES) -> Iterator[tuple]:
        for name in passes:
            yield from getattr(self, name)()

    # ------------------------------------------------------------------ products

    def products(self) -> Iterator[tuple]:
        page, openers = self.page, self.with_class("ProductContainer")
        if not openers:
            return
        box = self.around(openers, outermost=True)
        yield from (("product", -1, k, None, None, None, None, None) for k in openers if box[k] < 0)
        aside = [False] * self.size
        related = set(self.like(RELATED))
        for k, up in enumerate(page.parent):
            if up >= 0 and box[k] >= 0:
                aside[k] = aside[up] or (up in related and box[up] >= 0)
        own = lambda places: (k for k in places if box[k] >= 0 and not page.chrome[k] and not aside[k])
        ids = {k: m[1] for k, name in enumerate(page.id) if name and (m := _PRICE_ID.fullmatch(name))}
        for k in own(sorted(ids)):
            yield "vm-id", box[k], k, None, None, ids[k], None, None
            yield "scope", box[k], k, None, None, ids[k], None, None
        for k in own(self.by_tag.get("input", ())):
            if page.attrs[k].get("name") in PRODUCT_INPUTS:
                yield "vm-id", box[k], k, None, None, page.attrs[k].get("value", "").strip(), None, None
        blocks = self.with_class("product-price")
        yield from (("scope", box[k], k, None, None, "", None, None) for k in own(blocks))
        spans = [k for k in own(self.with_class("PricesalesPrice")) if page.tag[k] == "span"]
        by_id, by_block = (self.around(ids) , self.around(blocks)) if spans else ([], [])
        for k in spans:
            yield "price", box[k], k, self.text(k), None, ids.get(by_id[k], ""), int(by_block[k] >= 0), None
        for kind, places in (("name", self.by_tag.get("h1", ())), ("short", self.with_class("product-short-description"))):
            yield from ((kind, box[k], k, self.text(k), None, None, None, None) for k in own(places))
        selects = list(own(self.by_tag.get("select", ())))
        yield from (("select", box[k], k, None, None, None, None, None) for k in selects)
        options = [k for k in own(self.by_tag.get("option", ())) if page.attrs[k].get("value", "").strip() not in ("", "0")]
        labels = self.own_texts(options)
        yield from (("option", box[k], k, labels[k], None, page.attrs[k]["value"].strip(), None, None) for k in options)
        holder = self.around([k for k in own(self.with_class(*IMAGE_HOLDERS))])
        link = self.around(self.by_tag.get("a", []))
        pictures = [k for k in own(self.by_tag.get("img", ())) if holder[k] >= 0]
        pictures += [k for k in own(self.with_class("product-image")) if page.tag[k] == "img" and holder[k] < 0]
        for n, k in enumerate(pictures):
            yield "image", box[k], k, self._alt(k), page.url[k], page.url[link[k]] if link[k] >= 0 else None, n, None

    # ------------------------------------------------------------------ browse pages

    def listing(self) -> Iterator[tuple]:
        page = self.page
        for k in self.with_class("shop-kateory-title"):
            if page.element[k].tag == "h1" and not page.chrome[k]:
                yield "heading", -1, k, self.text(k), None, None, None, None
        openers = [k for k in self.with_class("browse-view") if page.element[k].tag == "div" and not page.chrome[k]]
        if not openers:
            return
        numbers, boxes, anchors = self.with_class("display-number"), self.with_class("browseProductContainer"), self.by_tag.get("a", [])
        view = self.holders(openers, sorted({*openers, *numbers, *boxes, *anchors}), outermost=True)
        yield from (("view", -1, k, None, None, None, None, None) for k in openers if view[k] < 0)
        yield from (("range", view[k], k, self.text(k), None, None, None, None) for k in numbers if view[k] >= 0)
        cards = [k for k in boxes if view[k] >= 0]
        headings = [k for k in self.with_class("browseProductTitle") if page.element[k].tag == "h2"]
        reds = [k for k in self.with_class("price-red") if page.element[k].tag == "span"]
        card = self.holders(cards, sorted({*headings, *reds, *anchors}))
        titles = self.holders([k for k in headings if card[k] >= 0], anchors)
        links: dict[int, list[int]] = {}
        pager = self.holders(self.with_class("vm-pagination"), anchors)
        for k in anchors:
            if titles[k] >= 0 and card[titles[k]] == card[k]:
                links.setdefault(card[k], []).append(k)
            if pager[k] >= 0 and view[k] >= 0:
                yield "page-link", view[k], k, self.text(k), page.address(k), None, None, None
        prices: dict[int, list[str]] = {}
        for k in reds:
            if card[k] >= 0:
                prices.setdefault(card[k], []).append(self.text(k))
        for k in cards:
            found = links.get(k, [])
            one = found[0] if len(found) == 1 else None
            yield "card", view[k], k, None if one is None else self.text(one), None if one is None else page.address(one), None, len(found), prices.get(k, [])

    # ------------------------------------------------------------------ trails and menus

    def trails(self) -> Iterator[tuple]:
        openers = self.with_class(*CRUMBS)
        if openers:
            trail = self.around(openers, outermost=True)
            yield from (("crumb", trail[k], k, self.text(k), self.page.url[k], None, None, None) for k in self.by_tag.get("a", ()) if trail[k] >= 0)

    def menu(self) -> Iterator[tuple]:
        entries = [k for k in self.with_class(*MENU_ENTRIES) if self.page.tag[k] == "li"]
        if not entries:
            return
        lists = self.around([k for tag in ("ul", "ol", "li") for k in self.by_tag.get(tag, ())])
        above = self.around(entries)
        first: dict[int, int] = {}
        for k in self.by_tag.get("a", ()):
            first.setdefault(lists[k], k)
        for k in entries:
            if k in first:
                over = first.get(above[k])
                yield "menu", above[k], k, self.text(first[k]), self.page.url[first[k]], None if over is None or above[k] < 0 else self.page.url[over], None, None

    # ------------------------------------------------------------------ calendar

    def _day(self, k: int) -> str | None:
        found = _DAY.search(self.page.url[k] or "")
        return found[1] if found else None

    def calendar(self) -> Iterator[tuple]:
        page = self.page
        entries = [k for k in self.with_class("cal_titlelink") if page.tag[k] == "a"]
        if not entries:
            return
        cells = self.by_tag.get("td", [])
        cell = self.around(cells)
        day_links = [k for k in self.with_class("cal_daylink") if page.tag[k] == "a"]
        # the only day that a cell names, '' for several; a cell inside another one counts for both
        days: dict[int, str] = {}

        def name(where: int, day: str) -> None:
            if where >= 0:
                days[where] = day if days.get(where, day) == day else ""

        for k in day_links:
            if day := self._day(k):
                name(cell[k], day)
        for k in reversed(cells):
            if k in days:
                name(cell[k], days[k])
        # the seven-day header of a cell: the one day link of each column
        column = self.around(self.with_class("jev_daynum"))
        in_column: dict[int, list[int]] = {}
        for k in day_links:
            in_column.setdefault(column[k], []).append(k)
        headers: dict[int, list[int]] = {}
        for k in self.with_class("jevdaydata"):
            if page.tag[k] == "div" and page.tag[page.parent[k]] == "td":
                headers.setdefault(page.parent[k], []).append(k)
        columns: dict[int, list[int]] = {only: [] for found in headers.values() if len(found) == 1 for only in found}
        rows = {k for k in self.with_class("jeveventrow") if page.parent[k] >= 0 and page.tag[page.parent[k]] == "td"}
        offset: dict[int, int | None] = dict.fromkeys(rows, 0)
        starts: dict[int, tuple[int | None, int | None]] = {}
        numbered = set(self.with_class("jev_daynum"))
        for k, up in enumerate(page.parent):
            if page.tag[k][0] == "#":
                continue
            if up in columns:
                columns[up].append(k)
            if up in rows:
                widths = [int(m[1]) for c in page.classes[k] if (m := _WIDTH.fullmatch(c))]
                width = widths[0] if len(widths) == 1 else 1 if not widths and "jev_dayoutofmonth" in page.classes[k] else None
                starts[k] = offset[up], width
                offset[up] = None if width is None or offset[up] is None else offset[up] + width
        block = self.around(set(starts))
        for k in entries:
            where = cell[k]
            if where < 0:
                yield "entry", -1, k, self.text(k), page.url[k], None, None, None
                continue
            day = days.get(where) or None
            if day is None and block[k] >= 0 and page.parent[page.parent[block[k]]] == where and len(headers.get(where, ())) == 1:
                named = columns[headers[where][0]]
                start, width = starts[block[k]]
                if len(named) == 7 and numbered.issuperset(named) and offset[page.parent[block[k]]] == 7 and start is not None and width and start < 7:
                    links = in_column.get(named[start], [])
                    day = self._day(links[0]) if len(links) == 1 else None
            yield "entry", where, k, self.text(k), page.url[k], day, None, None

    # ------------------------------------------------------------------ images, marks, main content

    def images(self) -> Iterator[tuple]:
        pictures = self.by_tag.get("img", ())
        if pictures:
            link = self.around(self.by_tag.get("a", []))
            holder = self.around([k for k in self.like(GALLERY) if not self.page.chrome[k]])
            yield from (("img", holder[k], k, self._alt(k), self.page.url[k], self.page.url[link[k]] if link[k] >= 0 else None, None, None) for k in pictures)

    def marks(self) -> Iterator[tuple]:
        page, seen = self.page, set()
        area = self.around(self.with_class("portal-real-content"))
        mark = lambda value, k: ("mark", -1, k, None, None, value, None, None)
        for name in PAGE_MARKS:
            found = next((k for k in self.named.get(name, ()) if page.tag[k] == "div" and area[k] >= 0), None)
            if found is not None:
                yield mark(name, found)
        found = next((k for k, name in enumerate(page.id) if name == "xmap" and area[k] >= 0), None)
        if found is not None:
            yield mark("xmap", found)
        if "portal-real-content" not in self.named and ERROR_TEXT in self.shown:
            letters = [0]
            for a, b in zip(self.at[:-1], self.at[1:], strict=True):
                letters.append(letters[-1] + (len(_RUN.sub("", self.shown[a:b])) if b > a else 0))
            for k in self.by_tag.get("b", ()):
                # only an element of that many letters can say it, and nested ones that say the same are asked once
                span = (letters[k + 1], letters[page.last[k]])
                if span[1] - span[0] == len(ERROR_TEXT) and span not in seen:
                    seen.add(span)
                    if self.text(k) == ERROR_TEXT:
                        yield mark("source-error", k)
                        return

    def mains(self) -> Iterator[tuple]:
        page = self.page
        area = self.around(self.with_class(*CONTENT_AREAS))
        anywhere: Callable[[int], bool] = lambda k: True
        inside: Callable[[int], bool] = lambda k: area[k] >= 0
        groups = [
            ("item-page", self.with_class("item-page"), anywhere), ("article-content", self.with_class("article-content"), inside),
            ("article", self.by_tag.get("article", []), inside), ("article-any", self.by_tag.get("article", []), anywhere),
        ]
        for value, places, wanted in groups:
            clean = [k for k in places if not page.chrome[k] and wanted(k)]
            held = self.around(clean)
            yield from (("main", -1, k, None, None, value, page.last[k], None) for k in clean if held[k] < 0)
