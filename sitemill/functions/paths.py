"""Site paths, addresses and identities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from sitemill import constants as K
from sitemill.functions.binding import apply_sql, let, let_sql, once
from sitemill.functions.unicode import has_control, has_invisible, nfc, utf16_length

# ------------------------------------------------------------------ SQL texts of the shared steps

_ICU_NFC = "reflect('com.ibm.icu.text.Normalizer', 'compose', {v}, false)"


def _utf16(v: str) -> str:
    return f"(length({v}) + regexp_count({v}, r'[\\x{{10000}}-\\x{{10FFFF}}]'))"


def _decode(v: str) -> str:
    """Strict percent decoding: null for malformed escapes or bytes that are not UTF-8; '+' stays '+'."""
    marks = lambda x: f"(length({x}) - length(replace({x}, '\\uFFFD', '')))"
    checked = let_sql(
        f"try_url_decode(replace({v}, '+', '%2B'))", "d",
        f"CASE WHEN {marks('d')} = {marks(v)} + regexp_count({v}, '(?i)%EF%BF%BD') THEN d END",
    )
    return f"CASE WHEN contains({v}, '%') THEN {checked} ELSE {v} END"


def _nfc(v: str) -> str:
    return rf"CASE WHEN {v} RLIKE r'[^\x00-\x7F]' THEN {_ICU_NFC.format(v=v)} ELSE {v} END"


def _decoded_nfc(v: str) -> str:
    return let_sql(_decode(v), "u", _nfc("u"))


def percent_decode(c: Column) -> Column:
    return apply_sql(c, "v", _decode("v"))


def _safe_path(v: str) -> str:
    raw_ok = (
        rf"length({v}) <= {K.MAX_PATH} AND {v} RLIKE r'\A/(?!/)' AND NOT {v} RLIKE r'[\\\x00-\x20\x7F-\x9F?#]' "
        f"AND NOT {v} RLIKE r'(?i)%(?:2f|5c|00|3f|23)'"
    )
    path_ok = (
        r"NOT p RLIKE r'[%?#\\\s\p{Z}\x00-\x1F\x7F-\x9F\p{Cf}]' "
        r"AND NOT p RLIKE r'/\.{1,2}(?:/|\z)' AND NOT p RLIKE '//'"
    )
    return let_sql(let_sql(f"CASE WHEN {raw_ok} THEN {v} END", "r", _decoded_nfc("r")), "p", f"CASE WHEN {path_ok} THEN p END")


def safe_page_path(c: Column) -> Column:
    """Decoded NFC path of an own page, or null when decoding could change its meaning."""
    return apply_sql(c, "v", _safe_path("v"))


def bundle_path(c: Column) -> Column:
    """Stored form of a source path: safe, and without a trailing slash (except the root)."""
    path = safe_page_path(c)
    return F.when(path == "/", path).otherwise(F.regexp_replace(path, r"/\z", ""))


def route_key(c: Column) -> Column:
    """'/x', '/x/' and '/x.HTML' are one address, and so are composed and decomposed spellings."""
    return F.regexp_replace(F.regexp_replace(nfc(c), r"\A/+|/+\z", ""), r"(?i)\.html\z", "")


def page_stem(c: Column) -> Column:
    """Slug form: no leading slash, no final '.html'."""
    return F.regexp_replace(F.ltrim(c, F.lit("/")), r"(?i)\.html\z", "")


def _segments(v: str) -> str:
    encoded_ok = rf"NOT {v} RLIKE r'(?i)%(?:2f|5c|[01][0-9a-f])|[\\\x00-\x1F]' AND length({v}) > 0"
    # a character has two units at most, so a short part needs no count of the wide ones
    part_ok = rf"s <> '' AND NOT s IN ('.', '..') AND (length(s) <= {K.MAX_SEGMENT_UNITS // 2} OR {_utf16('s')} <= {K.MAX_SEGMENT_UNITS})"
    named = (
        r"named_struct('segments', concat(slice(t, 1, size(t) - 1), array(regexp_replace(element_at(t, -1), r'(?i)\.html\z', ''))), "
        r"'path', regexp_replace(n, r'(?i)\.html\z', ''), 'requested', concat('/', n))"
    )
    ok = rf"size(t) <= {K.MAX_SEGMENTS} AND NOT element_at(t, -1) RLIKE r'(?i)\A\.html\z' AND forall(t, s -> {part_ok})"
    split = let_sql("split(n, '/')", "t", f"CASE WHEN {ok} THEN {named} END")
    return let_sql(let_sql(f"CASE WHEN {encoded_ok} THEN {v} END", "r", _decoded_nfc("r")), "n", split)


def normalize_segments(c: Column) -> Column:
    """struct(segments, path, requested) of a raw address without its leading slash, or null."""
    return apply_sql(c, "v", _segments("v"))


_SEGMENT = r"[\p{L}\p{M}\p{N}_~-][\p{L}\p{M}\p{N}_.~-]*"


def is_safe_slug(c: Column, nested: bool = True) -> Column:
    shape = rf"\A{_SEGMENT}(?:/{_SEGMENT})*\z" if nested else rf"\A{_SEGMENT}\z"
    return F.coalesce(c.rlike(shape) & (utf16_length(c) <= 200), F.lit(False))


def is_key(c: Column) -> Column:
    return F.coalesce(
        c.rlike(r"\A[\p{L}\p{N}_.:/-]{1,300}\z") & ~c.rlike(r"(?:\A|/)\.{1,2}(?:/|\z)") & (nfc(c) == c), F.lit(False)
    )


def entity_key(prefix: str, c: Column) -> Column:
    """Readable key when valid, else the prefix and a digest."""
    plain = F.concat(F.lit(prefix + ":"), c)
    digest = F.concat(F.lit(prefix + "-sha256:"), F.substring(F.sha2(c.cast("binary"), 256), 1, 40))
    return F.when(is_key(plain), plain).otherwise(digest)


# ------------------------------------------------------------------ addresses with a host

_URL = r"\A([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?\z"
_AUTHORITY = r"\A[^/]*://(?:[^/?#]*@)?"


def url_parts(c: Column) -> Column:
    """struct of an absolute URL split by position; null when there is no scheme and authority."""
    part = lambda shape, group: f"regexp_extract(v, r'{shape}', {group})"
    return apply_sql(c, "v", f"""CASE WHEN v RLIKE r'{_URL}' THEN named_struct(
 'scheme', lower({part(_URL, 1)}), 'host', lower({part(_AUTHORITY + '([^/?#:@]*)', 1)}),
 'port', {part(_AUTHORITY + r'[^/?#:@]*:([0-9]+)(?:[/?#]|\z)', 1)}, 'has_user', contains({part(_URL, 2)}, '@'),
 'path', {part(_URL, 3)}, 'query', {part(_URL, 4)}, 'fragment', {part(_URL, 5)}) END""")


def _is_own_host(host: Column, hosts: Sequence[str] | None, suffix: str | None) -> Column:
    own = F.lit(True)
    if hosts is not None:
        own = host.isin(list(hosts))
    if suffix is not None:
        own = own & host.rlike(suffix)
    return own


def site_path(c: Column, hosts: Sequence[str] | None = None, host_pattern: str | None = None) -> Column:
    """Safe path of an own http(s) URL without a query; null for everything else."""
    return _site_path(c, ("", "80", "443"), hosts, host_pattern)


# an address without anything to decode, to judge or to cut off: a host in small letters without a port, and segments of plain characters
_PLAIN_URL = r"\Ahttps?://([a-z0-9.-]++)((?:/(?!\.{1,2}(?:/|\z))[A-Za-z0-9_.~-]++)++)\z"


def _site_path(c: Column, ports: Sequence[str], hosts: Sequence[str] | None, host_pattern: str | None) -> Column:
    """_judged_site_path; most addresses are plain, and their path is known without the steps that the others take."""
    part = lambda v, group: F.regexp_extract(v, _PLAIN_URL, group)
    plain = lambda v: F.lit("" in ports) & (F.length(v) <= K.MAX_PATH) & v.rlike(_PLAIN_URL)
    return let(c, lambda v: F.when(plain(v), F.when(_is_own_host(part(v, 1), hosts, host_pattern), part(v, 2))).otherwise(_judged_site_path(v, ports, hosts, host_pattern)))


def _judged_site_path(c: Column, ports: Sequence[str], hosts: Sequence[str] | None, host_pattern: str | None) -> Column:
    own = lambda url: (
        url["scheme"].isin("http", "https")
        & ~url["has_user"]
        & url["port"].isin(*ports)
        & url["query"].isin("", "?")
        & _is_own_host(url["host"], hosts, host_pattern)
    )
    return safe_page_path(let(url_parts(c), lambda url: F.when(own(url), F.coalesce(F.nullif(url["path"], F.lit("")), F.lit("/")))))


def plain_own_path(c: Column, hosts: Sequence[str] | None = None, host_pattern: str | None = None) -> Column:
    """Stricter than site_path: no query mark, fragment or port at all."""
    return F.when(~c.rlike(r"[?#]"), _site_path(c, ("",), hosts, host_pattern))


def public_url(c: Column) -> Column:
    """Reportable form of an address: no query, fragment or credentials."""
    return let(
        url_parts(F.trim(c)), lambda url: F.concat(url["scheme"], F.lit("://"), url["host"], url["path"])
    )


@once
def request_identity(c: Column) -> Column:
    """The captured spelling kept beside the decoded key."""
    shape = r"(?i)\Ahttps://[^/?#]+(/[^?#]*)?(\?[^#]*)?(#.*)?\z"
    some = lambda group: F.nullif(F.regexp_extract(c, shape, group), F.lit(""))
    matched = c.rlike(shape)
    return F.struct(
        F.when(matched, F.coalesce(some(1), F.lit("/"))).alias("original_path"),
        F.when(matched, some(2)).alias("query"),
        F.when(matched, some(3)).alias("fragment"),
    )


# ------------------------------------------------------------------ application addresses

def is_app_route(route: Column) -> Column:
    return route.isin(*K.APP_EXACT) | F.split(route, "/")[0].isin(*K.APP_SEGMENTS)


def fixed_section(route: Column) -> Column:
    """Section name shown at a fixed address, or null."""
    table = F.create_map(*[F.lit(item) for pair in K.FIXED_SECTIONS.items() for item in pair])
    return F.try_element_at(table, route)


def section_path(section: Column) -> Column:
    table = F.create_map(*[F.lit(item) for pair in K.SECTION_PATHS.items() for item in pair])
    return F.try_element_at(table, section)


def shadowed_route(route: Column, collection: Column, legacy: Column) -> Column:
    """The application serves something else at this address."""
    own_section = (collection == "pages") & F.coalesce(route_key(legacy) == route, F.lit(False))
    return is_app_route(route) | (fixed_section(route).isNotNull() & ~own_section)


def _quoted(values: Sequence[str]) -> str:
    return ", ".join(f"'{value}'" for value in values)


_PLAIN = rf"v RLIKE r'\A/(?!/)' AND length(v) <= {K.MAX_PATH} AND "
_UNSLASHED = r"regexp_replace(v, r'\A/|/+\z', '')"


def public_seo_path(c: Column) -> Column:
    """Address fit for search engines, decoded; null for application, account and unsafe ones."""
    first = r"regexp_replace(lower(m.segments[0]), r'\.html\z', '')"
    ok = (
        f"NOT m.path IN ({_quoted(K.APP_EXACT)}) AND NOT m.segments[0] IN ({_quoted(K.APP_SEGMENTS)}) "
        r"AND NOT m.requested RLIKE r'[?#%\\\s\p{Z}\x00-\x1F\x7F]' "
        f"AND NOT {first} IN ({_quoted(K.APP_SEGMENTS + K.NON_PUBLIC_SEGMENTS)}) AND NOT startswith(m.path, 'component/user')"
    )
    plain = _PLAIN + r"NOT v RLIKE r'[?#\\\s\p{Z}\x00-\x1F\x7F]'"
    inner = let_sql(f"CASE WHEN {plain} AND v <> '/' THEN {_UNSLASHED} END", "q", _segments("q"))
    return apply_sql(c, "v", f"CASE WHEN v = '/' THEN '/' ELSE {let_sql(inner, 'm', f'CASE WHEN {ok} THEN m.requested END')} END")


def decoded_request(c: Column) -> Column:
    """Decoded address as the resolver looks it up ('/' stays '/'), or null."""
    plain = _PLAIN + r"NOT v RLIKE r'[?#\\\x00-\x1F\x7F]'"
    inner = let_sql(f"CASE WHEN {plain} AND v <> '/' THEN {_UNSLASHED} END", "q", _segments("q"))
    ok = r"NOT m.requested RLIKE r'[?#%\\\x00-\x1F\x7F]'"
    return apply_sql(c, "v", f"CASE WHEN v = '/' THEN '/' ELSE {let_sql(inner, 'm', f'CASE WHEN {ok} THEN m.requested END')} END")


def content_href(c: Column) -> Column:
    """Site link of a content path: leading slash and '.html' added, schemes rejected."""
    ok = r"v <> '' AND NOT v RLIKE r'(?i)\A[a-z][a-z0-9+.-]*:' AND NOT startswith(v, '//') AND NOT contains(v, r'\')"
    named = let_sql(r"concat('/', regexp_replace(v, r'\A/+', ''))", "p", r"CASE WHEN p RLIKE r'(?i)(?:/|\.html)\z' THEN p ELSE concat(p, '.html') END")
    return apply_sql(F.trim(c), "v", f"CASE WHEN {ok} THEN {named} END")


def canonical_path(built: Column, legacy: Column) -> Column:
    """The old address when it is a plain site path, else the built one; no trailing slash."""
    usable = r"v.legacy RLIKE r'\A/(?![/\\])' AND NOT v.legacy RLIKE r'[?#\\\s]'"
    path = f"CASE WHEN {usable} THEN v.legacy ELSE v.built END"
    body = let_sql(path, "p", r"CASE WHEN p = '/' THEN p ELSE nullif(regexp_replace(p, r'/+\z', ''), '') END")
    return apply_sql(F.struct(built.alias("built"), F.trim(legacy).alias("legacy")), "v", body)


@once
def public_canonical(c: Column) -> Column:
    """Keeps only a page number from 2 to 1000 of the query."""
    path = F.split(c, r"\?")[0]
    query = F.when(F.size(F.split(c, r"\?")) == 2, F.split(c, r"\?")[1])
    page = F.regexp_extract(query, r"\Astrona=([1-9][0-9]{0,3})\z", 1)
    safe = public_seo_path(path)
    number = F.when(page != "", page).cast("int")
    return (
        F.when(~c.contains("?"), safe)
        .when(number == 1, safe)
        .when(number <= 1000, F.concat(safe, F.lit("?strona="), page))
    )


def parse_page(c: Column, maximum: int = 1000) -> Column:
    number = F.when(c.rlike(r"\A[0-9]{1,4}\z"), c).cast("int")
    return F.coalesce(F.least(F.greatest(number, F.lit(1)), F.lit(maximum)), F.lit(1))


@once
def search_query(c: Column) -> Column:
    """Trimmed, single spaces; shorter than 2 is no search."""
    text = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x1F\s]+", " "))
    return F.when(F.length(text) >= 2, text).otherwise(F.lit(""))


def with_query(path: Column, params: dict[str, Column]) -> Column:
    """Path with its non-empty parameters; a first page number is dropped."""
    pairs = []
    for name, value in params.items():
        text = value.cast("string")
        keep = (text != "") & ((text.cast("int") > 1) if name == "strona" else F.lit(True))
        pairs.append(F.when(keep, F.concat(F.lit(name + "="), F.url_encode(text))))
    query = F.concat_ws("&", *pairs)
    return F.when(query == "", path).otherwise(F.concat(path, F.lit("?"), query))


def list_canonical(path: Column, kind: Column, page: Column, q: Column, org: Column, view: Column) -> Column:
    """Canonical of a list page: searches and filters point at the plain list."""
    paged = with_query(path, {"strona": parse_page(page)})
    trips = with_query(path, {"widok": F.when(trip_view(view) == "past", F.lit("minione")).when(trip_view(view) == "undated", F.lit("bez-daty")), "strona": parse_page(page)})
    plain = ((kind == "shop") & (search_query(q) != "")) | ((kind == "courses") & (F.coalesce(org, F.lit("")) != ""))
    return F.when(plain, path).when(kind == "trips", trips).otherwise(paged)


def trip_view(c: Column) -> Column:
    return F.when(c == "minione", F.lit("past")).when(c == "bez-daty", F.lit("undated")).otherwise(F.lit("upcoming"))


def legacy_candidates(raw: Column, requested: Column) -> Column:
    """Spellings a stored legacy path may have: decoded and as sent, with and without slashes."""
    encoded = F.concat(F.lit("/"), raw)
    return F.array_distinct(F.array(requested, encoded, F.substr(requested, F.lit(2)), F.substr(encoded, F.lit(2))))


def with_slash(candidates: Column) -> Column:
    slashed = F.transform(F.filter(candidates, lambda item: item.startswith("/")), lambda item: F.concat(item, F.lit("/")))
    return F.array_distinct(F.concat(candidates, slashed))


def path_candidates(path: Column) -> Column:
    return F.array_distinct(
        F.array(path, F.concat(path, F.lit(".html")), F.concat(F.lit("/"), path), F.concat(F.lit("/"), path, F.lit(".html")))
    )


@once
def measurement_path(c: Column) -> Column:
    """Public path only: no query, private area or traversal."""
    ok = c.rlike(r"\A/(?!/)") & (utf16_length(c) <= K.MAX_PATH) & ~c.rlike(r"[\\\x00-\x1F\x7F]")
    path = F.split(F.when(ok, c), "[?#]", 2)[0]
    public = lambda decoded: (
        ~decoded.rlike(r"[?#\\\x00-\x1F\x7F]")
        & ~decoded.rlike(r"(?:\A|/)\.{1,2}(?:/|\z)")
        & ~decoded.rlike(r"(?i)\A/(?:api|admin|_next|media|newsletter|zgloszenie|platnosc-testowa|login|logout|token)(?:/|\.|\z)")
    )
    return F.when(let(percent_decode(path), public), path)


def category_slug(path: Column, navigation: bool = False) -> Column:
    """Category address below the shop root; from the site root only when navigation names it."""
    segment = r"[0-9]+-[\w.~-]+"
    stem = page_stem(path)
    shape = rf"(?U)\A{K.SHOP_ROOT}(?:/{segment})+\z"
    found = stem.rlike(shape)
    if navigation:
        found = found | stem.rlike(rf"(?U)\A{segment}(?:/{segment})*\z")
    return F.when(found, stem)


def page_kind(path: Column) -> Column:
    stem = page_stem(path)
    parts = F.split(stem, "/")
    legal = F.lower(stem).rlike(
        "regulamin|polityka|prywatno|cookies|rodo|reklamacj|zwrot|odst[aą]pien|dostaw|p[lł]atno|warunki-|gwarancj"
    )
    deep = F.size(parts) >= 2
    return (
        F.when(legal, F.lit("legal"))
        .when(deep & parts[0].isin("aktualnosci", "aktualności", "news"), F.lit("news"))
        .when(deep & parts[0].startswith("relacje"), F.lit("report"))
        .otherwise(F.lit("page"))
    )


def media_verdict(src: Column, hosts: Sequence[str] | None = None, host_pattern: str | None = None) -> Column:
    """struct(code, path, url) of an absolute image address: a null code means usable."""
    raw = F.trim(F.coalesce(src, F.lit("")))
    step = F.struct(raw.alias("raw"), url_parts(raw).alias("url"))
    decoded = let(step, lambda s: F.struct(s["raw"].alias("raw"), s["url"].alias("url"), percent_decode(s["url"]["path"]).alias("decoded")))
    named = F.struct(
        decoded["raw"].alias("raw"), decoded["url"].alias("url"), decoded["decoded"].alias("decoded"),
        nfc(F.substr(decoded["decoded"], F.lit(2))).alias("path"),
    )

    def verdict(v: Column) -> Column:
        raw, url, text, path = v["raw"], v["url"], v["decoded"], v["path"]
        default_port = F.when(url["scheme"] == "http", F.lit("80")).otherwise(F.lit("443"))
        asset = F.lower(path).rlike(r"\A(?:" + "|".join(K.ASSET_FOLDERS) + ")") & ~path.rlike(
            r"\A(?:" + "|".join(K.PRODUCT_IMAGE_FOLDERS) + ")"
        )
        return (
            F.when(raw == "", F.lit("media-empty"))
            .when(raw.rlike(r"(?i)\Adata:"), F.lit("media-inline-data"))
            .when(raw.contains("\\") | has_control(raw) | (F.length(raw) > K.MAX_PATH) | url.isNull(), F.lit("media-unsafe"))
            .when(raw.contains("?"), F.lit("media-query"))
            .when(raw.rlike(r"(?i)%(?:2e|2f|5c|00|3f|23)"), F.lit("media-encoded-separator"))
            .when(url["path"].rlike(r"/\.{1,2}(?:/|\z)"), F.lit("media-traversal"))
            .when(~url["scheme"].isin("http", "https"), F.lit("media-scheme"))
            .when(url["has_user"], F.lit("media-userinfo"))
            .when(~_is_own_host(url["host"], hosts, host_pattern), F.lit("media-external-host"))
            .when((url["port"] != "") & (url["port"] != default_port), F.lit("media-port"))
            .when(text.isNull() | (F.length(path) == 0) | text.rlike(r"[\\%]") | has_control(text) | has_invisible(text), F.lit("media-unsafe"))
            .when(text.rlike(r"//|/\.|/\z"), F.lit("media-hidden-or-empty-segment"))
            .when(~text.rlike(r"(?i)\.(?:" + "|".join(K.IMAGE_EXTENSIONS) + r")\z"), F.lit("media-extension"))
            .when(utf16_length(path) > 1024, F.lit("media-unsafe"))
            .when(asset, F.lit("media-template-asset"))
        )

    return let(
        let(named, lambda v: F.struct(verdict(v).alias("code"), v["path"].alias("path"), v["url"].alias("url"))),
        lambda v: F.struct(
            v["code"].alias("code"),
            F.when(v["code"].isNull(), v["path"]).alias("path"),
            F.when(v["code"].isNull(), F.concat(F.lit("https://"), v["url"]["host"], v["url"]["path"])).alias("url"),
        ),
    )


def safe_file_path(c: Column) -> Column:
    """True for a relative path without empty, dot or '.env' segments."""
    parts = F.split(c, "/")
    return (
        ~c.startswith("/")
        & ~c.contains("\\")
        & ~has_control(c)
        & (utf16_length(c) <= 1024)
        & F.forall(parts, lambda part: ~part.isin("", ".", "..") & ~part.startswith(".env"))
    )
