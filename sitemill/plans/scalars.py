"""Column functions over table columns, with decomposed, wide and invisible characters among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sitemill import constants as K
from sitemill.functions import dates as D, documents as DC, hashing as H, money as M, paths as P, text as T, unicode as U
from sitemill.sources.adapters import dealt, table

_DECOMPOSED, _COMPOSED = "cafe\u0301", "caf\u00e9"


def _pick(number: Column, *choices: Column | str) -> Column:
    return F.get(F.array(*(F.lit(c) if isinstance(c, str) else c for c in choices)), (number % len(choices)).cast("int"))


def text_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Normal forms, lengths and plain text of names."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(_pick(F.col("c_custkey"), _DECOMPOSED, "\ufb01sh", "a\u00a0\u2003b", "x\U0001F600y", "\u200bz"), F.lit(" "), F.col("c_name")).alias("t"))
    html = F.concat(F.lit("<p>"), F.col("t"), F.lit("</p><script>no</script> &amp; &lt;b&gt; <br>"), F.col("id").cast("string"))
    return rows.select("id", U.nfc(F.col("t")).alias("nfc"), U.nfkc(F.col("t")).alias("nfkc"), U.utf16_length(F.col("t")).cast("long").alias("units"), T.text_value(F.concat(F.lit(" \t"), F.col("t"))).alias("value"), T.plain_text(html).alias("plain"), U.has_invisible(F.col("t")).alias("invisible"))


def key_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that are fit to be read, and digests of the rest; captured spellings of addresses; routes the application hides."""
    c = F.col("c_custkey")
    key = F.concat(_pick(c, "n", _COMPOSED, _DECOMPOSED, "a b", "a/../b"), F.lit("-"), c.cast("string"))
    request = P.request_identity(F.concat(_pick(c, "https://shop.example.com/a%20", "HTTPS://x.example/", "http://x.example/", "https://x.example?q="), c.cast("string"), _pick(c, "#f", "?x=1#f", "", "")))
    route = _pick(c, "admin", "kontakt", "p-1", "api")
    rows = table(spark, sf, "customer")
    return rows.select(
        c.alias("id"), P.is_key(key).alias("is_key"), P.entity_key("k", key).alias("entity_key"), request["original_path"].alias("path"), request["query"].alias("query"), request["fragment"].alias("fragment"),
        P.trip_view(_pick(c, "minione", "bez-daty", "other")).alias("view"), P.public_canonical(F.concat(F.lit("/lista"), _pick(c, "", "?strona=1", "?strona=7", "?strona=2000", "?q=x"))).alias("canonical"),
        P.shadowed_route(route, F.lit("pages"), F.concat(F.lit("/"), route)).alias("shadowed"),
    )


def money_forms(spark: SparkSession, sf: str) -> DataFrame:
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    cents = F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, k).otherwise(-k - 1).cast("long")
    variants = F.transform(F.sequence(F.lit(1), (k % 4).cast("int") + 1), lambda n: F.struct(F.when((k + n) % 3 > 0, (k * 10 + n).cast("long")).alias("price_cents")))
    some = F.when(k % 4 > 0, variants).otherwise(F.slice(variants, 1, 0))
    base = F.round(price * 100).cast("long")
    span = M.price_span(base, F.when(k % 5 == 0, base - 1), some)
    return table(spark, sf, "part").select(
        k.alias("id"), M.cents_of(cents, price).alias("cents"), M.legacy_cents(F.when(k % 7 == 0, -price).otherwise(price)).alias("legacy"), span["min"].alias("low"), span["max"].alias("high"),
        M.clamp_qty(k % 150 - 5, F.when(k % 2 == 0, k % 40)).alias("qty"),
    )


def date_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Printed times read back, and times printed."""
    ts = F.col("ts").cast("timestamp_ntz")
    weekdays = F.array(*(F.lit(d) for d in ("Poniedziałek", "Wtorek", "Środa", "Czwartek", "Piątek", "Sobota", "Niedziela")))
    printed = F.concat(F.element_at(weekdays, F.weekday(ts) + 1), F.lit(", "), F.dayofmonth(ts).cast("string"), F.lit(". styczeń "), F.year(ts).cast("string"))
    # columns of one step are computed once for all that the next one makes of them
    e = dealt(table(spark, sf, "events").select("event_id", "ts"), "event_id").select("event_id", "ts", printed.alias("day"), F.date_format(ts, "HH:mm").alias("clock"))
    day, clock = F.col("day"), F.col("clock")
    text = _pick(F.col("event_id"), F.concat(day, F.lit(", "), clock), F.concat(day, F.lit(", "), clock, F.lit(" - 23:59")), F.concat(F.lit("Od "), day, F.lit(" - "), clock, F.lit("\nDo "), day, F.lit(" - 23:59")), day, F.concat(day, F.lit(", "), clock, F.lit(" - 00:00")))
    said = F.concat(F.lit("Kurs. Najbliższy kurs rozpoczyna się: "), F.date_format(ts, "yyyy-MM-dd"), F.lit(" o godz. "), clock, _pick(F.col("event_id"), ".", " Najbliższy kurs rozpoczyna się: jutro", ":00"))
    rows = e.select("event_id", D.event_dates(text).alias("read"), D.format_datetime(ts).alias("shown"), D.course_next_date(said).alias("said"))
    return rows.select("event_id", "read.starts_at", "read.ends_at", "read.code", "shown", F.col("said.starts_at").alias("course"), F.col("said.reason").alias("reason"))


def contact_forms(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    digits = F.lpad(c.cast("string"), 9, "5")
    phone = F.concat(_pick(c, "+48 ", "", "tel. ", "+49-30-"), digits, _pick(c, "", " lub 22 826 47 73", "; +1 (555) 000-1111"))
    mail = F.concat(_pick(c, " A.B", "x y", "ok"), c.cast("string"), F.lit("@Example.COM"), _pick(c, " ", "", "@b"))
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), (c % 60 + 1).cast("int")), lambda n: F.concat(F.lit("wo,"), n.cast("string"))))
    return table(spark, sf, "customer").select(
        c.alias("id"), F.concat_ws("|", F.transform(T.phone_parts(phone), lambda p: F.concat(p["text"], F.lit("="), F.coalesce(p["href"], F.lit("-"))))).alias("phones"), T.tel_href(phone).alias("tel"),
        T.valid_email(mail).alias("mail"), T.excerpt(words, 100).alias("excerpt"),
    )


def digest_forms(spark: SparkSession, sf: str) -> DataFrame:
    n = F.when(F.col("c_custkey") % 3 > 0, F.col("c_name"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), H.stable_hash(F.col("c_custkey").alias("k"), n.alias("name")).alias("stable"), H.fnv1a32(F.concat(F.col("c_name"), F.lit("é"))).alias("fnv"), H.file_digest(F.encode("c_name", "utf-8")).alias("file"))


def consent_forms(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    raw = _pick(c, '{"v":1,"analytics":true}', '{"v":1,"analytics":false}', '{"v":2,"analytics":true}', '{"v":1,"analytics":"true"}', "x", '{"v":1}')
    quote = F.concat(F.lit('{"items":[{"product":'), _pick(c, c.cast("string"), '"x"'), F.lit(',"name":"n","qty":1,"unitPriceCents":5,"lineTotalCents":5}],"subtotalCents":5,"deliveryCents":0,"totalCents":'), c.cast("string"), F.lit(',"currency":"PLN","deliveryMethod":"m","deliveryMethods":[]}'))
    read, q = DC.parse_consent(raw), DC.parse_quote(quote)
    return table(spark, sf, "customer").select(c.alias("id"), read["decided"].alias("decided"), read["analytics"].alias("analytics"), q["totalCents"].alias("total"), F.get(q["items"], F.lit(0))["product"].alias("product"))


QUERIES = {query.__name__: query for query in (text_forms, key_forms, money_forms, date_forms, contact_forms, digest_forms, consent_forms)}

_HIDDEN = " OR ".join(f"route = '{r}'" for r in ("admin", "kontakt", "p-1", "api") if r in K.APP_EXACT or r in K.APP_SEGMENTS) or "false"
_MONTH = K.MONTHS_GENITIVE[0]

ORACLES = {
    "text_forms": """WITH t AS (SELECT c_custkey AS id, concat(['cafe' || chr(769), chr(64257) || 'sh', 'a' || chr(160) || chr(8195) || 'b', 'x😀y', chr(8203) || 'z'][c_custkey % 5 + 1], ' ', c_name) AS t FROM customer)
 SELECT id, CASE WHEN id % 5 = 0 THEN replace(t, 'e' || chr(769), 'é') ELSE t END AS nfc, CASE id % 5 WHEN 0 THEN replace(t, 'e' || chr(769), 'é') WHEN 1 THEN replace(t, chr(64257), 'fi') WHEN 2 THEN replace(replace(t, chr(160), ' '), chr(8195), ' ') ELSE t END AS nfkc,
 CAST(length(t) + CASE WHEN id % 5 = 3 THEN 1 ELSE 0 END AS BIGINT) AS units, CASE WHEN id % 5 = 2 THEN replace(t, chr(160) || chr(8195), ' ') ELSE t END AS value,
 concat(CASE WHEN id % 5 = 2 THEN replace(t, chr(160) || chr(8195), ' ') ELSE t END, ' & <b> ', id) AS plain, id % 5 = 4 AS invisible FROM t""",
    "key_forms": f"""WITH t AS (SELECT c_custkey AS id, concat(['n', 'café', 'cafe' || chr(769), 'a b', 'a/../b'][c_custkey % 5 + 1], '-', c_custkey) AS k, ['admin', 'kontakt', 'p-1', 'api'][c_custkey % 4 + 1] AS route FROM customer)
 SELECT id, id % 5 < 2 AS is_key, CASE WHEN id % 5 < 2 THEN concat('k:', k) ELSE concat('k-sha256:', substring(sha256(k), 1, 40)) END AS entity_key,
 CASE id % 4 WHEN 0 THEN concat('/a%20', id) WHEN 1 THEN concat('/', id) WHEN 3 THEN '/' END AS path, CASE id % 4 WHEN 1 THEN '?x=1' WHEN 3 THEN concat('?q=', id) END AS query, CASE WHEN id % 4 < 2 THEN '#f' END AS fragment,
 ['past', 'undated', 'upcoming'][id % 3 + 1] AS view, CASE WHEN id % 5 < 2 THEN '/lista' WHEN id % 5 = 2 THEN '/lista?strona=7' END AS canonical, ({_HIDDEN}) AS shadowed FROM t""",
    "money_forms": """WITH p AS (SELECT p_partkey AS k, CAST(round(p_retailprice * 100) AS BIGINT) AS base FROM part),
 v AS (SELECT k, base, CASE WHEN k % 5 = 0 THEN base - 1 END AS sale, CASE WHEN k % 4 > 0 THEN list_transform(range(1, k % 4 + 2), lambda n: CASE WHEN (k + n) % 3 > 0 THEN k * 10 + n END) ELSE [] END AS own FROM p),
 w AS (SELECT k, base, CASE WHEN sale > 0 AND sale < base THEN sale ELSE base END AS plain, own FROM v),
 x AS (SELECT k, base, list_filter(CASE WHEN len(own) > 0 THEN list_transform(own, lambda o: CASE WHEN o IS NULL THEN plain WHEN o > 0 THEN o END) ELSE [plain] END, lambda z: z IS NOT NULL) AS z FROM w)
 SELECT k AS id, CASE k % 3 WHEN 1 THEN k ELSE base END AS cents, CASE WHEN k % 7 > 0 THEN base END AS legacy, CAST(list_min(z) AS BIGINT) AS low, CAST(list_max(z) AS BIGINT) AS high,
 greatest(1, least(k % 150 - 5, CASE WHEN k % 2 = 0 THEN k % 40 ELSE 99 END, 99)) AS qty FROM x""",
    "date_forms": f"""WITH e AS (SELECT event_id, ts, event_id % 5 AS f, date_trunc('minute', ts) AS m, date_trunc('day', ts) + INTERVAL 23 HOUR + INTERVAL 59 MINUTE AS late FROM events),
 r AS (SELECT *, CASE WHEN f = 3 THEN 'event-date-missing-time' WHEN f = 4 AND strftime(ts, '%H:%M') <> '00:00' THEN 'event-date-end-before-start' END AS code FROM e)
 SELECT event_id, CASE WHEN code IS NULL THEN m - INTERVAL 1 HOUR END AS starts_at, CASE WHEN code IS NULL AND f IN (1, 2) THEN late - INTERVAL 1 HOUR WHEN code IS NULL AND f = 4 THEN m - INTERVAL 1 HOUR END AS ends_at, code,
 concat(day(ts + INTERVAL 1 HOUR), ' ', CASE month(ts + INTERVAL 1 HOUR) WHEN 1 THEN '{_MONTH}' ELSE '{K.MONTHS_GENITIVE[1]}' END, ' ', year(ts + INTERVAL 1 HOUR), ', ', strftime(ts + INTERVAL 1 HOUR, '%H:%M')) AS shown,
 CASE WHEN event_id % 3 = 0 THEN m - INTERVAL 1 HOUR END AS course, CASE event_id % 3 WHEN 1 THEN '2 start date mentions' WHEN 2 THEN 'start date is not written as YYYY-MM-DD o godz. HH:MM' END AS reason FROM r""",
    "contact_forms": """WITH c AS (SELECT c_custkey AS id, lpad(CAST(c_custkey AS VARCHAR), 9, '5') AS d FROM customer),
 a AS (SELECT *, concat(['+48 ', '', 'tel. ', '+49-30-'][id % 4 + 1], d) AS one, CASE id % 4 WHEN 0 THEN concat('tel:+48', d) WHEN 1 THEN concat('tel:+48', d) WHEN 3 THEN concat('tel:+4930', d) END AS link FROM c),
 w AS (SELECT id, array_to_string(list_transform(range(1, id % 60 + 2), lambda n: concat('wo,', n)), ' ') AS t FROM c),
 x AS (SELECT id, CASE WHEN length(t) <= 100 THEN t ELSE concat(regexp_replace(left(left(t, 99), length(left(t, 99)) - strpos(reverse(left(t, 99)), ' ')), '[\\s,.;:–-]+$', ''), '…') END AS excerpt FROM w)
 SELECT a.id, concat(one, '=', coalesce(link, '-'), ['', '|22 826 47 73=tel:+48228264773', '|+1 (555) 000-1111=tel:+15550001111'][a.id % 3 + 1]) AS phones, coalesce(link, CASE a.id % 3 WHEN 1 THEN 'tel:+48228264773' WHEN 2 THEN 'tel:+15550001111' END) AS tel,
 CASE a.id % 3 WHEN 0 THEN concat('a.b', a.id, '@example.com') END AS mail, excerpt FROM a JOIN x USING (id)""",
    "digest_forms": """SELECT c_custkey AS id, sha256(concat('{"k":', c_custkey, ',"name":', CASE WHEN c_custkey % 3 > 0 THEN concat('"', c_name, '"') ELSE 'null' END, '}')) AS stable,
 printf('%08x', CAST(list_reduce(list_transform(string_split(c_name || 'é', ''), lambda x: CAST(unicode(x) AS HUGEINT)), lambda h, u: (xor(CAST(h AS BIGINT), CAST(u AS BIGINT))::HUGEINT * 16777619) % 4294967296, CAST(2166136261 AS HUGEINT)) AS BIGINT)) AS fnv, sha256(c_name) AS file FROM customer""",
    "consent_forms": """SELECT c_custkey AS id, c_custkey % 6 < 2 AS decided, c_custkey % 6 = 0 AS analytics, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS total, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS product FROM customer""",
}
