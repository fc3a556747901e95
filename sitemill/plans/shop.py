"""Carts, stock, orders, payments, seats, subscriptions and page views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sitemill.constants import TAIL_EVENTS
from sitemill.functions.paths import measurement_path
from sitemill.operators import commerce as C, validate as V
from sitemill.sources.adapters import table, view, with_views


def _cart(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as cart lines; products with variants are asked for by a variant id that some lack."""
    items = view(spark, sf, "v_order_item")
    has = F.col("product_id") % 3 > 0
    return items.select(
        "order_id", "pos", "product_id",
        F.when(has & (F.col("pos") % 2 == 0), F.concat(F.lit("v"), (F.col("order_id") % 3).cast("string"))).alias("variant_id"),
        F.when(has & (F.col("pos") % 2 == 1), F.concat(F.lit("size "), (F.col("order_id") % 2).cast("string"))).alias("variant"), "qty",
    )


def _priced(spark: SparkSession, sf: str) -> DataFrame:
    # stock counts boxes of fifty, so that part of the carts can be served
    products = view(spark, sf, "v_product").withColumn("stock", F.col("stock") * 50)
    variants = view(spark, sf, "v_variant").withColumn("stock", (F.col("stock") * 50).cast("long"))
    return C.price_lines(_cart(spark, sf), products, variants)


def cart_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return _priced(spark, sf).where("reject is not null").select("order_id", "pos", "reject")


def cart_quote(spark: SparkSession, sf: str) -> DataFrame:
    return C.quote_orders(_priced(spark, sf))


def delivery_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Every order total priced with a delivery and payment pair; methods are the nation keys below ten."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("subtotal_cents"),
        F.concat(F.lit("m-"), (F.col("o_custkey") % 12).cast("string")).alias("method"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("cod")).when(F.col("o_orderkey") % 3 == 1, F.lit("online")).otherwise(F.lit("bank_transfer")).alias("payment"),
    )
    methods = table(spark, sf, "nation").where("n_nationkey < 10").select(
        F.concat(F.lit("m-"), F.col("n_nationkey").cast("string")).alias("method"), (F.col("n_nationkey") * 150).cast("long").alias("price_cents"),
        F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("online"), F.lit("cod"))).otherwise(F.array(F.lit("online"), F.lit("bank_transfer"))).alias("payments"),
    )
    return C.add_delivery(orders, methods, 20_000_000, {"cod": 500})


def quote_line_match(spark: SparkSession, sf: str) -> DataFrame:
    cart = _cart(spark, sf)
    quoted = cart.select("order_id", "product_id", "variant_id", "variant", (F.col("qty") * 100).alias("line_total_cents")).where("order_id % 5 <> 0")
    return C.match_quote_lines(cart, quoted).select("order_id", "pos", "line_total_cents")


def cart_rule_issues(spark: SparkSession, sf: str) -> DataFrame:
    cart = view(spark, sf, "v_order_item").select((F.col("order_id") * 10 + F.col("pos")).alias("key"), F.when(F.col("product_id") % 41 > 0, F.col("product_id")).alias("product_id"), (F.col("qty") * 3).alias("qty"))
    return V.row_rules(cart, V.cart_rules())[1]


def stock_ledger(spark: SparkSession, sf: str) -> DataFrame:
    items = view(spark, sf, "v_order_item")
    dates = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("at"))
    requests = items.join(dates, "order_id").select(
        F.col("product_id").alias("key"), F.trunc(F.col("at").cast("date"), "month").alias("chunk"), "at", (F.col("order_id") * 10 + F.col("pos")).alias("line"), "qty"
    )
    stock = view(spark, sf, "v_product").select(F.col("id").alias("key"), (F.col("stock") * 100).alias("stock"))
    return C.stock_ledger(requests, stock).select("line", "verdict")


def order_reservations(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as units: shops of ten customers each sell twenty goods, some without a known stock, and a few lines lack a quantity."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("at"), F.floor(F.col("o_custkey") / 10).alias("shop"))
    good = F.col("product_id") % 20
    key = lambda g: F.concat_ws(":", F.col("shop").cast("string"), g.cast("string"))
    items = view(spark, sf, "v_order_item").join(orders, "order_id")
    lines = items.select("order_id", key(good).alias("key"), F.trunc(F.col("at").cast("date"), "year").alias("chunk"), "at", F.when((F.col("order_id") * 10 + F.col("pos")) % 97 > 0, F.col("qty")).alias("qty"))
    stock = items.select("shop", good.alias("good")).distinct().select(key(F.col("good")).alias("key"), F.when((F.col("shop") + F.col("good")) % 60 > 0, (F.col("shop") + F.col("good") * 7) % 9 * 60).cast("long").alias("stock"))
    return C.order_reservations(lines, stock)


def stock_corrections(spark: SparkSession, sf: str) -> DataFrame:
    """Compare-and-set commands of every user on one counter; values are small so that many succeed."""
    e = view(spark, sf, "v_event")
    commands = e.select(F.col("state_key").alias("key"), F.col("ts").cast("date").alias("chunk"), F.col("ts").alias("at"), F.col("event_id").alias("id"), (F.col("amount_cents") % 4).alias("expected"), (F.col("event_id") % 4).alias("stock"))
    stock = e.select(F.col("state_key").alias("key")).distinct().withColumn("stock", F.lit(1).cast("long"))
    return C.stock_corrections(commands, stock).select("id", "verdict")


def order_intake(spark: SparkSession, sf: str) -> DataFrame:
    e = view(spark, sf, "v_event")
    return C.order_intake(e.select(F.col("event_key").alias("idempotency_key"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.col("command").alias("fingerprint"))).select("id", "verdict")


def payment_event_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user are notifications for attempts that start every six days."""
    e = view(spark, sf, "v_event").withColumn("attempt", F.concat_ws(":", F.col("state_key").cast("string"), F.floor(F.dayofmonth("ts") / 6).cast("string")))
    events = e.select(
        F.col("event_id").alias("id"), F.col("ts").alias("at"), "event_key", "attempt", F.col("command").alias("digest"),
        F.when(F.col("command").isin("purchase", "click"), F.lit("paid")).otherwise(F.lit("failed")).alias("outcome"), (F.col("amount_cents") % 3).alias("amount_cents"),
    )
    attempts = e.where("event_id % 50 <> 0").groupBy("attempt").agg(F.lit(1).cast("long").alias("amount_cents"), (F.min("ts") + F.expr("interval 3 days")).alias("expires_at"))
    return C.payment_verdicts(events, attempts)


def order_status_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user and ten-day span are the commands on one order."""
    e = view(spark, sf, "v_event")
    order_id = F.concat_ws(":", F.col("state_key").cast("string"), F.floor(F.dayofmonth("ts") / 3).cast("string"))
    method = F.when(F.col("state_key") % 3 == 0, F.lit("cod")).when(F.col("state_key") % 3 == 1, F.lit("online")).otherwise(F.lit("bank_transfer"))
    command = (
        F.when(F.col("command") == "view", F.lit("shipped")).when(F.col("command") == "purchase", F.lit("paid-event")).when(F.col("command") == "click", F.lit("bank-paid"))
        .when(F.col("command") == "signup", F.lit("cod-collected")).otherwise(F.lit("cancelled"))
    )
    return C.order_status_replay(e.select(order_id.alias("order_id"), F.col("ts").alias("at"), F.col("event_id").alias("id"), method.alias("method"), command.alias("command")))


def expired_orders(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", F.lit("pending")).otherwise(F.lit("paid")).alias("payment_status"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("shipped")).otherwise(F.lit("new")).alias("status"), (F.col("o_orderdate") + F.expr("interval 30 minutes")).alias("expires_at"),
    )
    return C.expired_orders(orders, F.lit("1997-01-01").cast("timestamp_ntz")).select("id", "expires_at")


def expired_seats(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where("event_type = 'signup'")
    rows = e.select(
        F.col("event_id").alias("id"), F.when(F.col("event_id") % 4 == 0, F.lit("enrolled")).otherwise(F.lit("new")).alias("status"), F.when(F.col("event_id") % 6 == 0, F.lit(True)).alias("released"),
        F.when(F.col("event_id") % 5 == 0, F.col("ts")).alias("confirmed_at"), (F.col("ts") + F.expr("interval 30 minutes")).alias("expires_at"),
    )
    return C.expired_seats(rows, F.lit("2024-01-20").cast("timestamp_ntz")).select("id")


def seat_ledger(spark: SparkSession, sf: str) -> DataFrame:
    e = view(spark, sf, "v_event")
    signups = e.select((F.col("state_key") % 40).alias("session_id"), F.col("ts").cast("date").alias("chunk"), F.col("ts").alias("at"), F.col("event_id").alias("id"), (F.col("event_id") % 90).alias("person"))
    sessions = e.select((F.col("state_key") % 40).alias("session_id")).distinct().select("session_id", F.when(F.col("session_id") % 7 > 0, F.col("session_id") % 30).alias("capacity"), (F.col("session_id") % 3).alias("reserved"))
    return C.seat_ledger(signups, sessions)


def newsletter_state(spark: SparkSession, sf: str) -> DataFrame:
    e = view(spark, sf, "v_event")
    command = F.when(F.col("event_id") % 9 == 0, F.lit("unsubscribe")).when(F.col("command").isin("view", "click"), F.lit("subscribe")).when(F.col("event_id") % 5 == 0, F.lit("confirm"))
    rows = e.select((F.col("event_id") % 1700).alias("address"), F.col("ts").alias("at"), F.col("event_id").alias("id"), command.alias("command")).where("command is not null")
    return C.newsletter_states(rows)


def page_views_clean(spark: SparkSession, sf: str) -> DataFrame:
    e = view(spark, sf, "v_event")
    path = F.when(F.col("command") == "error", F.lit("/api/x")).otherwise(F.concat(F.lit("/"), F.col("command"), F.lit("/"), (F.col("event_id") % 2).cast("string"), F.lit("?q=1")))
    rows = e.where("state_key % 4 <> 0").select(F.col("state_key").alias("visitor"), F.col("ts").cast("date").alias("chunk"), F.col("ts").alias("at"), F.col("event_id").alias("id"), measurement_path(path).alias("path"))
    return C.clean_page_views(rows.where("path is not null"), tail=TAIL_EVENTS).select("visitor", "id", "path")


QUERIES = {
    query.__name__: query
    for query in (
        cart_rejects, cart_quote, delivery_totals, quote_line_match, cart_rule_issues, stock_ledger, order_reservations, stock_corrections, order_intake, payment_event_verdicts,
        order_status_replay, expired_orders, expired_seats, seat_ledger, newsletter_state, page_views_clean,
    )
}

_PRICED = f"""{with_views('v_product', 'v_variant', 'v_order_item')},
cart AS (SELECT order_id, pos, product_id, CASE WHEN product_id % 3 > 0 AND pos % 2 = 0 THEN concat('v', CAST(order_id % 3 AS VARCHAR)) END AS variant_id, CASE WHEN product_id % 3 > 0 AND pos % 2 = 1 THEN concat('size ', CAST(order_id % 2 AS VARCHAR)) END AS variant, qty FROM v_order_item),
j AS (SELECT c.*, p.id AS found, p.price_cents AS pp, p.sale_price_cents AS ps, p.stock * 50 AS pst, c.product_id % 3 > 0 AS many, v.variant_id AS vid, v.stock * 50 AS vst, v.price_cents AS vp
 FROM cart c LEFT JOIN (SELECT * FROM v_product WHERE published) p ON p.id = c.product_id LEFT JOIN v_variant v ON v.product_id = c.product_id AND (v.variant_id = c.variant_id OR (c.variant_id IS NULL AND v.label = c.variant))),
u AS (SELECT *, CASE WHEN many THEN vst ELSE pst END AS st, coalesce(CASE WHEN many THEN vp END, CASE WHEN ps > 0 AND ps < pp THEN ps ELSE pp END) AS unit FROM j),
pr AS (SELECT *, CASE WHEN qty NOT BETWEEN 1 AND 99 THEN 'quantity-out-of-range' WHEN found IS NULL THEN 'product-unavailable' WHEN many AND vid IS NULL THEN 'variant-not-matched'
 WHEN st IS NULL OR st < qty THEN 'stock-insufficient' WHEN unit = 0 THEN 'price-unconfirmed' END AS reject FROM u)"""
_EV = with_views("v_event")
_MOVE = "CASE " + " ".join(
    f"WHEN method = '{m}' AND s.state = '{b}' AND command = '{c}' THEN '{a}'" for m, moves in C.ORDER_MOVES.items() for (b, c), a in moves.items()
) + " ELSE s.state END"

ORACLES = {
    "cart_rejects": f"{_PRICED} SELECT order_id, pos, reject FROM pr WHERE reject IS NOT NULL",
    "cart_quote": f"""{_PRICED}, m AS (SELECT order_id, product_id, vid, sum(qty) AS q, min(unit) AS unit, min(st) AS st FROM pr WHERE reject IS NULL GROUP BY ALL),
 l AS (SELECT order_id, count(*) AS lines, CAST(sum(q * unit) AS BIGINT) AS subtotal_cents, bool_or(q > 99) AS large, bool_or(st < q) AS short FROM m GROUP BY 1), b AS (SELECT order_id, bool_or(reject IS NOT NULL) AS bad, count(*) AS n FROM pr GROUP BY 1),
 c AS (SELECT order_id, lines, subtotal_cents, CASE WHEN bad THEN 'line-rejected' WHEN n > 50 THEN 'too-many-lines' WHEN large THEN 'quantity-out-of-range' WHEN short THEN 'stock-insufficient' WHEN subtotal_cents > 100000000 THEN 'total-too-large' END AS reject FROM b LEFT JOIN l USING (order_id))
 SELECT order_id, CASE WHEN reject IS NULL THEN lines END AS lines, CASE WHEN reject IS NULL THEN subtotal_cents END AS subtotal_cents, reject FROM c""",
    "delivery_totals": """WITH o AS (SELECT o_orderkey AS order_id, CAST(round(o_totalprice * 100) AS BIGINT) AS subtotal_cents, o_custkey % 12 AS m, CASE o_orderkey % 3 WHEN 0 THEN 'cod' WHEN 1 THEN 'online' ELSE 'bank_transfer' END AS payment FROM orders),
 r AS (SELECT *, CASE WHEN m >= 10 THEN 'delivery-unknown' WHEN payment = 'cod' AND m % 2 = 1 OR payment = 'bank_transfer' AND m % 2 = 0 THEN 'payment-not-offered' END AS reject, CASE WHEN subtotal_cents >= 20000000 THEN 0 ELSE m * 150 END AS d, CASE WHEN payment = 'cod' THEN 500 ELSE 0 END AS x FROM o)
 SELECT order_id, concat('m-', CAST(m AS VARCHAR)) AS method, payment, subtotal_cents, CASE WHEN reject IS NULL THEN d END AS delivery_cents, CAST(CASE WHEN reject IS NULL THEN x END AS BIGINT) AS surcharge_cents, CASE WHEN reject IS NULL THEN subtotal_cents + d + x END AS total_cents, reject FROM r""",
    "quote_line_match": f"""{with_views('v_order_item')}, cart AS (SELECT order_id, pos, product_id, qty, CASE WHEN product_id % 3 > 0 AND pos % 2 = 0 THEN concat('id:v', CAST(order_id % 3 AS VARCHAR)) WHEN product_id % 3 > 0 THEN concat('label:size ', CAST(order_id % 2 AS VARCHAR)) ELSE 'label:' END AS k FROM v_order_item),
 q AS (SELECT order_id, product_id, k, min(qty * 100) AS line_total_cents FROM cart WHERE order_id % 5 <> 0 GROUP BY ALL) SELECT order_id, pos, line_total_cents FROM cart LEFT JOIN q USING (order_id, product_id, k)""",
    "cart_rule_issues": """SELECT l_orderkey * 10 + l_linenumber AS key, 'product_id' AS field, 'product-id-invalid' AS code FROM lineitem WHERE l_partkey % 41 = 0 OR l_partkey < 1
 UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'qty', 'quantity-out-of-range' FROM lineitem WHERE CAST(l_quantity AS BIGINT) * 3 NOT BETWEEN 1 AND 99""",
    "stock_ledger": f"""{with_views('v_product', 'v_order_item')}, q AS (SELECT product_id AS k, order_id * 10 + pos AS line, qty, row_number() OVER (PARTITION BY product_id ORDER BY o_orderdate, order_id * 10 + pos) AS n FROM v_order_item JOIN orders ON o_orderkey = order_id),
 w AS (SELECT id AS k, stock * 100 AS rest, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS line, '' AS verdict FROM v_product
  UNION ALL SELECT w.k, CASE WHEN q.qty <= rest THEN rest - q.qty ELSE rest END, q.n, q.line, CASE WHEN rest IS NULL THEN 'review' WHEN q.qty <= rest THEN 'reserved' ELSE 'rejected' END FROM w JOIN q ON q.k = w.k AND q.n = w.n + 1)
 SELECT line, verdict FROM w WHERE line IS NOT NULL""",
    "order_reservations": f"""{with_views('v_order_item')}, i AS (SELECT order_id, o_orderdate AS moment, o_custkey // 10 AS shop, product_id % 20 AS good, CASE WHEN (order_id * 10 + pos) % 97 > 0 THEN qty END AS qty FROM v_order_item JOIN orders ON o_orderkey = order_id),
 g AS (SELECT order_id, moment, shop, good, sum(qty) AS need, bool_or(qty IS NULL OR (shop + good) % 60 = 0) AS wrong FROM i GROUP BY ALL),
 o AS (SELECT order_id, shop, bool_or(wrong) AS wrong, list(struct_pack(good := good, need := CAST(need AS BIGINT))) AS lines, row_number() OVER (PARTITION BY shop ORDER BY moment, order_id) AS n FROM g GROUP BY order_id, shop, moment),
 w AS (SELECT shop, CAST(0 AS BIGINT) AS n, list_transform(range(20), lambda k: CAST((shop + k * 7) % 9 * 60 AS BIGINT)) AS rest, CAST(NULL AS BIGINT) AS order_id, '' AS verdict FROM (SELECT DISTINCT shop FROM o)
  UNION ALL SELECT w.shop, o.n, CASE WHEN NOT o.wrong AND NOT list_contains(list_transform(o.lines, lambda l: l.need > w.rest[l.good + 1]), true)
    THEN list_transform(range(20), lambda k: w.rest[k + 1] - coalesce(list_sum(list_transform(list_filter(o.lines, lambda l: l.good = k), lambda l: l.need)), 0)::BIGINT) ELSE w.rest END, o.order_id,
   CASE WHEN o.wrong THEN 'review' WHEN list_contains(list_transform(o.lines, lambda l: l.need > w.rest[l.good + 1]), true) THEN 'rejected' ELSE 'reserved' END FROM w JOIN o ON o.shop = w.shop AND o.n = w.n + 1)
 SELECT order_id, verdict FROM w WHERE order_id IS NOT NULL""",
    "stock_corrections": f"""{_EV}, c AS (SELECT state_key AS k, event_id AS id, amount_cents % 4 AS e, event_id % 4 AS v, row_number() OVER (PARTITION BY state_key ORDER BY ts, event_id) AS n FROM v_event),
 w AS (SELECT DISTINCT k, CAST(1 AS BIGINT) AS cur, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, false AS ok FROM c UNION ALL SELECT w.k, CASE WHEN c.e = cur THEN c.v ELSE cur END, c.n, c.id, c.e = cur FROM w JOIN c ON c.k = w.k AND c.n = w.n + 1)
 SELECT id, CASE WHEN ok THEN 'accepted' ELSE 'stale' END AS verdict FROM w WHERE id IS NOT NULL""",
    "order_intake": f"""{_EV}, f AS (SELECT *, first_value(event_id) OVER (PARTITION BY event_key ORDER BY ts, event_id) AS fid, first_value(command) OVER (PARTITION BY event_key ORDER BY ts, event_id) AS fp FROM v_event)
 SELECT event_id AS id, CASE WHEN event_id = fid THEN 'created' WHEN command = fp THEN 'duplicate' ELSE 'conflict' END AS verdict FROM f""",
    "payment_event_verdicts": f"""{_EV}, e AS (SELECT event_id AS id, ts, event_key, concat(CAST(state_key AS VARCHAR), ':', CAST(day(ts) // 6 AS VARCHAR)) AS a, command AS digest, CASE WHEN command IN ('purchase', 'click') THEN 'paid' ELSE 'failed' END AS outcome, amount_cents % 3 = 1 AS okamt FROM v_event),
 att AS (SELECT a, min(ts) + INTERVAL 3 DAY AS exp FROM e WHERE id % 50 <> 0 GROUP BY a), k AS (SELECT e.*, exp FROM e JOIN att USING (a)),
 s AS (SELECT event_key, arg_min(id, (ts, id)) AS fid, min(ts) AS fts, arg_min(digest, (ts, id)) AS fd FROM k WHERE okamt GROUP BY 1),
 cl AS (SELECT a, arg_min(k.id, (ts, k.id)) AS cid, min(ts) AS cts, arg_min(outcome, (ts, k.id)) AS co FROM k JOIN s ON s.fid = k.id GROUP BY 1)
 SELECT k.id, CASE WHEN s.fid IS NOT NULL AND (k.ts, k.id) > (s.fts, s.fid) THEN CASE WHEN k.digest = fd THEN 'duplicate' ELSE 'digest-mismatch' END WHEN NOT okamt THEN 'amount-mismatch'
  WHEN k.id = cl.cid AND k.ts < exp THEN 'accepted' WHEN outcome = 'paid' AND NOT coalesce(co = 'paid' AND cts < exp, false) THEN 'terminal-review' ELSE 'terminal-state' END AS verdict
 FROM k LEFT JOIN s USING (event_key) LEFT JOIN cl USING (a) UNION ALL SELECT id, 'unknown-attempt' FROM e WHERE a NOT IN (SELECT a FROM att)""",
    "order_status_replay": f"""{_EV}, c AS (SELECT concat(CAST(state_key AS VARCHAR), ':', CAST(day(ts) // 3 AS VARCHAR)) AS o, event_id AS id, CASE state_key % 3 WHEN 0 THEN 'cod' WHEN 1 THEN 'online' ELSE 'bank_transfer' END AS method,
  CASE command WHEN 'view' THEN 'shipped' WHEN 'purchase' THEN 'paid-event' WHEN 'click' THEN 'bank-paid' WHEN 'signup' THEN 'cod-collected' ELSE 'cancelled' END AS command, ts FROM v_event),
 q AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY ts, id) AS n FROM c),
 s AS (SELECT DISTINCT o, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, '' AS before, 'new' AS state FROM q UNION ALL SELECT s.o, q.n, q.id, s.state, {_MOVE} FROM s JOIN q ON q.o = s.o AND q.n = s.n + 1)
 SELECT o AS order_id, id, before, state AS after FROM s WHERE id IS NOT NULL""",
    "expired_orders": "SELECT o_orderkey AS id, o_orderdate + INTERVAL 30 MINUTE AS expires_at FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 5 <> 0 AND o_orderdate + INTERVAL 30 MINUTE <= TIMESTAMP '1997-01-01'",
    "expired_seats": "SELECT event_id AS id FROM events WHERE event_type = 'signup' AND event_id % 4 <> 0 AND event_id % 6 <> 0 AND event_id % 5 <> 0 AND ts + INTERVAL 30 MINUTE <= TIMESTAMP '2024-01-20'",
    "seat_ledger": f"""{_EV}, g AS (SELECT state_key % 40 AS s, event_id AS id, ts, row_number() OVER (PARTITION BY state_key % 40, event_id % 90 ORDER BY ts, event_id) AS r FROM v_event),
 u AS (SELECT s, id, row_number() OVER (PARTITION BY s ORDER BY ts, id) AS place FROM g WHERE r = 1)
 SELECT id, CASE WHEN s % 7 = 0 OR s % 30 < 1 OR place <= greatest(0, s % 30 - s % 3) THEN 'seated' ELSE 'full' END AS verdict FROM u UNION ALL SELECT id, 'repeat' FROM g WHERE r > 1""",
    "newsletter_state": f"""{_EV}, c AS (SELECT event_id % 1700 AS address, ts, event_id AS id, CASE WHEN event_id % 9 = 0 THEN 'unsubscribe' WHEN command IN ('view', 'click') THEN 'subscribe' WHEN event_id % 5 = 0 THEN 'confirm' END AS cmd FROM v_event),
 q AS (SELECT *, row_number() OVER (PARTITION BY address ORDER BY ts, id) AS n FROM c WHERE cmd IS NOT NULL),
 s AS (SELECT DISTINCT address, CAST(0 AS BIGINT) AS n, 'none' AS st, CAST(NULL AS TIMESTAMP) AS until FROM q UNION ALL
  SELECT s.address, q.n, CASE WHEN cmd = 'unsubscribe' THEN 'unsubscribed' WHEN cmd = 'subscribe' AND st <> 'active' THEN 'pending' WHEN cmd = 'confirm' AND st = 'pending' AND ts < until THEN 'active' ELSE st END,
   CASE WHEN cmd = 'subscribe' AND st <> 'active' AND NOT (st = 'pending' AND until > ts) THEN ts + INTERVAL 24 HOUR ELSE until END FROM s JOIN q ON q.address = s.address AND q.n = s.n + 1)
 SELECT address, arg_max(st, n) AS state FROM s GROUP BY address HAVING arg_max(st, n) <> 'none'""",
    "page_views_clean": f"""{_EV}, p AS (SELECT state_key AS visitor, event_id AS id, ts, concat('/', command, '/', CAST(event_id % 2 AS VARCHAR)) AS path FROM v_event WHERE state_key % 4 <> 0 AND command <> 'error'),
 l AS (SELECT *, lag(path) OVER (PARTITION BY visitor ORDER BY ts, id) AS prev FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY visitor ORDER BY ts DESC, id DESC) AS rn FROM l WHERE prev IS DISTINCT FROM path)
 SELECT visitor, id, path FROM k WHERE rn <= 50""",
}
