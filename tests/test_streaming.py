from __future__ import annotations

import random
import tempfile
from datetime import datetime, timedelta


from sitemill.operators import commerce as C
from sitemill.streaming import desks as D, sinks

T0 = datetime(2026, 1, 1)


def stream(spark, rows, schema, desk, name, delay=None, batches=2):
    """Feeds rows file by file and returns everything the desk emitted."""
    folder = tempfile.mkdtemp(prefix="sitemill-test-")
    size = (len(rows) + batches - 1) // batches
    for number in range(batches):
        part = spark.createDataFrame(rows[number * size : (number + 1) * size], schema)
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = D.run(source, desk, delay).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(180)
    return spark.table(name).collect()


def test_order_intake_agrees_with_batch(spark):
    rng = random.Random(5)
    rows = [(f"k{rng.randrange(4)}", T0 + timedelta(minutes=i), i, rng.choice("ab"), "request") for i in range(30)]
    got = stream(spark, rows, "key string, at timestamp, id long, fingerprint string, command string", D.OrderIntake(), "intake")
    batch = spark.createDataFrame(rows, "idempotency_key string, at timestamp, id long, fingerprint string, command string")
    assert {(r.id, r.verdict) for r in got} == {(r.id, r.verdict) for r in C.order_intake(batch).collect()}


def test_stock_expires_and_releases(spark):
    rows = [
        ("p", T0, 1, "load", None, 3, None, False), ("p", T0 + timedelta(minutes=1), 2, "reserve", "a", 2, None, False), ("p", T0 + timedelta(minutes=2), 3, "reserve", "b", 2, None, False),
        ("p", T0 + timedelta(minutes=3), 4, "release", "a", None, None, False), ("p", T0 + timedelta(minutes=4), 5, "reserve", "c", 3, 60, True), ("p", T0 + timedelta(minutes=5), 6, "ship", "c", None, None, False),
        ("q", T0, 7, "reserve", "d", 1, None, False), ("r", T0, 8, "load", None, 5, None, False), ("r", T0 + timedelta(minutes=1), 9, "reserve", "e", 1, None, False), ("z", T0 + timedelta(days=1), 10, "load", None, 1, None, False),
    ]
    got = stream(spark, rows, "key string, at timestamp, id long, command string, line string, qty long, minutes int, cod boolean", D.StockKeeper(), "stock", "1 minute")
    # the shipped cash-on-delivery line c never expires, the unpaid line e does
    assert {(r.line, r.verdict) for r in got} == {("a", "reserved"), ("b", "rejected"), ("a", "released"), ("c", "reserved"), ("d", "review"), ("e", "reserved"), ("e", "expired")}


def test_payment_desk(spark):
    base = (None, None, None)
    rows = [
        ("A", T0, 1, "attempt", None, None, None, 5, "raw", 60, "ready", False), ("A", T0 + timedelta(minutes=1), 2, "event", "k1", "d", "paid", 5, "other", None, None, None),
        ("A", T0 + timedelta(minutes=2), 3, "event", "k2", "d", "paid", 5, "raw", None, None, None), ("A", T0 + timedelta(minutes=3), 4, "event", "k2", "d", "paid", 5, "raw", None, None, None),
        ("A", T0 + timedelta(minutes=4), 5, "event", "k2", "e", "paid", 5, "raw", None, None, None), ("B", T0, 6, "attempt", None, None, None, 5, "pending-1", 60, "initializing", False),
        ("B", T0 + timedelta(minutes=1), 7, "event", "k3", "d", "failed", 5, "new", None, None, None), ("B", T0 + timedelta(minutes=2), 8, "event", "k4", "d", "paid", 5, "new", None, None, None),
        ("C", T0, 9, "event", "k5", "d", "paid", 5, None, None, None, None), ("D", T0, 10, "attempt", None, None, None, 5, "r", 30, "ready", False), ("D", T0 + timedelta(minutes=31), 11, "event", "k6", "d", "paid", 5, "r", None, None, None),
        ("D", T0 + timedelta(minutes=32), 12, "event", "k7", "d", "paid", 6, "r", None, None, None),
    ]
    schema = "key string, at timestamp, id long, command string, event_key string, digest string, outcome string, amount_cents long, reference string, minutes int, initialization string, offline boolean"
    got = stream(spark, rows, schema, D.PaymentDesk(), "payments")
    assert {r.id: r.verdict for r in got} == {2: "reference-mismatch", 3: "accepted", 4: "duplicate", 5: "digest-mismatch", 7: "accepted", 8: "terminal-review", 9: "unknown-attempt", 11: "terminal-review", 12: "amount-mismatch"}


def test_order_desk_agrees_with_batch(spark):
    rng = random.Random(6)
    methods = {"o1": "cod", "o2": "online", "o3": "bank_transfer"}
    rows = [(key, T0 + timedelta(minutes=i), i, methods[key], rng.choice(["shipped", "cancelled", "bank-paid", "cod-collected", "paid-event"])) for i in range(40) for key in [rng.choice(list(methods))]]
    got = stream(spark, rows, "key string, at timestamp, id long, method string, command string", D.OrderDesk(), "orders")
    batch = spark.createDataFrame([(k, a.replace(tzinfo=None), i, m, c) for k, a, i, m, c in rows], "order_id string, at timestamp_ntz, id long, method string, command string")
    assert {(r.id, r.before, r.after) for r in got} == {(r.id, r.before, r.after) for r in C.order_status_replay(batch).collect()}


def test_seats(spark):
    m = lambda n: T0 + timedelta(minutes=n)
    rows = [("s", m(0), 1, "open", None, 2), ("s", m(1), 2, "signup", "a", None), ("s", m(2), 3, "signup", "b", None), ("s", m(3), 4, "signup", "c", None), ("s", m(4), 5, "signup", "a", None), ("s", m(5), 6, "confirm", "a", None),
            ("s", m(6), 7, "reject", "a", None), ("s", m(7), 8, "signup", "c", None), ("s", m(8), 9, "enrol", "a", None), ("s", m(9), 10, "confirm", "c", None), ("t", m(3000), 11, "open", None, 1)]
    got = stream(spark, rows, "key string, at timestamp, id long, command string, person string, capacity long", D.SeatKeeper(), "seats", "1 minute")
    assert {(r.id, r.person, r.verdict) for r in got} == {(2, "a", "seated"), (3, "b", "seated"), (4, "c", "full"), (5, "a", "repeat"), (6, "a", "confirmed"), (7, "a", "rejected"), (8, "c", "seated"), (9, "a", "full"), (10, "c", "confirmed"), (None, "b", "expired")}


def test_subscriptions_agree_with_batch(spark):
    rng = random.Random(8)
    rows = [(f"p{rng.randrange(5)}", T0 + timedelta(hours=7 * i + rng.randrange(5)), i, rng.choice(["subscribe", "confirm", "unsubscribe", "subscribe"])) for i in range(60)]
    got = stream(spark, rows, "key string, at timestamp, id long, command string", D.Subscriptions(), "subs")
    last = {r.key: r.verdict for r in sorted(got, key=lambda r: r.id)}
    batch = spark.createDataFrame([(k, a.replace(tzinfo=None), i, c) for k, a, i, c in rows], "address string, at timestamp_ntz, id long, command string")
    assert {r.address: r.state for r in C.newsletter_states(batch).collect()} == {k: v for k, v in last.items() if v != "unknown"}


def test_corrections_and_views(spark):
    rows = [("p", T0 + timedelta(minutes=i), i, c, e, s) for i, (c, e, s) in enumerate([("load", None, 5), ("set", 5, 7), ("set", 5, 8), ("set", 7, -1), ("set", 7, 0)])]
    got = stream(spark, rows, "key string, at timestamp, id long, command string, expected long, stock long", D.InventoryDesk(), "corrections")
    assert {(r.id, r.verdict, r.before, r.after) for r in got} == {(0, "loaded", None, 5), (1, "accepted", 5, 7), (2, "stale", 7, 7), (3, "invalid", 7, 7), (4, "accepted", 7, 0)}
    rows = [("v", T0 + timedelta(minutes=i), i, c, p) for i, (c, p) in enumerate([("view", "/a"), ("consent", None), ("view", "/a"), ("view", "/a"), ("view", None), ("view", "/b"), ("revoke", None), ("view", "/c"), ("consent", None), ("view", "/b")])]
    got = stream(spark, rows, "key string, at timestamp, id long, command string, path string", D.PageViews(), "views")
    assert [(r.id, r.path) for r in sorted(got, key=lambda r: r.id)] == [(2, "/a"), (5, "/b"), (9, "/b")]


def test_outbox_is_written_once(spark):
    folder = tempfile.mkdtemp(prefix="sitemill-test-")
    write = sinks.append_once(f"{folder}/out", "dedup_key")
    batch = lambda keys: spark.createDataFrame([(k, k) for k in keys], "dedup_key string, body string")
    write(batch(["a", "b", "a"]), 0)
    write(batch(["b", "c"]), 1)
    write(batch(["b", "c"]), 1)
    assert sorted(r.dedup_key for r in spark.read.parquet(f"{folder}/out").collect()) == ["a", "b", "c"]
    verdicts = spark.createDataFrame([(1, "reserved"), (1, "rejected"), (2, "reserved")], "order_id int, verdict string")
    assert {(r.order_id, r.verdict) for r in D.order_verdicts(verdicts).collect()} == {(1, "rejected"), (2, "reserved")}


def whole_orders(lines, stock):
    """Orders one after another, each taking all it needs or nothing."""
    left, out = dict(stock), {}
    for at, order in sorted({(r[3], r[0]) for r in lines}):
        need, wrong = {}, False
        for o, key, _, _, qty in lines:
            if o == order:
                wrong |= qty is None or qty < 1 or left.get(key) is None
                need[key] = need.get(key, 0) + (qty or 0)
        out[order] = "review" if wrong else "rejected" if any(left[k] < q for k, q in need.items()) else "reserved"
        if out[order] == "reserved":
            left |= {k: left[k] - q for k, q in need.items()}
    return out


def order_lines(rng, orders, goods):
    stock = {f"g{k}": rng.choice([None, 0, 5, 20, 60]) for k in range(goods)}
    lines = []
    for n in range(orders):
        at = T0 + timedelta(minutes=rng.randrange(orders // 2))
        for _ in range(rng.choice([1, 2, 3])):
            lines.append((f"o{n:03}", f"g{rng.randrange(goods)}", at.date(), at, rng.choice([1, 2, 3, 9, None] if n % 7 == 0 else [1, 2, 3, 9])))
    return lines, stock


def test_whole_orders_over_tables(spark):
    for seed in range(3):
        lines, stock = order_lines(random.Random(seed), 80, 6)
        rng = random.Random(seed)
        want = whole_orders(lines, stock)
        rng.shuffle(lines)
        got = C.order_reservations(spark.createDataFrame(lines, "order_id string, key string, chunk date, at timestamp, qty long"), spark.createDataFrame(list(stock.items()), "key string, stock long"))
        assert {r.order_id: r.verdict for r in got.collect()} == want and {"reserved", "rejected", "review"} <= set(want.values())
    empty = spark.createDataFrame([], "order_id string, key string, chunk date, at timestamp, qty long")
    assert C.order_reservations(empty, spark.createDataFrame([("a", 1)], "key string, stock long")).count() == 0


def test_whole_orders_store_a_round_once(spark, monkeypatch, tmp_path):
    """A round stores its lines once, and the verdicts are made of stored rows: the lines are not made again for them."""
    stored, cut = [], C.cut_lineage
    monkeypatch.setattr(C, "cut_lineage", lambda df: stored.append(df.columns) or cut(df))
    lines, stock = order_lines(random.Random(1), 80, 6)
    spark.createDataFrame(lines, "order_id string, key string, chunk date, at timestamp, qty long").write.parquet(f"{tmp_path}/lines")
    got = C.order_reservations(spark.read.parquet(f"{tmp_path}/lines"), spark.createDataFrame(list(stock.items()), "key string, stock long"))
    assert {r.order_id: r.verdict for r in got.collect()} == whole_orders(lines, stock)
    rounds = [columns for columns in stored if "served" in columns and "refused" in columns]
    assert len(rounds) > 1 and len(stored) == len(rounds) + 2
    assert got.inputFiles() and not [file for file in got.inputFiles() if str(tmp_path) in file]


def test_whole_orders_of_crowded_keys(spark, monkeypatch):
    """Keys with many lines are summed by chunk, the others as one group, with the same verdicts; undated orders come first."""
    rng = random.Random(5)
    lines, stock = order_lines(rng, 90, 12)
    lines = [(o, key if rng.random() < 0.5 else "g1", at.date() + timedelta(days=int(o[1:]) // 9), at + timedelta(days=int(o[1:]) // 9), qty) for o, key, _, at, qty in lines]
    stock |= {"g1": 150}
    want = whole_orders(lines, stock)
    counts = {key: sum(line[1] == key for line in lines) for key in stock}
    table, shelf = (spark.createDataFrame(lines, "order_id string, key string, chunk date, at timestamp, qty long"), spark.createDataFrame(list(stock.items()), "key string, stock long"))
    for most in (0, sorted(counts.values())[-2]):
        monkeypatch.setattr(C, "CROWDED_LINES", most)
        assert {r.order_id: r.verdict for r in C.order_reservations(table, shelf).collect()} == want and {"reserved", "rejected", "review"} <= set(want.values())
        undated = spark.createDataFrame([("a", "k", T0.date(), T0, 3), ("b", "k", None, None, 3), ("c", "k", T0.date(), T0, 2)], table.schema)
        got = C.order_reservations(undated, spark.createDataFrame([("k", 5)], "key string, stock long"))
        assert {r.order_id: r.verdict for r in got.collect()} == {"a": "rejected", "b": "reserved", "c": "reserved"}


def test_whole_orders_as_streams(spark):
    """Two desks that write for each other come to the verdicts of the table, whatever order the lines arrive in."""
    rng = random.Random(21)
    lines, stock = order_lines(rng, 14, 3)
    want = whole_orders(lines, stock)
    need = {}
    for order, key, _, at, qty in lines:
        old = need.get((order, key))
        need[order, key] = (at, None if qty is None or (old and old[1] is None) else qty + (old[1] if old else 0))
    many = {order: sum(1 for o, _ in need if o == order) for order, _ in need}
    schema = "key string, at timestamp, ms long, id long, command string, order_id string, qty long, lines int, verdict string"
    rows = [(key, T0 - timedelta(minutes=5), None, 0, "load", None, n, None, None) for key, n in stock.items()]
    asked = [(key, at, None, 1, "reserve", order, qty, many[order], None) for (order, key), (at, qty) in need.items()]
    rng.shuffle(asked)
    folder = tempfile.mkdtemp(prefix="sitemill-test-")
    put = lambda rows, name: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
    put(rows + asked, "requests")
    put([("g0", T0 + timedelta(days=1), None, 2, "tick", None, None, None, None)], "requests")  # lets the watermark pass the orders
    put([("none", None, 0, 3, "tick", None, None, None, None)], "told")
    answers = "key string, at timestamp, ms long, id long, command string, product string, verdict string, qty long, lines int, cod boolean"
    spark.createDataFrame([("none", T0, 0, 1, "tick", None, None, None, None, None)], answers).write.parquet(f"{folder}/answers")
    spark.createDataFrame([], "order_id string, verdict string").write.parquet(f"{folder}/verdicts")

    def shelf(batch, number):
        batch.selectExpr("order_id AS key", "at", "ms", "id", "command", "product", "verdict", "qty", "lines", "false AS cod").write.mode("append").parquet(f"{folder}/answers")

    def judge(batch, number):
        batch.where("key IS NOT NULL").selectExpr("key", "at", "ms", "id", "command", "order_id", "qty", "lines", "verdict").write.mode("append").parquet(f"{folder}/told")
        batch.where("command = 'verdict'").select("order_id", "verdict").write.mode("append").parquet(f"{folder}/verdicts")

    def turn(source, desk, sink, name):
        query = D.run(source, desk, "1 minute").writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/state-{name}").trigger(availableNow=True).start()
        query.awaitTermination(120)

    read = lambda name, kind: spark.readStream.schema(kind).parquet(f"{folder}/{name}")
    got = {}
    for _ in range(8):
        turn(read("requests", schema).unionByName(read("told", schema)), D.Shelf(), shelf, "shelf")
        turn(read("answers", answers), D.OrderJudge(minutes=100_000), judge, "judge")
        found = spark.read.parquet(f"{folder}/verdicts").collect()
        assert len(found) == len({r.order_id for r in found})
        got = {r.order_id: r.verdict for r in found}
        if set(got) == set(want):
            break
    assert got == want


def test_a_desk_with_deadlines_needs_a_delay(spark):
    import pytest

    with pytest.raises(ValueError, match="delay"):
        D.run(spark.readStream.format("rate").load(), D.StockKeeper())


def test_a_timer_reads_what_is_due(spark, monkeypatch):
    """Many holds, few due: the expiry looks up the due ones and never goes through all that are held."""
    class Table:
        def __init__(self):
            self.rows, self.read = {}, 0

        def containsKey(self, key):
            return key in self.rows

        def getValue(self, key):
            self.read += 1
            return self.rows[key]

        def updateValue(self, key, value):
            self.rows[key] = value

        def removeKey(self, key):
            del self.rows[key]

        def iterator(self):
            raise AssertionError("all holds were read")

    class Value:
        def __init__(self):
            self.row = None

        def exists(self):
            return self.row is not None

        def get(self):
            return self.row

        def update(self, row):
            self.row = row

    keeper, timers = D.StockKeeper(), []
    keeper.value, keeper.table = {"stock": Value()}, {"held": Table(), "deadlines": Table()}
    monkeypatch.setattr(keeper, "wake", timers.append)
    row = lambda **values: dict({"ms": 0, "id": 0, "qty": 1, "line": None, "minutes": None, "cod": False}, **values)
    list(keeper.step("p", row(command="load", qty=10_000)))
    for k in range(2000):
        assert [r.verdict for r in keeper.step("p", row(command="reserve", line=f"l{k}", minutes=30 if k < 3 else 600))] == ["reserved"]
    assert [r.verdict for r in keeper.step("p", row(command="reserve", line="odd", qty=None))] == ["review"]
    keeper.table["held"].read = 0
    assert sorted(r.line for r in keeper.late("p", min(timers))) == ["l0", "l1", "l2"] and keeper.table["held"].read <= 10
    assert len(timers) == 2


def test_payment_state_shrinks(spark):
    rows = [("A", T0, 1, "attempt", None, None, None, 5, "raw", 10, "ready", False)]
    rows += [("A", T0 + timedelta(minutes=1, seconds=k), 2 + k, "event", f"k{k}", "d", "failed" if k else "paid", 5, "raw", None, None, None) for k in range(20)]
    rows += [("Z", T0 + timedelta(days=1), 90, "attempt", None, None, None, 5, "raw", 10, "ready", False), ("Z", T0 + timedelta(days=1, minutes=1), 91, "close", None, None, None, None, None, None, None, None)]
    rows += [("A", T0 + timedelta(days=2), 100, "event", "k0", "d", "paid", 5, "raw", None, None, None), ("A", T0 + timedelta(days=2), 101, "event", "k7", "d", "failed", 5, "raw", None, None, None), ("A", T0 + timedelta(days=2), 102, "event", "new", "d", "paid", 5, "raw", None, None, None)]
    schema = "key string, at timestamp, id long, command string, event_key string, digest string, outcome string, amount_cents long, reference string, minutes int, initialization string, offline boolean"
    got = {r.id: r.verdict for r in stream(spark, rows, schema, D.PaymentDesk(keep_minutes=60), "payments_ttl", "1 minute", batches=len(rows))}
    assert got[2] == "accepted" and got[100] == "duplicate"  # the deciding event is known for good
    assert got[101] == "terminal-state" and got[102] == "terminal-state"


def test_stream_writes_once(spark):
    folder = tempfile.mkdtemp(prefix="sitemill-test-")
    put = lambda keys: spark.createDataFrame([(k, k) for k in keys], "dedup_key string, body string").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    for keys in (["a", "b", "a"], ["b", "c"], ["c", "d"]):
        put(keys)
        source = spark.readStream.schema("dedup_key string, body string").parquet(f"{folder}/in")
        sinks.write_once(source, f"{folder}/out", "dedup_key", f"{folder}/state", {"availableNow": True}).awaitTermination(120)
    assert sorted(r.dedup_key for r in spark.read.parquet(f"{folder}/out").collect()) == ["a", "b", "c", "d"]


def test_batches_open_their_own_buckets(spark):
    folder = tempfile.mkdtemp(prefix="sitemill-test-")
    write = sinks.append_once(f"{folder}/out", "dedup_key", buckets=8)
    batch = lambda keys: spark.createDataFrame([(k, "x") for k in keys], "dedup_key string, body string")
    for number, keys in enumerate([[f"k{n}" for n in range(40)], ["k1", "new"], ["new", "k39", "newer"], []]):
        write(batch(keys), number)
        write(batch(keys), number)  # a replay
    assert sorted(r.dedup_key for r in spark.read.parquet(f"{folder}/out").collect()) == sorted([*(f"k{n}" for n in range(40)), "new", "newer"])
