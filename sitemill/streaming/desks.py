"""Keyed state machines: orders, stock, payments, seats, subscriptions, corrections and page views.

Each class is one transformWithState processor; run(df, desk) attaches it. Rows of a key are taken in
(at, id) order within a micro-batch, so a batch should be bounded by the source's rate options. The
batch functions of operators.commerce give the same verdicts over complete tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sitemill import constants as K
from sitemill.operators.commerce import ORDER_MOVES

MINUTE = 60_000  # deadlines are UTC milliseconds
DEADLINES = ("moment bigint", "names array<string>")
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Desk(StatefulProcessor):
    """Common shape: values() names the state, step() handles one row, late() one timer."""

    key = "key"
    output = "key string, id bigint, verdict string"
    timers = False
    states: dict[str, str] = {}
    maps: dict[str, tuple[str, str]] = {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = {name: handle.getValueState(name, schema) for name, schema in self.states.items()}
        self.table = {name: handle.getMapState(name, *schemas) for name, schemas in self.maps.items()}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for row in sorted(rows, key=lambda row: (row["ms"], row["id"])):
            yield from self.step(key[0], row)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # a cleared or replaced deadline leaves its timer behind, so the state decides what is due
        yield from self.late(key[0], expiredTimerInfo.getExpiryTimeInMs())

    def late(self, key, now) -> Iterator[Row]:
        return iter(())

    def close(self) -> None:
        pass

    # small helpers over tuples
    def get(self, name, default=None):
        state = self.value[name]
        return state.get() if state.exists() else default

    def put(self, name, *values):
        self.value[name].update(values)

    def wake(self, moment: int):
        self.handle.registerTimer(moment)

    # deadlines of many names: each moment keeps its own names, so a timer reads what is due and nothing else
    def wake_for(self, moment: int, name: str):
        deadlines = self.table["deadlines"]
        if deadlines.containsKey((moment,)):
            names = deadlines.getValue((moment,))[0]
            if name not in names:
                deadlines.updateValue((moment,), ([*names, name],))
        else:
            deadlines.updateValue((moment,), ([name],))
            self.wake(moment)

    def names_due(self, moment: int) -> list[str]:
        deadlines = self.table["deadlines"]
        if not deadlines.containsKey((moment,)):
            return []
        names = deadlines.getValue((moment,))[0]
        deadlines.removeKey((moment,))
        return sorted(names)


def run(df: DataFrame, desk: Desk, delay: str | None = None) -> DataFrame:
    """Attaches a desk to a stream with columns key, at (timestamp), id and the desk's own columns. The
    delay of the watermark must exceed the longest deadline a desk keeps."""
    if desk.timers and not delay:
        raise ValueError(f"{type(desk).__name__} keeps deadlines: give the watermark's delay")
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    timed = df.withWatermark("at", delay) if delay else df
    # rows without a time are never late and move no watermark: desks write them for each other, with their moment in ms
    moment = F.coalesce(F.unix_millis("at"), "ms") if "ms" in df.columns else F.unix_millis("at")
    timed = timed.withColumn("ms", moment)
    return timed.groupBy(desk.key).transformWithState(
        statefulProcessor=desk, outputStructType=desk.output, outputMode="Append", timeMode="EventTime" if desk.timers and delay else "None"
    )


class OrderIntake(Desk):
    """Rows: fingerprint, command (request or close). One order per key; a closed one is final.

    With keep_minutes a key is forgotten that long after its order was closed, so the state holds open orders and recently closed
    ones; a request that comes later still starts a new order. Without it keys are kept for good."""

    states = {"order": "fingerprint string, closed boolean"}

    def __init__(self, keep_minutes: int | None = None):
        self.keep, self.timers = keep_minutes, keep_minutes is not None

    def late(self, key, now):
        order = self.get("order")
        if order and order[1]:
            self.value["order"].clear()
        return iter(())

    def step(self, key, row):
        order = self.get("order")
        if row["command"] == "close":
            if order and not order[1]:
                self.put("order", order[0], True)
                if self.timers:
                    self.wake(row["ms"] + MINUTE * self.keep)
            return
        if order is None:
            self.put("order", row["fingerprint"], False)
            verdict = "created"
        elif order[0] != row["fingerprint"]:
            verdict = "conflict"
        else:
            verdict = "closed" if order[1] else "duplicate"
        yield Row(key=key, id=row["id"], verdict=verdict)


class StockKeeper(Desk):
    """Rows: command (load, reserve, release, ship, pay), line, qty, minutes, cod. One product or variant
    per key; an order's lines are reserved one by one and judged together by order_verdicts."""

    timers = True
    output = "key string, id bigint, line string, verdict string"
    states = {"stock": "left bigint"}
    maps = {"held": ("line string", "qty bigint, until bigint, cod boolean"), "deadlines": DEADLINES}

    def step(self, key, row):
        stock, held, line = self.get("stock"), self.table["held"], row["line"]
        verdict = None
        if row["command"] == "load":
            self.put("stock", row["qty"])
        elif row["command"] == "reserve":
            left = stock[0] if stock else None
            if left is None:
                verdict = "review"
            elif held.containsKey((line,)):
                verdict = "duplicate"
            elif row["qty"] is None:
                verdict = "review"
            elif row["qty"] > left:
                verdict = "rejected"
            else:
                until = row["ms"] + MINUTE * (row["minutes"] or K.ONLINE_RESERVATION_MINUTES)
                self.put("stock", left - row["qty"])
                held.updateValue((line,), (row["qty"], until, bool(row["cod"])))
                self.wake_for(until, line)
                verdict = "reserved"
        elif held.containsKey((line,)):
            qty, until, cod = held.getValue((line,))
            if row["command"] == "release":
                yield from self._free(key, row["id"], line, qty, "released")
            elif row["command"] == "pay" or (row["command"] == "ship" and cod):
                # paid goods and shipped cash-on-delivery parcels have left the shelf for good
                held.removeKey((line,))
        elif row["command"] == "release":
            verdict = "not-held"
        if verdict:
            yield Row(key=key, id=row["id"], line=line, verdict=verdict)

    def _free(self, key, number, line, qty, verdict):
        self.table["held"].removeKey((line,))
        left = self.get("stock", (None,))[0]
        if left is None:
            verdict = "review"
        else:
            self.put("stock", left + qty)
        yield Row(key=key, id=number, line=line, verdict=verdict)

    def late(self, key, now):
        held = self.table["held"]
        for line in self.names_due(now):
            # a line that was released and taken again has a later deadline of its own
            if held.containsKey((line,)) and held.getValue((line,))[1] <= now:
                yield from self._free(key, None, line, held.getValue((line,))[0], "expired")


def order_verdicts(lines: DataFrame) -> DataFrame:
    """lines(order_id, verdict) -> one verdict per order: reserved only when every line is."""
    bad = F.max(F.when(F.col("verdict") != "reserved", F.col("verdict")))
    return lines.groupBy("order_id").agg(F.coalesce(bad, F.lit("reserved")).alias("verdict"))


class Shelf(Desk):
    """Whole orders, first stage: one product (or variant) per key. Rows: command, order_id, qty, lines.

    load sets the stock; reserve is one line of an order of so many lines (lines of an order on one key are added up before).
    Both wait until the watermark has passed them, then take effect in (at, order) order whatever order they came in.
    A line is answered fits when it can be served even if every open order before it is, short when it cannot even if
    none is, review without known stock or quantity; otherwise it waits. The second stage (OrderJudge) answers with confirm
    or release, later perhaps return; each narrows what the waiting lines wait for. Its rows come from the stream that the second stage
    writes, unioned with the requests; neither stage's rows for the other carry a time, so none is ever late. A return adds stock from the
    moment it arrives.

    The state of a key holds its open orders and one row per minute of requests that the watermark has not passed; a timer reads
    its own minute only."""

    timers = True
    output = "order_id string, at timestamp, ms bigint, id bigint, command string, product string, verdict string, qty bigint, lines int"
    states = {"shelf": "left bigint"}
    maps = {
        "inbox": ("minute bigint", "rows array<struct<ms:bigint,order_id:string,command:string,qty:bigint,lines:int>>"),
        "open": ("order_id string", "ms bigint, qty bigint, lines int, state string"),
    }

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh: dict[int, list[tuple]] = {}
        moved = False
        for row in rows:
            if row["command"] in ("load", "reserve"):
                # a row the watermark has passed already is taken with the next minute that is due
                due = max(row["ms"], timerValues.getCurrentWatermarkInMs()) // MINUTE * MINUTE + MINUTE
                fresh.setdefault(due, []).append((row["ms"], row["order_id"], row["command"], row["qty"], row["lines"]))
            else:
                moved |= self._settle(row["command"], row["order_id"], row["qty"])
        inbox = self.table["inbox"]
        for due, came in fresh.items():
            if inbox.containsKey((due,)):
                came = [*inbox.getValue((due,))[0], *came]
            else:
                self.wake(due)
            inbox.updateValue((due,), (came,))
        if moved:
            yield from self._answers(key[0])

    def late(self, key, now):
        inbox = self.table["inbox"]
        if not inbox.containsKey((now,)):
            return
        for ms, order, command, qty, lines in sorted(inbox.getValue((now,))[0], key=lambda r: (r[0], r[2] != "load", r[1] or "")):
            if command == "load":
                self.put("shelf", qty)
            elif self.get("shelf", (None,))[0] is None or qty is None or qty < 1:
                yield self._answer(key, order, ms, "review", qty, lines)
            else:
                self.table["open"].updateValue((order,), (ms, qty, lines, "waits"))
        inbox.removeKey((now,))
        yield from self._answers(key)

    def _settle(self, command, order, qty) -> bool:
        open_ = self.table["open"]
        held = open_.getValue((order,)) if open_.containsKey((order,)) else None
        if command == "confirm" and held:
            open_.updateValue((order,), (*held[:3], "served"))
        elif command == "release" and held:
            open_.removeKey((order,))
        elif command == "return" and held:
            open_.removeKey((order,))
        elif command == "return":
            self.put("shelf", (self.get("shelf", (0,))[0] or 0) + qty)
        else:
            return False
        return True

    def _answer(self, key, order, ms, verdict, qty, lines):
        return Row(order_id=order, at=None, ms=ms, id=0, command="answer", product=key, verdict=verdict, qty=qty, lines=lines)

    def _answers(self, key):
        open_ = self.table["open"]
        left = self.get("shelf", (0,))[0] or 0
        served = pending = 0
        waiting = False
        for (order,), (ms, qty, lines, state) in sorted(open_.iterator(), key=lambda e: (e[1][0], e[0][0])):
            if state == "waits":
                most = left - served
                if qty > most:
                    open_.removeKey((order,))
                    yield self._answer(key, order, ms, "short", qty, lines)
                    continue
                if qty <= most - pending:
                    open_.updateValue((order,), (ms, qty, lines, "fits"))
                    yield self._answer(key, order, ms, "fits", qty, lines)
            if state == "served" and not waiting:
                left -= qty  # nobody open is before it: it leaves the shelf
                open_.removeKey((order,))
            elif state == "served":
                served += qty
            else:
                pending += qty
                waiting = True
        self.put("shelf", left)


class OrderJudge(Desk):
    """Whole orders, second stage: one order per key. Rows: command answer (of a Shelf: product, verdict, qty, lines), pay, ship, cancel, with cod.

    The order is served once all its lines fit, and refused with the first that does not; either way the shelves that
    hold lines get one row each (confirm or release), so a refused order holds nothing. A served order that is neither paid nor
    shipped against cash on delivery is returned at its deadline or when it is cancelled. The commands carry times and move the
    watermark that deadlines follow."""

    timers = True
    output = "key string, at timestamp, ms bigint, id bigint, command string, order_id string, qty bigint, lines int, verdict string"
    states = {"order": "verdict string, until bigint"}
    maps = {"line": ("product string", "qty bigint")}

    def __init__(self, minutes: int = K.ONLINE_RESERVATION_MINUTES):
        self.minutes = minutes

    def step(self, key, row):
        verdict, until = self.get("order", ("open", None))
        held = self.table["line"]
        if row["command"] == "answer":
            if row["verdict"] == "fits" and verdict in ("rejected", "review"):
                yield self._row(row["product"], row["id"], row["ms"], "release", key, row["qty"])
            elif row["verdict"] == "fits" and verdict == "open":
                held.updateValue((row["product"],), (row["qty"],))
                if sum(1 for _ in held.keys()) == row["lines"]:
                    until = row["ms"] + MINUTE * self.minutes
                    self.put("order", "reserved", until)
                    self.wake(until)
                    yield self._verdict(key, row["id"], until - MINUTE * self.minutes, "reserved")
                    for (product,), (qty,) in held.iterator():
                        yield self._row(product, row["id"], row["ms"], "confirm", key, qty)
            elif verdict == "open":
                verdict = "review" if row["verdict"] == "review" else "rejected"
                self.put("order", verdict, None)
                yield self._verdict(key, row["id"], row["ms"], verdict)
                yield from self._tell(key, row, "release")
        elif verdict == "reserved" and row["command"] == "cancel":
            yield from self._end(key, row["id"], row["ms"], "cancelled")
        elif verdict == "reserved" and (row["command"] == "pay" or (row["command"] == "ship" and row["cod"])):
            self.put("order", "kept", None)

    def late(self, key, now):
        verdict, until = self.get("order", ("open", None))
        if verdict == "reserved" and until <= now:
            yield from self._end(key, None, now, "expired")

    def _end(self, key, number, ms, verdict):
        self.put("order", verdict, None)
        yield self._verdict(key, number, ms, verdict)
        yield from self._tell(key, {"id": number, "ms": ms}, "return")

    def _tell(self, key, row, command):
        held = self.table["line"]
        for (product,), (qty,) in list(held.iterator()):
            held.removeKey((product,))
            yield self._row(product, row["id"], row["ms"], command, key, qty)

    def _verdict(self, key, number, ms, verdict):
        return Row(key=None, at=None, ms=ms, id=number, command="verdict", order_id=key, qty=None, lines=None, verdict=verdict)

    def _row(self, product, number, ms, command, order, qty):
        return Row(key=product, at=None, ms=ms, id=number, command=command, order_id=order, qty=qty, lines=None, verdict=None)


class PaymentDesk(Desk):
    """Rows: command (attempt, event, close), event_key, digest, outcome, amount_cents, reference,
    minutes, initialization, offline. One attempt per key; first valid event before expiry decides.

    seen holds the events that were judged, to tell repeats. With keep_minutes only the deciding event is kept that long after the
    attempt's deadline: events that come still later are judged by the attempt's state, as any new event of a closed
    attempt is, so the state of a key does not grow with what is sent to it afterwards."""

    states = {"attempt": "due bigint, until bigint, status string, reference string, initialization string, review boolean, offline boolean", "deciding": "event_key string", "forgotten": "flag boolean"}
    maps = {"seen": ("event_key string", "digest string")}

    def __init__(self, keep_minutes: int | None = None):
        self.keep, self.timers = keep_minutes, keep_minutes is not None

    def late(self, key, now):
        if self.get("forgotten") is None:
            self.put("forgotten", True)
            seen = self.table["seen"]
            deciding = self.get("deciding", (None,))[0]
            for (event,) in list(seen.keys()):
                if event != deciding:
                    seen.removeKey((event,))
        return iter(())

    def step(self, key, row):
        attempt, seen = self.get("attempt"), self.table["seen"]
        if row["command"] == "attempt":
            if attempt is None:
                if self.timers:
                    self.wake(row["ms"] + MINUTE * (row["minutes"] + self.keep))
                self.put("attempt", row["amount_cents"], row["ms"] + MINUTE * row["minutes"], "pending", row["reference"], row["initialization"], False, bool(row["offline"]))
            return
        if row["command"] == "close":
            if attempt and attempt[2] == "pending":
                self.put("attempt", *attempt[:2], "cancelled", *attempt[3:])
            return
        verdict = self._judge(row, attempt, seen)
        yield Row(key=key, id=row["id"], verdict=verdict)

    def _judge(self, row, attempt, seen):
        if attempt is None:
            return "unknown-attempt"
        due, until, status, reference, initialization, review, offline = attempt
        if seen.containsKey((row["event_key"],)):
            return "duplicate" if seen.getValue((row["event_key"],))[0] == row["digest"] else "digest-mismatch"
        if offline:
            return "offline-refused"
        if row["amount_cents"] != due:
            return "amount-mismatch"
        if self.get("forgotten") is None:
            seen.updateValue((row["event_key"],), (row["digest"],))
        if row["reference"] is not None and row["reference"] != reference:
            # only an attempt that never stored its reference may still be bound to one
            if initialization != "initializing":
                self.put("attempt", due, until, status, reference, initialization, True, offline)
                return "reference-mismatch"
            if review and status == "pending":
                return "review-required"
            reference, initialization = row["reference"], "ready"
        if status == "pending" and row["ms"] < until:
            self.put("attempt", due, until, row["outcome"], reference, initialization, review, offline)
            self.put("deciding", row["event_key"])
            return "accepted"
        late_paid = row["outcome"] == "paid" and status != "paid"
        self.put("attempt", due, until, "expired" if status == "pending" else status, reference, initialization, review or late_paid, offline)
        return "terminal-review" if late_paid else "terminal-state"


class OrderDesk(Desk):
    """Rows: method, command. Output carries the state before and after for the audit trail."""

    output = "key string, id bigint, command string, before string, after string"
    states = {"order": "state string"}

    def step(self, key, row):
        before = self.get("order", ("new",))[0]
        after = ORDER_MOVES[row["method"]].get((before, row["command"]), before)
        if after != before:
            self.put("order", after)
        yield Row(key=key, id=row["id"], command=row["command"], before=before, after=after)


class SeatKeeper(Desk):
    """Rows: command (open, signup, confirm, enrol, reject), person, capacity. One session per key."""

    timers = True
    output = "key string, id bigint, person string, verdict string"
    states = {"session": "capacity bigint, reserved bigint"}
    maps = {"seat": ("person string", "status string, held boolean, confirmed boolean, until bigint"), "deadlines": DEADLINES}

    def step(self, key, row):
        if row["command"] == "open":
            self.put("session", row["capacity"], self.get("session", (None, 0))[1])
            return
        person, seats = row["person"], self.table["seat"]
        old = seats.getValue((person,)) if seats.containsKey((person,)) else None
        verdict = getattr(self, "_" + row["command"])(person, row, old)
        yield Row(key=key, id=row["id"], person=person, verdict=verdict)

    def _take(self):
        capacity, reserved = self.get("session", (None, 0))
        if capacity is not None and reserved >= capacity:
            return False
        self.put("session", capacity, reserved + 1)
        return True

    def _give(self):
        capacity, reserved = self.get("session", (None, 0))
        self.put("session", capacity, max(0, reserved - 1))

    def _signup(self, person, row, old):
        if old and old[1]:
            return "repeat"
        if not self._take():
            return "full"
        until = row["ms"] + MINUTE * K.SEAT_RESERVATION_MINUTES
        self.table["seat"].updateValue((person,), ("new", True, False, until))
        self.wake_for(until, person)
        return "seated"

    def _confirm(self, person, row, old):
        if not old or not old[1] or (row["ms"] >= old[3] and not old[2]):
            return "expired-link"
        self.table["seat"].updateValue((person,), (old[0], True, True, old[3]))
        return "confirmed"

    def _enrol(self, person, row, old):
        if old and not old[1] and not self._take():
            return "full"
        if not old:
            return "unknown"
        self.table["seat"].updateValue((person,), ("enrolled", True, old[2], old[3]))
        return "enrolled"

    def _reject(self, person, row, old):
        if not old:
            return "unknown"
        if old[1]:
            self._give()
        self.table["seat"].updateValue((person,), ("rejected", False, old[2], old[3]))
        return "rejected"

    def late(self, key, now):
        seats = self.table["seat"]
        for person in self.names_due(now):
            value = seats.getValue((person,)) if seats.containsKey((person,)) else None
            if value and value[1] and not value[2] and value[0] != "enrolled" and value[3] <= now:
                seats.updateValue((person,), (value[0], False, value[2], value[3]))
                self._give()
                yield Row(key=key, id=None, person=person, verdict="expired")


class Subscriptions(Desk):
    """Rows: command (subscribe, confirm, unsubscribe). Double opt-in within 24 hours."""

    states = {"entry": "status string, until bigint"}

    def step(self, key, row):
        status, until = self.get("entry", (None, None))
        if row["command"] == "subscribe" and status != "active" and not (status == "pending" and until > row["ms"]):
            status, until = "pending", row["ms"] + 60 * MINUTE * K.NEWSLETTER_HOURS
        elif row["command"] == "confirm" and status == "pending" and until > row["ms"]:
            status = "active"
        elif row["command"] == "unsubscribe":
            status, until = "unsubscribed", None
        if status is not None:
            self.put("entry", status, until)
        yield Row(key=key, id=row["id"], verdict=status or "unknown")


class InventoryDesk(Desk):
    """Rows: expected, stock. Compare-and-set with the audit columns before and after."""

    output = "key string, id bigint, verdict string, before bigint, after bigint"
    states = {"stock": "value bigint"}

    def step(self, key, row):
        before = self.get("stock", (None,))[0]
        valid = row["stock"] is not None and 0 <= row["stock"] <= K.MAX_STOCK
        if row["command"] == "load" or (valid and row["expected"] == before):
            self.put("stock", row["stock"])
            verdict, after = ("loaded" if row["command"] == "load" else "accepted"), row["stock"]
        else:
            verdict, after = ("stale" if valid else "invalid"), before
        yield Row(key=key, id=row["id"], verdict=verdict, before=before, after=after)


class PageViews(Desk):
    """Rows: command (consent, revoke, view), path (already cleaned, null when private). Emits views that
    differ from the visitor's previous one; losing consent forgets it."""

    output = "key string, id bigint, path string"
    states = {"visitor": "consent boolean, path string"}

    def step(self, key, row):
        consent, previous = self.get("visitor", (False, None))
        if row["command"] in ("consent", "revoke"):
            given = row["command"] == "consent"
            self.put("visitor", given, previous if given else None)
        elif consent and row["path"] and row["path"] != previous:
            self.put("visitor", True, row["path"])
            yield Row(key=key, id=row["id"], path=row["path"])


def outbox_once(messages: DataFrame, delay: str | None = None) -> DataFrame:
    """One message per dedup_key: for ever without a delay, else within the watermark delay."""
    if delay is None:
        return messages.dropDuplicates(["dedup_key"])
    return messages.withWatermark("at", delay).dropDuplicatesWithinWatermark(["dedup_key"])
