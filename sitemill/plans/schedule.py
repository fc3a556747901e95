"""Calendar, sessions, trips and local time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sitemill.functions import dates as D
from sitemill.functions.money import course_price, seats_left
from sitemill.operators import calendar as C
from sitemill.sources.adapters import table, view, with_views

_NOW = "2024-01-15 00:00:00"


def _now():
    return F.lit(_NOW).cast("timestamp_ntz")


def _schedule(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "v_schedule")
    length = F.when(F.col("id") % 3 == 0, F.make_dt_interval(F.col("id") % 5)).when(F.col("id") % 3 == 1, F.make_dt_interval(F.lit(0), F.col("id") % 12))
    return rows.withColumn("ends_at", F.col("starts_at") + length).withColumn("title", F.concat(F.lit("entry "), (F.col("id") % 50).cast("string")))


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    rows = _schedule(spark, sf)
    events = rows.where("kind = 'event'").withColumn("session_id", F.when(F.col("id") % 2 == 0, F.col("id") + 1)).withColumn("trip_id", F.when(F.col("id") % 5 == 0, F.col("id") + 2))
    return C.calendar_entries(events, rows.where("kind = 'course'"), rows.where("kind = 'trip'"))


def calendar_entries(spark: SparkSession, sf: str) -> DataFrame:
    return _entries(spark, sf)


def calendar_month(spark: SparkSession, sf: str) -> DataFrame:
    month = D.month_range(F.lit("2024-01-01").cast("date"))
    return _entries(spark, sf).where(C.overlaps_month(F.col("starts_at"), F.col("ends_at"), month["start"], month["end"])).select("key", "starts_at")


def calendar_upcoming(spark: SparkSession, sf: str) -> DataFrame:
    return _entries(spark, sf).where(C.not_ended(F.col("starts_at"), F.col("ends_at"), _now())).orderBy("starts_at", "kind_rank", "key").limit(5).select("key", "kind", "starts_at")


def calendar_month_groups(spark: SparkSession, sf: str) -> DataFrame:
    return C.month_groups(_entries(spark, sf)).select("key", "month", "position")


def calendar_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Derived dates outside the captured months (months of entries with an even number)."""
    months = table(spark, sf, "orders").where("o_orderkey % 97 = 0").select(F.date_format(D.month_start(F.col("o_orderdate")), "yyyy-MM").alias("month"))
    derived = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("starts_at"))
    return C.uncovered_months(derived, months).select("id", "month")


def trip_views(spark: SparkSession, sf: str) -> DataFrame:
    trips = _schedule(spark, sf).where("kind = 'trip'")
    return trips.select("id", C.trip_group(F.col("starts_at"), F.col("ends_at"), _now()).alias("view"))


def next_session(spark: SparkSession, sf: str) -> DataFrame:
    rows = _schedule(spark, sf).where("kind = 'course' and starts_at is not null")
    return C.next_sessions(rows, _now()).select("course_id", "id", "starts_at", course_price(F.when(F.col("id") % 2 == 0, F.col("id") * 100), F.col("course_id") * 10).alias("price_cents"))


def session_seats(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_schedule").select("id", seats_left(F.col("capacity"), F.col("reserved")).alias("seats"))


def local_instants(spark: SparkSession, sf: str) -> DataFrame:
    """Every event time read as Warsaw wall-clock time, moved so that many fall around clock changes."""
    local = F.timestamp_add("HOUR", (F.col("event_id") % 6000).cast("int"), F.lit("2024-03-01 00:30:00").cast("timestamp_ntz"))
    rows = table(spark, sf, "events").select("event_id", local.alias("local"))
    utc = D.instant_of_local(F.col("local"))
    return rows.select(
        "event_id", F.date_format("local", "yyyy-MM-dd HH:mm").alias("wall"), F.date_format(utc, "yyyy-MM-dd HH:mm").alias("utc"),
        F.date_format(D.month_start(F.col("local")), "yyyy-MM-dd").alias("month_start"),
        F.date_format(D.month_range(F.trunc(F.col("local").cast("date"), "month"))["start"], "yyyy-MM-dd HH:mm").alias("month_utc"),
    )


def calendar_details(spark: SparkSession, sf: str) -> DataFrame:
    """Event pages against month-calendar rows at the same address: merged, conflicting or alone."""
    events = table(spark, sf, "events")
    route = F.concat(F.lit("kalendarz/e-"), (F.col("event_id") % 3000).cast("string"))
    details = events.where("event_type = 'view'").select(F.col("event_id").alias("id"), route.alias("route"), F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("starts_at"))
    rows = events.where("event_type = 'click'").select(F.concat(F.lit("row-"), F.col("event_id").cast("string")).alias("key"),
        F.concat(F.lit("kalendarz/e-"), ((F.col("event_id") + 1) % 3000).cast("string")).alias("route"), F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("starts_at"))
    return C.merge_event_details(details, rows).select("id", "outcome", "calendar_key")


def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Events linked to the only course term with the same name and start day."""
    rows = _schedule(spark, sf).where("starts_at is not null").withColumn("starts_at", F.date_trunc("day", F.col("starts_at")).cast("timestamp_ntz"))
    courses = rows.where("kind = 'course'").select(F.col("id").alias("course_id"), F.col("title").alias("name"), F.col("starts_at").alias("next_date"))
    events = rows.where("kind = 'event'").select("id", "title", "starts_at")
    return C.link_event_sessions(events, courses).select("id", "course_id")


QUERIES = {
    query.__name__: query
    for query in (
        calendar_entries, calendar_month, calendar_upcoming, calendar_month_groups, calendar_fallback, trip_views, next_session, session_seats,
        local_instants, calendar_details, event_sessions,
    )
}

_S = f"""{with_views('v_schedule')}, s AS (SELECT *, starts_at + CASE id % 3 WHEN 0 THEN to_days(CAST(id % 5 AS INTEGER)) WHEN 1 THEN to_hours(id % 12) END AS ends_at, concat('entry ', CAST(id % 50 AS VARCHAR)) AS title FROM v_schedule),
ev AS (SELECT *, CASE WHEN id % 2 = 0 THEN id + 1 END AS session_id, CASE WHEN id % 5 = 0 THEN id + 2 END AS trip_id FROM s WHERE kind = 'event'),
ent AS (SELECT 'event-' || id AS key, 'event' AS kind, 0 AS kind_rank, title, starts_at, ends_at FROM ev
 UNION ALL SELECT 'course-' || id, 'course', 1, title, starts_at, ends_at FROM s WHERE kind = 'course' AND id NOT IN (SELECT session_id FROM ev WHERE session_id IS NOT NULL)
 UNION ALL SELECT 'trip-' || id, 'trip', 2, title, starts_at, ends_at FROM s WHERE kind = 'trip' AND starts_at IS NOT NULL AND id NOT IN (SELECT trip_id FROM ev WHERE trip_id IS NOT NULL))"""
_TS = f"TIMESTAMP '{_NOW}'"
_LOCAL = lambda x: f"timezone('Europe/Warsaw', timezone('UTC', {x}))"
_UTC = lambda x: f"timezone('UTC', timezone('Europe/Warsaw', {x}))"

ORACLES = {
    "calendar_entries": f"{_S} SELECT * FROM ent",
    "calendar_month": f"""{_S} SELECT key, starts_at FROM ent WHERE starts_at < TIMESTAMP '2024-01-31 23:00:00' AND (starts_at >= TIMESTAMP '2023-12-31 23:00:00' OR ends_at >= TIMESTAMP '2023-12-31 23:00:00')""",
    "calendar_upcoming": f"{_S} SELECT key, kind, starts_at FROM ent WHERE starts_at >= {_TS} OR ends_at >= {_TS} ORDER BY starts_at, kind_rank, key LIMIT 5",
    "calendar_month_groups": f"""{_S} SELECT key, strftime({_LOCAL('starts_at')}, '%Y-%m') AS month, row_number() OVER (PARTITION BY strftime({_LOCAL('starts_at')}, '%Y-%m') ORDER BY starts_at, kind_rank, key) AS position FROM ent""",
    "calendar_fallback": f"""WITH o AS (SELECT o_orderkey AS id, strftime({_LOCAL('o_orderdate')}, '%Y-%m') AS month FROM orders) SELECT id, month FROM o WHERE month NOT IN (SELECT month FROM o WHERE id % 97 = 0)""",
    "trip_views": f"""{_S} SELECT id, CASE WHEN coalesce(ends_at, starts_at) IS NULL THEN 'undated' WHEN coalesce(ends_at, starts_at) >= {_TS} THEN 'upcoming' ELSE 'past' END AS view FROM s WHERE kind = 'trip'""",
    "next_session": f"""{_S}, r AS (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY starts_at, id) AS rn FROM s WHERE kind = 'course' AND starts_at >= {_TS})
 SELECT course_id, id, starts_at, CASE WHEN id % 2 = 0 THEN id * 100 ELSE course_id * 10 END AS price_cents FROM r WHERE rn = 1""",
    "session_seats": f"{with_views('v_schedule')} SELECT id, CASE WHEN capacity >= 1 THEN greatest(0, capacity - reserved) END AS seats FROM v_schedule",
    "local_instants": f"""WITH e AS (SELECT event_id, TIMESTAMP '2024-03-01 00:30:00' + to_hours(event_id % 6000) AS l FROM events), u AS (SELECT *, {_UTC('l')} AS u FROM e),
 k AS (SELECT *, {_LOCAL('u')} = l AND {_LOCAL("u + INTERVAL 1 HOUR")} <> l AND {_LOCAL("u - INTERVAL 1 HOUR")} <> l AS ok FROM u)
 SELECT event_id, strftime(l, '%Y-%m-%d %H:%M') AS wall, CASE WHEN ok THEN strftime(u, '%Y-%m-%d %H:%M') END AS utc, strftime(date_trunc('month', {_LOCAL('l')}), '%Y-%m-%d') AS month_start,
 strftime({_UTC("CAST(date_trunc('month', l) AS TIMESTAMP)")}, '%Y-%m-%d %H:%M') AS month_utc FROM k""",
    "calendar_details": """WITH d AS (SELECT event_id AS id, event_id % 3000 AS r, date_trunc('day', ts) AS t FROM events WHERE event_type = 'view'),
 c AS (SELECT (event_id + 1) % 3000 AS r, count(*) n, min('row-' || event_id) AS k, min(date_trunc('day', ts)) AS t FROM events WHERE event_type = 'click' GROUP BY 1)
 SELECT id, CASE WHEN n IS NULL THEN 'standalone' WHEN n = 1 AND c.t = d.t THEN 'merged' ELSE 'calendar-detail-conflict' END AS outcome, CASE WHEN n = 1 AND c.t = d.t THEN k END AS calendar_key FROM d LEFT JOIN c USING (r)""",
    "event_sessions": f"""{_S}, c AS (SELECT title, date_trunc('day', starts_at) AS t, count(*) n, min(id) AS course_id FROM s WHERE kind = 'course' GROUP BY ALL)
 SELECT e.id, CASE WHEN n = 1 THEN c.course_id END AS course_id FROM ev e LEFT JOIN c ON c.title = e.title AND c.t = date_trunc('day', e.starts_at)""",
}
