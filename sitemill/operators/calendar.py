"""Calendar entries, months, sessions and trips. Times are UTC timestamp_ntz."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sitemill import constants as K
from sitemill.functions import dates as D
from sitemill.functions.unicode import nfc
from sitemill.operators.ordered import first_per_key, position_in_key, range_chunks


def calendar_entries(events: DataFrame, sessions: DataFrame, trips: DataFrame) -> DataFrame:
    """events(id, title, starts_at, ends_at, session_id, trip_id), sessions and trips(id, title, starts_at,
    ends_at) -> one list. A session or trip an event points to is shown once, as the event;
    undated records are left out."""
    shape = lambda df, kind: df.where("starts_at is not null").select(
        F.concat(F.lit(kind + "-"), F.col("id").cast("string")).alias("key"), F.lit(kind).alias("kind"),
        F.lit(K.CALENDAR_KINDS.index(kind)).alias("kind_rank"), "title", "starts_at", "ends_at",
    )
    covered = lambda column: events.where(f"{column} is not null").select(F.col(column).alias("id")).distinct()
    return (
        shape(events, "event")
        .unionByName(shape(sessions.join(covered("session_id"), "id", "left_anti"), "course"))
        .unionByName(shape(trips.join(covered("trip_id"), "id", "left_anti"), "trip"))
    )


def calendar_order() -> list[Column]:
    """Start, then kind, then title in Polish alphabetical order."""
    return [F.col("starts_at"), F.col("kind_rank"), F.collate("title", "pl")]


def overlaps_month(starts: Column, ends: Column, month_start: Column, month_end: Column) -> Column:
    return (starts < month_end) & ((starts >= month_start) | F.coalesce(ends >= month_start, F.lit(False)))


def not_ended(starts: Column, ends: Column, now: Column) -> Column:
    return (starts >= now) | F.coalesce(ends >= now, F.lit(False))


def trip_group(starts: Column, ends: Column, now: Column) -> Column:
    """upcoming, past or undated: disjoint and complete; the end decides when there is one."""
    deciding = F.coalesce(ends, starts)
    return F.when(deciding.isNull(), F.lit("undated")).when(deciding >= now, F.lit("upcoming")).otherwise(F.lit("past"))


def month_groups(entries: DataFrame) -> DataFrame:
    """Adds the Warsaw month and the entry's position in it: by start, kind, Polish title, then key. Positions replace nested
    lists, so a crowded month is never built as one array, and its entries are counted in ranges of that order."""
    dated = entries.where("starts_at is not null").withColumn("month", F.date_format(D.month_start(F.col("starts_at")), "yyyy-MM"))
    order = [*calendar_order(), F.col("key")]
    return position_in_key(range_chunks(dated, [F.col("month"), *order]), ["month"], "chunk", order, "position").drop("chunk")


def uncovered_months(derived: DataFrame, covered: DataFrame) -> DataFrame:
    """Prose dates yield to captured months: derived(starts_at, ...) without those in covered(month)."""
    month = F.date_format(D.month_start(F.col("starts_at")), "yyyy-MM")
    return derived.withColumn("month", month).join(covered.select("month").distinct(), "month", "left_anti")


def next_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    """Earliest session per course that has not started; the lowest id breaks ties."""
    return first_per_key(sessions.where(F.col("starts_at") >= now), ["course_id"], [F.col("starts_at"), F.col("id")])


def events_by_org(courses: DataFrame, org: str | None) -> DataFrame:
    """Only a known organisation filters."""
    known = ["PADI", "IANTD", "TDI/SDI", "Freediving", "Inne"]
    return courses.where(F.col("org") == org) if org in known else courses


def pages_of_kind(pages: DataFrame, *kinds: str) -> DataFrame:
    return pages.where(F.col("kind").isin(*kinds))


def merge_event_details(details: DataFrame, rows: DataFrame) -> DataFrame:
    """details(id, route, starts_at), rows(key, route, starts_at) -> one outcome per event page.

    Exactly one calendar row at the address and the same start merges into the calendar row; any
    other row there is a conflict and the detail becomes a page; no row keeps the detail."""
    per_route = rows.groupBy("route").agg(
        F.count("*").alias("n"), F.min("key").alias("row_key"), F.min("starts_at").alias("row_start")
    )
    joined = details.join(per_route, "route", "left")
    outcome = (
        F.when(F.col("n").isNull(), F.lit("standalone"))
        .when((F.col("n") == 1) & (F.col("row_start") == F.col("starts_at")), F.lit("merged"))
        .otherwise(F.lit("calendar-detail-conflict"))
    )
    return joined.select("id", "route", outcome.alias("outcome"), F.when(outcome == "merged", F.col("row_key")).alias("calendar_key"))


def link_event_sessions(events: DataFrame, courses: DataFrame) -> DataFrame:
    """events(id, title, starts_at), courses(course_id, name, next_date) -> events linked to exactly one
    course term of the same NFC name and start."""
    terms = courses.where("next_date is not null").groupBy(nfc(F.col("name")).alias("_name"), F.col("next_date").alias("starts_at")).agg(
        F.count("*").alias("n"), F.min("course_id").alias("course_id")
    )
    named = events.withColumn("_name", nfc(F.col("title")))
    joined = named.join(terms.where("n = 1").drop("n"), ["_name", "starts_at"], "left")
    return joined.drop("_name")


def course_terms(courses: DataFrame, covered_months: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions, calendar rows) derived from stated start dates; keys hash (course, start)."""
    dated = courses.where("next_date is not null").withColumn(
        "term", F.sha2(F.concat_ws("\x00", F.col("key"), D.iso_millis(F.col("next_date"))), 256)
    )
    sessions = dated.select(F.concat(F.lit("public-course-start:"), "term").alias("key"), F.col("name").alias("title"), F.col("next_date").alias("starts_at"), F.col("key").alias("course"))
    rows = dated.select(F.concat(F.lit("public-course-calendar:"), "term").alias("key"), F.col("name").alias("title"), F.col("next_date").alias("starts_at"),
                        F.concat(F.lit("public-course-start:"), "term").alias("session"))
    return sessions, uncovered_months(rows, covered_months).drop("month")
