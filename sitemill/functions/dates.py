"""Wall-clock time in Warsaw and its UTC instants. Inputs and results are timestamp_ntz in UTC
unless a name says 'local', so no result depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sitemill import constants as K
from sitemill.functions.binding import let


def to_local(utc: Column) -> Column:
    """Warsaw wall-clock time of a UTC instant."""
    return F.convert_timezone(F.lit("UTC"), F.lit(K.SITE_ZONE), utc.cast("timestamp_ntz"))


def to_utc(local: Column) -> Column:
    """One UTC instant for a wall-clock time; see warsaw_instant for gaps and overlaps."""
    return F.convert_timezone(F.lit(K.SITE_ZONE), F.lit("UTC"), local.cast("timestamp_ntz"))


def instant_of_local(local: Column) -> Column:
    """UTC instant, or null when the wall-clock time is skipped or happens twice."""
    hour = F.expr("interval 1 hour")

    def single(wall: Column, utc: Column) -> Column:
        twice = (to_local(utc + hour) == wall) | (to_local(utc - hour) == wall)
        return F.when((to_local(utc) == wall) & ~twice, utc)

    return let(local, lambda wall: let(to_utc(wall), lambda utc: single(wall, utc)))


def warsaw_instant(year: Column, month: Column, day: Column, hour: Column, minute: Column) -> Column:
    text = F.format_string("%04d-%02d-%02d %02d:%02d:00", year.cast("int"), month.cast("int"), day.cast("int"), hour.cast("int"), minute.cast("int"))
    return instant_of_local(text.try_cast("timestamp_ntz"))


def warsaw_midnight(local_day: Column) -> Column:
    """UTC instant at which a Warsaw day starts."""
    return to_utc(local_day.cast("timestamp_ntz"))


def month_start(utc: Column) -> Column:
    """First local day of the Warsaw month that holds the instant (a date)."""
    return F.trunc(to_local(utc).cast("date"), "month")


def month_range(first_day: Column) -> Column:
    """struct(start, end): UTC bounds of the Warsaw month that starts on first_day."""
    return F.struct(
        warsaw_midnight(first_day).alias("start"), warsaw_midnight(F.add_months(first_day, 1)).alias("end")
    )


def shift_month(first_day: Column, delta: int) -> Column:
    return F.add_months(first_day, delta)


def parse_month(text: Column) -> Column:
    """First day of a 'YYYY-MM' month between 2000 and 2100, or null."""
    year = F.regexp_extract(text, r"\A([0-9]{4})-([0-9]{2})\z", 1)
    number = F.regexp_extract(text, r"\A([0-9]{4})-([0-9]{2})\z", 2)
    ok = (F.nullif(year, F.lit("")).cast("int").between(2000, 2100)) & (F.nullif(number, F.lit("")).cast("int").between(1, 12))
    return F.when(ok, F.concat(text, F.lit("-01"))).cast("date")


def month_label(first_day: Column) -> Column:
    """'listopad 2026'."""
    names = F.array(*[F.lit(name) for name in K.MONTHS_NOMINATIVE])
    return F.concat(F.element_at(names, F.month(first_day)), F.lit(" "), F.year(first_day).cast("string"))


def format_datetime(utc: Column) -> Column:
    """'14 listopada 2026, 09:00' in Warsaw time; empty for null."""
    local = to_local(utc)
    names = F.array(*[F.lit(name) for name in K.MONTHS_GENITIVE])
    text = F.concat(
        F.dayofmonth(local).cast("string"), F.lit(" "), F.element_at(names, F.month(local)), F.lit(" "),
        F.year(local).cast("string"), F.lit(", "), F.date_format(local, "HH:mm"),
    )
    return F.coalesce(text, F.lit(""))


def iso_millis(utc: Column) -> Column:
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


_NEXT_COURSE = "Najbliższy kurs rozpoczyna się"


def course_next_date(text: Column) -> Column:
    """struct(starts_at, reason): set only by exactly one sentence in the exact form."""
    shape = _NEXT_COURSE + r":\s*([0-9]{4}-[0-9]{2}-[0-9]{2} o godz\. [0-9]{2}:[0-9]{2})(?![0-9:])"

    def counted(t: Column) -> Column:
        return F.struct(F.regexp_count(t, F.lit(_NEXT_COURSE)).alias("mentions"), F.regexp_count(t, F.lit(shape)).alias("found"), F.regexp_extract(t, shape, 1).alias("printed"))

    def dated(v: Column) -> Column:
        one = (v["mentions"] == 1) & (v["found"] == 1)
        wall = F.when(one, F.concat(F.replace(v["printed"], F.lit(" o godz. "), F.lit(" ")), F.lit(":00"))).try_cast("timestamp_ntz")
        return let(wall, lambda day: F.struct(v["mentions"].alias("mentions"), v["found"].alias("found"), one.alias("one"), day.alias("day"), instant_of_local(day).alias("instant")))

    def judged(v: Column) -> Column:
        return F.struct(
            F.when(v["one"], v["instant"]).alias("starts_at"),
            F.when(v["mentions"] > 1, F.concat(v["mentions"].cast("string"), F.lit(" start date mentions")))
            .when((v["mentions"] == 1) & (v["found"] != 1), F.lit("start date is not written as YYYY-MM-DD o godz. HH:MM"))
            .when(v["one"] & v["day"].isNull(), F.lit("not a calendar date or time"))
            .when(v["one"] & v["instant"].isNull(), F.lit("local time is ambiguous or skipped at a DST change"))
            .alias("reason"),
        )

    return let(let(let(text, counted), dated), judged)


_DAY = r"(\S+), ([0-9]{1,2})\. (\S+) ([0-9]{4})"
_CLOCK = r"([0-9]{2}):([0-9]{2})"


def _event_instant(fields: Column, first: int) -> Column:
    """struct(at, code) of one printed day and clock: six fields from first on. The weekday must agree with the date."""
    months = F.array(*[F.lit(name) for name in K.MONTHS_NOMINATIVE])
    weekdays = F.array(*[F.lit(name) for name in K.WEEKDAYS])
    weekday, day, month, year, hour, minute = (F.get(fields, F.lit(first + n)) for n in range(6))

    def dated(number: Column) -> Column:
        date = F.concat_ws("-", year, F.lpad(number.cast("string"), 2, "0"), F.lpad(day, 2, "0"))
        clock = F.concat(F.lit(" "), hour, F.lit(":"), minute, F.lit(":00"))
        return let(date, lambda d: F.struct(number.alias("number"), d.try_cast("date").alias("date"), instant_of_local(F.concat(d, clock).try_cast("timestamp_ntz")).alias("at")))

    def checked(v: Column) -> Column:
        code = (
            F.when(v["number"] == 0, F.lit("event-date-month-unknown"))
            .when(v["date"].isNull(), F.lit("event-date-invalid"))
            .when(F.element_at(weekdays, F.weekday(v["date"]) + 1) != weekday, F.lit("event-date-weekday-mismatch"))
            .when(v["at"].isNull(), F.lit("event-date-invalid"))
        )
        return F.struct(v["at"].alias("at"), code.alias("code"))

    return let(let(F.array_position(months, month), dated), checked)


def event_dates(text: Column) -> Column:
    """struct(starts_at, ends_at, code) of a printed event header; lines are joined by a newline.

    The text is bound once and each form is read in one match: its fields, which hold no white space, come as lines."""
    forms = {
        "range": rf"\AOd {_DAY} - {_CLOCK}\nDo {_DAY} - {_CLOCK}\z",
        "same-day": rf"\A{_DAY}, {_CLOCK} - {_CLOCK}\z",
        "start": rf"\A{_DAY}, {_CLOCK}\z",
    }
    day_only = rf"(?m)^(?:(?:Od|Do) )?{_DAY}$"

    def printed(t: Column) -> Column:
        group = lambda form, *numbers: F.split(F.regexp_replace(t, forms[form], "\n".join(f"${n}" for n in numbers)), "\n")
        fields = (
            F.when(t.rlike(forms["range"]), group("range", *range(1, 13)))
            .when(t.rlike(forms["same-day"]), group("same-day", 1, 2, 3, 4, 5, 6, 1, 2, 3, 4, 7, 8))
            .when(t.rlike(forms["start"]), group("start", 1, 2, 3, 4, 5, 6))
        )
        return let(fields, lambda f: F.struct(
            F.when(f.isNotNull(), _event_instant(f, 0)).alias("starts"), F.when(F.size(f) == 12, _event_instant(f, 6)).alias("ends"),
            F.when(f.isNull(), t.rlike(day_only)).alias("day_only"),
        ))

    def judged(v: Column) -> Column:
        return (
            F.when(v["starts"].isNull() & v["day_only"], F.lit("event-date-missing-time"))
            .when(v["starts"].isNull(), F.lit("event-date-unparsed"))
            .when(v["starts"]["code"].isNotNull(), v["starts"]["code"])
            .when(v["ends"]["code"].isNotNull(), v["ends"]["code"])
            .when(v["ends"]["at"] < v["starts"]["at"], F.lit("event-date-end-before-start"))
        )

    def named(v: Column) -> Column:
        return let(
            judged(v),
            lambda code: F.struct(
                F.when(code.isNull(), v["starts"]["at"]).alias("starts_at"),
                F.when(code.isNull(), v["ends"]["at"]).alias("ends_at"),
                code.alias("code"),
            ),
        )

    return let(let(text, printed), named)
