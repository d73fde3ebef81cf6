"""Dates as an Indian ledger writes them, and the April-to-March fiscal calendar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Day numbers a spreadsheet serial date may take, and the day they count from.
SERIAL_LOW, SERIAL_HIGH, SERIAL_ORIGIN = 20_000, 80_000, "1899-12-30"
MONTH_NAMES = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def fiscal_start_year(day: Column) -> Column:
    """Calendar year in which the fiscal year holding ``day`` began."""
    return F.year(F.add_months(day.cast("date"), -3))


def fiscal_year(day: Column) -> Column:
    start = fiscal_start_year(day)
    return F.format_string("FY%d-%02d", start, F.pmod(start + 1, F.lit(100)))


def fiscal_period(day: Column) -> Column:
    """April is period 1, March is period 12."""
    return F.month(F.add_months(day.cast("date"), -3))


def closing_day(start_year: Column) -> Column:
    return F.make_date(start_year + 1, F.lit(3), F.lit(31))


def dmy(day: Column) -> Column:
    return F.date_format(day, "dd-MM-yyyy")


def iso_to_dmy(text: Column) -> Column:
    """``2025-03-31`` as ``31-03-2025``; text of any other shape stays as it is."""
    return F.when(
        text.rlike(r"^[^-]*-[^-]*-[^-]*$"), F.regexp_replace(text, r"^([^-]*)-([^-]*)-([^-]*)$", "$3-$2-$1")
    ).otherwise(text)


def has_clock(stamp: Column) -> Column:
    return (F.hour(stamp) != 0) | (F.minute(stamp) != 0)


def _day_first(low: Column) -> Column:
    """Lower-case day-first text rewritten year first, one replacement after another; other text stays as it is."""
    month = F.array_position(F.array(*map(F.lit, MONTH_NAMES)), F.regexp_extract(low, r"^\d{1,2}[-/. ]([a-z]{3})", 1))
    named = F.concat(
        F.regexp_extract(low, r"^\d{1,2}", 0), F.lit("-"), month.cast("string"),
        F.regexp_extract(low, r"^\d{1,2}[-/. ][a-z]{3,9}(.*)$", 1),
    )
    s = F.when(low.rlike(r"^\d{1,2}[-/. ][a-z]"), named).otherwise(low)
    s = F.regexp_replace(s, r"^(\d{1,2})[-/. ](\d{1,2})[-/., ]+(7[6-9]|[89]\d)(?!\d)", "$1-$2-19$3")
    s = F.regexp_replace(s, r"^(\d{1,2})[-/. ](\d{1,2})[-/., ]+(\d{2})(?!\d)", "$1-$2-20$3")
    # Only one reading is a real date: the month comes first here.
    s = F.regexp_replace(s, r"^(0?\d|1[0-2])[-/. ](1[3-9]|[2-9]\d)(?!\d)", "$2-$1")
    s = F.regexp_replace(s, r"^(\d{1,2})[-/. ](\d{1,2})[-/., ]+(\d{4})[ t,]*", "$3-$2-$1 ")
    return F.trim(F.regexp_replace(s, r"\s*[ap]m$", ""))


def parse_ledger_date(text: Column) -> Column:
    """Text to TIMESTAMP_NTZ, each value on its own terms.

    Year-first text is read year-month-day, a bare number in the serial range is a
    spreadsheet day number, everything else is read day-first. Unreadable text is null.
    A cheap look at the shape comes before every cast, because a failed cast is slow, and
    all text is brought to one form first, so that it is rewritten and cast once.
    """
    t = F.trim(text)
    number = F.when(t.rlike(r"^\+?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?$"), t.try_cast("double"))
    serial_days = F.date_add(F.lit(SERIAL_ORIGIN).cast("date"), F.floor(number).cast("int"))
    serial_seconds = F.round((number - F.floor(number)) * 86400).cast("bigint")
    serial_stamp = serial_days.cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), serial_seconds.cast("decimal(18,6)")
    )

    low = F.lower(t)
    shape = r"^\d{1,2}[-/. ](?:\d{1,2}|[a-z]{3,9})[-/., ]+(?:\d{4}|\d{2})(?:[ t,]+\d{1,2}:\d{2}(?::\d{2})?\s*(?:[ap]m)?)?$"
    year_first = F.when(t.rlike(r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}"), F.regexp_replace(t, "/", "-")).when(low.rlike(shape), _day_first(low))
    # What a 12-hour clock adds to the hour as written: afternoons before 12, nights at 12 (or later) marked am.
    half_day = (
        F.when(low.rlike(r"[ t,](?:0?\d|1[01]):\d{2}(?::\d{2})?\s*pm$"), 12)
        .when(low.rlike(r"[ t,](?:1[2-9]|2\d):\d{2}(?::\d{2})?\s*am$"), -12)
        .otherwise(0)
    )
    stamp = year_first.try_cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), half_day)
    return F.when(number.between(SERIAL_LOW, SERIAL_HIGH), serial_stamp).otherwise(stamp)
