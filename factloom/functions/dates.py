"""Date and time cleaning expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(c, pattern, group).try_cast("int")


def _rolled(y: Column, m: Column, d: Column) -> Column:
    """Year, month, day with overflowing months and days carried over (Feb 31 is Mar 2 or 3)."""
    return F.date_add(F.add_months(F.make_date(y, F.lit(1), F.lit(1)), m - 1), d - 1)


def full_year(y: Column, this_year: int) -> Column:
    """Two-digit years go to 19yy when 20yy lies more than ten years after `this_year`."""
    return F.when(y >= 100, y).when(y + 2000 > this_year + 10, y + 1900).otherwise(y + 2000)


def clean_date(c: Column, this_year: int) -> Column:
    """Mixed date strings (Y-M-D, M/D/Y, M.D.Y, M/D/yy) to a date; anything else is null."""
    t = F.translate(c, ".", "/")
    ymd = r"^(\d{4})-(\d?\d)-(\d?\d)$"
    mdy = r"^(0?[1-9]|1[012])/(0?[1-9]|[12][0-9]|3[01])/(\d{4}|\d{2})$"
    year = _part(t, mdy, 3)
    year = F.when(F.length(F.regexp_extract(t, mdy, 3)) == 2, full_year(year, this_year)).otherwise(year)
    return (F.when(t.rlike(ymd), _rolled(_part(t, ymd, 1), _part(t, ymd, 2), _part(t, ymd, 3)))
            .when(t.rlike(mdy), _rolled(year, _part(t, mdy, 1), _part(t, mdy, 2))))


def _ymd_number(n: Column) -> Column:
    """YYYYMMDD number to a date, null when there is no such day."""
    s = n.cast("string")
    return F.concat_ws("-", s.substr(1, 4), s.substr(5, 2), s.substr(7, 2)).try_cast("date")


def clean_epoch_date(c: Column) -> Column:
    """A long holding YYYYMMDDHHMM, YYYYMMDD, epoch seconds or epoch milliseconds to a UTC date."""
    long_form = c.between(100001010000, 999912312359)
    clock_ok = ((F.floor(c / 100) % 100) <= 23) & ((c % 100) <= 59)
    from_long = F.when(long_form & clock_ok, _ymd_number(F.floor(c / 10000)))
    from_short = F.when(c.between(10000101, 99991231), _ymd_number(c))
    day = F.when(c < 1000000000000, F.floor(c / 86400)).otherwise(F.floor(c / 86400000))
    return F.coalesce(from_long, from_short, F.date_add(F.lit("1970-01-01").cast("date"), day.try_cast("int")))


def julian_day(d: Column) -> Column:
    """Day number with 0001-01-01 as day 1; modulo 7 gives 0 for Sunday."""
    return (F.datediff(d, F.lit("0001-01-01").cast("date")) + 1).cast("long")


def from_julian_day(n: Column) -> Column:
    """The date of a day number; numbers below 1 are null."""
    return F.when(n > 0, F.date_add(F.lit("0001-01-01").cast("date"), (n - 1).cast("int")))


def date_features(d: Column, other: Column, days: int = 0, months: int = 0, years: int = 0) -> dict[str, Column]:
    """Shifted dates, distance to `other`, names, day number and the usual formats."""
    return {
        "plus_days": F.date_add(d, days),
        "plus_months": F.add_months(d, months),
        "plus_years": F.add_months(d, 12 * years),
        "days_between": F.datediff(d, other).cast("long"),
        "day_name": F.date_format(d, "EEEE"),
        "month_name": F.date_format(d, "MMMM"),
        "day_of_week": (julian_day(d) % 7).cast("int"),
        "julian": julian_day(d),
        "short_format": F.date_format(d, "M/d/yy"),
        "full_format": F.date_format(d, "M/d/yyyy"),
        "sql_format": F.date_format(d, "yyyy-MM-dd"),
        "long_format": F.date_format(d, "MMM d, yyyy"),
        "weekday_format": F.date_format(d, "EEE, MMM d, yyyy"),
    }


def ymdhm_to_timestamp(c: Column, zone: str) -> Column:
    """A YYYYMMDDHHMM wall-clock number in `zone` to an instant; 0 and impossible values are null."""
    return F.try_make_timestamp(
        F.floor(c / 100000000).cast("int"), (F.floor(c / 1000000) % 100).cast("int"),
        (F.floor(c / 10000) % 100).cast("int"), (F.floor(c / 100) % 100).cast("int"),
        (c % 100).cast("int"), F.lit(0), F.lit(zone))


def diff_minutes(start: Column, subtract: Column, zone: str) -> Column:
    """Whole minutes from `subtract` to `start`, both YYYYMMDDHHMM wall-clock numbers in `zone`."""
    gap = F.unix_seconds(ymdhm_to_timestamp(start, zone)) - F.unix_seconds(ymdhm_to_timestamp(subtract, zone))
    return (gap / 60).cast("long")


def parse_hhmm(c: Column) -> Column:
    """Time text such as `5pm`, `0530`, `5:30 PM` to an HHMM number; -1 when it is not a time."""
    t = F.btrim(c, F.lit("".join(chr(i) for i in range(33))))
    digits = F.regexp_extract(t, r"^([0-9]*)", 1)
    n = F.length(digits)
    hour_len = F.when(n == 3, 1).when(n == 4, 2).otherwise(n)
    hour = F.substring(t, F.lit(1), hour_len).try_cast("int")
    rest = F.substring(t, hour_len + 1, F.lit(1000))
    parted = rest.rlike(r"^[:. -]")
    tail = F.when(parted, F.substring(rest, F.lit(2), F.lit(1000))).otherwise(rest)
    minutes = F.regexp_extract(tail, r"^([0-9][0-9]?)", 1).try_cast("int")
    has_minutes = tail.rlike(r"^[0-9]")
    # The half-day mark follows two minute characters, or comes first; one space before it is skipped.
    after = F.when(has_minutes, F.substring(tail, 3, 1000)).otherwise(tail)
    mark = F.regexp_extract(after, r"^ ?(.)", 1)
    hour24 = (F.when(F.lower(mark) == "p", F.when(hour < 12, hour + 12).otherwise(hour))
              .otherwise(F.when(hour == 12, 0).otherwise(hour)))
    return (F.when(c.isNull() | (n == 0) | (n > 4), -1)
            .when(rest == "", hour * 100)
            .when(tail == "", -1)
            .when(has_minutes & (F.length(tail) <= 2), hour * 100 + minutes)
            .otherwise(hour24 * 100 + F.coalesce(minutes, F.lit(0)))).cast("int")


def format_ampm(c: Column) -> Column:
    """HHMM number as `5:30 PM`; noon is PM."""
    hour, minute = F.floor(c / 100), c % 100
    shown = F.when(hour > 12, hour - 12).when(hour == 0, 12).otherwise(hour)
    return F.concat(shown.cast("string"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0"),
                    F.when(hour >= 12, F.lit(" PM")).otherwise(F.lit(" AM")))
