"""Date and time functions on zone-less timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SECONDS = 86400


def in_zone(col: Column, zone: str, source: str = "UTC") -> Column:
    """Shift a zone-less timestamp before truncation or extraction."""
    return F.convert_timezone(F.lit(source), F.lit(zone), col)


def iso_year(col: Column) -> Column:
    return F.extract(F.lit("yearofweek"), col)


def iso_week_day(col: Column) -> Column:
    return F.weekday(col) + 1


def whole_second(col: Column) -> Column:
    return F.floor(F.extract(F.lit("second"), col)).cast("int")


def trunc(col: Column, unit: str) -> Column:
    """Start of the year/quarter/month/week/day/hour/minute/second; zone-less."""
    return F.date_trunc(unit, col).cast("timestamp_ntz")


def trunc_date_unit(col: Column, unit: str) -> Column:
    """Same for dates; a date has no hour."""
    if unit not in ("year", "quarter", "month", "week", "day"):
        raise ValueError(f"a date cannot be truncated to {unit}")
    return col if unit == "day" else F.trunc(col, unit)


def time_of_day(col: Column) -> Column:
    """Day-time interval since midnight."""
    return col - F.date_trunc("day", col).cast("timestamp_ntz")


def interval_seconds(col: Column) -> Column:
    """Whole interval in seconds, fraction kept."""
    day = F.extract(F.lit("day"), col).cast("bigint")
    hour = F.extract(F.lit("hour"), col)
    minute = F.extract(F.lit("minute"), col)
    second = F.extract(F.lit("second"), col)
    return day * DAY_SECONDS + hour * 3600 + minute * 60 + second.cast("double")


def parse_date(text: Column) -> Column:
    """ISO date with one- or two-digit month and day, else NULL."""
    compact = F.try_to_timestamp(F.when(text.rlike(r"^\d{8}$"), text), F.lit("yyyyMMdd"))
    dashed = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text).try_cast("date")
    return F.coalesce(dashed, compact.cast("date"))


# Fixed patterns of accepted texts.
TIME_PATTERN = r"^(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:[.,](\d{1,6})\d*)?)?$"


def parse_time(text: Column) -> Column:
    """``HH:MM[:SS[.ffffff]]`` as an interval since midnight, else NULL."""
    part = lambda i: F.regexp_extract(text, TIME_PATTERN, i)
    num = lambda i: F.coalesce(part(i).try_cast("int"), F.lit(0))
    secs = num(3) + F.rpad(part(4), 6, "0").try_cast("int") / F.lit(1e6)
    secs = F.coalesce(secs, num(3).cast("double"))
    ok = text.rlike(TIME_PATTERN) & (num(1) < 24) & (num(2) < 60) & (num(3) < 60)
    return F.when(
        ok, F.make_dt_interval(F.lit(0), num(1), num(2), secs.cast("decimal(18,6)"))
    )


def parse_timestamp(text: Column) -> Column:
    """ISO date and time, ``T`` or blank between, else NULL. With an offset from
    UTC (``Z``, ``+hh``, ``+hhmm``, ``+hh:mm``) the time is moved to UTC."""
    zone = F.regexp_extract(text, r"\s*(Z|[+-]\d{2}(?::?\d{2})?)$", 1)
    zone = F.when(text.rlike(r":\d{1,2}.*(Z|[+-]\d{2}(:?\d{2})?)$") | text.endswith("Z"), zone).otherwise("")
    clock = F.rtrim(F.left(text, F.length(text) - F.length(zone)))
    ok = clock.rlike(r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{1,2}(:\d{1,2}([.,]\d+)?)?$")
    digits = F.regexp_replace(zone, "[^0-9]", "")
    minutes = F.coalesce(F.left(digits, F.lit(2)).try_cast("int"), F.lit(0)) * 60
    minutes = minutes + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
    minutes = F.when(zone.startswith("-"), -minutes).otherwise(minutes)
    local = F.regexp_replace(clock, ",", ".").try_cast("timestamp_ntz")
    return F.when(ok, local - F.make_dt_interval(F.lit(0), F.lit(0), minutes))


def _seconds(number: Column) -> Column:
    """Seconds with a point or comma, cut at microseconds."""
    whole, part = F.regexp_extract(number, r"^(\d*)", 1), F.regexp_extract(number, r"[.,](\d+)$", 1)
    micros = F.rpad(F.left(part, F.lit(6)), 6, "0").try_cast("int")
    return F.coalesce(whole.try_cast("bigint"), F.lit(0)).cast("decimal(18,6)") + F.coalesce(micros, F.lit(0)) / F.lit(1000000).cast("decimal(18,6)")


def _clock_duration(text: Column) -> Column:
    """``[D [day[s][,]] ][-][[HH:]MM:]SS[.ffffff]`` or ``D day[s]``."""
    day_part = r"^(-?\d+)( days?,?)?$"
    words_only = text.rlike(r"^-?\d+ days?$")
    clock = F.when(words_only, F.lit("0")).otherwise(F.substring_index(text, " ", -1))
    days = F.when(words_only, text).otherwise(F.left(text, F.greatest(F.lit(0), F.length(text) - F.length(clock) - 1)))
    days_ok = (days == "") & ~text.startswith(" ") | days.rlike(day_part)
    minus = clock.startswith("-")
    parts = F.reverse(F.split(F.regexp_replace(clock, "^[-+]", ""), ":"))  # seconds first
    whole = F.forall(F.slice(parts, 2, 3), lambda x: x.rlike(r"^\d+$"))
    ok = days_ok & (F.size(parts) <= 3) & whole & F.get(parts, F.lit(0)).rlike(r"^\d+([.,]\d{1,12})?$")
    unit = lambda i, size: F.coalesce(F.get(parts, F.lit(i)).try_cast("bigint"), F.lit(0)) * size
    total = _seconds(F.get(parts, F.lit(0))) + unit(1, 60) + unit(2, 3600)
    total = F.when(minus, -total).otherwise(total)
    count = F.coalesce(F.regexp_extract(days, day_part, 1).try_cast("int"), F.lit(0))
    return F.when(ok, F.make_dt_interval(count, F.lit(0), F.lit(0), total.cast("decimal(18,6)")))


def _iso_duration(text: Column) -> Column:
    """``[-]PnDTnHnMn.nS``, each part optional."""
    body = F.regexp_replace(text, "^[-+]?P", "")
    date, clock = F.split_part(body, F.lit("T"), F.lit(1)), F.split_part(body, F.lit("T"), F.lit(2))
    number = r"\d+(?:[.,]\d+)?"
    ok = text.rlike(r"^[-+]?P") & date.rlike(rf"^(?:{number}D)?$") & clock.rlike(rf"^(?:{number}H)?(?:{number}M)?(?:{number}S)?$")
    part = lambda of, mark, size: _seconds(F.regexp_extract(of, rf"({number}){mark}", 1)) * size
    total = part(date, "D", 86400) + part(clock, "H", 3600) + part(clock, "M", 60) + part(clock, "S", 1)
    total = F.when(text.startswith("-"), -total).otherwise(total)
    return F.when(ok, F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), total.cast("decimal(18,6)")))


def parse_duration(text: Column) -> Column:
    """Clock form, day and clock form, or ISO 8601 as an interval, else NULL."""
    return F.coalesce(_clock_duration(text), _iso_duration(text))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, not once per use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _whole_months(then: Column, now: Column) -> Column:
    months = (F.year(now) - F.year(then)) * 12 + (F.month(now) - F.month(then))
    day, today = F.dayofmonth(then), F.dayofmonth(now)
    behind = (day > today) | ((day == today) & (time_of_day(then) > time_of_day(now)))
    return months - behind.cast("int")


def _seconds_left(then: Column, now: Column, months: Column) -> Column:
    """Seconds after the whole months.

    Fixed rule: the pivot keeps the day up to the month's last day, and
    February always counts 28.
    """
    start = F.add_months(F.trunc(F.to_date(then), "month"), months)
    longest = F.when(F.month(start) == 2, 28).otherwise(F.dayofmonth(F.last_day(start)))
    day = F.least(F.dayofmonth(then), longest)
    pivot = F.date_add(start, day - 1).cast("timestamp_ntz") + time_of_day(trunc(then, "second"))
    base = F.when(months == 0, then).otherwise(pivot)
    return F.floor(interval_seconds(now - base)).cast("bigint")


UNIT_NAMES = ("year", "month", "week", "day", "hour", "minute")


def elapsed(then: Column, now: Column, depth: int = 2) -> Column:
    """Text such as ``1 year, 2 months``: the first non-zero unit and the
    adjacent non-zero ones, at most ``depth``; ``0 minutes`` for the future.
    Number and unit are joined by a no-break space.

    Months are calendar months; the day of the pivot is clamped to the month.
    """
    if depth < 1:
        raise ValueError("depth must be positive")
    names = F.array(*[F.lit(n) for n in UNIT_NAMES])
    nothing = F.lit("0\u00a0minutes")

    def counts(months: Column) -> Column:
        def split(rest: Column) -> Column:
            week = 7 * DAY_SECONDS
            parts = [months / 12, months % 12, rest / week, rest % week / DAY_SECONDS, rest % DAY_SECONDS / 3600, rest % 3600 / 60]
            return F.array(*[F.floor(p).cast("bigint") for p in parts])

        return let(_seconds_left(then, now, months), split)

    def words(values: Column) -> Column:
        text = F.transform(values, lambda v, i: F.concat(
            v.cast("string"), F.lit("\u00a0"), F.get(names, i), F.when(v == 1, "").otherwise("s")))
        some = F.transform(values, lambda v: v > 0)
        first = F.array_position(some, True).cast("int")

        def run(start: Column) -> Column:
            stop = F.array_position(F.slice(some, start, F.lit(depth)), False).cast("int")
            size = F.when(stop == 0, depth).otherwise(stop - 1)
            return F.array_join(F.slice(text, start, size), ", ")

        return F.when(first == 0, nothing).otherwise(let(F.greatest(first, F.lit(1)), run))

    return F.when(now <= then, nothing).otherwise(let(let(_whole_months(then, now), counts), words))
