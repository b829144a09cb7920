"""Trading-day and session expressions. "Now" is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXCHANGE_ZONE = "America/New_York"
JUNETEENTH_SINCE = 2022


def _weekday(day: Column) -> Column:
    """Monday 0 .. Sunday 6."""
    return F.weekday(day)


def _nth(year: Column, month: int, weekday: str, n: int) -> Column:
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(F.next_day(F.date_sub(first, 1), weekday), 7 * (n - 1))


def _last(year: Column, month: int, weekday: str) -> Column:
    end = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.next_day(F.date_sub(end, 7), weekday)


def _observed(day: Column) -> Column:
    """Saturday moves to Friday, Sunday to Monday."""
    return F.date_add(day, F.when(_weekday(day) == 5, -1).when(_weekday(day) == 6, 1).otherwise(0))


def easter(year: Column) -> Column:
    """Western Easter by the anonymous Gregorian algorithm (Meeus)."""
    div = lambda x, k: F.floor(x / F.lit(k))
    golden, century, yy = year % 19, div(year, 100), year % 100
    skipped = div(century - div(century + 8, 25) + 1, 3)
    epact = (19 * golden + century - div(century, 4) - skipped + 15) % 30
    leap = (32 + 2 * (century % 4) + 2 * div(yy, 4) - epact - (yy % 4)) % 7
    shift = div(golden + 11 * epact + 22 * leap, 451)
    total = epact + leap - 7 * shift + 114
    return F.make_date(year, div(total, 31).cast("int"), (total % 31 + 1).cast("int"))


def holiday(day: Column) -> Column:
    """Name of the full-day holiday on `day`, else null.

    A fixed-date holiday is looked up within the year of `day` only, so a New
    Year's Day observed on 31 December of the year before is not found.
    """
    year, month = F.year(day), F.month(day)
    fixed = lambda m, d: _observed(F.make_date(year, F.lit(m), F.lit(d)))
    # The cheap half of a rule comes first: a day looks at the formulas of its own month, and only a spring Friday at Easter.
    rules = [
        ("juneteenth", (month == 6) & (year >= JUNETEENTH_SINCE), fixed(6, 19)),
        ("new_year", month == 1, fixed(1, 1)),
        ("mlk_day", month == 1, _nth(year, 1, "Mon", 3)),
        ("washington", month == 2, _nth(year, 2, "Mon", 3)),
        ("good_friday", month.between(3, 4) & (_weekday(day) == 4), F.date_sub(easter(year), 2)),
        ("memorial_day", month == 5, _last(year, 5, "Mon")),
        ("independence_day", month == 7, fixed(7, 4)),
        ("labor_day", month == 9, _nth(year, 9, "Mon", 1)),
        ("thanksgiving", month == 11, _nth(year, 11, "Thu", 4)),
        ("christmas", month == 12, fixed(12, 25)),
    ]
    found = F
    for name, near, when in rules:
        found = found.when(near & (day == when), name)
    return found


def is_weekend(day: Column) -> Column:
    return _weekday(day) >= 5


def is_trading_day(day: Column) -> Column:
    return ~is_weekend(day) & holiday(day).isNull()


def exchange_time(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, EXCHANGE_ZONE)


def _clock(local: Column) -> Column:
    return F.date_format(local, "HH:mm:ss.SSSSSS")


def _open_until(ts: Column, close: str) -> Column:
    local = exchange_time(ts)
    return (~is_weekend(F.to_date(local))
            & _clock(local).between("09:30:00.000000", f"{close}:00.000000"))


def regular_session(ts: Column) -> Column:
    """09:30-16:00 on weekdays, both ends included; holidays are not looked at."""
    return _open_until(ts, "16:00")


def market_open_status(ts: Column) -> Column:
    """The status line's wider window, to 16:10."""
    return _open_until(ts, "16:10")


def scan_paused(ts: Column, pause_days: bool = True, regular_only: bool = True) -> Column:
    if not pause_days:
        return F.lit(False)
    day = F.to_date(exchange_time(ts))
    paused = is_weekend(day) | holiday(day).isNotNull()
    return paused | ~regular_session(ts) if regular_only else paused


def last_deadline(now: Column, times: tuple[str, ...] = ("19:30", "16:30")) -> Column:
    """Latest rebuild time passed by `now`, among today's and yesterday's."""
    local = exchange_time(now)
    day = F.to_date(local)
    points = F.array(*[
        F.to_timestamp(F.concat(F.date_format(F.date_sub(day, back), "yyyy-MM-dd"), F.lit(f" {t}:00")))
        for back in (1, 0) for t in times])
    return F.to_utc_timestamp(F.array_max(F.filter(points, lambda p: p <= local)), EXCHANGE_ZONE)


def snapshot_is_fresh(built_at: Column, now: Column, times: tuple[str, ...] = ("19:30", "16:30")) -> Column:
    return built_at >= last_deadline(now, times)
