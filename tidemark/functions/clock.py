"""Calendar rules of the admission layer. Times are wall-clock (TIMESTAMP_NTZ) in the market's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: When the window of a trade date opens, on the calendar day before, and closes.
WINDOW_OPENS, CUTOFF = "15:30:00", "08:59:59"
TIME = r"^([01]?\d|2[0-3]):[0-5]?\d:[0-5]?\d$"


def at_time(day: Column, time: str | Column) -> Column:
    """A day and H:M:S as a time; null if the time isn't one."""
    time = F.lit(time) if isinstance(time, str) else F.trim(time)
    part = lambda i: F.lpad(F.get(F.split(time, ":"), F.lit(i)), 2, "0")
    text = F.concat(day.cast("date").cast("string"), F.lit(" "), part(0), F.lit(":"), part(1), F.lit(":"), part(2))
    return F.when(time.rlike(TIME), text.cast("timestamp_ntz"))


def window_start(trade_date: Column) -> Column:
    return at_time(F.date_sub(trade_date, 1), WINDOW_OPENS)


def cutoff(trade_date: Column) -> Column:
    return at_time(trade_date, CUTOFF)


def next_trading_day(day: Column) -> Column:
    """The next day that is no Saturday or Sunday; holidays are not known."""
    return F.date_add(day, F.when(F.dayofweek(day) == 6, 3).when(F.dayofweek(day) == 7, 2).otherwise(1))


def previous_day(day: Column) -> Column:
    return F.date_sub(day, 1)


def effective_known_at(known_at: Column, available_from: Column) -> Column:
    return F.greatest(F.coalesce(known_at, available_from), available_from)


def is_available(available_from: Column, cut: Column) -> Column:
    """Inclusive; what has no time is not available."""
    return F.coalesce(available_from <= cut, F.lit(False))


#: Names of zones in mail times, and months.
ZONES = {"GMT": "+00:00", "UT": "+00:00", "UTC": "+00:00", "Z": "+00:00", "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00"}
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
MAIL = r"(?i)^(?:[a-z]{3,9},?\s+)?(\d{1,2})[ -]([a-z]{3})[a-z]*[ -](\d{4}|\d{2})\s+(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?(?:\s+([+-]\d{4}|[a-z]{1,5}))?(?:\s+\(.*\))?$"


def mail_time(text: Column, local) -> Column:
    """An RFC 2822 time: the weekday and the seconds may be absent, the zone an offset or one of ZONES. Without a zone, with an unknown one or with -0000 it is a ``local`` time."""
    part = lambda k: F.regexp_extract(text, MAIL, k)
    two = lambda c: F.lpad(c, 2, "0")
    month = F.position(F.lower(F.substring(part(2), 1, 3)), F.lit(MONTHS))
    number = two(F.when((month > 0) & (month % 3 == 1), (month + 2) / 3).cast("int").cast("string"))
    year = F.when(F.length(part(3)) == 4, part(3)).when(part(3) > "68", F.concat(F.lit("19"), part(3))).otherwise(F.concat(F.lit("20"), part(3)))
    stamp = F.concat(year, F.lit("-"), number, F.lit("-"), two(part(1)), F.lit("T"), two(part(4)), F.lit(":"), two(part(5)), F.lit(":"), two(F.coalesce(F.nullif(part(6), F.lit("")), F.lit("00"))))
    said = F.upper(part(7))
    offset = F.when(said.rlike(r"^[+-]\d{4}$") & (said != "-0000"), F.concat(F.substring(said, 1, 3), F.lit(":"), F.substring(said, 4, 2)))
    offset = F.coalesce(offset, F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])[said])
    known = text.rlike(MAIL)
    return F.when(known & offset.isNotNull(), F.try_to_timestamp(F.concat(stamp, offset))).when(known, local(F.try_to_timestamp(stamp)))


def web_time(text: Column, zone: str | None = None) -> Column:
    """A date alone, with dashes, slashes or dots, means the end of that day; ISO and RFC 2822 times parse; relative ages give null.

    zone: that of the market, in which dates and times without an offset are read; else the session's.
    """
    clean = F.trim(text)
    local = lambda t: F.to_utc_timestamp(t, zone) if zone else t
    day = F.regexp_replace(clean, "[/.]", "-")
    offset = clean.rlike(r"([+-]\d{2}:?\d{2}|Z)$")
    iso = clean.rlike(r"^\d{4}-\d{2}-\d{2}[T ]")
    dated = clean.rlike(r"^\d{4}(-\d{2}-|/\d{2}/|\.\d{2}\.)\d{2}$")
    stamp = F.try_to_timestamp(clean)
    return F.when(dated, local(F.try_to_timestamp(F.concat(day, F.lit("T23:59:59"))))).when(iso, F.when(offset, stamp).otherwise(local(stamp))).otherwise(mail_time(clean, local))


def date_in_range(text: Column, lower: Column | None = None, upper: Column | None = None) -> Column:
    """Whether a date's text is within both bounds; a value or a bound that is no date admits nothing. Without bounds all is admitted."""
    iso = lambda c: F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))
    if lower is None and upper is None:
        return F.lit(True)
    rule = iso(text).isNotNull()
    if lower is not None:
        rule = rule & (iso(text) >= iso(lower))
    if upper is not None:
        rule = rule & (iso(text) <= iso(upper))
    return F.coalesce(rule, F.lit(False))


def time_at_most(text: Column, upper: Column) -> Column:
    """Whether a time's text is not after ``upper``; what is no time is not."""
    return F.coalesce(F.try_to_timestamp(text) <= upper, F.lit(False))
