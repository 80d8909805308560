"""Time scalar functions.

Timestamps are carried as ``TIMESTAMP_NTZ`` holding UTC wall-clock time, so
nothing depends on the session time zone.  Exchange-local time comes from
``convert_timezone`` which is DST-aware.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
MARKET_TZ = "America/New_York"
MARKET_CLOSE_HOUR = 16            # publications at/after 16:00 local -> next day
MARKET_OPEN_SECOND = 9 * 3600 + 30 * 60   # 09:30:00 local
MARKET_CLOSE_SECOND = 16 * 3600           # 16:00:00 local (exclusive)
# Accepted ISO-8601 shapes: extended or basic date, optional time (HH, HH:MM,
# HH:MM:SS, fraction), optional offset Z / +HH / +HH:MM / +HHMM.
ISO_PATTERN = (r"^(\d{4})-?(\d{2})-?(\d{2})"
               r"(?:[T ](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,9}))?)?)?)?"
               r"(Z|z|[+-]\d{2}(?::?\d{2})?)?$")
# ---------------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_of_date(as_of) -> Column:
    """Run date as a DATE column (``None`` -> current date)."""
    return _as_date(as_of)


def _as_date(as_of) -> Column:
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of.cast("date")
    if isinstance(as_of, (_dt.date, _dt.datetime)):
        return F.lit(as_of.isoformat()[:10]).cast("date")
    return F.lit(str(as_of)).cast("date")


def parse_iso_utc(raw: Column | str) -> Column:
    """tolerant ISO-8601 parse to a UTC ``TIMESTAMP_NTZ``.

    ``Z`` means UTC; an explicit offset is subtracted; a value without offset
    is taken as UTC.  Anything else (empty, 'garbage', '13:42', '2026', an
    impossible date) gives NULL.

    Cost: one guard, one rewrite to the extended form (basic dates and comma
    fractions included), one trailing-separator trim and one offset extract;
    the wall-clock parse is Spark's own string -> TIMESTAMP_NTZ cast.
    """
    s = _col(raw)
    ok = s.rlike(ISO_PATTERN)
    extended = F.regexp_replace(s, ISO_PATTERN, "$1-$2-$3T$4:$5:$6.$7")
    local_text = F.regexp_replace(extended, r"[T:.]+$", "")
    # string -> TIMESTAMP_NTZ is a pure wall-clock parse (no session zone);
    # impossible dates (Feb 30, hour 24) give NULL
    local = F.when(ok, local_text.try_cast("timestamp_ntz"))
    off = F.regexp_extract(s, ISO_PATTERN, 8)
    hhmm = F.replace(off, F.lit(":"), F.lit(""))
    sign = F.when(off.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    minutes = (F.substring(hhmm, 2, 2).try_cast("int") * 60
               + F.coalesce(F.substring(hhmm, 4, 2).try_cast("int"), F.lit(0)))
    off_minutes = F.when((off == "") | (F.upper(off) == "Z"), F.lit(0)).otherwise(sign * minutes)
    return F.timestamp_add("MINUTE", -off_minutes, local)


def session_date_ts(ts_utc: Column | str, tz: str = MARKET_TZ,
                    close_hour: int = MARKET_CLOSE_HOUR) -> Column:
    """trading session a UTC instant can affect.

    Local hour >= close_hour moves to the next calendar day, then Saturday and
    Sunday roll to Monday.  No holiday calendar.  NULL in -> NULL out.
    """
    local = F.convert_timezone(F.lit("UTC"), F.lit(tz), _col(ts_utc))
    base = F.date_add(F.to_date(local),
                      F.when(F.hour(local) >= close_hour, 1).otherwise(0))
    wd = F.weekday(base)
    return F.date_add(base, F.when(wd >= 5, 7 - wd).otherwise(0))


def session_date(raw: Column | str, as_of=None, tz: str = MARKET_TZ,
                 close_hour: int = MARKET_CLOSE_HOUR) -> Column:
    """session date of a raw ISO string; unparseable -> ``as_of``
    (no weekend roll for the fallback, like the feed path it mirrors)."""
    return F.coalesce(session_date_ts(parse_iso_utc(raw), tz, close_hour),
                      _as_date(as_of))


def in_trading_hours(ts_utc: Column | str, tz: str = MARKET_TZ,
                     open_second: int = MARKET_OPEN_SECOND,
                     close_second: int = MARKET_CLOSE_SECOND) -> Column:
    """Mon-Fri and open <= local time < close."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(tz), _col(ts_utc))
    sod = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    return (F.weekday(local) < 5) & (sod >= open_second) & (sod < close_second)


def iso_seconds_z(ts_utc: Column | str) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ`` text of a UTC timestamp."""
    return F.date_format(_col(ts_utc), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def days_from(as_of, n: int) -> Column:
    """``as_of + n`` days (negative n goes back)."""
    return F.date_add(_as_date(as_of), F.lit(n))
