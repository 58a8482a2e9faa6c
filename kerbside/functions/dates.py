"""Date functions (DAT1-4). ``as_of`` is always an argument, never the clock."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def ts_lit(v: dt.datetime | Column) -> Column:
    """A timestamp literal read in the *session* time zone.

    ``F.lit(datetime)`` converts a naive Python datetime with the Python
    process's local zone; text cast to timestamp uses the session zone
    (UTC here), whatever the process zone is.
    """
    if isinstance(v, Column):
        return v
    return F.lit(v.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def as_date(as_of: dt.date | str | Column) -> Column:
    if isinstance(as_of, Column):
        return as_of.cast("date")
    return F.lit(as_of).cast("date") if isinstance(as_of, dt.date) else F.to_date(F.lit(as_of))


def job_status(date_col: Column | str, as_of: dt.date | str | Column) -> Column:
    """DAT1: Expired before today, Upcoming after, Today on the day."""
    d = F.col(date_col) if isinstance(date_col, str) else date_col
    today = as_date(as_of)
    return F.when(d < today, "Expired").when(d > today, "Upcoming").otherwise("Today")


def long_date(date_col: Column | str) -> Column:
    """DAT2: ``02 January 1995``."""
    return F.date_format(date_col, "dd MMMM yyyy")


def short_date(date_col: Column | str) -> Column:
    """DAT3: ``Mon, Jan 2`` (fixed English locale)."""
    return F.date_format(date_col, "E, MMM d")


def week_start(d: Column) -> Column:
    """Monday of the week containing ``d``."""
    return F.date_trunc("week", d).cast("date")


def calendar_start(as_of: dt.date | str | Column) -> Column:
    """DAT4: Monday of the week of today − 7 days."""
    return week_start(F.date_sub(as_date(as_of), 7))


def calendar_last_day(as_of: dt.date | str | Column) -> Column:
    """DAT4: Sunday of the week of today + 28 days."""
    return F.date_add(week_start(F.date_add(as_date(as_of), 28)), 6)
