"""Moments relative to now, and parsing of post times."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

AsOf = dt.datetime | str | Column | None


def whole_second(as_of: AsOf = None) -> Column:
    """``as_of`` (default: the query's current time) without its fraction of a second, in UTC.

    A datetime or text becomes a literal, so that bounds derived from it fold into constants and
    reach partition pruning and the scan.
    """
    if as_of is None:
        moment = F.current_timestamp()
    elif isinstance(as_of, Column):
        moment = as_of
    else:
        if isinstance(as_of, dt.datetime):
            if as_of.tzinfo is not None:
                as_of = as_of.astimezone(dt.timezone.utc).replace(tzinfo=None)
            as_of = as_of.isoformat(sep=" ")
        moment = F.lit(as_of).cast("timestamp")
    return F.date_trunc("second", moment)


def minutes_before(as_of: AsOf, minutes: int) -> Column:
    return whole_second(as_of) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(int(minutes)))


def days_before(as_of: AsOf, days: int) -> Column:
    """Calendar day ``days`` before ``as_of``."""
    return F.date_sub(F.to_date(whole_second(as_of)), days)


def like_column(moment: Column, data_type: T.DataType) -> Column:
    """``moment`` in the type of the column it is compared with, so that the column needs no cast."""
    return moment.cast(data_type)


def not_after_now(moment: Column) -> Column:
    """``moment``, or now if it lies in the future.

    Event time for watermarks: one post with a wrong clock would otherwise move the watermark past
    all posts to come.
    """
    return F.least(moment, F.current_timestamp())


# Fixed value: the month names of post times.
_MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"


def post_time(text: Column) -> Column:
    """Parse a post's time: ISO text, or ``Wed Oct 10 20:19:24 +0000 2018``.

    The second form has fixed columns, so its parts are put in ISO order for the fast cast.
    """
    month = F.floor((F.instr(F.lit(_MONTHS), F.substring(text, 5, 3)) + 2) / 3)
    iso = F.concat(
        F.substring(text, 27, 4),
        F.lit("-"),
        F.lpad(month.cast("string"), 2, "0"),
        F.lit("-"),
        F.substring(text, 9, 2),
        F.lit(" "),
        F.substring(text, 12, 8),
        F.substring(text, 21, 3),
        F.lit(":"),
        F.substring(text, 24, 2),
    )
    named = F.substring(text, 4, 1) == " "
    return F.when(named, iso).otherwise(text).try_cast("timestamp")
