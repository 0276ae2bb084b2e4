"""Scalar column functions (parsing, cleaning, arithmetic helpers)."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "col", "to_ts", "time_us", "readable_time", "DAY_US", "duration_us", "day_of", "parse_date",
    "strip_chars", "parse_number", "zero_if_missing", "round_half_even",
    "label", "ratio", "flag", "domain_name", "any_of",
    "lit_ts", "lit_date", "DOMAIN_PATTERN",
]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_ts(v: dt.datetime | str) -> Column:
    """A ``timestamp_ntz`` literal (the logs carry wall-clock time).

    Built from text, so neither the Python process's nor the session's time
    zone can shift it.
    """
    if isinstance(v, str):
        v = dt.datetime.fromisoformat(v)
    return F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz")


def lit_date(v: dt.date | str) -> Column:
    if isinstance(v, str):
        v = dt.date.fromisoformat(v)
    return F.lit(v).cast("date")


# Time of day as text: two digits each for hour, minute and second, or one, and a fraction on wish.
CANONICAL_TIME = r"^(?:(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d{1,9})?|24:00:00(?:\.0{1,9})?)$"
TIME_OF_DAY = r"^(?:(?:[01]?\d|2[0-3]):[0-5]?\d:[0-5]?\d(?:\.\d{1,9})?|24:00:00(?:\.0{1,9})?)$"
DAY_US = 86_400_000_000


def readable_time(time_c: str | Column) -> Column:
    """Whether a text is a time of day, ``HH:mm:ss[.fraction]`` from 00:00:00 to 24:00:00."""
    return col(time_c).cast("string").rlike(TIME_OF_DAY)


def time_us(time_c: str | Column) -> Column:
    """Microseconds from midnight to a time of day; NULL if the text is none.

    Two-digit parts, the usual case, are read at their fixed places; digits beyond
    the microsecond are cut off.
    """
    t = col(time_c).cast("string")
    at = lambda start: F.substring(t, start, 2).try_cast("bigint")
    part = lambda k: F.split_part(t, F.lit(":"), F.lit(k))
    us = lambda h, m, s, fraction: (
        ((h * 60 + m) * 60 + s) * 1_000_000 + F.rpad(F.substring(fraction, 1, 6), 6, "0").try_cast("bigint"))
    loose = us(part(1).try_cast("bigint"), part(2).try_cast("bigint"),
               F.split_part(part(3), F.lit("."), F.lit(1)).try_cast("bigint"), F.split_part(t, F.lit("."), F.lit(2)))
    return F.when(t.rlike(CANONICAL_TIME), us(at(1), at(4), at(7), F.substring(t, 10, 6))) \
            .when(t.rlike(TIME_OF_DAY), loose)


def to_ts(date_c: str | Column, time_c: str | Column) -> Column:
    """Date plus ``HH:mm:ss[.ffffff]`` time-of-day text -> ``timestamp_ntz``.

    ``24:00:00`` is the next day's midnight.  NULL if either part is NULL or the
    text is no time of day (a later hour, a negative part); ``unreadable_times``
    counts such rows.
    """
    return F.timestamp_add("MICROSECOND", time_us(time_c), col(date_c).cast("date").cast("timestamp_ntz"))


def duration_us(start: str | Column, end: str | Column) -> Column:
    """``end - start`` as integer microseconds (NULL if either is NULL)."""
    return F.timestamp_diff("MICROSECOND", col(start), col(end))


def day_of(ts: str | Column) -> Column:
    """Day of a ``timestamp_ntz`` as a date (``date_trunc`` would make it zoned)."""
    return F.to_date(col(ts))


# Leading month-day-year of a text, as R's as.Date(x, "%m-%d-%Y") reads it
# (leading blanks skipped, anything after the year ignored).
LEADING_MDY = r"^\s*(\d{1,2}-\d{1,2}-\d{4})"


def parse_date(c: str | Column, fmt: str = "M-d-yyyy") -> Column:
    """Text -> date; text that does not parse gives NULL.

    For the default month-day-year format only the leading date is read, so
    ``"06-10-2014 00:00"`` gives 2014-06-10 as in R; other formats must match
    the whole text.
    """
    if fmt == "M-d-yyyy":
        return F.try_to_date(F.regexp_extract(col(c), LEADING_MDY, 1), fmt)
    return F.try_to_date(col(c), fmt)


def strip_chars(c: str | Column, chars: str) -> Column:
    """Remove every occurrence of each character in ``chars``."""
    return F.translate(col(c), chars, "")


def parse_number(c: str | Column) -> Column:
    """Text -> double; anything R's ``as.numeric`` would not read gives NULL.

    That is an optional sign, decimal digits with an optional fraction and
    exponent, or Inf / NaN, with blanks around.

    ``try_cast`` trims blanks and gives NULL for text that is not a number; the
    only spellings it accepts that R does not are a trailing ``d``/``f`` type
    suffix (``1d``, ``2.5F``), rejected here by a last-character test rather
    than a per-row regular expression.
    """
    s = col(c).cast("string")
    t = F.lower(F.trim(s))
    suffixed = F.substring(t, -1, 1).isin("d", "f") & ~t.isin("inf", "+inf", "-inf")
    # Empty text (the usual "missing") is decided here: a failed cast is slow.
    return F.when((t != "") & ~suffixed, s.try_cast("double"))


def zero_if_missing(c: str | Column) -> Column:
    """NULL and NaN (both "missing" to R's ``is.na``) -> 0."""
    return F.coalesce(F.nanvl(col(c), F.lit(None).cast("double")), F.lit(0.0))


def round_half_even(c: str | Column) -> Column:
    """Round to integer, ties to even (R's ``round``): 2.5 -> 2, 3.5 -> 4."""
    return F.rint(col(c))


def label(*cols: str | Column, sep: str = " - ") -> Column:
    """Values pasted into one text label; a missing value reads ``NA``."""
    return F.concat_ws(sep, *[F.coalesce(col(c).cast("string"), F.lit("NA")) for c in cols])


def ratio(num: str | Column, den: str | Column, on_zero: str = "ieee") -> Column:
    """``num / den`` as doubles with a defined result for a zero denominator.

    ``on_zero="ieee"`` gives R's answers: 0/0 = NaN, x/0 = +-Inf.  ``"null"``
    gives NULL.  Spark's ANSI division would raise instead.
    """
    n = col(num).cast("double")
    d = col(den).cast("double")
    if on_zero == "null":
        return F.when(d != 0, n / d)
    if on_zero != "ieee":
        raise ValueError(f"on_zero must be 'ieee' or 'null', not {on_zero!r}")
    return (F.when(d != 0, n / d)
             .when(d.isNull() | n.isNull(), F.lit(None).cast("double"))
             .when(F.isnan(n) | (n == 0), F.lit(float("nan")))
             .when(n > 0, F.lit(float("inf")))
             .otherwise(F.lit(float("-inf"))))


def flag(pred: Column) -> Column:
    """0/1 integer flag; a NULL predicate counts as false (SQL CASE)."""
    return F.when(pred, F.lit(1)).otherwise(F.lit(0))


def any_of(preds: list[Column]) -> Column:
    return reduce(or_, preds)


# Host of a URL: optional scheme, optional userinfo, then the host up to the
# first ':', '/', '?' or '#'.  A bare "a.com/x" has no scheme and still matches,
# and so does the scheme-relative "//a.com/x".
DOMAIN_PATTERN = r"^(?:(?:[a-z][a-z0-9+.-]*:)?//)?(?:[^@/?#]*@)?([^:/?#]*)"


def domain_name(url: str | Column) -> Column:
    """Content URL -> domain name.

    Lower-case host without scheme, userinfo, port, path or one leading
    ``www.``; NULL when there is no host.
    """
    host = F.regexp_extract(F.lower(F.trim(col(url))), DOMAIN_PATTERN, 1)
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", host)
