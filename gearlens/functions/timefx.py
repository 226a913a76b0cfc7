"""Time features (F1-F3) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gearlens import schema as S

# Accepted inspection times: a date with dashes or slashes, alone or with minutes,
# seconds and 1 to 9 fraction digits after a blank or T, and then with a zone.
# Group 1 is the wall-clock time of the sender, without the zone.
TIME_TEXT = r"^(\d{4}([-/])\d{2}\2\d{2}(?:\z|[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?))\s*(?:Z|[+-]\d{2}:?\d{2})?\z"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_time(c: str | Column, time_of_day: str | Column | None = None) -> Column:
    """text -> timestamp; null (not an error) for a text of another form.

    A zone is read but not applied: the clock time of the sender stays; digits
    after the sixth of a fraction are cut.  With ``time_of_day`` the date and the
    time come from two columns and are joined with a space first.

    One pattern checks the form and a cast reads it, so the text is used once and
    the expression stays small when a plan repeats it.
    """
    text = _c(c).cast("string")
    if time_of_day is not None:
        text = F.concat_ws(" ", text, _c(time_of_day).cast("string"))
    return F.translate(F.regexp_extract(F.trim(text), TIME_TEXT, 1), "/", "-").try_cast("timestamp")


def as_time(df: DataFrame, c: str = S.TIME) -> Column:
    """The column as a timestamp: string columns are parsed, others kept."""
    dtype = dict(df.dtypes)[c]
    return parse_time(c) if dtype == "string" else F.col(c)


def weekday_name(c: str | Column) -> Column:
    return F.date_format(_c(c), "EEEE")


def month_name(c: str | Column) -> Column:
    """full month name (``monthname`` gives the short form)."""
    return F.date_format(_c(c), "MMMM")


def time_features(df: DataFrame, ts: str = S.TIME, with_month_name: bool = False) -> DataFrame:
    """add hour, month, date and weekday name of the inspection time."""
    t = as_time(df, ts)
    new = {
        S.HOUR: F.hour(t),
        S.MON: F.month(t),
        S.DATE: F.to_date(t),
        S.DOW: weekday_name(t),
    }
    if with_month_name:
        new[S.MONTH_NUM] = F.month(t)
        new[S.MONTH_NAME] = month_name(t)
    keep = [F.col(f"`{c}`") for c in df.columns if c not in new]
    return df.select(*keep, *[e.alias(n) for n, e in new.items()])
