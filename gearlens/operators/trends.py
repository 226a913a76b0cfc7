"""Volumes, rolling windows and orderings.

Null group keys are left out everywhere (pandas ``groupby`` semantics).
``count_col`` chooses between counting non-null ids (``count(col)``) and rows
(``count(*)``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gearlens import schema as S
from gearlens.functions.timefx import as_time, month_name, weekday_name
from gearlens.operators.common import sorted_small
from gearlens.operators.prep import first_present
from gearlens.operators.profile import histogram


def _count(count_col: str | None):
    return F.count(F.col(count_col)) if count_col else F.count(F.lit(1))


def daily_volume(df: DataFrame, ts: str = S.TIME, count_col: str | None = S.KEY) -> DataFrame:
    """Inspections per calendar date -> (inspection_date, n_inspections)."""
    d = F.to_date(as_time(df, ts))
    return (df.select(d.alias(S.DATE), *([F.col(count_col)] if count_col else []))
              .where(F.col(S.DATE).isNotNull())
              .groupBy(S.DATE)
              .agg(_count(count_col).alias("n_inspections")))


def avg_daily_volume(df: DataFrame, ts: str = S.TIME, count_col: str | None = S.KEY) -> DataFrame:
    """Mean of the daily counts -> one row (avg_daily_inspections)."""
    return daily_volume(df, ts, count_col).agg(F.avg("n_inspections").alias("avg_daily_inspections"))


def monthly_volume(df: DataFrame, ts: str = S.TIME, count_col: str | None = None) -> DataFrame:
    """Count per month number and full month name, ordered by number."""
    t = as_time(df, ts)
    out = (df.select(F.month(t).alias(S.MONTH_NUM), month_name(t).alias(S.MONTH_NAME),
                     *([F.col(count_col)] if count_col else []))
             .where(F.col(S.MONTH_NUM).isNotNull())
             .groupBy(S.MONTH_NUM, S.MONTH_NAME)
             .agg(_count(count_col).alias("n_inspections")))
    return sorted_small(out, S.MONTH_NUM)     # at most 12 rows


def avg_volume_by_weekday(df: DataFrame, ts: str = S.TIME, count_col: str | None = S.KEY) -> DataFrame:
    """A10: count per (date, weekday), then the mean count per weekday."""
    t = as_time(df, ts)
    per_day = (df.select(F.to_date(t).alias(S.DATE), weekday_name(t).alias(S.DOW),
                         *([F.col(count_col)] if count_col else []))
                 .where(F.col(S.DATE).isNotNull())
                 .groupBy(S.DATE, S.DOW)
                 .agg(_count(count_col).alias("n")))
    return per_day.groupBy(S.DOW).agg(F.avg("n").alias("avg_inspections"))


def hourly_volume(df: DataFrame, ts: str = S.TIME, count_col: str | None = None) -> DataFrame:
    """Inspections per hour of day, ordered by hour."""
    h = F.hour(as_time(df, ts))
    out = (df.select(h.alias(S.HOUR), *([F.col(count_col)] if count_col else []))
             .where(F.col(S.HOUR).isNotNull())
             .groupBy(S.HOUR)
             .agg(_count(count_col).alias("n_inspections")))
    return sorted_small(out, S.HOUR)          # at most 24 rows


def daily_intensity_histogram(df: DataFrame, bins: int = 30, ts: str = S.TIME,
                              count_col: str | None = None) -> DataFrame:
    """Equal-width histogram of the daily counts (how often a day has X)."""
    return histogram(daily_volume(df, ts, count_col), "n_inspections", bins)


def vintage(df: DataFrame, year_cols=(S.REG_YEAR, S.REG_YEAR_ALT)) -> DataFrame:
    """Count per registration year (first present column), ascending."""
    yc = first_present(df, list(year_cols))
    out = (df.select(F.col(yc).alias("registration_year"))
             .where(F.col("registration_year").isNotNull())
             .groupBy("registration_year").agg(F.count(F.lit(1)).alias("n_inspections")))
    return sorted_small(out, "registration_year")   # one row per calendar year


def registration_month_volume(df: DataFrame, month_col: str = S.REG_MONTH,
                              count_col: str | None = S.KEY) -> DataFrame:
    """Count per registration month."""
    out = (df.select(F.col(month_col).alias("registration_month"), *([F.col(count_col)] if count_col else []))
             .where(F.col("registration_month").isNotNull())
             .groupBy("registration_month").agg(_count(count_col).alias("n_inspections")))
    return sorted_small(out, "registration_month")   # at most 12 rows


def group_mean(df: DataFrame, feature: str, target: str = S.TARGET) -> DataFrame:
    """Mean target per non-null value of a feature."""
    return (df.where(F.col(feature).isNotNull())
              .groupBy(feature).agg(F.avg(target).alias("mean_target"))
              .orderBy(feature))


def _rolling(daily: DataFrame, fn, value: str, date_col: str, n: int, out: str) -> DataFrame:
    # The daily table has one row per calendar date, so an unpartitioned
    # window stays small (a century is ~36.5k rows) whatever the input size.
    w = Window.orderBy(date_col).rowsBetween(-(n - 1), 0)
    return daily.withColumn(out, F.when(F.count(value).over(w) == n, fn(value).over(w)))


def rolling_mean(daily: DataFrame, n: int = 7, value: str = "n_inspections",
                 date_col: str = S.DATE, out: str = "rolling_mean") -> DataFrame:
    """Mean of the last n rows (not calendar days); null until n rows."""
    return _rolling(daily, F.avg, value, date_col, n, out)


def rolling_std(daily: DataFrame, n: int = 7, value: str = "n_inspections",
                date_col: str = S.DATE, out: str = "rolling_std") -> DataFrame:
    """Sample standard deviation over the same n-row frame."""
    return _rolling(daily, F.stddev_samp, value, date_col, n, out)


def volume_trend(df: DataFrame, n: int = 7, ts: str = S.TIME, count_col: str | None = S.KEY) -> DataFrame:
    """A7 + W1 + W2: daily volume with its n-row rolling mean and deviation."""
    daily = daily_volume(df, ts, count_col)
    w = Window.orderBy(S.DATE).rowsBetween(-(n - 1), 0)
    full = F.count("n_inspections").over(w) == n
    return daily.select(
        S.DATE, "n_inspections",
        F.when(full, F.avg("n_inspections").over(w)).alias("rolling_mean"),
        F.when(full, F.stddev_samp("n_inspections").over(w)).alias("rolling_std"),
    )


# ---------------------------------------------------------------------------
# Orderings
# ---------------------------------------------------------------------------
def latest_first(df: DataFrame, ts: str = S.TIME, key: str | None = S.KEY) -> DataFrame:
    """O1: newest inspection first, nulls last; key breaks ties."""
    order = [F.col(ts).desc_nulls_last()]
    if key and key in df.columns:
        order.append(F.col(key).asc_nulls_last())
    return df.orderBy(*order)


def sort_by(df: DataFrame, cols, ascending=True, tie_break: str | None = None) -> DataFrame:
    """O2: sort by columns (nulls last, like pandas) with an optional tie-break."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    asc = [ascending] * len(cols) if isinstance(ascending, bool) else list(ascending)
    order = [F.col(c).asc_nulls_last() if a else F.col(c).desc_nulls_last() for c, a in zip(cols, asc)]
    if tie_break and tie_break not in cols:
        order.append(F.col(tie_break).asc_nulls_last())
    return df.orderBy(*order)


def top_k(df: DataFrame, col: str, k: int = 10, tie_break: str | None = None) -> DataFrame:
    """O3: the k largest values (TakeOrderedAndProject: a bounded heap per task)."""
    return sort_by(df, col, False, tie_break).limit(k)
