"""Projection, filtering and cleaning (P1-P16), the 1:1 join (J1), row append.

Column choices (by name, substring or type) are metadata decisions taken on
the driver from ``df.columns``/``df.schema``; they never run a job.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gearlens import schema as S


def _q(c: str) -> str:
    return f"`{c}`"


def drop_columns(df: DataFrame, names) -> DataFrame:
    """Drop by name; absent names are ignored."""
    present = [c for c in names if c in df.columns]
    return df.drop(*present)


def columns_like(df: DataFrame, text: str, case_insensitive: bool = False) -> list[str]:
    if case_insensitive:
        t = text.lower()
        return [c for c in df.columns if t in c.lower()]
    return [c for c in df.columns if text in c]


def drop_columns_like(df: DataFrame, text: str) -> DataFrame:
    """Drop every column whose name contains ``text``."""
    return drop_columns(df, columns_like(df, text))


def select_columns_like(df: DataFrame, text: str, case_insensitive: bool = False, keep=()) -> DataFrame:
    """Keep ``keep`` plus the columns whose name contains ``text``."""
    cols = [c for c in keep if c in df.columns]
    cols += [c for c in columns_like(df, text, case_insensitive) if c not in cols]
    return df.select(*[F.col(_q(c)) for c in cols])


def select_columns_of_type(df: DataFrame, kind: str, keep=()) -> DataFrame:
    """Keep numeric / string / timestamp columns."""
    from gearlens.operators.profile import columns_of_kind
    cols = [c for c in keep if c in df.columns]
    cols += [c for c in columns_of_kind(df, kind) if c not in cols]
    return df.select(*[F.col(_q(c)) for c in cols])


def slot_columns(df: DataFrame, marker: str = S.SLOT_PREFIX) -> list[str]:
    return columns_like(df, marker)


def fill_slots(df: DataFrame, cols=None, value: str = S.SLOT_FILL_VALUE) -> DataFrame:
    """P5: fill nulls of the condition/slot block with a constant."""
    cols = slot_columns(df, "engineTransmission") if cols is None else list(cols)
    return df.select(*[F.coalesce(F.col(_q(c)).cast("string"), F.lit(value)).alias(c) if c in cols
                       else F.col(_q(c)) for c in df.columns])


def fill_unknown(df: DataFrame, cols=None, value: str = S.UNKNOWN_VALUE) -> DataFrame:
    """Null -> 'Unknown', every value as text."""
    cols = slot_columns(df) if cols is None else list(cols)
    return df.select(*[F.coalesce(F.col(_q(c)).cast("string"), F.lit(value)).alias(c) if c in cols
                       else F.col(_q(c)) for c in df.columns])


def iqr_filter(df: DataFrame, col: str, k: float = 1.5, exact: bool = True) -> DataFrame:
    """Keep rows strictly inside (q1 - k*IQR, q3 + k*IQR).

    Quartiles are exact and linear-interpolated over the non-null values;
    rows with a null value are dropped.  The fences become literals, so the
    predicate reaches the parquet scan (PushedFilters).
    """
    from gearlens.operators.profile import fences
    f = fences(df, col, k, exact)
    if f is None:
        return df.limit(0)
    lo, hi = f
    return df.where((F.col(col) > F.lit(lo)) & (F.col(col) < F.lit(hi)))


def filter_weak(df: DataFrame, max_rating: float = S.WEAK_RATING_MAX, col: str = S.TARGET) -> DataFrame:
    """Rating at or below the bound; a null rating is dropped."""
    return df.where(F.col(col) <= F.lit(max_rating))


def first_present(df: DataFrame, names) -> str | None:
    """P10: the first of ``names`` that exists in the table."""
    for n in names:
        if n in df.columns:
            return n
    return None


def present(df: DataFrame, names) -> list[str]:
    return [n for n in names if n in df.columns]


def records_view(df: DataFrame, weak_only: bool = False) -> DataFrame:
    """The records table: five display columns, optional weak filter,
    newest first."""
    from gearlens.operators.trends import latest_first
    mapping = {k: v for k, v in S.RECORD_COLUMNS.items() if k in df.columns}
    keep_key = S.KEY in df.columns
    view = df.select(*([F.col(S.KEY)] if keep_key else []),
                     *[F.col(_q(k)).alias(v) for k, v in mapping.items()])
    rating = S.RECORD_COLUMNS[S.TARGET]
    if weak_only and rating in view.columns:
        view = view.where(F.col(_q(rating)) <= F.lit(S.WEAK_RATING_MAX))
    date_name = S.RECORD_COLUMNS[S.TIME]
    if date_name in view.columns:
        view = latest_first(view, _q(date_name), S.KEY if keep_key else None)
    return view


def cast_rating_int(df: DataFrame, col: str = S.TARGET) -> DataFrame:
    """Truncate the target toward zero (4.9 -> 4)."""
    return df.withColumn(col, F.col(col).cast("double").cast("int"))


def cast_double(df: DataFrame, cols) -> DataFrame:
    """Columns as doubles in place; text that is no number is null."""
    wanted = [c for c in cols if c in df.columns]
    return df.withColumns({c: F.col(_q(c)).cast("string").try_cast("double") if df.schema[c].dataType.typeName() == "string" else F.col(_q(c)).cast("double")
                           for c in wanted})


def head(df: DataFrame, n: int = 5, order=(S.KEY,)) -> DataFrame:
    """First n rows under a total order (never an arbitrary n)."""
    order = [c for c in order if c in df.columns]
    return (df.orderBy(*[F.col(_q(c)) for c in order]) if order else df).limit(n)


_NOT_WORD = re.compile(r"\W")


def sanitize_name(name: str) -> str:
    """P13 on a name: everything but letters and digits of any script becomes an underscore."""
    return _NOT_WORD.sub("_", name)


def sanitize_names(df: DataFrame) -> DataFrame:
    """Every non-alphanumeric character of a column name -> '_'."""
    new = [sanitize_name(c) for c in df.columns]
    dup = {n for n in new if new.count(n) > 1}
    if dup:
        raise ValueError(f"column names collide after sanitising: {sorted(dup)}")
    return df.toDF(*new)


def align_features(df: DataFrame, columns, keep=()) -> DataFrame:
    """The trained feature list in order; a missing feature is 0,
    extra columns are dropped (``keep`` columns are carried in front)."""
    cols = [F.col(_q(c)) for c in keep if c in df.columns]
    cols += [F.col(_q(c)).cast("double").alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in columns]
    return df.select(*cols)


def split_target(df: DataFrame, target: str = S.TARGET) -> tuple[DataFrame, DataFrame]:
    """(features, target); error if the target column is missing."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    return df.drop(target), df.select(target)


def search_records(df: DataFrame, text: str, cols=None) -> DataFrame:
    """Rows where any of ``cols`` contains ``text`` (case-insensitive)."""
    cols = list(cols or df.columns)
    hay = F.lower(F.concat_ws(" ", *[F.col(_q(c)).cast("string") for c in cols]))
    return df.where(hay.contains(text.lower()))


def attach_features(df: DataFrame, feats: DataFrame, key: str = S.KEY, drop=()) -> DataFrame:
    """1:1 inner join of an encoded block to its base rows, on the key
    (never by row position).  Prefer computing the block in the same
    ``select`` when it derives from the same rows."""
    base = drop_columns(df, drop)
    return base.join(feats, key, "inner")


def append_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Stack two tables by column name, duplicates kept."""
    return a.unionByName(b, allowMissingColumns=False)
