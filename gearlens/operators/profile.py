"""Table profiling.

Per-column statistics are computed in **one** aggregation over all columns and
then unpivoted, so a wide table costs one scan, not one job per column.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gearlens import schema as S
from gearlens.functions.timefx import as_time
from gearlens.operators.common import sorted_small
from gearlens.operators.quantiles import exact_quantiles, quantiles_of, running_counts, value_frequencies

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _q(c: str) -> str:
    return f"`{c}`"


def _is_float(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))


def missing(df: DataFrame, c: str):
    """Null, or NaN in a float column (pandas counts both as missing)."""
    col = F.col(_q(c))
    return (col.isNull() | F.isnan(col)) if _is_float(df, c) else col.isNull()


def as_number(df: DataFrame, c: str):
    """The column as double with NaN turned into null."""
    col = F.col(_q(c)).cast("double")
    return F.when(~F.isnan(col), col) if _is_float(df, c) else col


def _unpivot(wide: DataFrame, cols, name: str, value: str) -> DataFrame:
    return wide.unpivot([], [F.col(_q(c)).alias(c) for c in cols], name, value)


def null_rate(df: DataFrame, min_pct: float | None = None, digits: int = 4) -> DataFrame:
    """A1: percent of nulls per column (> min_pct), rounded, most-null first."""
    cols = df.columns
    total = F.count(F.lit(1))
    wide = df.agg(*[(F.lit(100.0) * F.count_if(missing(df, c)) / total).alias(c) for c in cols])
    long = _unpivot(wide, cols, "column_name", "null_pct")
    if min_pct is not None:
        long = long.where(F.col("null_pct") > F.lit(float(min_pct)))
    return sorted_small(long.select("column_name", F.round("null_pct", digits).alias("null_pct")),
                        F.col("null_pct").desc(), "column_name")


def count_sparse_columns(df: DataFrame, min_pct: float = 50.0) -> DataFrame:
    """A2: number of columns whose null share is above ``min_pct``."""
    return null_rate(df, min_pct).agg(F.count(F.lit(1)).alias("n_sparse_columns"))


def schema_profile(df: DataFrame) -> DataFrame:
    """A3: column, type and non-null count (one aggregation)."""
    cols = df.columns
    wide = df.agg(*[F.count(F.col(_q(c))).alias(c) for c in cols])
    long = _unpivot(wide, cols, "column_name", "non_null")
    types = df.sparkSession.createDataFrame(
        [(c, t, i) for i, (c, t) in enumerate(df.dtypes)], "column_name string, data_type string, pos int")
    return sorted_small(long.join(F.broadcast(types), "column_name"), "pos").drop("pos")


def columns_of_kind(df: DataFrame, kind: str) -> list[str]:
    """Column names by kind: numeric, string, timestamp, boolean."""
    def match(dt):
        if kind == "numeric":
            return isinstance(dt, NUMERIC)
        if kind == "string":
            return isinstance(dt, T.StringType)
        if kind == "timestamp":
            return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))
        if kind == "boolean":
            return isinstance(dt, T.BooleanType)
        raise ValueError(kind)
    return [f.name for f in df.schema.fields if match(f.dataType)]


def type_counts(df: DataFrame) -> dict:
    """A4: number of string / numeric / timestamp columns (metadata only)."""
    return {k: len(columns_of_kind(df, k)) for k in ("string", "numeric", "timestamp")}


def is_unique(df: DataFrame, col: str = S.KEY) -> DataFrame:
    """A5: distinct non-null count equals non-null count."""
    return df.agg((F.count_distinct(F.col(col)) == F.count(F.col(col))).alias("is_unique"))


def span_days(df: DataFrame, ts: str = S.TIME) -> DataFrame:
    """Whole 24-hour days between the first and the last time.

    Computed on the time difference, so a wall-clock NTZ value never passes
    through a zone conversion.
    """
    t = as_time(df, ts)
    agg = df.agg(F.min(t).alias("lo"), F.max(t).alias("hi"))
    micros = F.expr("timestampdiff(MICROSECOND, lo, hi)")
    return agg.select(F.floor(micros / F.lit(86_400_000_000)).cast("bigint").alias("span_days"))


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-width counts over [min, max]; the last bin is closed.

    Empty bins are listed with count 0.  A column with a single value uses
    [v - 0.5, v + 0.5] (the usual convention).  The range is a scalar
    subquery (computed once), the counts one partial aggregation.
    """
    x = F.col(col).cast("double")
    vals = df.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    rng = vals.agg(F.min("x").alias("mn"), F.max("x").alias("mx"))
    rng = rng.select(
        F.when(F.col("mn") == F.col("mx"), F.col("mn") - 0.5).otherwise(F.col("mn")).alias("lo"),
        F.when(F.col("mn") == F.col("mx"), F.col("mx") + 0.5).otherwise(F.col("mx")).alias("hi"))
    r = rng.select(F.struct("lo", "hi")).scalar()
    lo, hi = r.getField("lo"), r.getField("hi")
    b = F.least(F.floor((F.col("x") - lo) / (hi - lo) * F.lit(bins)), F.lit(bins - 1)).cast("int")
    counts = vals.select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    # the edges use the same (reused) scalar subquery: no second pass over the input
    edges = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    edges = edges.select(
        "bin",
        (lo + (hi - lo) * F.col("bin") / F.lit(bins)).alias("bin_lo"),
        (lo + (hi - lo) * (F.col("bin") + 1) / F.lit(bins)).alias("bin_hi"))
    # edges has exactly ``bins`` rows
    out = (edges.join(F.broadcast(counts), "bin", "left")
                .select("bin", "bin_lo", "bin_hi", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))
    return sorted_small(out, "bin")


def value_shares(df: DataFrame, col: str = S.TARGET) -> DataFrame:
    """Share of each non-null value among the non-null rows."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.select(F.sum("n")).scalar()     # over the grouped rows: both read the same exchange
    return (counts.select(F.col(col).alias("value"), (F.col("n") / total).alias("share"))
                  .orderBy(F.col("share").desc(), "value"))


def box_summary(df: DataFrame, col: str, by=None, k: float = 1.5) -> DataFrame:
    """Quartiles, 1.5 IQR fences, whiskers (furthest value inside the
    fences), outlier count; per group when ``by`` is given."""
    by = list(by or [])
    # the written (group, value, count) rows serve the quartiles and the whiskers: one read of the input
    placed = running_counts(value_frequencies(df, col, by), "__x", "__c", by)
    q = quantiles_of(placed, [0.25, 0.5, 0.75], by, ["q1", "median", "q3"])
    if by:
        q = q.select("*", (F.col("q3") - F.col("q1")).alias("iqr"))
        q = q.select("*", (F.col("q1") - k * F.col("iqr")).alias("lower_fence"),
                     (F.col("q3") + k * F.col("iqr")).alias("upper_fence"))
        j = placed.join(q, by, "inner")
    else:
        got = q.first()
        if got is None or got["q1"] is None:
            return df.sparkSession.createDataFrame([], "q1 double, median double, q3 double, iqr double, "
                                                   "lower_fence double, upper_fence double, n long, "
                                                   "whisker_low double, whisker_high double, n_outliers long")
        q1, med, q3 = got
        iqr = q3 - q1
        consts = {"q1": q1, "median": med, "q3": q3, "iqr": iqr,
                  "lower_fence": q1 - k * iqr, "upper_fence": q3 + k * iqr}
        j = placed.select("__x", "__c", *[F.lit(v).alias(n) for n, v in consts.items()])
    inside = (F.col("__x") >= F.col("lower_fence")) & (F.col("__x") <= F.col("upper_fence"))
    agg = j.groupBy(*by, "q1", "median", "q3", "iqr", "lower_fence", "upper_fence").agg(
        F.sum("__c").alias("n"),
        F.min(F.when(inside, F.col("__x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("__x"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("__c"))).alias("n_outliers"),
    )
    return agg.orderBy(*by) if by else agg      # as many rows as groups: a range sort, not one task


def fences(df: DataFrame, col: str, k: float = 1.5, exact: bool = True,
           accuracy: int = 100_000) -> tuple[float, float] | None:
    """(lower, upper) 1.5-IQR fences of a column; None when it is all null.
    ``exact=False`` takes the quartiles from ``percentile_approx``."""
    if exact:
        q = exact_quantiles(df, col, [0.25, 0.75])
    else:
        r = df.where(F.col(col).isNotNull()).agg(
            F.percentile_approx(F.col(col).cast("double"), [0.25, 0.75], accuracy).alias("q")).first()
        q = list(r["q"]) if r and r["q"] else None
    if q is None:
        return None
    q1, q3 = q
    iqr = q3 - q1
    return q1 - k * iqr, q3 + k * iqr


def outliers(df: DataFrame, col: str, k: float = 1.5) -> DataFrame:
    """Rows strictly beyond the fences (a value on a fence is inside)."""
    f = fences(df, col, k)
    if f is None:
        return df.limit(0)
    lo, hi = f
    # literal bounds: the filter is pushed into the scan
    return df.where((F.col(col) < F.lit(lo)) | (F.col(col) > F.lit(hi)))


def _corr(a, b):
    """Correlation over the rows where both are present.  Null for a constant
    side, where ``corr`` itself is a division by zero in ANSI mode."""
    both = a.isNotNull() & b.isNotNull()
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b)))


def pearson_matrix(df: DataFrame, cols, wide: bool = False) -> DataFrame:
    """Pairwise-complete Pearson correlations in one aggregation.

    Long form: (col_a, col_b, corr) for every ordered pair, diagonal included;
    a column that is constant over the rows of a pair has no correlation (null).
    """
    cols = list(cols)
    # the upper triangle is aggregated (k(k+1)/2 correlations), then mirrored
    upper = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    aggs = [_corr(as_number(df, cols[i]), as_number(df, cols[j])).alias(f"c{i}_{j}") for i, j in upper]
    w = df.agg(*aggs)
    entries = []
    for i, j in upper:
        entries.append(F.struct(F.lit(cols[i]).alias("col_a"), F.lit(cols[j]).alias("col_b"), F.col(f"c{i}_{j}").alias("corr")))
        if i != j:
            entries.append(F.struct(F.lit(cols[j]).alias("col_a"), F.lit(cols[i]).alias("col_b"), F.col(f"c{i}_{j}").alias("corr")))
    stack = F.explode(F.array(*entries))
    long = w.select(stack.alias("s")).select("s.*")
    if not wide:
        return long
    return long.groupBy("col_a").pivot("col_b", cols).agg(F.first("corr"))


PAIR_SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def pair_sums(df: DataFrame, cols) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) of every pair of columns over the rows that have
    both, values taken from their column's mean.  With x the values (0 where missing)
    and m their presence, all sums are products of the blocks x'x, x'm, (x^2)'m and m'm
    of a task's rows, added up by pair.  A task holds four k x k blocks for k columns;
    NaN counts as missing."""
    k = len(cols)
    numbers = df.select(*[as_number(df, c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    present = [F.when(~F.isnan(f"x{i}"), F.col(f"x{i}")) for i in range(k)]
    means = [m or 0.0 for m in numbers.agg(*[F.avg(p) for p in present]).first()]

    def products(batches):
        n, sx, sxx, sxy = (np.zeros((k, k)) for _ in range(4))
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns]) - means
            m = ~np.isnan(x)
            x, m = np.where(m, x, 0.0), m.astype(float)
            n, sx, sxx, sxy = n + m.T @ m, sx + x.T @ m, sxx + (x * x).T @ m, sxy + x.T @ x
        i, j = np.divmod(np.arange(k * k), k)
        columns = [i, j, n, sx, sx.T, sxx, sxx.T, sxy]
        yield pa.RecordBatch.from_arrays([pa.array(np.ravel(c)) for c in columns], ["i", "j", *PAIR_SUMS])

    schema = "i bigint, j bigint, " + ", ".join(f"{c} double" for c in PAIR_SUMS)
    return numbers.mapInArrow(products, schema).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in PAIR_SUMS])


def pearson_wide(df: DataFrame, cols) -> DataFrame:
    """A20 for blocks of many columns: the rows of :func:`pearson_matrix` (col_a, col_b,
    corr) from :func:`pair_sums`, so that k columns cost one product of blocks and not
    k(k+1)/2 expressions.  No correlation (null) where a side is constant over the
    rows of a pair, or no row has both; no columns, no rows."""
    cols = list(cols)
    if not cols:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    s = pair_sums(df, cols)
    n = F.greatest("n", F.lit(1.0))
    spread = lambda q, t: F.col(q) / n - (F.col(t) / n) * (F.col(t) / n)                            # noqa: E731
    moves = lambda q, t: spread(q, t) > 1e-12 * F.col(q) / n                                        # noqa: E731
    corr = (F.col("sxy") / n - F.col("sx") / n * F.col("sy") / n) / F.sqrt(spread("sxx", "sx") * spread("syy", "sy"))
    names = F.array(*[F.lit(c) for c in cols])
    # its own correlation is 1 but for rounding
    corr = F.when(moves("sxx", "sx") & moves("syy", "sy"), F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(corr))
    return s.select(F.get(names, F.col("i").cast("int")).alias("col_a"), F.get(names, F.col("j").cast("int")).alias("col_b"), corr.alias("corr"))


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns equal to their first row everywhere (no nulls, min = max)."""
    cols = df.columns
    n = F.count(F.lit(1))
    wide = df.agg(*[((F.count(F.col(_q(c))) == n) & (n > 0) &
                     F.min(F.col(_q(c))).eqNullSafe(F.max(F.col(_q(c))))).alias(c) for c in cols])
    long = _unpivot(wide, cols, "column_name", "is_constant")
    return sorted_small(long.where("is_constant").select("column_name"), "column_name")


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of a column, null counted as one value."""
    return df.select(F.col(_q(col)).alias("value")).distinct()


def constant_flags(df: DataFrame, cols=None) -> list[str]:
    """Driver-side list of constant columns (small: one row per column)."""
    d = df if cols is None else df.select(*[F.col(_q(c)) for c in cols])
    return [r["column_name"] for r in constant_columns(d).collect()]


def unpivot_columns(df: DataFrame, cols, name="column_name", value="value") -> DataFrame:
    return _unpivot(df, cols, name, value)


def or_all(conds):
    return reduce(lambda a, b: a | b, conds)
