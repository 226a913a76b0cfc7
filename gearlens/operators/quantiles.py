"""Exact linear-interpolated quantiles and running counts, distributed.

Spark's exact ``percentile`` merges a map of *all distinct values* of a group
into a single task; for a continuous column over a huge table that does not
fit.  Here a column is reduced to one row per (group, value) and its count, the
rows are dealt out by range of (group, value), and each range's running counts
start at the total of the ranges before it.  A hot value is one row, a hot
group is many ranges, and only the range totals (groups + partitions rows) are
brought together per group.  Interpolation is ``lo + (h - floor h) * (hi - lo)``,
as Spark's ``percentile`` and DuckDB's ``quantile_cont``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gearlens.session import ensure_checkpoint_dir

BELOW, TOTAL = "__below", "__total"


def value_frequencies(df: DataFrame, col: str, by=()) -> DataFrame:
    """(by, __x, __c): each distinct value of ``col`` as double and its count;
    nulls and NaN are left out."""
    x = F.col(col).cast("double")
    data = df.select(*by, x.alias("__x")).where(F.col("__x").isNotNull() & ~F.isnan("__x"))
    return data.groupBy(*by, "__x").agg(F.count(F.lit(1)).alias("__c"))


def running_counts(freq: DataFrame, value: str, count: str, by=(), ranges: int | None = None) -> DataFrame:
    """``freq`` (one row per (by, value)) with ``__below``, the rows of the group
    with a smaller value, and ``__total``, all rows of the group.

    The ranges come from sampled cut points, so they are written to the
    checkpoint folder once: a later step or a lost executor reads the same
    ranges again.  The result does not depend on where they are cut; ``ranges``
    only sets how many there are at most (the session's shuffle partitions by
    default).  Null group keys are a group like any other.
    """
    by = list(by)
    ensure_checkpoint_dir(freq.sparkSession)
    order = [F.col(f"`{c}`") for c in (*by, value)]
    dealt = freq.repartitionByRange(ranges, *order) if ranges else freq.repartitionByRange(*order)
    dealt = dealt.withColumn("__range", F.spark_partition_id()).checkpoint()

    keys = [f"__by{i}" for i in range(len(by))]
    sizes = dealt.groupBy(*[F.col(f"`{b}`").alias(k) for b, k in zip(by, keys)], F.col("__range").alias("__r")) \
        .agg(F.sum(count).alias("__rows"))
    group = Window.partitionBy(*keys)        # one row per range that holds rows of the group
    earlier = group.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "__r", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__offset"),
                         F.sum("__rows").over(group).alias(TOTAL))
    same = reduce(lambda a, b: a & b, [F.col(f"`{b}`").eqNullSafe(F.col(k)) for b, k in zip(by, keys)],
                  F.col("__range") == F.col("__r"))
    placed = dealt.join(sizes, same)
    in_range = Window.partitionBy(*keys, "__r").orderBy(F.col(f"`{value}`")).rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("__offset") + F.coalesce(F.sum(count).over(in_range), F.lit(0))
    return placed.select(*[F.col(f"`{c}`") for c in freq.columns], below.alias(BELOW), F.col(TOTAL))


def quantiles_of(placed: DataFrame, probs, by=(), names=None) -> DataFrame:
    """One row per group, one column per p, from :func:`running_counts` of
    :func:`value_frequencies`: the two order statistics around each rank are the
    values whose running counts span it."""
    probs = list(probs)
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    first, n, x = F.col(BELOW), F.col(TOTAL), F.col("__x")

    def statistic(rank):
        return F.max(F.when((first <= rank) & (rank < first + F.col("__c")), x))

    aggs = [F.max(TOTAL).alias("__n")]
    for i, p in enumerate(probs):
        h = (n - 1) * F.lit(float(p))
        aggs += [statistic(F.floor(h)).alias(f"__lo{i}"), statistic(F.ceil(h)).alias(f"__hi{i}")]
    found = placed.groupBy(*by).agg(*aggs)
    out = []
    for i, (p, name) in enumerate(zip(probs, names)):
        h = (F.col("__n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        out.append((lo + (h - F.floor(h)) * (hi - lo)).alias(name))
    return found.select(*by, *out)


def exact_quantiles(df: DataFrame, col: str, probs, ranges: int | None = None) -> list[float] | None:
    """Quantiles of a whole column as numbers; None if it holds no value."""
    names = [f"q{i}" for i in range(len(list(probs)))]
    r = quantiles_of(running_counts(value_frequencies(df, col), "__x", "__c", ranges=ranges), probs, names=names).first()
    return None if r is None or r[0] is None else list(r)


def quantile_frame(df: DataFrame, col: str, probs, by=None, names=None, exact: bool = True,
                   accuracy: int = 100_000, ranges: int | None = None) -> DataFrame:
    """Quantiles as a DataFrame: one row per group, one column per p.

    ``exact=False`` uses ``percentile_approx`` (a bounded sketch per group)
    and no shuffle of values.
    """
    by = list(by or [])
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    if exact:
        return quantiles_of(running_counts(value_frequencies(df, col, by), "__x", "__c", by, ranges), probs, by, names)
    qs = F.percentile_approx(F.col(col).cast("double"), list(probs), accuracy)
    res = df.where(F.col(col).isNotNull()).groupBy(*by).agg(qs.alias("__q"))
    return res.select(*by, *[F.col("__q")[i].alias(n) for i, n in enumerate(names)])
