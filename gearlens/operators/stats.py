"""Statistical tests.

The heavy part of each test (counts, ranks, sums, moments) runs on Spark as
aggregations over *pre-aggregated* tables -- value frequencies or
(group, value) counts -- so a hot value or group costs one row, not a third
of the table.  Only one small row per test reaches the driver, where the tail
probability is evaluated (``functions.distributions``).

Rows whose feature or target is null are left out of a test.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gearlens import schema as S
from gearlens.functions.distributions import chi2_sf, f_sf, t_sf_two_sided
from gearlens.operators.common import sorted_small
from gearlens.operators.quantiles import BELOW, TOTAL, running_counts
from gearlens.session import ensure_checkpoint_dir

ALPHA = 0.05


def _q(c: str) -> str:
    return f"`{c}`"


# ---------------------------------------------------------------------------
# Mid-ranks from a frequency table
# ---------------------------------------------------------------------------
def mid_ranks(freq: DataFrame, value: str, count: str = "c", by=(), buckets: int | None = None) -> DataFrame:
    """Add ``rank``: the average 1-based rank of each distinct value within
    its ``by`` group, from a table with one row per (by, value) and its count.

    One plan for every size: running counts by range of (group, value), see
    :func:`running_counts`.  ``buckets`` is the number of ranges; the result
    does not depend on it.
    """
    placed = running_counts(freq, value, count, by, buckets)
    rank = F.col(BELOW) + (F.col(_q(count)) + 1) / F.lit(2.0)
    return placed.withColumn("rank", rank).drop(BELOW, TOTAL)


# ---------------------------------------------------------------------------
# T1 Spearman
# ---------------------------------------------------------------------------
def spearman_stat(df: DataFrame, a: str, b: str, buckets: int | None = None) -> DataFrame:
    """T1 on Spark: one row (n, rho).  Pairs with a null are left out.

    Rows are first reduced to (a, b, count) and written, so the source is read
    once; ranks come from the marginal frequencies; rho is the weighted Pearson
    correlation of the ranks.
    """
    both = (df.select(F.col(_q(a)).alias("a"), F.col(_q(b)).alias("b"))
              .where(F.col("a").isNotNull() & F.col("b").isNotNull()))
    ensure_checkpoint_dir(df.sparkSession)
    pairs = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).checkpoint()
    ra = mid_ranks(pairs.groupBy("a").agg(F.sum("c").alias("c")), "a", "c", buckets=buckets) \
        .select("a", F.col("rank").alias("ra"))
    rb = mid_ranks(pairs.groupBy("b").agg(F.sum("c").alias("c")), "b", "c", buckets=buckets) \
        .select("b", F.col("rank").alias("rb"))
    j = pairs.join(ra, "a").join(rb, "b")
    # mid-ranks of n rows have the mean (n + 1) / 2, ties or not: one aggregation is enough
    c, n = F.col("c"), F.sum("c").cast("double")
    offset = n * (n + 1) / 2 * (n + 1) / 2
    cross, own_a, own_b = (F.sum(c * F.col(x) * F.col(y)) - offset for x, y in (("ra", "rb"), ("ra", "ra"), ("rb", "rb")))
    return j.agg(F.sum("c").alias("n"), F.try_divide(cross, F.sqrt(own_a) * F.sqrt(own_b)).alias("rho"))


def _spearman_p(rho, n):
    if rho is None or n is None or n < 3 or (isinstance(rho, float) and math.isnan(rho)):
        return float("nan")
    if abs(rho) >= 1.0:
        return 0.0
    t = rho * math.sqrt((n - 2) / (1.0 - rho * rho))
    return t_sf_two_sided(t, n - 2)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman rank correlation with its two-sided p (t, n-2)."""
    r = spearman_stat(df, a, b).first()
    n, rho = r["n"], r["rho"]
    return _result(df, [("spearman", a, b, int(n or 0), rho, _spearman_p(rho, n))],
                   "test string, a string, b string, n long, rho double, p_value double")


def _result(df, rows, schema):
    return df.sparkSession.createDataFrame(rows, schema)


# ---------------------------------------------------------------------------
# T2 Kruskal-Wallis, T3 t-test, T4 trends (grouped; many features at once)
# ---------------------------------------------------------------------------
def _long(df: DataFrame, features, target: str) -> DataFrame:
    """(feature, value, y) for every feature; null features/targets left out,
    values as text so features of any type stack."""
    from gearlens.operators.profile import as_number
    features = list(features)
    base = df.select(*[F.col(_q(f)).cast("string").alias(f) for f in features],
                     as_number(df, target).alias("y"))
    long = base.unpivot(["y"], features, "feature", "value")
    return long.where(F.col("value").isNotNull() & F.col("y").isNotNull())


def value_counts(long: DataFrame) -> DataFrame:
    """(feature, value, y) -> count: the one pre-aggregation every grouped
    test starts from (map-side combined, so a hot group is one row per y).
    Written to the checkpoint folder: the tests use it several times and the
    source is read once."""
    ensure_checkpoint_dir(long.sparkSession)
    return long.groupBy("feature", "value", "y").agg(F.count(F.lit(1)).alias("c")).checkpoint()


def kruskal_stats(long: DataFrame | None = None, cnt: DataFrame | None = None) -> DataFrame:
    """T2 per feature from (feature, value, y): H with tie correction,
    n groups, N.  Runs on (feature, value, y) counts."""
    cnt = cnt if cnt is not None else value_counts(long)
    ties = cnt.groupBy("feature", "y").agg(F.sum("c").alias("t"))
    ranks = mid_ranks(ties, "y", "t", by=["feature"])
    per_group = (cnt.join(ranks.select("feature", "y", "rank"), ["feature", "y"])
                    .groupBy("feature", "value")
                    .agg(F.sum("c").alias("n_i"), F.sum(F.col("c") * F.col("rank")).alias("r_i")))
    tie_sum = ties.groupBy("feature").agg(F.sum(F.pow(F.col("t"), 3) - F.col("t")).alias("tie"))
    agg = per_group.groupBy("feature").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n_i").alias("N"),
        F.sum(F.col("r_i") * F.col("r_i") / F.col("n_i")).alias("sr"))
    agg = agg.join(tie_sum, "feature")
    N = F.col("N").cast("double")
    h = F.lit(12.0) / (N * (N + 1)) * F.col("sr") - 3 * (N + 1)
    # one row, or all values tied: no statistic
    corr = F.lit(1.0) - F.try_divide(F.col("tie"), N * N * N - N)
    return agg.select("feature", "k", "N", F.try_divide(h, corr).alias("statistic"))


def moments(long: DataFrame) -> DataFrame:
    """(feature, value) -> n, mean, sample variance (partial aggregation)."""
    return long.groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.var_samp("y").alias("var"))


def moments_from_counts(cnt: DataFrame) -> DataFrame:
    """The same moments from (feature, value, y, c): mean first, then the
    centred sum of squares (two hash aggregations and a join on the small
    per-group table; no window, so a hot group is still split across tasks)."""
    m = cnt.groupBy("feature", "value").agg(F.sum("c").alias("n"),
                                            (F.sum(F.col("c") * F.col("y")) / F.sum("c")).alias("mean"))
    # one row per (feature, value): grows with feature cardinality, so the
    # join strategy is left to AQE (broadcast when the runtime size is small)
    ss = (cnt.join(m, ["feature", "value"])
             .groupBy("feature", "value", "n", "mean")
             .agg(F.sum(F.col("c") * F.pow(F.col("y") - F.col("mean"), 2)).alias("ss")))
    return ss.select("feature", "value", "n", "mean",
                     F.when(F.col("n") > 1, F.col("ss") / (F.col("n") - 1)).alias("var"))


def t_stats(mom: DataFrame) -> DataFrame:
    """T3 per feature with exactly two groups: pooled-variance t (group 1 is
    the smaller value as text) and df."""
    w = Window.partitionBy("feature").orderBy("value")
    two = mom.withColumn("__i", F.row_number().over(w))
    g1 = two.where("__i = 1").select("feature", F.col("n").alias("n1"), F.col("mean").alias("m1"), F.col("var").alias("v1"))
    g2 = two.where("__i = 2").select("feature", F.col("n").alias("n2"), F.col("mean").alias("m2"), F.col("var").alias("v2"))
    j = g1.join(g2, "feature")
    dfree = F.col("n1") + F.col("n2") - 2
    # a group of one row has no variance and adds nothing; without any variation there is no statistic
    spread = (F.col("n1") - 1) * F.coalesce("v1", F.lit(0.0)) + (F.col("n2") - 1) * F.coalesce("v2", F.lit(0.0))
    sp2 = F.try_divide(spread, dfree.cast("double"))
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(sp2 * (F.lit(1.0) / F.col("n1") + F.lit(1.0) / F.col("n2"))))
    return j.select("feature", t.alias("statistic"), dfree.cast("double").alias("df"))


def anova_stats(mom: DataFrame, min_rows: int = 2) -> DataFrame:
    """T5 per feature: one-way F over the groups with at least ``min_rows``
    rows (the groups that are kept are the ones tested); k, N."""
    kept = mom.where(F.col("n") >= min_rows)
    grand = kept.groupBy("feature").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("__gm"))
    g = kept.join(grand, "feature")
    agg = g.groupBy("feature").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("N"),
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("__gm"), 2)).alias("ssb"),
        F.sum((F.col("n") - 1) * F.col("var")).alias("ssw"))
    d1 = F.col("k") - 1
    d2 = F.col("N") - F.col("k")
    f = F.try_divide(F.col("ssb") * d2, F.col("ssw") * d1)       # null without variation inside the groups
    return agg.select("feature", "k", "N", F.when(F.col("k") >= 2, f).alias("statistic"),
                      d1.cast("double").alias("df1"), d2.cast("double").alias("df2"))


def kruskal_wallis(df: DataFrame, feature: str, target: str = S.TARGET) -> DataFrame:
    """Kruskal-Wallis H of ``target`` across the values of ``feature``."""
    r = kruskal_stats(_long(df, [feature], target)).first()
    if r is None or r["k"] < 2 or r["statistic"] is None:
        return _result(df, [(feature, int(r["k"]) if r else 0, None, None, None)],
                       "feature string, k long, statistic double, df double, p_value double")
    h, k = r["statistic"], r["k"]
    return _result(df, [(feature, int(k), h, float(k - 1), chi2_sf(h, k - 1))],
                   "feature string, k long, statistic double, df double, p_value double")


def t_test(df: DataFrame, feature: str, target: str = S.TARGET) -> DataFrame:
    """Two-sample pooled-variance t of ``target`` between the two values
    of ``feature``."""
    r = t_stats(moments(_long(df, [feature], target))).first()
    if r is None or r["statistic"] is None:
        return _result(df, [(feature, None, None, None)], "feature string, statistic double, df double, p_value double")
    return _result(df, [(feature, r["statistic"], r["df"], t_sf_two_sided(r["statistic"], r["df"]))],
                   "feature string, statistic double, df double, p_value double")


TREND_SCHEMA = ("feature string, n_groups long, test string, statistic double, df double, "
                "p_value double, verdict string")


def temporal_trend_stats(df: DataFrame, features, target: str = S.TARGET) -> DataFrame:
    """T4 on Spark: per feature, group count and the statistic of
    Kruskal-Wallis (more than 2 groups) or the t-test (2 groups)."""
    # one scan: every statistic derives from the (feature, value, y) counts
    cnt = value_counts(_long(df, features, target))
    mom = moments_from_counts(cnt)
    ngroups = mom.groupBy("feature").agg(F.count(F.lit(1)).alias("n_groups"))
    kw = kruskal_stats(cnt=cnt).select("feature", F.col("statistic").alias("h"))
    tt = t_stats(mom).select("feature", F.col("statistic").alias("t"), F.col("df").alias("t_df"))
    out = ngroups.join(kw, "feature", "left").join(tt, "feature", "left")
    return out.select(
        "feature", "n_groups",
        F.when(F.col("n_groups") > 2, "Kruskal-Wallis").when(F.col("n_groups") == 2, "t-test").alias("test"),
        F.when(F.col("n_groups") > 2, F.col("h")).when(F.col("n_groups") == 2, F.col("t")).alias("statistic"),
        F.when(F.col("n_groups") > 2, (F.col("n_groups") - 1).cast("double"))
         .when(F.col("n_groups") == 2, F.col("t_df")).alias("df"))


def temporal_trends(df: DataFrame, features=(S.HOUR, S.MON, S.DOW, S.REG_MONTH, S.REG_YEAR),
                    target: str = S.TARGET) -> DataFrame:
    """T4: trend test per feature with p-value and verdict (p < 0.05).
    A feature with fewer than two groups, or a target without variation, gets no
    statistic."""
    rows = temporal_trend_stats(df, features, target).collect()   # one row per feature
    got = {r["feature"]: r for r in rows}
    out = []
    for f in features:
        r = got.get(f)
        if r is None or r["n_groups"] < 2:
            out.append((f, int(r["n_groups"]) if r else 0, None, None, None, None, "not enough groups"))
            continue
        if r["statistic"] is None:
            out.append((f, int(r["n_groups"]), r["test"], None, None, None, "no variation"))
            continue
        p = chi2_sf(r["statistic"], r["df"]) if r["test"] == "Kruskal-Wallis" else t_sf_two_sided(r["statistic"], r["df"])
        out.append((f, int(r["n_groups"]), r["test"], r["statistic"], r["df"], p,
                    "significant" if p < ALPHA else "not significant"))
    return _result(df, out, TREND_SCHEMA)


ANOVA_SCHEMA = "feature string, n_groups long, statistic double, df1 double, df2 double, p_value double, verdict string"


def anova(df: DataFrame, cols, target: str = S.TARGET, min_rows: int = 2) -> DataFrame:
    """T5: one-way ANOVA of ``target`` per column; a column where fewer than
    two groups have ``min_rows`` rows is skipped."""
    cols = list(cols)
    rows = {r["feature"]: r for r in anova_stats(moments(_long(df, cols, target)), min_rows).collect()}
    out = []
    for c in cols:
        r = rows.get(c)
        if r is None or r["k"] < 2 or r["statistic"] is None:
            out.append((c, int(r["k"]) if r else 0, None, None, None, None, "skipped"))
            continue
        p = f_sf(r["statistic"], r["df1"], r["df2"])
        out.append((c, int(r["k"]), r["statistic"], r["df1"], r["df2"], p,
                    "significant" if p < ALPHA else "not significant"))
    return _result(df, out, ANOVA_SCHEMA)


# ---------------------------------------------------------------------------
# T6 variance inflation
# ---------------------------------------------------------------------------
def vif(df: DataFrame, cols, add_constant: bool = True) -> DataFrame:
    """Variance inflation factor of each column (statsmodels convention
    with a constant term).  The columns are assembled to a vector, so wide blocks
    of flags cost one Gram-matrix aggregation and not k(k+1)/2 expressions; only
    the k x k matrix is inverted on the driver.

    Columns that take part in an exact linear relation get infinity, and so does
    the constant then; the other columns keep their finite factor.  A table with a constant column or fewer than two
    complete rows gives infinity everywhere.  Rows with a null in any column are
    left out."""
    cols = list(cols)
    parts = [f"__v{i}" for i in range(len(cols))]
    x = df.select(*[F.col(_q(c)).cast("double").alias(p) for c, p in zip(cols, parts)]).dropna()
    v = VectorAssembler(inputCols=parts, outputCol="v").transform(x).select("v").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = v.count()        # the summary of no rows is an error
        s = v.agg(Summarizer.metrics("mean", "std").summary(F.col("v")).alias("s")).first()["s"] if n >= 2 else None
        usable = s is not None and bool(np.all(s["std"].toArray() > 0))
        # scale-free form: correlation matrix R and z = mean / sd, so columns of
        # very different scales (odometer vs. month) do not hurt the inversion
        corr = Correlation.corr(v, "v").first()[0].toArray() if usable else None
    finally:
        v.unpersist()
    vifs, const_vif = [float("inf")] * len(cols), float("inf")
    if usable:
        z = s["mean"].toArray() / s["std"].toArray()
        vifs, const_vif = _inflation(corr, z, n)
    out = [("const", const_vif)] if add_constant else []
    out += [(c, float(f)) for c, f in zip(cols, vifs)]
    return _result(df, out, "feature string, vif double")


def _inflation(corr: np.ndarray, z: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Factors of the columns and of the constant.  The residual of a column
    on the others is 1 over its diagonal entry of the inverse; with exact
    relations the pseudo-inverse has it for the columns outside of them."""
    size, axes = np.linalg.eigh(corr)
    null = size <= 1e-12 * size.max()
    inverse = (axes[:, ~null] / size[~null]) @ axes[:, ~null].T
    related = np.abs(axes[:, null]).max(axis=1, initial=0.0) > 1e-6
    const = float("inf") if null.any() else 1.0 + n / (n - 1) * float(z @ inverse @ z)
    return np.where(related, np.inf, np.diag(inverse)), const


# ---------------------------------------------------------------------------
# T7 kernel density
# ---------------------------------------------------------------------------
def kde(df: DataFrame, col: str, grid_size: int = 200, cut: float = 3.0, bins: int | None = None) -> DataFrame:
    """Gaussian kernel density on an even grid, Scott bandwidth
    (n^(-1/5) times the sample deviation), grid from min - cut*bw to
    max + cut*bw.  Distinct values with their counts each emit ``grid_size``
    contributions that are summed per grid point (partial aggregation).

    ``bins``: linear binning first -- values are moved to the centre of one of
    ``bins`` equal-width bins over [min, max] (error at most half a bin width),
    so the kernel work is bounded by bins x grid_size whatever the row count.
    """
    x = F.col(_q(col)).cast("double")
    vals = df.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    st = vals.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("sd"),
                  F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    n, sd = st["n"], st["sd"]
    if not n or sd is None or sd == 0 or math.isnan(sd):
        return _result(df, [], "grid_index int, x double, density double")
    bw = sd * n ** (-1.0 / 5.0)
    start = st["lo"] - cut * bw
    step = ((st["hi"] + cut * bw) - start) / (grid_size - 1)
    if bins:
        width = (st["hi"] - st["lo"]) / bins if st["hi"] > st["lo"] else 1.0
        k = F.least(F.floor((F.col("x") - F.lit(st["lo"])) / F.lit(width)), F.lit(bins - 1))
        vals = vals.select((F.lit(st["lo"]) + (k + 0.5) * F.lit(width)).alias("x"))
    freq = vals.groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    g = F.explode(F.sequence(F.lit(0), F.lit(grid_size - 1))).alias("grid_index")
    contrib = freq.select("x", "c", g)
    gx = F.lit(start) + F.col("grid_index") * F.lit(step)
    z = (gx - F.col("x")) / F.lit(bw)
    term = F.col("c") * F.exp(F.lit(-0.5) * z * z)
    norm = 1.0 / (n * bw * math.sqrt(2.0 * math.pi))
    out = (contrib.groupBy("grid_index").agg(F.sum(term).alias("s"))
                   .select(F.col("grid_index").cast("int").alias("grid_index"),
                           (F.lit(start) + F.col("grid_index") * F.lit(step)).alias("x"),
                           (F.col("s") * F.lit(norm)).alias("density")))
    return sorted_small(out, "grid_index")


__all__ = ["mid_ranks", "spearman", "spearman_stat", "kruskal_wallis", "kruskal_stats", "t_test", "t_stats",
           "temporal_trends", "temporal_trend_stats", "anova", "anova_stats", "moments", "moments_from_counts",
           "value_counts", "vif", "kde"]
