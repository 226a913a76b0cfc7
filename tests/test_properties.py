"""Properties and scale paths (quantiles and ranks by range)."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gearlens.operators import encode as EN
from gearlens.operators import prep as P
from gearlens.operators import profile as PR
from gearlens.operators import quantiles as Q
from gearlens.operators import stats as ST
from gearlens.plans import model as ML
from gearlens.sources.driver_tables import SLOT_COLUMNS, inspections, table

SF = "/root/testdata/sf0.01"


def _linear_quantile(xs, p):
    xs = sorted(xs)
    h = (len(xs) - 1) * p
    lo, hi = xs[int(np.floor(h))], xs[int(np.ceil(h))]
    return lo + (h - np.floor(h)) * (hi - lo)


@pytest.mark.parametrize("ranges", [None, 1, 40])
def test_exact_quantiles_match_brute_force(spark, ranges):
    rng = random.Random(7)
    rows = [(rng.choice("abc"), rng.lognormvariate(0, 2) if rng.random() > 0.3 else float(rng.randint(0, 5)))
            for _ in range(3000)]
    # one hot group holding most rows, plus a null value, a NaN and a null group
    rows += [("a", 2.5)] * 2000 + [("b", None), ("c", float("nan")), (None, 4.0), (None, 6.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.25, 0.5, 0.75, 0.9]
    got = {r[0]: list(r)[1:] for r in Q.quantile_frame(df, "x", probs, by=["g"], ranges=ranges).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g in got:
        xs = [x for gg, x in rows if gg == g and x is not None and x == x]
        assert got[g] == pytest.approx([_linear_quantile(xs, p) for p in probs], rel=1e-12, abs=1e-12)
    whole = Q.exact_quantiles(df, "x", probs, ranges=ranges)
    xs = [x for _, x in rows if x is not None and x == x]
    assert whole == pytest.approx([_linear_quantile(xs, p) for p in probs], rel=1e-12)


def test_exact_quantiles_many_probabilities_ungrouped(spark):
    rng = random.Random(17)
    xs = [rng.paretovariate(1.5) for _ in range(4000)] + [1.0] * 1500
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    probs = [i / 50 for i in range(51)]
    got = Q.exact_quantiles(df, "x", probs, ranges=9)
    assert got == pytest.approx([_linear_quantile(xs, p) for p in probs], rel=1e-12)


def test_exact_quantiles_without_values(spark):
    empty = spark.createDataFrame([("a", None)], "g string, x double")
    assert Q.exact_quantiles(empty, "x", [0.5]) is None
    assert Q.quantile_frame(empty, "x", [0.5], by=["g"]).count() == 0
    assert PR.fences(empty, "x") is None
    assert PR.box_summary(empty, "x").count() == 0


def test_quantiles_of_very_many_groups(spark):
    # more groups than any driver-side list was allowed to hold before
    df = spark.range(0, 360_000).select((F.col("id") % 120_000).alias("g"), F.col("id").cast("double").alias("x"))
    q = Q.quantile_frame(df, "x", [0.5], by=["g"])
    assert q.count() == 120_000
    assert q.where(F.col("q50") != F.col("g") + 120_000).count() == 0


def test_spearman_ranges_equal_single_range(spark):
    rng = random.Random(9)
    rows = [(float(rng.randint(0, 300)), rng.gauss(0, 1)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double")
    whole = ST.spearman_stat(df, "a", "b", buckets=1).first()
    ranged = ST.spearman_stat(df, "a", "b", buckets=15).first()
    assert ranged["n"] == whole["n"] == 3000
    assert ranged["rho"] == pytest.approx(whole["rho"], rel=1e-12)


def test_kruskal_matches_plain_ranks(spark):
    rng = random.Random(13)
    rows = [(rng.choice("pqrs"), float(rng.randint(0, 500))) for _ in range(4000)]
    long = spark.createDataFrame(rows, "value string, y double").withColumn("feature", F.lit("f"))
    got = ST.kruskal_stats(long).first()
    assert (got["k"], got["N"]) == (4, 4000)
    ys = np.array([y for _, y in rows])
    order = np.sort(ys)
    rank = (np.searchsorted(order, ys, "left") + np.searchsorted(order, ys, "right") + 1) / 2
    groups = np.array([g for g, _ in rows])
    n = len(rows)
    h = 12 / (n * (n + 1)) * sum(rank[groups == g].sum() ** 2 / (groups == g).sum() for g in "pqrs") - 3 * (n + 1)
    ties = np.unique(ys, return_counts=True)[1].astype(float)
    # H is a difference of large terms: summation order moves its last digits
    assert got["statistic"] == pytest.approx(h / (1 - (ties ** 3 - ties).sum() / (n ** 3 - n)), rel=1e-9)


def test_mid_ranks_do_not_depend_on_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xy"), float(rng.randint(0, 400))) for _ in range(4000)]
    df = spark.createDataFrame(rows, "g string, v double")
    freq = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    one = {(r.g, r.v): r.rank for r in ST.mid_ranks(freq, "v", "c", by=["g"], buckets=1).collect()}
    many = {(r.g, r.v): r.rank for r in ST.mid_ranks(freq, "v", "c", by=["g"], buckets=7).collect()}
    assert one == many
    for g in "xy":
        vs = sorted(v for gg, v in rows if gg == g)
        for v in set(vs):
            at = [i + 1 for i, w in enumerate(vs) if w == v]
            assert one[(g, v)] == sum(at) / len(at)


def test_histogram_counts_sum_to_rows(spark):
    ev = table(spark, SF, "events")
    assert PR.histogram(ev, "value", 13).agg(F.sum("n")).first()[0] == ev.where(F.col("value").isNotNull()).count()


def test_shares_sum_to_one(spark):
    s = PR.value_shares(inspections(spark, SF)).agg(F.sum("share")).first()[0]
    assert s == pytest.approx(1.0)


def test_one_hot_flags_at_most_one(spark):
    insp = inspections(spark, SF).select("appointmentId", SLOT_COLUMNS[0])
    enc = EN.one_hot_drop_first(insp, [SLOT_COLUMNS[0]], drop_first=False)
    flags = [c for c in enc.columns if c != "appointmentId"]
    assert enc.select(sum(F.col(c) for c in flags).alias("s")).agg(F.max("s")).first()[0] <= 1


def test_split_disjoint_and_complete(spark):
    insp = inspections(spark, SF).select("appointmentId")
    parts = ML.split(insp)
    assert sum(p.count() for p in parts) == insp.count()
    a, b, c = [set(r[0] for r in p.collect()) for p in parts]
    assert not (a & b) and not (a & c) and not (b & c)


def test_iqr_output_contained_in_input(spark):
    ev = table(spark, SF, "events")
    assert P.iqr_filter(ev, "value").join(ev, "event_id", "left_anti").count() == 0


def test_iqr_filter_pushes_literal_fences_into_scan(spark):
    plan = P.iqr_filter(table(spark, SF, "events"), "value")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value," in plan


def test_quantile_of_all_distinct_values(spark):
    df = spark.range(0, 200_000).select((F.col("id") * 1.000001).alias("x"))
    assert Q.exact_quantiles(df, "x", [0.5])[0] == pytest.approx(99_999.5 * 1.000001)


def test_vocabulary_bound_is_the_callers(spark):
    df = spark.range(0, 50).select(F.col("id").cast("string").alias("a"), F.lit("k").alias("b"))
    assert len(EN.category_vocabulary(df, ["a", "b"])["a"]) == 50
    with pytest.raises(ValueError, match="'a'"):
        EN.category_vocabulary(df, ["a", "b"], max_levels=49)


def test_binned_kde_close_to_exact(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(rng.gauss(10, 2),) for _ in range(2000)], "x double")
    exact = [r.density for r in ST.kde(df, "x", 50).collect()]
    binned = [r.density for r in ST.kde(df, "x", 50, bins=4096).collect()]
    assert max(abs(a - b) for a, b in zip(exact, binned)) < 1e-4


def test_approximate_fences_close_to_exact(spark):
    ev = table(spark, SF, "events")
    lo, hi = PR.fences(ev, "value")
    alo, ahi = PR.fences(ev, "value", exact=False)
    assert abs(alo - lo) < 1.0 and abs(ahi - hi) < 1.0
    assert abs(P.iqr_filter(ev, "value", exact=False).count() - 9537) < 20


def test_search_spaces_draw_distinct_settings(spark):
    from pyspark.ml.regression import GBTRegressor
    maps = ML.draw_param_maps(GBTRegressor(), ML.BOOSTED_SPACE_LEAFWISE, ML.SEARCH_DRAWS["leafwise"])
    assert len(maps) == 50 and len({tuple(sorted((p.name, v) for p, v in m.items())) for m in maps}) == 50


def test_wide_correlations_equal_pairwise_ones(spark):
    """The block product gives what one expression a pair gives; awkward columns included."""
    import random

    from gearlens.operators import profile as PR
    r = random.Random(2)
    rows = [(r.gauss(1e6, 3), None if r.random() < 0.4 else r.random(), 5.0, None, i % 2 == 0, None if i % 3 else float(i), i % 7) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, flat double, none double, flag boolean, c double, i int").repartition(4)
    numbers = df.withColumn("flag", df["flag"].cast("int"))
    one = {(x.col_a, x.col_b): x["corr"] for x in PR.pearson_matrix(numbers, numbers.columns).collect()}
    two = {(x.col_a, x.col_b): x["corr"] for x in PR.pearson_wide(numbers, numbers.columns).collect()}
    assert one.keys() == two.keys()
    for k, v in one.items():
        assert (v is None) == (two[k] is None) and (v is None or abs(v - two[k]) < 1e-6), (k, v, two[k])
    assert PR.pearson_wide(numbers, []).count() == 0
    assert {x["corr"] for x in PR.pearson_wide(numbers.limit(0), ["a", "b"]).collect()} <= {None}
