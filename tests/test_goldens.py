"""Hand-made inputs with hand-computed answers (FIXTURES section 4)."""
import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from gearlens import schema as S
from gearlens.functions import bands as BD
from gearlens.operators import encode as EN
from gearlens.operators import prep as P
from gearlens.operators import profile as PR
from gearlens.operators import stats as ST
from gearlens.operators import trends as TR


def one_col(spark, values, name="x", kind="double"):
    conv = float if kind == "double" else (lambda v: v)
    return spark.createDataFrame([(None if v is None else conv(v),) for v in values], f"{name} {kind}")


def test_iqr_filter_drops_far_value(spark):
    df = one_col(spark, [1, 2, 3, 4, 5, 100])
    lo, hi = PR.fences(df, "x")
    assert (lo, hi) == (-1.5, 8.5)
    assert sorted(r.x for r in P.iqr_filter(df, "x").collect()) == [1, 2, 3, 4, 5]


def test_fence_edge_strict_filter_vs_outliers(spark):
    df = one_col(spark, [1, 1, 1, 3, 6])
    assert PR.fences(df, "x")[1] == 6.0
    assert 6.0 not in [r.x for r in P.iqr_filter(df, "x").collect()]
    assert PR.outliers(df, "x").count() == 0


def test_iqr_filter_drops_nulls(spark):
    df = one_col(spark, [1, 2, None, 3])
    assert P.iqr_filter(df, "x").where(F.col("x").isNull()).count() == 0


def _daily(spark, counts, skip=None):
    start = dt.date(2024, 1, 1)
    rows = [(start + dt.timedelta(days=i + (1 if skip is not None and i >= skip else 0)), c)
            for i, c in enumerate(counts)]
    return spark.createDataFrame(rows, "inspection_date date, n_inspections long")


def test_rolling_mean_and_std(spark):
    d = TR.rolling_std(TR.rolling_mean(_daily(spark, range(1, 9))))
    rows = d.orderBy("inspection_date").collect()
    assert [r.rolling_mean for r in rows[:6]] == [None] * 6
    assert [r.rolling_mean for r in rows[6:]] == [4.0, 5.0]
    assert [round(r.rolling_std, 6) for r in rows[6:]] == [2.160247, 2.160247]


def test_rolling_counts_rows_not_days(spark):
    d = TR.rolling_mean(_daily(spark, range(1, 9), skip=3))
    assert [r.rolling_mean for r in d.orderBy("inspection_date").collect()][6:] == [4.0, 5.0]


def test_span_days(spark):
    df = spark.createDataFrame([(dt.datetime(2019, 1, 1, 23),), (dt.datetime(2019, 1, 3, 1),)],
                               "inspectionStartTime timestamp")
    assert PR.span_days(df).first().span_days == 1


def test_daily_volume_nulls(spark):
    rows = [(1, dt.datetime(2019, 1, 1, 10)), (None, dt.datetime(2019, 1, 1, 11)), (3, None)]
    df = spark.createDataFrame(rows, "appointmentId long, inspectionStartTime timestamp")
    by_id = TR.daily_volume(df).collect()
    by_row = TR.daily_volume(df, count_col=None).collect()
    assert [(r.inspection_date, r.n_inspections) for r in by_id] == [(dt.date(2019, 1, 1), 1)]
    assert [r.n_inspections for r in by_row] == [2]


def test_value_shares(spark):
    got = {r.value: round(r.share, 6) for r in PR.value_shares(one_col(spark, [3, 3, 4, None]), "x").collect()}
    assert got == {3.0: 0.666667, 4.0: 0.333333}


def test_histogram_last_bin_closed(spark):
    h = PR.histogram(one_col(spark, list(range(11))), "x", 5)
    assert [r.n for r in h.collect()] == [2, 2, 2, 2, 3]


def test_spearman(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0), (4.0, 4.0)], "a double, b double")
    r = ST.spearman(df, "a", "b").first()
    assert round(r.rho, 6) == 0.8 and r.n == 4


def test_kruskal_wallis(spark):
    rows = [("a", float(v)) for v in (1, 2, 2)] + [("b", float(v)) for v in (2, 3, 3)] + [("c", float(v)) for v in (4, 5, 5)]
    df = spark.createDataFrame(rows, "g string, y double")
    r = ST.kruskal_wallis(df, "g", "y").first()
    assert round(r.statistic, 6) == 6.830409 and r.df == 2.0 and round(r.p_value, 6) == 0.03287


def _two_groups(spark):
    rows = [("p", float(v)) for v in (1, 2, 3)] + [("q", float(v)) for v in (2, 4, 6)]
    return spark.createDataFrame(rows, "g string, y double")


def test_t_test(spark):
    r = ST.t_test(_two_groups(spark), "g", "y").first()
    assert round(r.statistic, 6) == -1.549193 and r.df == 4.0


def test_anova_two_groups(spark):
    r = ST.anova(_two_groups(spark), ["g"], "y").first()
    assert round(r.statistic, 6) == 2.4 and (r.df1, r.df2) == (1.0, 4.0)


def test_anova_skip(spark):
    rows = [("p", float(v)) for v in range(5)] + [("q", 1.0)]
    r = ST.anova(spark.createDataFrame(rows, "g string, y double"), ["g"], "y").first()
    assert r.verdict == "skipped" and r.statistic is None


def test_vif(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0), (4.0, 4.0)], "x double, z double")
    got = {r.feature: r.vif for r in ST.vif(df, ["x", "z"]).collect()}
    assert round(got["x"], 6) == 2.777778 and round(got["z"], 6) == 2.777778
    # constant's VIF = n (X'X)^-1_00, computed directly
    import numpy as np
    X = np.array([[1, 1, 1], [1, 2, 3], [1, 3, 2], [1, 4, 4]], dtype=float)
    assert math.isclose(got["const"], 4 * np.linalg.inv(X.T @ X)[0, 0], rel_tol=1e-9)


def test_vif_collinear_is_infinite(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (4.0, 8.0)], "x double, z double")
    assert all(math.isinf(r.vif) for r in ST.vif(df, ["x", "z"]).collect())


def test_one_hot_drop_first(spark):
    df = spark.createDataFrame([("y",), ("B",), ("A",), (None,)], "c string")
    out = EN.one_hot_drop_first(df, ["c"])
    assert out.columns == ["c_B", "c_y"]
    rows = out.collect()
    assert [r.c_B for r in rows] == [0, 1, 0, 0] and [r.c_y for r in rows] == [1, 0, 0, 0]


def test_one_hot_single_value_vanishes(spark):
    df = spark.createDataFrame([("k", 1), ("k", 2)], "c string, n int")
    assert EN.one_hot_drop_first(df, ["c"]).columns == ["n"]


B = "engineTransmission_"
NAMES = [B + "battery_value_Yes", B + "battery_cc_value_0_Weak", B + "battery_cc_value_1_Weak",
         B + "engineOil_cc_value_0_Leaking", B + "coolant_cc_value_0_Leaking"]


def test_rollup_reference_mode():
    plan = EN.rollup_plan(NAMES, "reference")
    assert [n for n, _ in plan] == [B + "battery_value_Yes_Yes", B + "battery_cc_value_Weak",
                                    B + "engineOil_cc_value_Leaking"]
    assert dict(plan)[B + "engineOil_cc_value_Leaking"] == NAMES[3:]


def test_rollup_component_mode():
    plan = EN.rollup_plan(NAMES, "component")
    assert [n for n, _ in plan] == [B + "battery_value_Yes", B + "battery_cc_value_Weak",
                                    B + "engineOil_cc_value_Leaking", B + "coolant_cc_value_Leaking"]


def test_rollup_substring_swallows():
    assert [n for n, _ in EN.rollup_plan(["x_cc_value_0_Oil", "x_cc_value_1_Oil spill"], "reference")] == \
        ["x_cc_value_Oil"]


def test_rollup_output_that_is_a_source_is_lost():
    assert EN.rollup_plan(["x_cc_value_0_Hard", "x_cc_value_Hard"], "reference") == []


def test_slot_rollup_values(spark):
    df = spark.createDataFrame([(1, 0, 1), (0, 0, 0)], "`a_cc_value_0_W` int, `a_cc_value_1_W` int, `b_x` int")
    out = EN.slot_rollup(df, mode="component")
    assert out.columns == ["a_cc_value_W", "b_x"]
    assert [tuple(r) for r in out.collect()] == [(1, 1), (0, 0)]


@pytest.mark.parametrize("x,thr,rnd", [(4.5, "Excellent", "Very Good"), (0.4, "Poor", "Critical"),
                                       (5.0, "Excellent", "Excellent"), (3.5, "Very Good", "Very Good"),
                                       (2.5, "Average", "Below Average"), (1.5, "Below Average", "Below Average")])
def test_grades(spark, x, thr, rnd):
    r = one_col(spark, [x]).select(BD.grade_threshold("x").alias("t"), BD.grade_rounded("x").alias("r")).first()
    assert (r.t, r.r) == (thr, rnd)


def test_health(spark):
    rows = [({},), ({"clutch_hard": True, "engine_oil_leak": False},),
            ({"clutch_hard": True, "engine_oil_leak": True, "battery_jump_start": True},)]
    df = spark.createDataFrame(rows, "diagnostics map<string,boolean>")
    got = [(r.failed_checks, round(r.health_pct, 6), r.health_delta) for r in df.select(*BD.health_columns("diagnostics")).collect()]
    assert got == [(0, 100.0, "Optimal"), (1, 83.333333, "-1 Flags"), (3, 50.0, "-3 Flags")]


def test_result_card_bands(spark):
    r = one_col(spark, [4.0]).select(BD.rating_color("x").alias("c"), BD.condition_text("x").alias("t"),
                                     BD.market_value_band("x").alias("m")).first()
    assert (r.c, r.t, r.m) == ("green", "acceptable", "Medium")


def test_clamp_keeps_null(spark):
    got = [r.c for r in one_col(spark, [-1.0, 7.0, None, 2.0]).select(BD.clamp("x").alias("c")).collect()]
    assert got == [0.0, 5.0, None, 2.0]


def test_usage_band_strict(spark):
    got = [r.u for r in one_col(spark, [100000.0, 100001.0]).select(BD.usage_band("x").alias("u")).collect()]
    assert got == ["Normal", "High"]


def test_sanitize_and_errors(spark):
    df = spark.createDataFrame([(1, 2)], "`a b` int, `a-b` int")
    with pytest.raises(ValueError):
        P.sanitize_names(df)
    assert P.sanitize_names(df.select("`a b`")).columns == ["a_b"]
    with pytest.raises(ValueError):
        P.split_target(df, S.TARGET)
    assert P.first_present(df, ["zz", "a-b", "a b"]) == "a-b"


def test_cast_rating_int_truncates(spark):
    df = spark.createDataFrame([(4.9,), (0.5,)], f"{S.TARGET} double")
    assert [r[0] for r in P.cast_rating_int(df).collect()] == [4, 0]


def test_schema_profile_and_types(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 1.5)], "i int, s string, d double")
    prof = [(r.column_name, r.data_type, r.non_null) for r in PR.schema_profile(df).collect()]
    assert prof == [("i", "int", 2), ("s", "string", 1), ("d", "double", 1)]
    assert PR.type_counts(df) == {"string": 1, "numeric": 2, "timestamp": 0}
    assert P.select_columns_of_type(df, "numeric").columns == ["i", "d"]


def test_parse_time_two_columns(spark):
    df = spark.createDataFrame([("2019-03-04", "10:15"), ("2019-03-04", "bad")], "d string, t string")
    from gearlens.functions.timefx import parse_time
    got = [r.ts for r in df.select(parse_time("d", "t").alias("ts")).collect()]
    assert got[0] == dt.datetime(2019, 3, 4, 10, 15) and got[1] is None


def test_p_values(spark):
    rows = [("a", float(v)) for v in (1, 2, 2)] + [("b", float(v)) for v in (2, 3, 3)] + [("c", float(v)) for v in (4, 5, 5)]
    df = spark.createDataFrame(rows, "g string, y double")
    from gearlens.functions.distributions import chi2_sf, f_sf, t_sf_two_sided
    tr = {r.feature: r for r in ST.temporal_trends(df, ["g"], "y").collect()}["g"]
    assert tr.test == "Kruskal-Wallis" and tr.p_value == pytest.approx(chi2_sf(tr.statistic, 2))
    assert tr.verdict == "significant"
    a = ST.anova(df, ["g"], "y").first()
    assert a.p_value == pytest.approx(f_sf(a.statistic, 2, 6))
    t = ST.t_test(_two_groups(spark), "g", "y").first()
    assert t.p_value == pytest.approx(t_sf_two_sided(-1.549193, 4), rel=1e-5)
    assert chi2_sf(7.8147, 3) == pytest.approx(0.05, abs=1e-5)
    assert f_sf(4.1028, 2, 10) == pytest.approx(0.05, abs=1e-5)
    assert t_sf_two_sided(2.2281, 10) == pytest.approx(0.05, abs=1e-4)


def test_trend_single_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "g string, y double")
    r = ST.temporal_trends(df, ["g"], "y").first()
    assert r.statistic is None and r.verdict == "not enough groups"


def test_kde_integrates_to_one(spark):
    import random
    rng = random.Random(5)
    df = spark.createDataFrame([(rng.gauss(0, 1),) for _ in range(500)], "x double")
    rows = ST.kde(df, "x", 400).collect()
    step = rows[1].x - rows[0].x
    assert sum(r.density for r in rows) * step == pytest.approx(1.0, abs=0.01)


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0, 1.0), (float("nan"), 2.0), (3.0, 3.0), (None, 4.0)], "a double, b double")
    rates = {r.column_name: r.null_pct for r in PR.null_rate(df).collect()}
    assert rates == {"a": 50.0, "b": 0.0}
    corr = {(r.col_a, r.col_b): r.corr for r in PR.pearson_matrix(df, ["a", "b"]).collect()}
    assert round(corr[("a", "b")], 6) == 1.0 and corr[("a", "b")] == corr[("b", "a")]


def test_scale_conf():
    from gearlens.session import scale_conf
    c = scale_conf(100 * 1024 ** 4)
    assert int(c["spark.sql.shuffle.partitions"]) == 100 * 1024 ** 4 * 3 // (256 * 1024 ** 2)
    assert int(scale_conf(10 * 1024 ** 2)["spark.sql.shuffle.partitions"]) == 200


def test_parse_time_equals_trying_every_layout(spark):
    from pyspark.sql import functions as F
    from gearlens.functions.timefx import parse_time
    layouts = ["yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm:ss.SSSSSS",
               "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd"]
    texts = ["2019-03-04T10:15", "2019-03-04T10:15:30", "2019-03-04T10:15:30.123456", "2019-03-04T10:15:30.5",
             "2019-03-04 10:15", "2019-03-04 10:15:30", "2019-03-04 10:15:30.123456", "2019-03-04",
             " 2019-03-04T10:15 ", "2019-3-4", "2019-03-04T", "2019-03-04T10",
             "2019-03-04T10:15.5", "2019.03.04", "10:15", "1:2:3:4", "bad", "", "2019-02-30", "2019-03-04 25:00",
             "2019-03-04 10:15:30.", None]    # zones and longer fractions: tests/test_service_model.py
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    every = F.coalesce(*[F.try_to_timestamp(F.trim("s"), F.lit(f)) for f in layouts])
    got = df.select("s", parse_time("s").alias("a"), every.alias("b")).collect()
    assert [(r.s, r.a) for r in got] == [(r.s, r.b) for r in got]
    assert sum(r.a is not None for r in got) >= 8
