"""Row order of the sorting operators (O1, O2, P9), which the value comparison
of the oracle queries can't see; variance inflation of wide blocks (T6) and
correlations and tests without variation (A20, T2-T5)."""
import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gearlens import schema as S
from gearlens.operators import prep as P
from gearlens.operators import profile as PR
from gearlens.operators import stats as ST
from gearlens.operators import trends as TR
from gearlens.sources.driver_tables import inspections

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    return inspections(spark, SF).select(S.KEY, S.TIME, S.TARGET, S.ODOMETER, S.REG_YEAR, S.FUEL)


def _newest(row):
    t = row[S.TIME]
    return (t is None, -(t - dt.datetime(1970, 1, 1)).total_seconds() if t is not None else 0, row[S.KEY])


def test_latest_first_order(rows):
    want = [r[S.KEY] for r in sorted(rows.collect(), key=_newest)]
    assert [r[S.KEY] for r in TR.latest_first(rows).collect()] == want


@pytest.mark.parametrize("ascending", [True, False])
def test_sort_by_order_nulls_last(rows, ascending):
    sign = 1 if ascending else -1
    some = rows.withColumn(S.ODOMETER, F.when(F.col(S.KEY) % 7 != 0, F.col(S.ODOMETER)))
    want = sorted(some.collect(), key=lambda r: (r[S.ODOMETER] is None, sign * (r[S.ODOMETER] or 0), r[S.KEY]))
    got = TR.sort_by(some, S.ODOMETER, ascending, S.KEY).collect()
    assert [r[S.KEY] for r in got] == [r[S.KEY] for r in want]


def test_records_view_order(rows):
    weak = [r for r in rows.collect() if r[S.TARGET] is not None and r[S.TARGET] <= S.WEAK_RATING_MAX]
    assert weak
    got = P.records_view(rows, weak_only=True).collect()
    assert [r[S.KEY] for r in got] == [r[S.KEY] for r in sorted(weak, key=_newest)]


def test_vif_of_a_wide_block(spark):
    rng = random.Random(21)
    data = []
    for _ in range(600):
        base = [float(rng.random() < 0.3) for _ in range(70)]
        base[5] = base[4] if rng.random() < 0.8 else base[5]
        data.append(base)
    x = np.array(data)
    names = [f"flag {i}" for i in range(70)]
    df = spark.createDataFrame([tuple(r) for r in data], ", ".join(f"`{n}` double" for n in names))
    got = {r["feature"]: r["vif"] for r in ST.vif(df, names).collect()}
    inverse = np.linalg.inv(np.corrcoef(x.T))
    assert [got[n] for n in names] == pytest.approx(list(np.diag(inverse)), rel=1e-8)
    z = x.mean(0) / x.std(0, ddof=1)
    assert got["const"] == pytest.approx(1 + 600 / 599 * z @ inverse @ z, rel=1e-8)


def test_vif_exact_relation_marks_only_its_columns(spark):
    rng = random.Random(22)
    data = [(rng.gauss(3, 1), rng.gauss(0, 2), rng.gauss(1, 1)) for _ in range(400)]
    df = spark.createDataFrame(data, "a double, b double, d double").withColumn("c", F.col("a") - 2 * F.col("b"))
    got = {r["feature"]: r["vif"] for r in ST.vif(df, ["a", "b", "c", "d"]).collect()}
    assert all(math.isinf(got[k]) for k in ("a", "b", "c", "const"))
    x = np.array(data)
    assert got["d"] == pytest.approx(np.linalg.inv(np.corrcoef(x.T))[2, 2], rel=1e-8)


def test_vif_without_rows_or_with_a_constant(spark):
    empty = spark.createDataFrame([], "a double, b double")
    assert all(math.isinf(r["vif"]) for r in ST.vif(empty, ["a", "b"]).collect())
    flat = spark.range(5).select(F.col("id").cast("double").alias("a"), F.lit(1.0).alias("b"))
    assert all(math.isinf(r["vif"]) for r in ST.vif(flat, ["a", "b"]).collect())


def test_correlation_of_a_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 7.0, 2.0), (2.0, 7.0, None), (4.0, 7.0, 5.0), (5.0, None, 3.0)], "a double, b double, c double")
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in PR.pearson_matrix(df, ["a", "b", "c"]).collect()}
    assert [got["a", "b"], got["b", "b"], got["c", "b"]] == [None, None, None]
    assert got["a", "a"] == pytest.approx(1.0)
    assert got["a", "c"] == got["c", "a"] == pytest.approx(np.corrcoef([1, 4, 5], [2, 5, 3])[0, 1])


def test_tests_without_variation_have_no_statistic(spark):
    df = spark.createDataFrame([("p", "u", 2.0), ("p", "v", 2.0), ("q", "w", 2.0), ("q", "w", 2.0)], "two string, three string, y double")
    assert ST.kruskal_wallis(df, "three", "y").first()["statistic"] is None
    assert ST.t_test(df, "two", "y").first()["statistic"] is None
    assert ST.anova(df, ["two"], "y").first()["verdict"] == "skipped"
    got = {r["feature"]: r["verdict"] for r in ST.temporal_trends(df, ["two", "three"], "y").collect()}
    assert got == {"two": "no variation", "three": "no variation"}


def test_t_with_a_group_of_one_row(spark):
    df = spark.createDataFrame([("p", 1.0), ("p", 2.0), ("p", 4.0), ("q", 5.0)], "g string, y double")
    r = ST.t_test(df, "g", "y").first()
    mean, spread = 7 / 3, sum((y - 7 / 3) ** 2 for y in (1, 2, 4))
    assert r["statistic"] == pytest.approx((mean - 5) / math.sqrt(spread / 2 * (1 / 3 + 1)))
    assert r["df"] == 2
