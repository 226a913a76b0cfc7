"""Numbers stated for the driver tables at sf0.01 (FIXTURES section 3)."""
import pytest
from pyspark.sql import functions as F

from gearlens.operators import prep as P
from gearlens.operators import profile as PR
from gearlens.operators import stats as ST
from gearlens.operators import trends as TR
from gearlens.plans import model as ML
from gearlens.sources.driver_tables import inspections, table

SF = "/root/testdata/sf0.01"


def test_iqr_filter_events(spark):
    kept = P.iqr_filter(table(spark, SF, "events"), "value")
    r = kept.agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("mx")).first()
    assert (r.n, r.mx) == (9537, 150.89)


def test_kruskal_events(spark):
    r = ST.kruskal_wallis(table(spark, SF, "events"), "event_type", "value").first()
    assert round(r.statistic, 6) == 3.579596


def test_anova_lineitem(spark):
    r = ST.anova(table(spark, SF, "lineitem"), ["l_returnflag"], "l_quantity").first()
    assert round(r.statistic, 6) == 1.542466 and (r.df1, r.df2) == (2.0, 59997.0)


def test_t_lineitem(spark):
    r = ST.t_test(table(spark, SF, "lineitem"), "l_linestatus", "l_quantity").first()
    assert round(abs(r.statistic), 6) == 1.106749


def test_rolling_events(spark):
    t = TR.volume_trend(table(spark, SF, "events"), ts="ts", count_col=None)
    r = t.where(F.col("inspection_date") == F.lit("2024-01-10").cast("date")).first()
    assert (round(r.rolling_mean, 6), round(r.rolling_std, 6)) == (324.428571, 16.359066)


def test_span_days_events(spark):
    assert PR.span_days(table(spark, SF, "events"), "ts").first().span_days == 29


def test_md5_bucket_orders(spark):
    o = table(spark, SF, "orders")
    assert o.where(ML.split_bucket("o_orderkey") < 80).count() == 11964


def test_insp_shape(spark):
    insp = inspections(spark, SF)
    assert insp.count() == spark.read.parquet(f"{SF}/orders.parquet").count() == 15000
    assert PR.is_unique(insp).first().is_unique
