"""Sources/sinks, model persistence, planted-signal ML, scoring and streaming."""
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from gearlens import schema as S
from gearlens.plans import model as ML
from gearlens.plans import score as SC
from gearlens.sources import io as IO
from gearlens.sources.requests import read_requests
from gearlens.streaming.score_stream import run_to_completion, score_stream

FEATURES = ["odometer_reading", "flag"]


@pytest.fixture(scope="module")
def planted(spark):
    r = spark.range(3000).select(
        F.col("id").cast("string").alias("appointmentId"),
        (F.rand(1) * 150000).alias("odometer_reading"),
        (F.rand(2) < 0.2).cast("int").alias("flag"), F.randn(3).alias("noise"))
    y = F.lit(5.0) - F.col("odometer_reading") / 50000 - F.col("flag") + 0.2 * F.col("noise")
    return r.withColumn(S.TARGET, F.greatest(F.lit(0.0), F.least(F.lit(5.0), y))).drop("noise").cache()


@pytest.fixture(scope="module")
def gbt(planted):
    return ML.train(planted, FEATURES, "boosted", maxIter=10)


def test_boosted_learns_planted_signal(planted, gbt):
    assert ML.r2(gbt, planted) >= 0.9


def test_compare_and_search(planted):
    tr, va, te = ML.split(planted)
    cmp = {r.model: r for r in ML.compare_models(tr, va, FEATURES, kinds=("decision_tree", "boosted"),
                                                  params={"boosted": {"maxIter": 10}}).collect()}
    assert cmp["boosted"].validation_r2 > 0.85
    space = {"maxDepth": [2, 4], "stepSize": [0.1, 0.2], "maxIter": [5]}
    cvm, maps = ML.random_search(tr, FEATURES, space, n=2, folds=3)
    assert len(maps) == 2 and len(cvm.avgMetrics) == 2


def test_final_fit_and_importance(planted):
    tr, va, te = ML.split(planted)
    model, metrics = ML.final_fit(tr, va, te, FEATURES, maxIter=10)
    assert {r.metric for r in metrics.collect()} == {"train_r2", "test_r2", "test_r2_raw_target"}
    imp = ML.feature_importance(model, FEATURES, 10).collect()
    assert imp[0].feature == "odometer_reading"
    split_counts = ML.feature_importance(model, FEATURES, None, kind="split").collect()
    assert sum(r.importance for r in split_counts) > 0


def test_save_load_equal_predictions(spark, planted, gbt, tmp_path):
    path = str(tmp_path / "model")
    ML.save_model(gbt, path)
    ML.save_columns(spark, FEATURES, str(tmp_path / "cols"))
    again = ML.load_model(path)
    assert ML.load_columns(spark, str(tmp_path / "cols")) == FEATURES
    a = gbt.transform(planted).select("appointmentId", "prediction")
    b = again.transform(planted).select("appointmentId", F.col("prediction").alias("p2"))
    assert a.join(b, "appointmentId").where(F.col("prediction") != F.col("p2")).count() == 0


REQUESTS = [
    {"request_id": "ok", "inspectionStartTime": "2019-03-04T10:15", "odometer_reading": 50000,
     "fuel_type": "CNG", "diagnostics": {"clutch_hard": True}},
    {"request_id": "bad_time", "inspectionStartTime": "bad", "odometer_reading": 1, "fuel_type": "Petrol"},
    {"request_id": "bad_odo", "inspectionStartTime": "2019-03-04T10:15", "odometer_reading": "x", "fuel_type": "Petrol"},
    {"request_id": "no_fuel", "inspectionStartTime": "2019-03-04 10:15:00", "odometer_reading": 10, "fuel_type": None},
]
SERVE_COLS = ["year", "month", "odometer_reading", "inspection_hour", "inspection_mon", "fuel_type_Petrol",
              "fuel_type_Petrol___CNG", "engineTransmission_clutch_cc_value_Hard",
              "engineTransmission_battery_cc_value_Jump_Start", "something_else"]


@pytest.fixture(scope="module")
def request_dir():
    d = tempfile.mkdtemp(prefix="gearlens-req-")
    with open(os.path.join(d, "r.json"), "w") as f:
        for r in REQUESTS:
            f.write(json.dumps(r) + "\n")
    return d


def test_request_features(spark, request_dir):
    req = read_requests(spark, request_dir)
    feats = {r.request_id: r for r in SC.request_features(req, SERVE_COLS).collect()}
    ok = feats["ok"]
    assert (ok.inspection_hour, ok.inspection_mon, ok.odometer_reading) == (10.0, 3.0, 50000.0)
    assert ok.fuel_type_Petrol___CNG == 1.0 and ok.engineTransmission_clutch_cc_value_Hard == 1.0
    assert ok.fuel_type_Petrol == 0.0 and ok.something_else == 0.0 and ok.year == 0.0
    assert feats["bad_time"].reject_reason == "bad inspectionStartTime"
    assert feats["bad_odo"].reject_reason == "bad odometer_reading"
    assert feats["no_fuel"].reject_reason is None and feats["no_fuel"].fuel_type_Petrol == 0.0


def test_score_degradation_and_stream(spark, planted, request_dir, tmp_path):
    serve = planted.select("odometer_reading", F.lit(0).alias("flag"), S.TARGET)
    model = ML.train(serve, ["odometer_reading"], "boosted", maxIter=5)
    req = read_requests(spark, request_dir)
    scored, rejected = SC.score_requests(req, model, ["odometer_reading"])
    s = {r.request_id: r for r in scored.collect()}
    assert set(s) == {"ok", "no_fuel"} and all(0.0 <= r.prediction <= 5.0 for r in s.values())
    assert {r.request_id for r in rejected.collect()} == {"bad_time", "bad_odo"}
    deg = SC.degradation(req, model, ["odometer_reading"]).where("request_id = 'ok'").orderBy("step").collect()
    assert [r.odometer_reading for r in deg] == [50000.0 + 10000 * i for i in range(6)]
    assert all(r.prediction >= 0 for r in deg)
    qs = score_stream(spark, request_dir, str(tmp_path / "out"), model, ["odometer_reading"],
                      checkpoint=str(tmp_path / "ck"))
    run_to_completion(qs)
    streamed = {r.request_id: r.prediction for r in spark.read.parquet(str(tmp_path / "out" / "scored")).collect()}
    assert streamed == {k: v.prediction for k, v in s.items()}
    assert spark.read.parquet(str(tmp_path / "out" / "rejected")).count() == 2


def test_read_write_dispatch(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "appointmentId int, fuel_type string")
    IO.write_records_csv(df, str(tmp_path / "r.csv"))
    df.write.parquet(str(tmp_path / "r.parquet"))
    df.write.json(str(tmp_path / "r.json"))
    for name in ("r.csv", "r.parquet", "r.json"):
        got = IO.read_inspections(spark, str(tmp_path / name))
        assert sorted(r.appointmentId for r in got.collect()) == [1, 2]
    assert IO.format_of("x.unknown") == "csv"
    alt = IO.read_inspections(spark, str(tmp_path / "missing.csv"), alternatives=[str(tmp_path / "r.parquet")])
    assert alt.count() == 2
    with pytest.raises(Exception):
        IO.read_inspections(spark, str(tmp_path / "missing.csv")).count()


def test_residuals_are_scored_once(spark, tmp_path):
    """Quartiles and result read one staged table of residuals."""
    rows = spark.range(200).select(F.col("id").alias(S.KEY), (F.col("id") * 300.0).alias("odometer_reading"),
                                   F.when(F.col("id") % 50 == 0, 0.0).otherwise(5.0 - F.col("id") / 100.0).alias(S.TARGET))
    model = ML.train(rows, ["odometer_reading"], "decision_tree", maxDepth=2)
    got = SC.residual_outliers(rows, model)
    assert got.count() == 4 and {r[S.KEY] % 50 for r in got.collect()} == {0}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in plan and "parquet" in plan
