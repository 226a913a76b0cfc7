"""The model that requests are scored with uses what requests say; inputs that real clients send."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gearlens import schema as S
from gearlens.functions.timefx import parse_time
from gearlens.operators.prep import sanitize_name
from gearlens.operators.encode import base_name, slot_stem, suffix_token
from gearlens.plans import catalog
from gearlens.plans import score as SC

SF = "/root/testdata/sf0.01"


def test_every_request_flag_is_a_trained_feature(spark):
    _, cols = catalog._model(spark, SF)
    assert {*S.FUEL_FLAGS.values(), *S.DIAGNOSTIC_FLAGS.values()} <= set(cols)


def test_each_diagnostic_changes_some_prediction(spark):
    model, cols = catalog._model(spark, SF)
    rows = [(f"{k}-{o}", "2019-03-04T10:15", str(o), "Petrol", {} if k == "none" else {k: True}, 2012, 5)
            for o in range(20_000, 400_000, 20_000) for k in ("none", *S.DIAGNOSTIC_FLAGS)]
    req = spark.createDataFrame(rows, "request_id string, inspectionStartTime string, odometer_reading string, fuel_type string, "
                                      "diagnostics map<string,boolean>, year int, month int")
    got = {r.request_id: r.raw_prediction for r in SC.score_requests(req, model, cols)[0].collect()}
    for k in S.DIAGNOSTIC_FLAGS:
        assert any(got[f"{k}-{o}"] != got[f"none-{o}"] for o in range(20_000, 400_000, 20_000)), k


def test_unset_features_are_named():
    assert SC.unset_features([S.HOUR, "fuel_type_Petrol", "other_flag"]) == ["other_flag"]


@pytest.mark.parametrize("text,want", [
    ("2019-03-04T10:15:00.123Z", dt.datetime(2019, 3, 4, 10, 15, 0, 123000)), ("2019-03-04T10:15+05:30", dt.datetime(2019, 3, 4, 10, 15)),
    ("2019-03-04T10:15Z", dt.datetime(2019, 3, 4, 10, 15)), ("2019-03-04 10:15:09.123456789", dt.datetime(2019, 3, 4, 10, 15, 9, 123456)),
    ("2019/03/04 10:15", dt.datetime(2019, 3, 4, 10, 15)), ("2019-03-04T10:15:09-0800", dt.datetime(2019, 3, 4, 10, 15, 9)),
    ("2019/03/04", dt.datetime(2019, 3, 4)), ("2019-03-04", dt.datetime(2019, 3, 4)), ("2019-03-04 10:15", dt.datetime(2019, 3, 4, 10, 15)),
    ("soon", None), ("", None), (None, None)])
def test_time_texts(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").select(F.date_format(parse_time("t"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("t"))
    assert df.first().t == (want and want.strftime("%Y-%m-%d %H:%M:%S.%f"))


def test_decimal_odometer(spark):
    req = spark.createDataFrame([("a", "50000.0"), ("b", "50000.5"), ("c", "7"), ("d", "x"), ("e", None)], "request_id string, odometer_reading string") \
        .withColumns({"inspectionStartTime": F.lit("2019-03-04"), "diagnostics": F.lit(None).cast("map<string,boolean>")})
    got = {r.request_id: r["__odo"] for r in SC.parsed_requests(req).collect()}
    assert got == {"a": 50000, "b": None, "c": 7, "d": None, "e": None}


def test_names():
    assert sanitize_name("Straße + é_1") == "Straße___é_1"
    assert [suffix_token(n) for n in ("a_b_c", "abc", "a_")] == ["c", None, ""]
    assert [base_name(n, "c") for n in ("a_1_c", "a_b_c", "1_c", "a_12_c_c", "a_1_d")] == ["a", "a_b_c", "1_c", "a_12_c_c", "a_1_d"]
    assert [slot_stem(n) for n in ("a_1_c", "a_1_2_c", "a_1", "1_a")] == ["a_c", "a_2_c", "a_1", "1_a"]


def test_jobs_keep_the_submitted_master(monkeypatch, spark):
    """The job asks for no master of its own."""
    import argparse
    import os
    monkeypatch.syspath_prepend(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "jobs"))
    import _common
    from pyspark.sql import SparkSession
    asked = []
    monkeypatch.setattr(type(SparkSession.builder), "master", lambda self, m: asked.append(m) or self)
    parser = argparse.ArgumentParser()
    _common.add_common(parser)
    _common.session(parser.parse_args([]))
    assert asked == []
    _common.session(parser.parse_args(["--master", "local[2]"]))
    assert asked == ["local[2]"]
