"""The command-line jobs run end to end on the smallest driver tables."""
import importlib
import os
import sys

import pytest

from gearlens.sources.driver_tables import inspections
from gearlens.sources.requests import requests_from_inspections

SF = "/root/testdata/sf0.001"
JOBS = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "jobs")


def run_job(monkeypatch, name, args):
    # in-process, the job sees the test session as a cluster session and sizes
    # it to its input; the session's settings are restored for later tests
    from pyspark.sql import SparkSession
    from gearlens.session import scale_conf
    spark = SparkSession.getActiveSession()
    saved = {k: spark.conf.get(k, None) for k in scale_conf(1)}
    monkeypatch.syspath_prepend(JOBS)
    monkeypatch.setattr(sys, "argv", [name] + args)
    mod = importlib.import_module(name)
    try:
        mod.main()
        return spark.conf.get("spark.sql.shuffle.partitions")
    finally:
        for k, v in saved.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_train_report_score(spark, monkeypatch, tmp_path):
    model = str(tmp_path / "model")
    parts = run_job(monkeypatch, "train", ["--sf-dir", SF, "--model", model, "--rounds", "3"])
    assert parts == "200"      # sized to its (small) input: scale_conf's floor
    assert os.path.isdir(model) and os.path.isdir(model + "_columns")

    run_job(monkeypatch, "report", ["--sf-dir", SF, "--out", str(tmp_path / "report")])
    trend = spark.read.parquet(str(tmp_path / "report" / "volume_trend"))
    assert trend.count() > 0
    records = spark.read.option("header", True).csv(str(tmp_path / "report" / "records_csv"))
    assert records.count() == inspections(spark, SF).count()

    requests_from_inspections(inspections(spark, SF)).write.json(str(tmp_path / "req"))
    run_job(monkeypatch, "score", ["--requests", str(tmp_path / "req"), "--model", model,
                                   "--out", str(tmp_path / "scores")])
    scored = spark.read.parquet(str(tmp_path / "scores" / "scored")).count()
    rejected = spark.read.parquet(str(tmp_path / "scores" / "rejected")).count()
    assert scored + rejected == inspections(spark, SF).count() and rejected > 0


def test_search_job(spark, monkeypatch, tmp_path):
    run_job(monkeypatch, "search", ["--sf-dir", SF, "--draws", "2", "--folds", "2", "--out", str(tmp_path / "scores")])
    got = spark.read.parquet(str(tmp_path / "scores")).collect()
    assert len(got) == 2 and all("num_leaves" in r.params and r.mean_cv_r2 < 1 for r in got)


def test_input_bytes_sums_scanned_files(spark):
    import os
    from gearlens.session import input_bytes, scale_conf
    from gearlens.sources.driver_tables import inspections
    sf = "/root/testdata/sf0.01"
    want = sum(os.path.getsize(f"{sf}/{t}.parquet") for t in ("events", "orders", "lineitem"))
    assert input_bytes(inspections(spark, sf)) == want
    # 100 TB of parquet: ~1.2 M initial shuffle partitions before AQE merges small ones
    assert int(scale_conf(100 * 1024 ** 4)["spark.sql.shuffle.partitions"]) == 1_228_800
