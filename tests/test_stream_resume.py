"""Streaming scoring resumes from its checkpoint: each record is scored once."""
import json
import os

from pyspark.sql import functions as F

from gearlens import schema as S
from gearlens.plans import model as ML
from gearlens.plans.score import score_requests
from gearlens.sources.requests import read_requests
from gearlens.streaming.score_stream import run_to_completion, score_stream


def _write(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")


def test_restart_scores_each_record_once(spark, tmp_path):
    train = spark.range(500).select((F.col("id") * 300.0).alias("odometer_reading"),
                                    (F.lit(5.0) - F.col("id") / 100.0).alias(S.TARGET))
    model = ML.train(train, ["odometer_reading"], "boosted", maxIter=3)
    inp, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    first = [{"request_id": f"a{i}", "inspectionStartTime": "2019-01-02T08:00", "odometer_reading": 1000 * i,
              "fuel_type": "Petrol"} for i in range(5)]
    second = [{"request_id": f"b{i}", "inspectionStartTime": "2019-01-03T09:30", "odometer_reading": 2000 * i,
               "fuel_type": "LPG"} for i in range(4)] + [{"request_id": "bad", "inspectionStartTime": "x",
                                                           "odometer_reading": 1, "fuel_type": "CNG"}]
    _write(inp, "part-1.json", first)
    run_to_completion(score_stream(spark, inp, out, model, ["odometer_reading"], checkpoint=ck))
    _write(inp, "part-2.json", second)
    # a new query on the same checkpoint only reads the new file
    run_to_completion(score_stream(spark, inp, out, model, ["odometer_reading"], checkpoint=ck))
    scored = spark.read.parquet(f"{out}/scored")
    ids = [r.request_id for r in scored.collect()]
    assert sorted(ids) == sorted([f"a{i}" for i in range(5)] + [f"b{i}" for i in range(4)])
    assert [r.request_id for r in spark.read.parquet(f"{out}/rejected").collect()] == ["bad"]
    batch, _ = score_requests(read_requests(spark, inp), model, ["odometer_reading"])
    want = {r.request_id: r.prediction for r in batch.collect()}
    assert {r.request_id: r.prediction for r in scored.collect()} == want


def test_restart_between_the_two_writes(spark, tmp_path, monkeypatch):
    """A stream that dies after the scored records of a batch and before its rejected ones
    writes both once when it comes back."""
    import pytest
    from pyspark.sql.readwriter import DataFrameWriter
    train = spark.range(200).select((F.col("id") * 300.0).alias("odometer_reading"), (F.lit(5.0) - F.col("id") / 100.0).alias(S.TARGET))
    model = ML.train(train, ["odometer_reading"], "boosted", maxIter=1)
    inp, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    rows = [{"request_id": f"r{i}", "inspectionStartTime": "2019-01-02T08:00" if i % 3 else "x", "odometer_reading": 1000 * i, "fuel_type": "Petrol"} for i in range(12)]
    _write(inp, "part-1.json", rows)
    write = DataFrameWriter.parquet

    def dies(self, path, *args, **kw):
        if "/rejected/" in path:
            raise RuntimeError("lost")
        return write(self, path, *args, **kw)

    monkeypatch.setattr(DataFrameWriter, "parquet", dies)
    with pytest.raises(Exception):
        run_to_completion(score_stream(spark, inp, out, model, ["odometer_reading"], checkpoint=ck))
    assert os.path.isdir(f"{out}/scored") and not os.path.isdir(f"{out}/rejected")
    monkeypatch.setattr(DataFrameWriter, "parquet", write)
    _write(inp, "part-2.json", [{"request_id": "late", "inspectionStartTime": "2019-01-02T08:00", "odometer_reading": 5, "fuel_type": "CNG"}])
    run_to_completion(score_stream(spark, inp, out, model, ["odometer_reading"], checkpoint=ck))
    assert sorted(r.request_id for r in spark.read.parquet(f"{out}/scored").collect()) == sorted(["late", *[f"r{i}" for i in range(12) if i % 3]])
    assert sorted(r.request_id for r in spark.read.parquet(f"{out}/rejected").collect()) == sorted(f"r{i}" for i in range(12) if i % 3 == 0)


def test_a_batch_keeps_its_answers_only(spark, tmp_path, monkeypatch):
    """A micro-batch is scored once and what is kept of it holds no map and no feature;
    both parts are those of batch scoring."""
    from pyspark.sql.classic.dataframe import DataFrame
    train = spark.range(200).select((F.col("id") * 300.0).alias("odometer_reading"), (F.lit(5.0) - F.col("id") / 100.0).alias(S.TARGET))
    model = ML.train(train, ["odometer_reading"], "boosted", maxIter=2)
    inp, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [{"request_id": f"r{i}" if i else None, "inspectionStartTime": "2019-01-02T08:00" if i % 5 else "x", "fuel_type": "Petrol",
             "odometer_reading": 1000 * i if i % 7 else None, "diagnostics": {"clutch_hard": True}} for i in range(40)]
    _write(inp, "part-1.json", rows)
    kept, persist = [], DataFrame.persist
    monkeypatch.setattr(DataFrame, "persist", lambda self, *args: kept.append(self.columns) or persist(self, *args))
    run_to_completion(score_stream(spark, inp, out, model, ["odometer_reading"], checkpoint=str(tmp_path / "ck")))
    assert kept == [["request_id", "reject_reason", "raw_prediction", "inspectionStartTime", "odometer_reading"]]
    for name, want in zip(("scored", "rejected"), score_requests(read_requests(spark, inp), model, ["odometer_reading"])):
        got = spark.read.parquet(f"{out}/{name}").drop("batch")
        assert got.columns == want.columns and got.dtypes == want.dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 0


def test_query_derives_the_inspections_once(spark, tmp_path, monkeypatch):
    """Vocabulary, fit and requests of the registered query read one derivation."""
    import __spark_entry__ as E
    from gearlens.plans import catalog
    derived = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            derived.add(b.num_rows)
            yield b

    sf, n, day = str(tmp_path), 120, F.expr("timestamp'2020-01-01 08:00:00' + make_dt_interval(id)")
    spark.range(n).select(F.col("id").alias("o_orderkey"), F.element_at(F.array(F.lit("F"), F.lit("O")), (F.col("id") % 2 + 1).cast("int")).alias("o_orderstatus"),
                          (F.col("id") * 100.5).alias("o_totalprice"), day.alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority")).write.parquet(f"{sf}/orders.parquet")
    spark.range(n - 20).select(F.col("id").alias("event_id"), day.alias("ts"), F.format_string('{"k": %d}', F.col("id") % 100).alias("props")).write.parquet(f"{sf}/events.parquet")
    spark.range(3 * n).select((F.col("id") % n).alias("l_orderkey"), (F.col("id") / n + 1).cast("int").alias("l_linenumber"),
                              F.element_at(F.array(F.lit("R"), F.lit("A"), F.lit("N")), (F.col("id") % 7 % 3 + 1).cast("int")).alias("l_returnflag"),
                              F.lit("O").alias("l_linestatus")).write.parquet(f"{sf}/lineitem.parquet")
    insp = catalog.inspections(spark, sf)
    insp = insp.mapInArrow(counted, insp.schema)
    for name in ("_MODEL_CACHE", "_FRAME_CACHE"):
        monkeypatch.setattr(catalog, name, {})
    monkeypatch.setattr(catalog, "inspections", lambda *_: insp)
    scored = E.queries()["score_stream"](spark, sf)
    # rows without an event have no time, ids 0 and 97 no odometer
    assert scored.count() == n - 20 - 2 and derived.value == n
    assert not insp.storageLevel.useDisk
