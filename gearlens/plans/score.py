"""Scoring of request records (M10), the mileage what-if (M11) and
rating/prediction disagreement (M12).

A request becomes one row of the trained feature list in a single
projection: time features from the parsed time, odometer, fuel and
diagnostic flags, optional registration year/month (0 when absent, as the
original service), every other feature 0.  Records that cannot be scored
(unparseable time or odometer) are set aside with a reason instead of
failing the job.
"""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gearlens import schema as S
from gearlens.functions import bands as BD
from gearlens.functions.timefx import parse_time
from gearlens.operators.profile import fences
from gearlens.plans.model import PREDICTION
from gearlens.session import shared_folder


def _q(c: str) -> str:
    return f"`{c}`"


def parsed_requests(req: DataFrame) -> DataFrame:
    """Typed request fields plus ``reject_reason`` (null for good records)."""
    t = parse_time("inspectionStartTime")
    text = F.col("odometer_reading").cast("string")
    real = text.try_cast("double")                     # "50000.0" is as good as "50000"
    odo = F.coalesce(text.try_cast("bigint"), F.when((real == F.floor(real)) & (F.abs(real) < 2.0**53), real.try_cast("bigint")))
    diag = F.coalesce(F.col("diagnostics"), F.create_map().cast("map<string,boolean>"))
    extra = [c for c in req.columns if c not in ("inspectionStartTime", "odometer_reading", "diagnostics")]
    p = req.select(*[F.col(_q(c)) for c in extra], t.alias("__t"), odo.alias("__odo"), diag.alias("diagnostics"),
                   F.col("inspectionStartTime").alias("__time_text"),
                   F.col("odometer_reading").cast("string").alias("__odo_text"))
    reason = (F.when(F.col("__t").isNull(), F.lit("bad inspectionStartTime"))
               .when(F.col("__odo").isNull(), F.lit("bad odometer_reading")))
    return p.withColumn("reject_reason", reason)


def feature_exprs(columns, year_month_default: int = 0) -> list:
    """One expression per trained feature, in order (P14 semantics)."""
    fuel = {name: (F.col("fuel_type") == F.lit(choice)) for choice, name in S.FUEL_FLAGS.items()}
    diag = {name: BD.diagnostic_flag("diagnostics", key) for key, name in S.DIAGNOSTIC_FLAGS.items()}
    known = {
        S.HOUR: F.hour("__t"),
        S.MON: F.month("__t"),
        S.ODOMETER: F.col("__odo"),
        S.REG_YEAR: F.coalesce(F.col("year"), F.lit(year_month_default)),
        S.REG_MONTH: F.coalesce(F.col("month"), F.lit(year_month_default)),
    }
    out = []
    for c in columns:
        if c in known:
            e = known[c]
        elif c in fuel:
            e = F.coalesce(fuel[c].cast("int"), F.lit(0))
        elif c in diag:
            e = diag[c].cast("int")
        else:
            e = F.lit(0)
        out.append(e.cast("double").alias(c))
    return out


def unset_features(columns) -> list[str]:
    """Trained features that no request can set: they are 0 for every request."""
    settable = {S.HOUR, S.MON, S.ODOMETER, S.REG_YEAR, S.REG_MONTH, *S.FUEL_FLAGS.values(), *S.DIAGNOSTIC_FLAGS.values()}
    return [c for c in columns if c not in settable]


def request_features(req: DataFrame, columns, year_month_default: int = 0) -> DataFrame:
    """M10 input: (request_id, reject_reason, features...)."""
    p = parsed_requests(req)
    for c in ("year", "month", "fuel_type", "request_id"):
        if c not in p.columns:
            p = p.withColumn(c, F.lit(None).cast("int" if c in ("year", "month") else "string"))
    return p.select("request_id", "reject_reason", "__odo", "__time_text", "__odo_text",
                    *feature_exprs(columns, year_month_default))


def reject_records(req: DataFrame) -> DataFrame:
    """Records that cannot be scored, with their raw fields and the reason
    (needs no model)."""
    p = parsed_requests(req)
    rid = F.col("request_id") if "request_id" in p.columns else F.lit(None).cast("string")
    return p.where(F.col("reject_reason").isNotNull()).select(
        rid.alias("request_id"), F.col("__time_text").alias("inspectionStartTime"),
        F.col("__odo_text").alias("odometer_reading"), "reject_reason")


def score_requests(req: DataFrame, model: PipelineModel, columns,
                   year_month_default: int = 0) -> tuple[DataFrame, DataFrame]:
    """(scored, rejected).  Scored rows carry the clamped prediction and
    its grade; rejected rows carry the raw fields and the reason."""
    feats = request_features(req, columns, year_month_default)
    good = feats.where(F.col("reject_reason").isNull())
    bad = reject_records(req)
    pred = model.transform(good.drop("reject_reason", "__time_text", "__odo_text", "__odo"))
    return _graded(pred, PREDICTION), bad


def _graded(pred: DataFrame, raw: str) -> DataFrame:
    clamped = BD.clamp(F.col(raw))
    return pred.select("request_id", F.col(raw).alias("raw_prediction"),
                       clamped.alias("prediction"), BD.grade_threshold(clamped).alias("rating_text"))


def answer_requests(req: DataFrame, model: PipelineModel, columns, year_month_default: int = 0) -> DataFrame:
    """M10 as one row per record, for callers that keep a batch to split it: the raw
    prediction of a good record, the reason and raw fields of a rejected one (see
    :func:`split_answers`).  Fields are parsed once and no map is carried along.
    The model also sees rejected records, with 0 for what could not be read."""
    feats = request_features(req, columns, year_month_default)
    known = [F.coalesce(F.col(_q(c)), F.lit(0.0)).alias(c) for c in columns]
    pred = model.transform(feats.select("request_id", "reject_reason", "__time_text", "__odo_text", *known))
    bad = F.col("reject_reason").isNotNull()
    return pred.select("request_id", "reject_reason", F.when(~bad, F.col(PREDICTION)).alias("raw_prediction"),
                       F.when(bad, F.col("__time_text")).alias("inspectionStartTime"),
                       F.when(bad, F.col("__odo_text")).alias("odometer_reading"))


def split_answers(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scored, rejected) of :func:`answer_requests`, as :func:`score_requests` gives them."""
    bad = F.col("reject_reason").isNotNull()
    return (_graded(answers.where(~bad), "raw_prediction"),
            answers.where(bad).select("request_id", "inspectionStartTime", "odometer_reading", "reject_reason"))


def degradation(req: DataFrame, model: PipelineModel, columns, step: int = S.DEGRADATION_STEP_KM,
                n: int = S.DEGRADATION_POINTS, year_month_default: int = 0) -> DataFrame:
    """Re-score every good request with odometer +0, +step, ...
    (n points) in one batch; predictions have a floor of 0 only."""
    feats = request_features(req, columns, year_month_default).where(F.col("reject_reason").isNull())
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("step")
    grid = feats.select("*", k)
    grid = grid.withColumn(S.ODOMETER, (F.col("__odo") + F.col("step") * F.lit(step)).cast("double"))
    pred = model.transform(grid.drop("reject_reason", "__time_text", "__odo_text", "__odo"))
    return pred.select("request_id", F.col("step").cast("int").alias("step"), F.col(S.ODOMETER).alias("odometer_reading"),
                       BD.floor_zero(PREDICTION).alias("prediction"))


def residual_outliers(feats: DataFrame, model: PipelineModel, label: str = S.TARGET, k: float = 1.5,
                      key: str = S.KEY) -> DataFrame:
    """Labelled rows whose |rating - prediction| lies beyond the IQR
    fences of all residuals (ratings that disagree with the condition)."""
    pred = model.transform(feats.where(F.col(label).isNotNull()))
    res = pred.select(key, F.col(label).alias("rating"), F.col(PREDICTION).alias("prediction"),
                      F.abs(F.col(label) - F.col(PREDICTION)).alias("residual"))
    # the quartiles and the result read it: derived and scored once
    path = f"{shared_folder(feats.sparkSession, 'residuals')}/{uuid.uuid4().hex}"
    res.write.parquet(path)
    res = feats.sparkSession.read.parquet(path)
    f = fences(res, "residual", k)
    if f is None:
        return res.limit(0)
    lo, hi = f
    return res.where((F.col("residual") < F.lit(lo)) | (F.col("residual") > F.lit(hi)))
