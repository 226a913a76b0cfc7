"""Registered queries whose DuckDB SQL checks an operator end to end.

* Models: a tree of depth one over 0/1 features, a one-tree forest of it and a
  one-round booster are the same stump, which SQL can state.  So fitting, search,
  scores, importances, request scoring (batch, stream, saved model) and residuals
  are compared row by row.  The fits with the library's defaults stay in ``catalog``.
* Tests: statistic, p-value and verdict; SQL integrates the densities by Simpson's rule.
* Readers, writers and column operators: written, read back and compared by row.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gearlens import schema as S
from gearlens.functions import timefx as TF
from gearlens.operators import encode as EN
from gearlens.operators import prep as P
from gearlens.operators import profile as PR
from gearlens.operators import stats as ST
from gearlens.plans import booster as BO
from gearlens.plans import model as ML
from gearlens.plans import pipelines as PL
from gearlens.plans import score as SC
from gearlens.plans.catalog import (_FUEL_OF, _PRIORITIES, _SQL_BUCKET, _TREND_FEATURES, _TREND_LONG, _anova_sql, _kept_inspections, _kw_sql, _requests,
                                    _service_features, _spearman_sql, iso_ts, r6, register)
from gearlens.session import shared_folder
from gearlens.sources import io as IO
from gearlens.sources.driver_tables import INSP_COLUMNS, SLOT_COLUMNS, inspections, table, with_insp
from gearlens.sources.requests import DIAGNOSTIC_SLOT, read_requests
from gearlens.streaming.score_stream import run_to_completion, score_stream


def _scratch(spark, name: str) -> str:
    return shared_folder(spark, f"{name}-{uuid.uuid4().hex}")


# ---------------------------------------------------------------------------
# Write, read back, compare
# ---------------------------------------------------------------------------
_FORMATS = ("parquet", "csv", "json", "orc")
_FEW = [S.KEY, S.REG_YEAR, S.ODOMETER, S.FUEL]


@register("read_formats", with_insp(
    f"select f.format, {', '.join(_FEW)} from insp, (values {', '.join(f'({chr(39)}{f}{chr(39)})' for f in _FORMATS)}) f(format)"))
def q_read_formats(spark, sf_dir):
    run = _scratch(spark, "formats")
    IO.write_table(inspections(spark, sf_dir).select(*_FEW), f"{run}/insp.parquet")
    src = spark.read.parquet(f"{run}/insp.parquet")
    for f in _FORMATS[1:]:
        src.write.format(f).option("header", True).save(f"{run}/insp.{f}")
    # the first path of each pair doesn't exist
    back = [IO.read_inspections(spark, f"{run}/none.{f}", src.schema, alternatives=[f"{run}/insp.{f}"]).withColumn("format", F.lit(f)) for f in _FORMATS]
    return reduce(DataFrame.unionByName, back).select("format", *_FEW)


@register("records_csv", with_insp(f"""
select {S.KEY}, {S.FUEL}, {S.TARGET} from insp where {S.TARGET} <= {S.WEAK_RATING_MAX}"""))
def q_records_csv(spark, sf_dir):
    weak = P.filter_weak(inspections(spark, sf_dir).select(S.KEY, S.FUEL, S.TARGET))
    path = _scratch(spark, "records")
    IO.write_records_csv(weak, path)
    return IO.read_inspections(spark, path, weak.schema, "csv")


_B = "engineTransmission_"
_PLAIN = {S.REG_YEAR: S.REG_YEAR, S.REG_MONTH: S.REG_MONTH, S.ODOMETER: S.ODOMETER,
          S.HOUR: f"hour({S.TIME})", S.MON: f"month({S.TIME})"}
_PRODUCTION = {**_PLAIN, f"{_B}battery_value_Yes_Yes": f"({_B}battery_value = 'Yes')::int",
               **{f"{_B}battery_cc_value_{v}": "(" + " or ".join(f"coalesce({c} = '{v}', false)" for c in SLOT_COLUMNS) + ")::int" for v in ("N", "R")},
               **{f"fuel_type_{P.sanitize_name(p)}": f"(fuel_type = '{p}')::int" for p in _PRIORITIES},
               f"{_B}comments_value_O": f"coalesce(({_B}comments_value_0 = 'O')::int, 0)"}


@register("saved_columns", with_insp("\nunion all\n".join(
    f"select '{n}' as feature, round(sum(coalesce(cast({e} as double), 0)), 2) as total from insp" for n, e in _PRODUCTION.items())))
def q_saved_columns(spark, sf_dir):
    """The feature list, saved and loaded, applied to the table."""
    ff = PL.production_features(inspections(spark, sf_dir))
    path = _scratch(spark, "columns")
    ML.save_columns(spark, ff.features, path)
    names = ML.load_columns(spark, path)
    sums = P.align_features(ff.df, names).agg(*[F.round(F.coalesce(F.sum(n), F.lit(0.0)), 2).alias(n) for n in names])
    return sums.unpivot([], names, "feature", "total")


_N_SLOTS = " + ".join(f"({c} is not null)::int" for c in DIAGNOSTIC_SLOT.values())
_N_SET = " + ".join(f"coalesce(({c} = 'R')::int, 0)" for c in DIAGNOSTIC_SLOT.values())


@register("read_requests", with_insp(f"""
select cast(appointmentId as varchar) as request_id, strftime(inspectionStartTime, '%Y-%m-%dT%H:%M') as inspectionStartTime,
       coalesce(cast(cast(trunc(odometer_reading) as bigint) as varchar), 'x') as odometer_reading, {_FUEL_OF} as fuel_type, year, month,
       {_N_SLOTS} as n_given, {_N_SET} as n_set from insp"""))
def q_read_requests(spark, sf_dir):
    path = _scratch(spark, "requests")
    _requests(spark, sf_dir).write.json(path)
    given = F.map_values("diagnostics")
    return read_requests(spark, path).select(
        "request_id", "inspectionStartTime", "odometer_reading", "fuel_type", "year", "month",
        F.size(given).alias("n_given"), F.size(F.filter(given, lambda v: v)).alias("n_set"))


# ---------------------------------------------------------------------------
# every accepted form of a time, one per id class, and two that are none
# ---------------------------------------------------------------------------
# (pattern, what follows it, unit that the form keeps)
_TIME_FORMS = [("yyyy-MM-dd'T'HH:mm", "", "minute"), ("yyyy-MM-dd'T'HH:mm:ss", "", "second"), ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "", "microsecond"),
               ("yyyy-MM-dd HH:mm", "", "minute"), ("yyyy-MM-dd HH:mm:ss", "", "second"), ("yyyy-MM-dd HH:mm:ss.SSSSSS", "", "microsecond"),
               ("yyyy-MM-dd", "", "day"), ("yyyy/MM/dd", "", "day"), ("yyyy/MM/dd HH:mm", "", "minute"), ("yyyy-MM-dd'T'HH:mm:ss.SSS", "Z", "millisecond"),
               ("yyyy-MM-dd'T'HH:mm", "+05:30", "minute"), ("yyyy-MM-dd HH:mm:ss", "-0800", "second"), ("yyyy-MM-dd HH:mm:ss.SSSSSS", "789", "microsecond"),
               ("'soon' HH:mm", "", None), ("yyyy-MM-dd'T'HH", "", None)]


@register("parse_time_forms", with_insp(f"select {S.KEY}, strftime(case {S.KEY} % {len(_TIME_FORMS)} " + " ".join(
    f"when {i} then " + (f"date_trunc('{unit}', {S.TIME})::timestamp" if unit else "null") for i, (_, _, unit) in enumerate(_TIME_FORMS))
    + " end, '%Y-%m-%d %H:%M:%S.%f') as parsed from insp"))
def q_parse_time_forms(spark, sf_dir):
    form = F.col(S.KEY) % len(_TIME_FORMS)
    text = F.coalesce(*[F.when(form == i, F.concat(F.date_format(S.TIME, p), F.lit(end))) for i, (p, end, _) in enumerate(_TIME_FORMS)])
    return inspections(spark, sf_dir).select(S.KEY, iso_ts(TF.parse_time(text)).alias("parsed"))


# ---------------------------------------------------------------------------
# P4, P10, P13, P15, A3, A4
# ---------------------------------------------------------------------------
@register("select_columns_of_type", with_insp(f"select {S.KEY}, {S.REG_YEAR}, {S.REG_MONTH}, {S.ODOMETER}, {S.TARGET} from insp"))
def q_select_columns_of_type(spark, sf_dir):
    return P.select_columns_of_type(inspections(spark, sf_dir), "numeric", keep=[S.KEY])


@register("first_present", with_insp(f"select {S.KEY}, {S.REG_YEAR} as registered from insp"))
def q_first_present(spark, sf_dir):
    df = inspections(spark, sf_dir)
    return df.select(S.KEY, F.col(P.first_present(df, ["registration_year", S.REG_YEAR, S.REG_MONTH])).alias("registered"))


@register("sanitize_names", with_insp(f"select {S.KEY}, " + ", ".join(
    f"(fuel_type = '{p}')::int as fuel_type_{p.replace('-', '_').replace(' ', '_')}" for p in _PRIORITIES) + " from insp"))
def q_sanitize_names(spark, sf_dir):
    return P.sanitize_names(EN.one_hot_drop_first(inspections(spark, sf_dir).select(S.KEY, S.FUEL), [S.FUEL]))


_TYPES = {S.KEY: "bigint", S.TIME: "timestamp_ntz", S.REG_YEAR: "int", S.REG_MONTH: "int", S.ODOMETER: "double", S.TARGET: "double"}


def _profile_sql(cols, extra: str = "") -> str:
    return "\nunion all\n".join(f"select {extra}'{c}' as column_name, '{_TYPES.get(c, 'string')}' as data_type, count({c}) as non_null from insp" for c in cols)


@register("schema_profile", with_insp(_profile_sql(INSP_COLUMNS)))
def q_schema_profile(spark, sf_dir):
    return PR.schema_profile(inspections(spark, sf_dir))


@register("split_target", with_insp(_profile_sql([c for c in INSP_COLUMNS if c != S.TARGET], "'features' as part, ") + "\nunion all\n"
                                    + _profile_sql([S.TARGET], "'target' as part, ")))
def q_split_target(spark, sf_dir):
    x, y = P.split_target(inspections(spark, sf_dir))
    part = lambda df, name: PR.schema_profile(df).select(F.lit(name).alias("part"), "column_name", "data_type", "non_null")
    return part(x, "features").union(part(y, "target"))


_KINDS = {"string": [c for c in INSP_COLUMNS if c not in _TYPES], "timestamp": [S.TIME], "numeric": [c for c in _TYPES if c != S.TIME]}


@register("type_counts", with_insp("\nunion all\n".join(
    f"select '{k}' as kind, {len(cols)} as n_columns, {' + '.join(f'count({c})' for c in cols)} as non_null from insp" for k, cols in _KINDS.items())))
def q_type_counts(spark, sf_dir):
    """Columns per kind with the values that they hold."""
    df = inspections(spark, sf_dir)
    kinds = PR.type_counts(df)
    filled = df.agg(*[sum((F.count(c) for c in PR.columns_of_kind(df, k)), F.lit(0)).alias(k) for k in kinds])
    n = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in kinds.items()])
    return filled.unpivot([], list(kinds), "kind", "non_null").select("kind", n.alias("n_columns"), "non_null")


# ---------------------------------------------------------------------------
# M2-M12, S4, X1 with stumps
# ---------------------------------------------------------------------------
FLAGS = [*S.FUEL_FLAGS.values(), *S.DIAGNOSTIC_FLAGS.values()]
_FUEL_IS = dict(zip(S.FUEL_FLAGS.values(), (
    "fuel_type = '1-URGENT'", "fuel_type = '2-HIGH'", "fuel_type = '3-MEDIUM'",
    "fuel_type = '5-LOW' and appointmentId % 2 = 0", "fuel_type = '5-LOW' and appointmentId % 2 = 1")))
_DIAG_IS = {name: f"{DIAGNOSTIC_SLOT[key]} = 'R'" for key, name in S.DIAGNOSTIC_FLAGS.items()}
_FLAG_SQL = {f: f"coalesce(({e})::int, 0)" for f, e in {**_FUEL_IS, **_DIAG_IS}.items()}
# a request names no hybrid: every '5-LOW' is electric
_ASKED = {**_FUEL_IS, "fuel_type_Electric": "fuel_type = '5-LOW'", "fuel_type_Hybrid": "false", **_DIAG_IS}
_ASKED_SQL = {f: f"coalesce(({e})::int, 0)" for f, e in _ASKED.items()}


def _long_sql(flags: dict) -> str:
    return "[" + ", ".join(f"{{'f': '{f}', 'x': {e}}}" for f, e in flags.items()) + "]"


_SERVICE = f"""lg as (select appointmentId, bucket, y, u.f as feature, u.x as x from (
  select appointmentId, {_SQL_BUCKET} as bucket, greatest(rating_engineTransmission - 0.5 * ({_N_SET}), 0.0)::double as y,
         unnest({_long_sql(_FLAG_SQL)}) as u from insp where rating_engineTransmission is not null))"""


def _stump_sql(where: str, y: str = "y") -> str:
    """CTEs: ``bs`` the feature that splits best, ``pm`` the mean of either side,
    ``pr`` the prediction of every row, from the rows of ``where``."""
    return f"""{_SERVICE},
sd as (select feature, x, count(*) as n, sum({y})::double as s from lg where {where} group by 1, 2),
bs as (select feature from sd group by 1 having count(*) = 2 order by sum(s * s / n) desc limit 1),
pm as (select x, s / n as pred from sd join bs using (feature)),
pr as (select appointmentId, bucket, y, pred from lg join bs using (feature) join pm using (x))"""


def _r2_sql(where: str, y: str = "y") -> str:
    return f"(select round(1 - sum(({y} - pred) * ({y} - pred)) / (var_pop({y}) * count(*)), 6) from pr where {where})"


_STUMP = {"decision_tree": {"maxDepth": 1},
          "random_forest": {"maxDepth": 1, "numTrees": 1, "bootstrap": False, "featureSubsetStrategy": "all"},
          "boosted": {"maxDepth": 1, "maxIter": 1}}
_FIT = "bucket < 80"


@contextmanager
def _service_rows(spark, sf_dir):
    """Key, flags and rating of all inspections, kept while a query's fits read them."""
    rows = _service_features(spark, sf_dir).df.select(S.KEY, *FLAGS, S.TARGET).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield rows
    finally:
        rows.unpersist()


def _stump(rows, kind: str = "boosted"):
    fit, _ = ML.split(rows, weights=(0.80, 0.20))
    return ML.train(fit, FLAGS, kind, **_STUMP[kind])


@register("stump_compare_models", with_insp(
    f"select m.model, {_r2_sql('bucket < 64')} as train_r2, {_r2_sql('bucket >= 64 and bucket < 80')} as validation_r2 "
    "from (values ('decision_tree'), ('random_forest'), ('boosted')) m(model)", _stump_sql("bucket < 64")))
def q_stump_compare_models(spark, sf_dir):
    with _service_rows(spark, sf_dir) as rows:
        tr, va, _ = ML.split(rows)
        got = ML.compare_models(tr, va, FLAGS, params=_STUMP)
    return got.select("model", r6("train_r2").alias("train_r2"), r6("validation_r2").alias("validation_r2"))


_FOLDS = 3


@register("stump_random_search", with_insp(f"""
select '{{''maxDepth'': ' || d || '}}' as params,
       round(avg(1 - case d when 0 then e0 else e1 end / v), 6) as mean_cv_r2
from ev, range(0, 2) t(d) group by d""", f"""{_SERVICE},
tr as (select *, bucket % {_FOLDS} as fold from lg where bucket < 64),
sd as (select k, feature, x, count(*) as n, sum(y)::double as s from tr, range(0, {_FOLDS}) t(k) where fold <> k group by 1, 2, 3),
bs as (select k, feature from (select k, feature, row_number() over (partition by k order by sum(s * s / n) desc) as r
       from sd group by 1, 2 having count(*) = 2) where r = 1),
pm as (select k, feature, x, s / n as pred, sum(s) over (partition by k) / sum(n) over (partition by k) as flat from sd join bs using (k, feature)),
ev as (select k, sum((y - pred) * (y - pred)) as e1, sum((y - flat) * (y - flat)) as e0, var_pop(y) * count(*) as v
       from tr join pm on tr.feature = pm.feature and tr.x = pm.x and fold = k group by 1)"""))
def q_stump_random_search(spark, sf_dir):
    with _service_rows(spark, sf_dir) as rows:
        cv, maps = ML.random_search(ML.split(rows)[0], FLAGS, {"maxDepth": [0, 1]}, n=2, folds=_FOLDS, kind="decision_tree")
    return ML.search_results(cv, maps).select("params", r6("mean_cv_r2").alias("mean_cv_r2"))


@register("stump_final_fit", with_insp(f"""
select 'train_r2' as metric, {_r2_sql(_FIT, 'trunc(y)')} as value
union all select 'test_r2', {_r2_sql('bucket >= 80', 'trunc(y)')}
union all select 'test_r2_raw_target', {_r2_sql('bucket >= 80')}""", _stump_sql(_FIT, "trunc(y)")))
def q_stump_final_fit(spark, sf_dir):
    with _service_rows(spark, sf_dir) as rows:
        _, metrics = ML.final_fit(*ML.split(rows), FLAGS, **_STUMP["boosted"])
    return metrics.select("metric", r6("value").alias("value"))


@register("stump_importance", with_insp(
    "select distinct lg.feature, case when bs.feature is null then 0.0 else 1.0 end::double as importance from lg left join bs using (feature)",
    _stump_sql(_FIT)))
def q_stump_importance(spark, sf_dir):
    with _service_rows(spark, sf_dir) as rows:
        return ML.feature_importance(_stump(rows, "decision_tree"), FLAGS, None)


_ANSWERS = _stump_sql(_FIT) + f""",
rq as (select request_id, odo, pred from (
  select cast(appointmentId as varchar) as request_id, trunc(odometer_reading) as odo, unnest({_long_sql(_ASKED_SQL)}) as u
  from insp where odometer_reading is not null and inspectionStartTime is not null) join bs on u.f = bs.feature join pm on u.x = pm.x)"""
_GRADE = "case " + " ".join(f"when pred >= {b} then '{t}'" for b, t in S.GRADE_THRESHOLDS) + f" else '{S.GRADE_FLOOR_TEXT}' end"
_SCORED = with_insp(f"""
select request_id, round(pred, 6) as raw_prediction, round(greatest(0.0, least(5.0, pred)), 6) as prediction, {_GRADE} as rating_text from rq""", _ANSWERS)


def _scored(df: DataFrame) -> DataFrame:
    return df.select("request_id", r6("raw_prediction").alias("raw_prediction"), r6("prediction").alias("prediction"), "rating_text")


@register("stump_score", _SCORED)
def q_stump_score(spark, sf_dir):
    with _service_rows(spark, sf_dir) as rows:
        m = _stump(rows)
    return _scored(SC.score_requests(_requests(spark, sf_dir), m, FLAGS)[0])


@register("stump_saved_model", _SCORED)
def q_stump_saved_model(spark, sf_dir):
    path = _scratch(spark, "model")
    with _service_rows(spark, sf_dir) as rows:
        ML.save_model(_stump(rows, "random_forest"), path)
    return _scored(SC.score_requests(_requests(spark, sf_dir), ML.load_model(path), FLAGS)[0])


@register("stump_score_stream", _SCORED)
def q_stump_score_stream(spark, sf_dir):
    run = _scratch(spark, "stump-stream")
    with _kept_inspections(spark, sf_dir):
        with _service_rows(spark, sf_dir) as rows:
            m = _stump(rows, "decision_tree")
        _requests(spark, sf_dir).write.json(f"{run}/in")
    run_to_completion(score_stream(spark, f"{run}/in", f"{run}/out", m, FLAGS, checkpoint=f"{run}/ck"))
    return _scored(spark.read.parquet(f"{run}/out/scored"))


@register("stump_degradation", with_insp(f"""
select request_id, cast(step as int) as step, (odo + step * {S.DEGRADATION_STEP_KM})::double as odometer_reading,
       round(greatest(pred, 0.0), 6) as prediction from rq, range(0, {S.DEGRADATION_POINTS}) t(step)""", _ANSWERS))
def q_stump_degradation(spark, sf_dir):
    with _service_rows(spark, sf_dir) as rows:
        m = _stump(rows)
    # the odometer is carried with the features, so that the what-if has a column to change
    d = SC.degradation(_requests(spark, sf_dir), m, [S.ODOMETER, *FLAGS])
    return d.select("request_id", "step", "odometer_reading", r6("prediction").alias("prediction"))


_FENCE = 0.25


@register("stump_residual_outliers", with_insp(f"""
select appointmentId, y as rating, round(pred, 6) as prediction, round(r, 6) as residual from rs, fe
where r < q1 - {_FENCE} * (q3 - q1) or r > q3 + {_FENCE} * (q3 - q1)""", _stump_sql(_FIT) + """,
rs as (select *, abs(y - pred) as r from pr),
fe as (select quantile_cont(r, 0.25) as q1, quantile_cont(r, 0.75) as q3 from rs)"""))
def q_stump_residual_outliers(spark, sf_dir):
    with _service_rows(spark, sf_dir) as rows:
        m = _stump(rows)
    out = SC.residual_outliers(_service_features(spark, sf_dir).df, m, k=_FENCE)
    return out.select(S.KEY, "rating", r6("prediction").alias("prediction"), r6("residual").alias("residual"))


@register("request_features", with_insp(f"""
select cast(appointmentId as varchar) as request_id, {S.REG_YEAR}::double as {S.REG_YEAR}, {S.REG_MONTH}::double as {S.REG_MONTH},
       trunc({S.ODOMETER}) as {S.ODOMETER}, hour({S.TIME})::double as {S.HOUR}, month({S.TIME})::double as {S.MON},
       {', '.join(f'{e}::double as {f}' for f, e in _ASKED_SQL.items())} from insp where {S.ODOMETER} is not null and {S.TIME} is not null"""))
def q_request_features(spark, sf_dir):
    cols = [*_PLAIN, *FLAGS]
    return SC.request_features(_requests(spark, sf_dir), cols).where("reject_reason IS NULL").select("request_id", *cols)


# ---------------------------------------------------------------------------
# M4, M6, M8, M11 with the second-order booster
# ---------------------------------------------------------------------------
_L1, _L2, _RATE, _MIN = 0.05, 1.0, 0.5, 20
_LEAFWISE = {"rounds": 2, "num_leaves": 3, "learning_rate": _RATE, "reg_alpha": _L1, "reg_lambda": _L2, "min_rows": _MIN}
_FLAG_NO = f"list_position({FLAGS!r}, feature)"


def _soft(g: str, l1: float) -> str:
    return f"(sign({g}) * greatest(abs({g}) - {l1}, 0.0))"


def _side(g: str, n: str, l1: float, l2: float) -> str:
    return f"{_soft(g, l1)} * {_soft(g, l1)} / ({n} + {l2})"


def _split_sql(src: str, by: str = "", l1: float = _L1, l2: float = _L2, least: int = _MIN) -> str:
    """(by, feature, gain) of every split on a 0/1 feature from sums (by, feature, x, n, g)."""
    keys = f"{by}, " if by else ""
    gain = f"{_side('g0', 'n0', l1, l2)} + {_side('g1', 'n1', l1, l2)} - {_side('(g0 + g1)', '(n0 + n1)', l1, l2)}"
    return f"""(select {keys}feature, round({gain}, 9) as gain from (
  select {keys}feature, sum(n) filter (x = 0) as n0, sum(g) filter (x = 0) as g0, sum(n) filter (x = 1) as n1, sum(g) filter (x = 1) as g1
  from {src} group by {keys}feature) where n0 >= {least} and n1 >= {least} and {gain} > {BO.LEAST_GAIN})"""


def _round_sql(r: int) -> str:
    """CTEs of one round of three leaves: root split, best split of either child, values, new predictions ``p{r}``."""
    return f"""t{r} as (select appointmentId, pred - y as g from p{r - 1} where {_FIT}),
sa{r} as (select feature, x, count(*) as n, sum(g) as g from lg join t{r} using (appointmentId) group by 1, 2),
ba{r} as (select feature from {_split_sql(f'sa{r}')} order by gain desc, {_FLAG_NO} limit 1),
a{r} as (select appointmentId, x as side from lg join ba{r} using (feature)),
sb{r} as (select side, feature, x, count(*) as n, sum(g) as g from lg join t{r} using (appointmentId) join a{r} using (appointmentId) group by 1, 2, 3),
bb{r} as (select side, feature from {_split_sql(f'sb{r}', 'side')} order by gain desc, side, {_FLAG_NO} limit 1),
lf{r} as (select a.appointmentId, a.side, coalesce(x.x, -1) as below from a{r} a left join
  (select lg.appointmentId, bb.side, lg.x from lg join bb{r} bb using (feature)) x on x.appointmentId = a.appointmentId and x.side = a.side),
v{r} as (select side, below, -{_soft('sum(g)', _L1)} / (count(*) + {_L2}) * {_RATE} as v from lf{r} join t{r} using (appointmentId) group by 1, 2),
p{r} as (select p.appointmentId, p.bucket, p.y, p.pred + coalesce(v, 0.0) as pred from p{r - 1} p left join lf{r} using (appointmentId) left join v{r} using (side, below))"""


_BASE = f"""{_SERVICE},
on1 as (select distinct appointmentId, bucket, y from lg),
p0 as (select *, (select avg(y) from on1 where {_FIT}) as pred from on1)"""
_TWO_ROUNDS = f"{_BASE},\n{_round_sql(1)},\n{_round_sql(2)}"


def _leafwise(rows):
    return ML.train(ML.split(rows, weights=(0.80, 0.20))[0], FLAGS, "leafwise", **_LEAFWISE)


@register("leafwise_predictions", with_insp("select appointmentId, bucket < 80 as fitted, round(pred, 6) as prediction from p2", _TWO_ROUNDS))
def q_leafwise_predictions(spark, sf_dir):
    """Two rounds of three leaves with both penalties, row by row."""
    with _service_rows(spark, sf_dir) as rows:
        m = _leafwise(rows)
    out = m.transform(_service_features(spark, sf_dir).df.where(F.col(S.TARGET).isNotNull()))
    return out.select(S.KEY, (ML.split_bucket(S.KEY) < 80).alias("fitted"), r6(ML.PREDICTION).alias("prediction"))


@register("split_importance", with_insp(
    "select f.feature, count(b.feature)::double as importance from (select distinct feature from lg) f left join "
    "(select feature from ba1 union all select feature from bb1 union all select feature from ba2 union all select feature from bb2) b using (feature) group by 1",
    _TWO_ROUNDS))
def q_split_importance(spark, sf_dir):
    """M8 by number of splits, the leaf-wise library's default measure."""
    with _service_rows(spark, sf_dir) as rows:
        return ML.feature_importance(_leafwise(rows), FLAGS, None, "split")


_SPACE = {"rounds": [1, 2], "num_leaves": [2]}


def _fold_round(r: int) -> str:
    """One round of two leaves in every fold ``k``."""
    return f"""t{r} as (select k, appointmentId, pred - y as g from p{r - 1} where fold <> k),
s{r} as (select k, feature, x, count(*) as n, sum(g) as g from lg join t{r} using (appointmentId) group by 1, 2, 3),
b{r} as (select k, feature from (select *, row_number() over (partition by k order by gain desc, {_FLAG_NO}) as place from {_split_sql(f's{r}', 'k', 0.0)}) where place = 1),
v{r} as (select k, feature, x, -g / (n + {_L2}) * {_RATE} as v from s{r} join b{r} using (k, feature)),
p{r} as (select p.k, p.appointmentId, p.fold, p.y, p.pred + coalesce(v.v, 0.0) as pred
  from p{r - 1} p left join b{r} using (k) left join lg on lg.appointmentId = p.appointmentId and lg.feature = b{r}.feature
  left join v{r} v on v.k = p.k and v.x = lg.x)"""


@register("leafwise_search", with_insp(
    " union all ".join(f"""select '{{"num_leaves": 2, "rounds": {r}}}' as params, round(avg(r2), 6) as mean_cv_r2 from
(select k, 1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)) as r2 from p{r} where fold = k group by 1)""" for r in _SPACE["rounds"]),
    f"""{_SERVICE},
tr as (select distinct appointmentId, bucket % {_FOLDS} as fold, y from lg where bucket < 64),
p0 as (select k::int as k, appointmentId, fold, y, avg(y) filter (fold <> k) over (partition by k) as pred from tr, range(0, {_FOLDS}) r(k)),
{_fold_round(1)},
{_fold_round(2)}"""))
def q_leafwise_search(spark, sf_dir):
    """M6 on a small space whose two settings are one path."""
    base = BO.Settings(learning_rate=_RATE, reg_lambda=_L2, min_rows=_MIN)
    with _service_rows(spark, sf_dir) as rows:
        found = BO.boosted_search(ML.split(rows)[0], FLAGS, _SPACE, 2, _FOLDS, base)
    return BO.search_table(spark, found, _SPACE).withColumn("mean_cv_r2", r6("mean_cv_r2"))


_BAND_KM = 20000
_BAND = f"floor(odometer_reading / {_BAND_KM})"


@register("leafwise_missing", with_insp("select appointmentId, round(case when coalesce(band <= cut, low) then left_mean else right_mean end, 6) as prediction from mb, best", f"""
mb as (select appointmentId, {_SQL_BUCKET} as bucket, {_BAND} as band, {S.TARGET}::double as y from insp),
fr as (select band, y - avg(y) over () as g, avg(y) over () as mean from mb where {_FIT} and y is not null),
cd as (select cut, low, coalesce(band <= cut, low) as goes_left, g, mean from fr, (select distinct band as cut from fr where band is not null), (values (true), (false)) s(low)),
sm as (select cut, low, any_value(mean) as mean, count(*) filter (goes_left) as nl, count(*) filter (not goes_left) as nr,
         sum(g) filter (goes_left) as gl, sum(g) filter (not goes_left) as gr from cd group by 1, 2),
best as (select cut, low, mean + gl / nl as left_mean, mean + gr / nr as right_mean from sm where nl >= {_MIN} and nr >= {_MIN}
         order by round(gl * gl / nl + gr * gr / nr, 9) desc, cut, low desc limit 1)"""))
def q_leafwise_missing(spark, sf_dir):
    """One split on a column with missing values, which go to the side they fit."""
    rows = inspections(spark, sf_dir).select(S.KEY, F.floor(F.col(S.ODOMETER) / _BAND_KM).alias("band"), S.TARGET)
    m = ML.train(ML.split(rows, weights=(0.80, 0.20))[0], ["band"], "leafwise", rounds=1, num_leaves=2, learning_rate=1.0, min_rows=_MIN)
    return m.transform(rows).select(S.KEY, r6(ML.PREDICTION).alias("prediction"))


@register("odometer_degradation", with_insp(f"""
select cast(appointmentId as varchar) as request_id, cast(step as int) as step, (trunc(odometer_reading) + step * {S.DEGRADATION_STEP_KM})::double as odometer_reading,
       round(greatest(case when trunc(odometer_reading) + step * {S.DEGRADATION_STEP_KM} <= cut then left_mean else right_mean end, 0.0), 6) as prediction
from insp, best, range(0, {S.DEGRADATION_POINTS}) t(step) where odometer_reading is not null and inspectionStartTime is not null""", f"""
od as (select odometer_reading::double as x, {S.TARGET}::double as y from insp where {_SQL_BUCKET} < 80 and rating_engineTransmission is not null and odometer_reading is not null),
rk as (select x, y, count(*) over (order by x) as upto, count(*) over () as total from od),
ct as (select max(x) as cut from rk group by ceil(upto * {BO.MAX_BIN - 1} / total)),
sm as (select cut, avg(y) filter (x <= cut) as left_mean, avg(y) filter (x > cut) as right_mean, count(*) filter (x <= cut) as nl, count(*) filter (x > cut) as nr,
         any_value(m) as m from od, ct, (select avg(y) as m from od) group by 1),
best as (select cut, left_mean, right_mean from sm where nl >= {_MIN} and nr >= {_MIN}
         order by round(nl * pow(left_mean - m, 2) + nr * pow(right_mean - m, 2), 9) desc, cut limit 1)"""))
def q_odometer_degradation(spark, sf_dir):
    """M11 with one split on the odometer, so that a wrong step changes the answer."""
    rows = inspections(spark, sf_dir).select(S.KEY, S.ODOMETER, S.TARGET).where(F.col(S.ODOMETER).isNotNull())
    m = ML.train(ML.split(rows, weights=(0.80, 0.20))[0], [S.ODOMETER], "leafwise", rounds=1, num_leaves=2, learning_rate=1.0, min_rows=_MIN)
    d = SC.degradation(_requests(spark, sf_dir), m, [S.ODOMETER])
    return d.select("request_id", "step", "odometer_reading", r6("prediction").alias("prediction"))


@register("cast_double", with_insp("select appointmentId, try_cast(fuel_type as double) as fuel_number, odometer_reading::double as odometer_reading from insp"))
def q_cast_double(spark, sf_dir):
    df = inspections(spark, sf_dir).select(S.KEY, F.col(S.FUEL).alias("fuel_number"), S.ODOMETER)
    return P.cast_double(df, ["fuel_number", S.ODOMETER])


# ---------------------------------------------------------------------------
# T1-T5 with p-value and verdict
# ---------------------------------------------------------------------------
_STEPS = 4000
_SIMPSON = f"case when i in (0, {_STEPS}) then 1 when i % 2 = 1 then 4 else 2 end"


def _f_tail(src: str, f: str, d1: str, d2: str) -> str:
    """CTE ``tail`` (feature, p): P(F > f); with sin^2 = d1 f / (d1 f + d2) the density is a
    product of powers of sine and cosine, integrated from there."""
    return f"""ta as (select feature, {d1}::double as d1, {d2}::double as d2, atan(sqrt({d1} * {f} / {d2})) as lo from {src}),
tb as (select *, least(lo + 40 / sqrt(d2), pi() / 2) as hi, ln(2) + lgamma((d1 + d2) / 2) - lgamma(d1 / 2) - lgamma(d2 / 2) as c from ta),
tail as (select feature, sum({_SIMPSON} * exp(c + (d1 - 1) * ln(sin(lo + i * (hi - lo) / {_STEPS})) + (d2 - 1) * ln(cos(lo + i * (hi - lo) / {_STEPS}))))
                * any_value(hi - lo) / {_STEPS} / 3 as p from tb, range(0, {_STEPS} + 1) t(i) group by 1)"""


def _chi_tail(src: str, h: str, d: str) -> str:
    """CTE ``chi`` (feature, p): P(chi-square > h), integrated over the root of half the variable."""
    return f"""ca as (select feature, {d}::double as d, sqrt({h} / 2) as lo from {src}),
chi as (select feature, sum({_SIMPSON} * 2 * exp((d - 1) * ln(lo + i * 12.0 / {_STEPS}) - pow(lo + i * 12.0 / {_STEPS}, 2) - lgamma(d / 2)))
               * 12.0 / {_STEPS} / 3 as p from ca, range(0, {_STEPS} + 1) t(i) group by 1)"""


def _verdict(p: str) -> str:
    return f"case when {p} < {ST.ALPHA} then 'significant' else 'not significant' end"


def _tested(df: DataFrame) -> DataFrame:
    return df.withColumns({c: r6(c) for c in df.columns if c in ("statistic", "rho", "p_value")})


@register("spearman_test", with_insp(
    "select 'spearman' as test, 'year' as a, 'rating_engineTransmission' as b, n, round(rho, 6) as rho, round(p, 6) as p_value from rr, tail",
    _spearman_sql("insp", "year", "rating_engineTransmission") + """,
rr as (select 'r' as feature, count(*) as n, corr(ra, rb) as rho from rk),
""" + _f_tail("rr", "(rho * rho * (n - 2) / (1 - rho * rho))", "1", "(n - 2)")))
def q_spearman_test(spark, sf_dir):
    return _tested(ST.spearman(inspections(spark, sf_dir), S.REG_YEAR, S.TARGET))


_FUEL_LONG = "select 'fuel_type' as feature, fuel_type as value, rating_engineTransmission as y from insp"


@register("kruskal_wallis_test", with_insp(
    "select feature, k, round(h, 6) as statistic, (k - 1)::double as df, round(p, 6) as p_value from ks join chi using (feature)",
    _kw_sql(_FUEL_LONG) + ",\n" + _chi_tail("ks", "h", "(k - 1)")))
def q_kruskal_wallis_test(spark, sf_dir):
    return _tested(ST.kruskal_wallis(inspections(spark, sf_dir), S.FUEL))


@register("t_test_test", "with " + _kw_sql("select 'l_linestatus' as feature, l_linestatus as value, l_quantity as y from lineitem") + ",\n"
          + _f_tail("tt", "(t * t)", "1", "tdf")
          + "\nselect feature, round(t, 6) as statistic, tdf as df, round(p, 6) as p_value from tt join tail using (feature)")
def q_t_test_test(spark, sf_dir):
    return _tested(ST.t_test(table(spark, sf_dir, "lineitem"), "l_linestatus", "l_quantity"))


@register("temporal_trends_test", with_insp(f"""
select feature, n_groups, test, round(statistic, 6) as statistic, df, round(p, 6) as p_value,
       case when n_groups < 2 then 'not enough groups' when statistic is null then 'no variation' else {_verdict('p')} end as verdict
from (select ka.feature, ka.k as n_groups, case when ka.k > 2 then 'Kruskal-Wallis' when ka.k = 2 then 't-test' end as test,
             case when ka.k > 2 then h when ka.k = 2 then t end as statistic, case when ka.k > 2 then (ka.k - 1)::double when ka.k = 2 then tdf end as df,
             case when ka.k > 2 then chi.p when ka.k = 2 then tail.p end as p
      from ka left join ks using (feature) left join tt using (feature) left join chi using (feature) left join tail using (feature))""",
    _kw_sql(_TREND_LONG) + ",\n" + _chi_tail("ks", "h", "(k - 1)") + ",\n" + _f_tail("tt", "(t * t)", "1", "tdf")))
def q_temporal_trends_test(spark, sf_dir):
    return _tested(ST.temporal_trends(TF.time_features(inspections(spark, sf_dir)), _TREND_FEATURES))


_AN = _anova_sql("\nunion all\n".join(
    f"select '{c}' as feature, coalesce({c}, 'Unknown') as value, rating_engineTransmission as y from insp" for c in SLOT_COLUMNS)).split("|")


@register("anova_test", with_insp(f"""
select an.feature, k as n_groups, round(f, 6) as statistic, df1, df2, round(p, 6) as p_value, {_verdict('p')} as verdict from an join tail using (feature)""",
    _AN[0] + ",\nan as (select feature, k, (ssb / (k - 1)) / (ssw / (nn - k)) as f, (k - 1)::double as df1, (nn - k)::double as df2 from aa),\n"
    + _f_tail("an", "f", "df1", "df2")))
def q_anova_test(spark, sf_dir):
    return _tested(ST.anova(P.fill_unknown(inspections(spark, sf_dir), SLOT_COLUMNS), SLOT_COLUMNS))
