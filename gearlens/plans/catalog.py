"""Registered queries (one per operator of the coverage list) and their
DuckDB oracle SQL.

Each query takes ``(spark, sf_dir)``, derives the ``insp`` table from the
driver tables and applies one operator over the whole table.  For the
check, computed doubles are rounded to 6 places and dates rendered as ISO
text on both sides, so the two engines' results compare value by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gearlens.sources.driver_tables import inspections, table, with_insp
from gearlens.operators import trends as TR

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def iso_date(c) -> F.Column:
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd")


def iso_ts(c) -> F.Column:
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


SQL_ISO_TS = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


# ---------------------------------------------------------------------------
# Minimum slice: daily volume with 7-row rolling mean and deviation (A7+W1+W2)
# ---------------------------------------------------------------------------
@register("volume_trend", with_insp("""
select strftime(d, '%Y-%m-%d') as inspection_date, n_inspections,
       case when count(n_inspections) over w = 7 then round(avg(n_inspections) over w, 6) end as rolling_mean,
       case when count(n_inspections) over w = 7 then round(stddev_samp(n_inspections) over w, 6) end as rolling_std
from daily
window w as (order by d rows between 6 preceding and current row)""",
    """daily as (
  select cast(inspectionStartTime as date) as d, count(appointmentId) as n_inspections
  from insp where inspectionStartTime is not null group by 1)"""))
def q_volume_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = TR.volume_trend(inspections(spark, sf_dir))
    return t.select(iso_date("inspection_date").alias("inspection_date"), "n_inspections",
                    r6("rolling_mean").alias("rolling_mean"), r6("rolling_std").alias("rolling_std"))


# ---------------------------------------------------------------------------
# Helpers shared by several oracle queries
# ---------------------------------------------------------------------------
from gearlens import schema as S  # noqa: E402
from gearlens.functions import timefx as TF  # noqa: E402
from gearlens.operators import prep as P  # noqa: E402
from gearlens.operators import profile as PR  # noqa: E402
from gearlens.sources.driver_tables import (  # noqa: E402
    COMMENT_COLUMN, CONDITION_COLUMN, INSP_COLUMNS, SLOT_COLUMNS)

ALL_SLOT_BLOCK = [CONDITION_COLUMN, *SLOT_COLUMNS, COMMENT_COLUMN]   # every engineTransmission_ column


def _sql_hist(src: str, expr: str, bins: int) -> tuple[str, str]:
    """CTEs + body of the equal-width histogram in DuckDB."""
    ctes = f"""hv as (select cast({expr} as double) as x from {src} where {expr} is not null and not isnan(cast({expr} as double))),
hr as (select case when min(x) = max(x) then min(x) - 0.5 else min(x) end as lo,
              case when min(x) = max(x) then max(x) + 0.5 else max(x) end as hi from hv),
hc as (select cast(least(floor((x - lo) / (hi - lo) * {bins}), {bins - 1}) as int) as bin, count(*) as n from hv, hr group by 1),
he as (select cast(b as int) as bin, lo + (hi - lo) * b / {bins} as bin_lo, lo + (hi - lo) * (b + 1) / {bins} as bin_hi
       from hr, range(0, {bins}) t(b))"""
    body = """select he.bin, round(bin_lo, 6) as bin_lo, round(bin_hi, 6) as bin_hi, coalesce(n, 0) as n
from he left join hc using (bin)"""
    return ctes, body


def _hist_out(h: DataFrame) -> DataFrame:
    return h.select("bin", r6("bin_lo").alias("bin_lo"), r6("bin_hi").alias("bin_hi"), "n")


# ---------------------------------------------------------------------------
# F1-F3 time features
# ---------------------------------------------------------------------------
@register("time_features", with_insp("""
select appointmentId, cast(hour(inspectionStartTime) as int) as inspection_hour,
       cast(month(inspectionStartTime) as int) as inspection_mon,
       strftime(inspectionStartTime, '%Y-%m-%d') as inspection_date,
       dayname(inspectionStartTime) as inspection_dow,
       cast(month(inspectionStartTime) as int) as inspection_month_num,
       monthname(inspectionStartTime) as inspection_month_name
from insp"""))
def q_time_features(spark, sf_dir):
    df = TF.time_features(inspections(spark, sf_dir).select(S.KEY, S.TIME), with_month_name=True)
    return df.select(S.KEY, S.HOUR, S.MON, iso_date(S.DATE).alias(S.DATE), S.DOW, S.MONTH_NUM, S.MONTH_NAME)


# Text forms of the inspection time, one per id class, plus a broken one.
_TEXT_SPARK = {0: "yyyy-MM-dd'T'HH:mm", 1: "yyyy-MM-dd HH:mm:ss", 2: "yyyy-MM-dd"}
_TEXT_DUCK = {0: "%Y-%m-%dT%H:%M", 1: "%Y-%m-%d %H:%M:%S", 2: "%Y-%m-%d"}


@register("parse_time", with_insp("""
select appointmentId, strftime(coalesce(
         try_strptime(t, '%Y-%m-%dT%H:%M'), try_strptime(t, '%Y-%m-%d %H:%M:%S'),
         try_strptime(t, '%Y-%m-%d')), '%Y-%m-%d %H:%M:%S') as parsed
from txt""", """txt as (
  select appointmentId,
         case appointmentId % 4 when 0 then strftime(inspectionStartTime, '%Y-%m-%dT%H:%M')
                                when 1 then strftime(inspectionStartTime, '%Y-%m-%d %H:%M:%S')
                                when 2 then strftime(inspectionStartTime, '%Y-%m-%d')
                                else 'bad' end as t
  from insp)"""))
def q_parse_time(spark, sf_dir):
    insp = inspections(spark, sf_dir)
    m = F.col(S.KEY) % 4
    text = (F.when(m == 0, F.date_format(S.TIME, _TEXT_SPARK[0]))
             .when(m == 1, F.date_format(S.TIME, _TEXT_SPARK[1]))
             .when(m == 2, F.date_format(S.TIME, _TEXT_SPARK[2]))
             .otherwise(F.lit("bad")))
    parsed = TF.parse_time(text)
    return insp.select(S.KEY, F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("parsed"))


# ---------------------------------------------------------------------------
# A7-A11, A13, A15-A17 volumes
# ---------------------------------------------------------------------------
@register("daily_volume", with_insp("""
select strftime(cast(inspectionStartTime as date), '%Y-%m-%d') as inspection_date, count(appointmentId) as n_inspections
from insp where inspectionStartTime is not null group by 1"""))
def q_daily_volume(spark, sf_dir):
    d = TR.daily_volume(inspections(spark, sf_dir))
    return d.select(iso_date(S.DATE).alias(S.DATE), "n_inspections")


@register("avg_daily_volume", with_insp("""
select round(avg(n), 6) as avg_daily_inspections from (
  select count(appointmentId) as n from insp where inspectionStartTime is not null
  group by cast(inspectionStartTime as date))"""))
def q_avg_daily_volume(spark, sf_dir):
    return TR.avg_daily_volume(inspections(spark, sf_dir)).select(r6("avg_daily_inspections").alias("avg_daily_inspections"))


@register("monthly_volume", with_insp("""
select cast(month(inspectionStartTime) as int) as inspection_month_num, monthname(inspectionStartTime) as inspection_month_name,
       count(*) as n_inspections
from insp where inspectionStartTime is not null group by 1, 2"""))
def q_monthly_volume(spark, sf_dir):
    return TR.monthly_volume(inspections(spark, sf_dir))


@register("avg_volume_by_weekday", with_insp("""
select inspection_dow, round(avg(n), 6) as avg_inspections from (
  select cast(inspectionStartTime as date) as d, dayname(inspectionStartTime) as inspection_dow, count(appointmentId) as n
  from insp where inspectionStartTime is not null group by 1, 2)
group by 1"""))
def q_avg_volume_by_weekday(spark, sf_dir):
    return TR.avg_volume_by_weekday(inspections(spark, sf_dir)).select(S.DOW, r6("avg_inspections").alias("avg_inspections"))


@register("hourly_volume", with_insp("""
select cast(hour(inspectionStartTime) as int) as inspection_hour, count(*) as n_inspections
from insp where inspectionStartTime is not null group by 1"""))
def q_hourly_volume(spark, sf_dir):
    return TR.hourly_volume(inspections(spark, sf_dir))


_c, _b = _sql_hist("dv", "n", 30)
@register("daily_intensity_histogram", with_insp(_b, """dv as (
  select count(*) as n from insp where inspectionStartTime is not null group by cast(inspectionStartTime as date)),
""" + _c))
def q_daily_intensity_histogram(spark, sf_dir):
    return _hist_out(TR.daily_intensity_histogram(inspections(spark, sf_dir), 30))


@register("vintage", with_insp("""
select year as registration_year, count(*) as n_inspections from insp where year is not null group by 1"""))
def q_vintage(spark, sf_dir):
    return TR.vintage(inspections(spark, sf_dir))


@register("registration_month_volume", with_insp("""
select month as registration_month, count(appointmentId) as n_inspections from insp where month is not null group by 1"""))
def q_registration_month_volume(spark, sf_dir):
    return TR.registration_month_volume(inspections(spark, sf_dir))


@register("group_mean", with_insp("""
select month, round(avg(rating_engineTransmission), 6) as mean_target from insp where month is not null group by 1"""))
def q_group_mean(spark, sf_dir):
    return TR.group_mean(inspections(spark, sf_dir), S.REG_MONTH).select(S.REG_MONTH, r6("mean_target").alias("mean_target"))


# ---------------------------------------------------------------------------
# A1-A6, A12, A14, A18-A22 profiling
# ---------------------------------------------------------------------------
_NULL_UNION = "\nunion all\n".join(
    f"select '{c}' as column_name, 100.0 * count_if({c} is null) / count(*) as null_pct from insp" for c in INSP_COLUMNS)


@register("null_rate", with_insp(f"""
select column_name, round(null_pct, 4) as null_pct from ({_NULL_UNION}) where null_pct > 50"""))
def q_null_rate(spark, sf_dir):
    return PR.null_rate(inspections(spark, sf_dir), 50)


@register("count_sparse_columns", with_insp(f"""
select count(*) as n_sparse_columns from ({_NULL_UNION}) where null_pct > 50"""))
def q_count_sparse_columns(spark, sf_dir):
    return PR.count_sparse_columns(inspections(spark, sf_dir), 50)


@register("is_unique", with_insp("""
select count(distinct appointmentId) = count(appointmentId) as is_unique from insp"""))
def q_is_unique(spark, sf_dir):
    return PR.is_unique(inspections(spark, sf_dir), S.KEY)


@register("span_days", with_insp("""
select cast(floor((epoch_us(max(inspectionStartTime)) - epoch_us(min(inspectionStartTime))) / 86400000000.0) as bigint) as span_days
from insp"""))
def q_span_days(spark, sf_dir):
    return PR.span_days(inspections(spark, sf_dir))


_c, _b = _sql_hist("insp", "hour(inspectionStartTime)", 10)
@register("histogram_hour", with_insp(_b, _c))
def q_histogram_hour(spark, sf_dir):
    df = TF.time_features(inspections(spark, sf_dir).select(S.TIME))
    return _hist_out(PR.histogram(df, S.HOUR, 10))


_c, _b = _sql_hist("insp", "rating_engineTransmission", 10)
@register("histogram_rating", with_insp(_b, _c))
def q_histogram_rating(spark, sf_dir):
    return _hist_out(PR.histogram(inspections(spark, sf_dir), S.TARGET, 10))


_c, _b = _sql_hist("events", "value", 10)
@register("histogram_event_value", f"with {_c}\n{_b}")
def q_histogram_event_value(spark, sf_dir):
    return _hist_out(PR.histogram(table(spark, sf_dir, "events"), "value", 10))


@register("value_shares", with_insp("""
select rating_engineTransmission as value, round(count(*) / sum(count(*)) over (), 6) as share
from insp where rating_engineTransmission is not null group by 1"""))
def q_value_shares(spark, sf_dir):
    return PR.value_shares(inspections(spark, sf_dir), S.TARGET).select("value", r6("share").alias("share"))


def _box_sql(src: str, col: str, by: str | None) -> str:
    g = f"{by}, " if by else ""
    gb = f"group by {by}" if by else ""
    join = f"join bf using ({by})" if by else ", bf"
    return f"""bq as (select {g}quantile_cont({col}, 0.25) as q1, quantile_cont({col}, 0.5) as median,
              quantile_cont({col}, 0.75) as q3 from {src} where {col} is not null {gb}),
bf as (select *, q3 - q1 as iqr, q1 - 1.5 * (q3 - q1) as lower_fence, q3 + 1.5 * (q3 - q1) as upper_fence from bq),
bx as (select {g}q1, median, q3, iqr, lower_fence, upper_fence, count(*) as n,
              min(case when {col} >= lower_fence and {col} <= upper_fence then {col} end) as whisker_low,
              max(case when {col} >= lower_fence and {col} <= upper_fence then {col} end) as whisker_high,
              cast(count_if(not ({col} >= lower_fence and {col} <= upper_fence)) as bigint) as n_outliers
       from {src} {join} where {col} is not null group by all)"""


_BOX_COLS = ["q1", "median", "q3", "iqr", "lower_fence", "upper_fence", "whisker_low", "whisker_high"]
_BOX_SEL = ", ".join(f"round({c}, 6) as {c}" for c in _BOX_COLS) + ", n, n_outliers"


def _box_out(b: DataFrame, by=()) -> DataFrame:
    return b.select(*by, *[r6(c).alias(c) for c in _BOX_COLS], "n", "n_outliers")


@register("box_summary", with_insp(f"select {_BOX_SEL} from bx", _box_sql("insp", "odometer_reading", None)))
def q_box_summary(spark, sf_dir):
    return _box_out(PR.box_summary(inspections(spark, sf_dir), S.ODOMETER))


@register("box_summary_by_fuel", with_insp(f"select fuel_type, {_BOX_SEL} from bx",
                                           _box_sql("insp", "rating_engineTransmission", "fuel_type")))
def q_box_summary_by_fuel(spark, sf_dir):
    return _box_out(PR.box_summary(inspections(spark, sf_dir), S.TARGET, [S.FUEL]), [S.FUEL])


@register("box_summary_by_order", "with li as (select l_orderkey, cast(l_extendedprice as double) as price from lineitem),\n"
          + _box_sql("li", "price", "l_orderkey") + f"\nselect l_orderkey, {_BOX_SEL} from bx")
def q_box_summary_by_order(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_extendedprice").cast("double").alias("price"))
    return _box_out(PR.box_summary(li, "price", ["l_orderkey"]), ["l_orderkey"])


@register("outliers", with_insp("""
select appointmentId, odometer_reading from insp, bf
where odometer_reading < lower_fence or odometer_reading > upper_fence""",
    """bq as (select quantile_cont(odometer_reading, 0.25) as q1, quantile_cont(odometer_reading, 0.75) as q3
       from insp where odometer_reading is not null),
bf as (select q1 - 1.5 * (q3 - q1) as lower_fence, q3 + 1.5 * (q3 - q1) as upper_fence from bq)"""))
def q_outliers(spark, sf_dir):
    return PR.outliers(inspections(spark, sf_dir), S.ODOMETER).select(S.KEY, S.ODOMETER)


_CORR_COLS = [S.REG_YEAR, S.REG_MONTH, S.ODOMETER, S.TARGET]


@register("pearson_matrix", with_insp("\nunion all\n".join(
    f"select '{a}' as col_a, '{b}' as col_b, round(corr(cast({a} as double), cast({b} as double)), 6) as corr from insp"
    for a in _CORR_COLS for b in _CORR_COLS)))
def q_pearson_matrix(spark, sf_dir):
    return PR.pearson_matrix(inspections(spark, sf_dir), _CORR_COLS).select("col_a", "col_b", r6("corr").alias("corr"))


_TF_COLS = INSP_COLUMNS + [S.HOUR, S.MON, S.DATE, S.DOW]


@register("constant_columns", with_insp("\nunion all\n".join(
    f"select '{c}' as column_name from tf having count({c}) = count(*) and count(*) > 0 and min({c}) = max({c})"
    for c in _TF_COLS), """tf as (select *, hour(inspectionStartTime) as inspection_hour, month(inspectionStartTime) as inspection_mon,
       cast(inspectionStartTime as date) as inspection_date, dayname(inspectionStartTime) as inspection_dow from insp)"""))
def q_constant_columns(spark, sf_dir):
    return PR.constant_columns(TF.time_features(inspections(spark, sf_dir)))


@register("distinct_values", with_insp(f"select distinct {SLOT_COLUMNS[0]} as value from insp"))
def q_distinct_values(spark, sf_dir):
    return PR.distinct_values(inspections(spark, sf_dir), SLOT_COLUMNS[0])


# ---------------------------------------------------------------------------
# P1-P16 projection, filter, cleaning; U1, O1-O3
# ---------------------------------------------------------------------------
@register("drop_columns", with_insp("select * exclude (inspectionStartTime, fuel_type) from insp"))
def q_drop_columns(spark, sf_dir):
    df = P.drop_columns(inspections(spark, sf_dir), [S.TIME, S.FUEL, *S.EMPTY_SLOT_COLUMNS])
    return df


@register("drop_columns_like", with_insp(f"select * exclude ({COMMENT_COLUMN}, inspectionStartTime) from insp"))
def q_drop_columns_like(spark, sf_dir):
    return P.drop_columns_like(inspections(spark, sf_dir), S.COMMENT_MARK).drop(S.TIME)


@register("select_columns_like", with_insp(f"select appointmentId, {', '.join(SLOT_COLUMNS)} from insp"))
def q_select_columns_like(spark, sf_dir):
    return P.select_columns_like(inspections(spark, sf_dir), "CC_VALUE", case_insensitive=True, keep=[S.KEY])


@register("fill_slots", with_insp("select appointmentId, " + ", ".join(
    f"coalesce({c}, 'yes') as {c}" for c in ALL_SLOT_BLOCK) + " from insp"))
def q_fill_slots(spark, sf_dir):
    df = P.fill_slots(inspections(spark, sf_dir))
    return df.select(S.KEY, *ALL_SLOT_BLOCK)


@register("fill_unknown", with_insp("select appointmentId, rating_engineTransmission, " + ", ".join(
    f"coalesce(cast({c} as varchar), 'Unknown') as {c}" for c in SLOT_COLUMNS) + " from insp"))
def q_fill_unknown(spark, sf_dir):
    df = P.fill_unknown(inspections(spark, sf_dir), SLOT_COLUMNS)
    return df.select(S.KEY, S.TARGET, *SLOT_COLUMNS)


def _iqr_sql(src: str, col: str, name: str) -> str:
    return f"""{name}q as (select quantile_cont({col}, 0.25) as a, quantile_cont({col}, 0.75) as b from {src}),
{name} as (select {src}.* from {src}, {name}q where {col} > a - 1.5 * (b - a) and {col} < b + 1.5 * (b - a))"""


@register("iqr_filter", with_insp("select appointmentId, year, odometer_reading from f2",
                                  _iqr_sql("insp", "year", "f1") + ",\n" + _iqr_sql("f1", "odometer_reading", "f2")))
def q_iqr_filter(spark, sf_dir):
    df = inspections(spark, sf_dir).select(S.KEY, S.REG_YEAR, S.ODOMETER)
    return P.iqr_filter(P.iqr_filter(df, S.REG_YEAR), S.ODOMETER)


@register("iqr_filter_events", "with " + _iqr_sql("events", "value", "f1") + "\nselect event_id, value from f1")
def q_iqr_filter_events(spark, sf_dir):
    return P.iqr_filter(table(spark, sf_dir, "events"), "value").select("event_id", "value")


@register("filter_weak", with_insp("select appointmentId, rating_engineTransmission from insp where rating_engineTransmission <= 2"))
def q_filter_weak(spark, sf_dir):
    return P.filter_weak(inspections(spark, sf_dir)).select(S.KEY, S.TARGET)


@register("records_view", with_insp(f"""
select appointmentId, {SQL_ISO_TS.format('inspectionStartTime')} as "Inspection Date", year as "Year",
       rating_engineTransmission as "Engine Rating", odometer_reading as "Odometer (km)", fuel_type as "Fuel Type"
from insp where rating_engineTransmission <= 2"""))
def q_records_view(spark, sf_dir):
    v = P.records_view(inspections(spark, sf_dir), weak_only=True)
    return v.withColumn("Inspection Date", iso_ts("`Inspection Date`"))


@register("cast_rating_int", with_insp(
    "select appointmentId, cast(trunc(rating_engineTransmission) as int) as rating_engineTransmission from insp"))
def q_cast_rating_int(spark, sf_dir):
    return P.cast_rating_int(inspections(spark, sf_dir)).select(S.KEY, S.TARGET)


@register("head", with_insp("select appointmentId, fuel_type from insp order by appointmentId limit 5"))
def q_head(spark, sf_dir):
    return P.head(inspections(spark, sf_dir).select(S.KEY, S.FUEL), 5)


_ALIGN = [S.REG_YEAR, S.REG_MONTH, S.ODOMETER, S.HOUR, "fuel_type_Petrol"]


@register("align_features", with_insp("""
select appointmentId, cast(year as double) as year, cast(month as double) as month, odometer_reading,
       0.0::double as inspection_hour, 0.0::double as fuel_type_Petrol from insp"""))
def q_align_features(spark, sf_dir):
    return P.align_features(inspections(spark, sf_dir), _ALIGN, keep=[S.KEY])


@register("search_records", with_insp(f"""
select appointmentId, fuel_type, {CONDITION_COLUMN} from insp
where lower(concat_ws(' ', fuel_type, {CONDITION_COLUMN})) like '%urgent%'"""))
def q_search_records(spark, sf_dir):
    df = inspections(spark, sf_dir).select(S.KEY, S.FUEL, CONDITION_COLUMN)
    return P.search_records(df, "URGENT", [S.FUEL, CONDITION_COLUMN])


@register("latest_first", with_insp(f"select appointmentId, {SQL_ISO_TS.format('inspectionStartTime')} as inspectionStartTime from insp"))
def q_latest_first(spark, sf_dir):
    df = TR.latest_first(inspections(spark, sf_dir).select(S.KEY, S.TIME))
    return df.select(S.KEY, iso_ts(S.TIME).alias(S.TIME))


@register("sort_by", with_insp("select appointmentId, rating_engineTransmission from insp"))
def q_sort_by(spark, sf_dir):
    return TR.sort_by(inspections(spark, sf_dir).select(S.KEY, S.TARGET), S.TARGET, False, S.KEY)


@register("top_k", with_insp("""
select appointmentId, odometer_reading from insp where odometer_reading is not null
order by odometer_reading desc, appointmentId limit 10"""))
def q_top_k(spark, sf_dir):
    return TR.top_k(inspections(spark, sf_dir).select(S.KEY, S.ODOMETER), S.ODOMETER, 10, S.KEY)


# ---------------------------------------------------------------------------
# E1-E3, A23, J1 encoding
# ---------------------------------------------------------------------------
from gearlens.operators import encode as EN  # noqa: E402

_B = "engineTransmission_"


@register("category_vocabulary", with_insp("\nunion all\n".join(
    f"select distinct '{c}' as column_name, cast({c} as varchar) as value from insp where {c} is not null"
    for c in ALL_SLOT_BLOCK)))
def q_category_vocabulary(spark, sf_dir):
    return EN.category_vocabulary_df(inspections(spark, sf_dir), ALL_SLOT_BLOCK)


def _flag(col, v):
    return f"case when {col} = '{v}' then 1 else 0 end"


# Vocabulary of the fixture's condition block: slots take A/N/R, the Yes/No
# column Yes/No, the comment column F/O; drop-first removes A, No and F.
_E2_SQL = ", ".join(
    [f"{_flag(CONDITION_COLUMN, 'Yes')} as {CONDITION_COLUMN}_Yes"]
    + [f"{_flag(c, v)} as {c}_{v}" for c in SLOT_COLUMNS for v in ("N", "R")]
    + [f"{_flag(COMMENT_COLUMN, 'O')} as {COMMENT_COLUMN}_O"])


@register("one_hot_drop_first", with_insp(f"select appointmentId, {_E2_SQL} from insp"))
def q_one_hot_drop_first(spark, sf_dir):
    df = inspections(spark, sf_dir).select(S.KEY, *ALL_SLOT_BLOCK)
    return EN.one_hot_drop_first(df, ALL_SLOT_BLOCK)


def _any(cols, v):
    return "case when " + " or ".join(f"{c} = '{v}'" for c in cols) + " then 1 else 0 end"


@register("slot_rollup_reference", with_insp(f"""
select appointmentId,
       {_flag(CONDITION_COLUMN, 'Yes')} as {_B}battery_value_Yes_Yes,
       {_any(SLOT_COLUMNS, 'N')} as {_B}battery_cc_value_N,
       {_any(SLOT_COLUMNS, 'R')} as {_B}battery_cc_value_R,
       {_flag(COMMENT_COLUMN, 'O')} as {_B}comments_value_O
from insp"""))
def q_slot_rollup_reference(spark, sf_dir):
    df = inspections(spark, sf_dir).select(S.KEY, *ALL_SLOT_BLOCK)
    enc = EN.one_hot_drop_first(df, ALL_SLOT_BLOCK)
    return EN.slot_rollup(enc, [c for c in enc.columns if c != S.KEY], mode="reference")


_COMPONENTS = {"battery": SLOT_COLUMNS[0:2], "engineOil": SLOT_COLUMNS[2:4],
               "coolant": SLOT_COLUMNS[4:5], "clutch": SLOT_COLUMNS[5:7]}


@register("slot_rollup_component", with_insp("select appointmentId, " + ", ".join(
    [f"{_flag(CONDITION_COLUMN, 'Yes')} as {CONDITION_COLUMN}_Yes"]
    + [f"{_any(cs, v)} as {_B}{comp}_cc_value_{v}" for comp, cs in _COMPONENTS.items() for v in ("N", "R")]
    + [f"{_flag(COMMENT_COLUMN, 'O')} as {_B}comments_value_O"]) + " from insp"))
def q_slot_rollup_component(spark, sf_dir):
    df = inspections(spark, sf_dir).select(S.KEY, *ALL_SLOT_BLOCK)
    enc = EN.one_hot_drop_first(df, ALL_SLOT_BLOCK)
    return EN.slot_rollup(enc, [c for c in enc.columns if c != S.KEY], mode="component")


@register("any_flag", with_insp(f"""
select appointmentId, case when {SLOT_COLUMNS[0]} is not null or {SLOT_COLUMNS[1]} is not null then 1 else 0 end as any_battery_defect
from insp"""))
def q_any_flag(spark, sf_dir):
    df = inspections(spark, sf_dir).select(
        S.KEY, *[F.col(c).isNotNull().alias(f"has_{i}") for i, c in enumerate(SLOT_COLUMNS[:2])])
    return EN.any_flag(df, ["has_0", "has_1"], "any_battery_defect").select(S.KEY, "any_battery_defect")


@register("attach_features", with_insp(f"""
select appointmentId, rating_engineTransmission,
       {_any(SLOT_COLUMNS, 'N')} as {_B}battery_cc_value_N,
       {_any(SLOT_COLUMNS, 'R')} as {_B}battery_cc_value_R
from insp"""))
def q_attach_features(spark, sf_dir):
    insp = inspections(spark, sf_dir)
    block = insp.select(S.KEY, *SLOT_COLUMNS)
    feats = EN.slot_rollup(EN.one_hot_drop_first(block, SLOT_COLUMNS), mode="reference",
                           flag_cols=[c for c in EN.one_hot_drop_first(block, SLOT_COLUMNS).columns if c != S.KEY])
    return P.attach_features(insp.select(S.KEY, S.TARGET), feats, S.KEY)


# ---------------------------------------------------------------------------
# T1-T7 statistics (the statistic is checked here; p-values in unit tests)
# ---------------------------------------------------------------------------
from gearlens.operators import stats as ST  # noqa: E402


def _spearman_sql(src: str, a: str, b: str) -> str:
    return f"""sp as (select {a} as a, {b} as b from {src} where {a} is not null and {b} is not null),
rk as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as ra,
              rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 as rb from sp)"""


@register("spearman", with_insp("select count(*) as n, round(corr(ra, rb), 6) as rho from rk",
                                _spearman_sql("insp", "year", "rating_engineTransmission")))
def q_spearman(spark, sf_dir):
    return ST.spearman_stat(inspections(spark, sf_dir), S.REG_YEAR, S.TARGET).select("n", r6("rho").alias("rho"))


@register("spearman_lineitem", "with " + _spearman_sql("lineitem", "l_quantity", "l_extendedprice")
          + "\nselect count(*) as n, round(corr(ra, rb), 6) as rho from rk")
def q_spearman_lineitem(spark, sf_dir):
    # four value ranges per rank table: exercises the bucketed running sum
    df = table(spark, sf_dir, "lineitem")
    return ST.spearman_stat(df, "l_quantity", "l_extendedprice", buckets=4).select("n", r6("rho").alias("rho"))


def _kw_sql(long_sql: str) -> str:
    """CTEs ending in ``ks`` (feature, k, N, h) and ``kg`` group moments."""
    return f"""lg as ({long_sql}),
lv as (select * from lg where value is not null and y is not null),
kr as (select feature, value, y, rank() over (partition by feature order by y)
                         + (count(*) over (partition by feature, y) - 1) / 2.0 as r from lv),
kg as (select feature, value, count(*) as n_i, sum(r) as r_i, avg(y) as mu, var_samp(y) as s from kr group by 1, 2),
kt as (select feature, sum(t * t * t - t) as tie from (select feature, y, count(*)::double as t from lv group by 1, 2) group by 1),
ka as (select feature, count(*) as k, sum(n_i)::double as nn, sum(r_i * r_i / n_i) as sr from kg group by 1),
ks as (select feature, k, nn, (12.0 / (nn * (nn + 1)) * sr - 3 * (nn + 1)) / (1 - tie / (nn * nn * nn - nn)) as h
       from ka join kt using (feature)),
tg as (select feature, n_i, mu, s, row_number() over (partition by feature order by value) as i from kg),
tt as (select a.feature, (a.mu - b.mu) / sqrt(((a.n_i - 1) * a.s + (b.n_i - 1) * b.s) / (a.n_i + b.n_i - 2)
                                             * (1.0 / a.n_i + 1.0 / b.n_i)) as t,
              (a.n_i + b.n_i - 2)::double as tdf
       from tg a join tg b on a.feature = b.feature and a.i = 1 and b.i = 2)"""


@register("kruskal_wallis", _kw_sql(
    "select 'event_type' as feature, event_type as value, value as y from events").join(["with ", ""])
    + "\nselect k, cast(nn as bigint) as N, round(h, 6) as statistic from ks")
def q_kruskal_wallis(spark, sf_dir):
    long = ST._long(table(spark, sf_dir, "events"), ["event_type"], "value")
    return ST.kruskal_stats(long).select("k", F.col("N").cast("bigint").alias("N"), r6("statistic").alias("statistic"))


@register("kruskal_wallis_rating_by_fuel", with_insp(
    "select k, cast(nn as bigint) as N, round(h, 6) as statistic from ks",
    _kw_sql("select 'fuel_type' as feature, fuel_type as value, rating_engineTransmission as y from insp")))
def q_kruskal_wallis_rating_by_fuel(spark, sf_dir):
    long = ST._long(inspections(spark, sf_dir), [S.FUEL], S.TARGET)
    return ST.kruskal_stats(long).select("k", F.col("N").cast("bigint").alias("N"), r6("statistic").alias("statistic"))


@register("t_test", "with " + _kw_sql(
    "select 'l_linestatus' as feature, l_linestatus as value, l_quantity as y from lineitem")
    + "\nselect round(t, 6) as statistic, tdf as df from tt")
def q_t_test(spark, sf_dir):
    long = ST._long(table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_quantity")
    return ST.t_stats(ST.moments(long)).select(r6("statistic").alias("statistic"), "df")


def _anova_sql(long_sql: str) -> str:
    return f"""lg as ({long_sql}),
am as (select feature, value, count(*) as n, avg(y) as mu, var_samp(y) as s from lg
       where value is not null and y is not null group by 1, 2 having count(*) >= 2),
ag as (select feature, sum(n * mu) / sum(n) as gm from am group by 1),
aa as (select feature, count(*) as k, sum(n) as nn, sum(n * (mu - gm) * (mu - gm)) as ssb, sum((n - 1) * s) as ssw
       from am join ag using (feature) group by 1)
|select feature, k, cast(nn as bigint) as N, round(case when k >= 2 then (ssb / (k - 1)) / (ssw / (nn - k)) end, 6) as statistic,
       (k - 1)::double as df1, (nn - k)::double as df2 from aa"""


@register("anova", "with " + _anova_sql(
    "select 'l_returnflag' as feature, l_returnflag as value, l_quantity as y from lineitem").replace("|", ""))
def q_anova(spark, sf_dir):
    long = ST._long(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")
    a = ST.anova_stats(ST.moments(long))
    return a.select("feature", "k", F.col("N").cast("bigint").alias("N"), r6("statistic").alias("statistic"), "df1", "df2")


_AS = _anova_sql("\nunion all\n".join(
    f"select '{c}' as feature, coalesce({c}, 'Unknown') as value, rating_engineTransmission as y from insp"
    for c in SLOT_COLUMNS)).split("|")


@register("anova_slots", with_insp(_AS[1], _AS[0]))
def q_anova_slots(spark, sf_dir):
    df = P.fill_unknown(inspections(spark, sf_dir), SLOT_COLUMNS)
    a = ST.anova_stats(ST.moments(ST._long(df, SLOT_COLUMNS, S.TARGET)))
    return a.select("feature", "k", F.col("N").cast("bigint").alias("N"), r6("statistic").alias("statistic"), "df1", "df2")


_TREND_FEATURES = [S.HOUR, S.MON, S.DOW, S.REG_MONTH, S.REG_YEAR]
_TREND_LONG = "\nunion all\n".join([
    "select 'inspection_hour' as feature, cast(hour(inspectionStartTime) as varchar) as value, rating_engineTransmission as y from insp",
    "select 'inspection_mon' as feature, cast(month(inspectionStartTime) as varchar) as value, rating_engineTransmission as y from insp",
    "select 'inspection_dow' as feature, dayname(inspectionStartTime) as value, rating_engineTransmission as y from insp",
    "select 'month' as feature, cast(month as varchar) as value, rating_engineTransmission as y from insp",
    "select 'year' as feature, cast(year as varchar) as value, rating_engineTransmission as y from insp"])


@register("temporal_trends", with_insp("""
select ka.feature, ka.k as n_groups, case when ka.k > 2 then 'Kruskal-Wallis' when ka.k = 2 then 't-test' end as test,
       round(case when ka.k > 2 then h when ka.k = 2 then t end, 6) as statistic,
       case when ka.k > 2 then (ka.k - 1)::double when ka.k = 2 then tdf end as df
from ka left join ks using (feature) left join tt using (feature)""", _kw_sql(_TREND_LONG)))
def q_temporal_trends(spark, sf_dir):
    df = TF.time_features(inspections(spark, sf_dir))
    t = ST.temporal_trend_stats(df, _TREND_FEATURES, S.TARGET)
    return t.select("feature", "n_groups", "test", r6("statistic").alias("statistic"), "df")


@register("kde_event_value", """with kv as (select value as x from events where value is not null and not isnan(value)),
ks as (select count(*) as n, stddev_samp(x) as sd, min(x) as lo, max(x) as hi from kv),
kp as (select n, sd * pow(n, -0.2) as bw, lo, hi from ks),
kg as (select cast(i as int) as grid_index, (lo - 3 * bw) + i * (((hi + 3 * bw) - (lo - 3 * bw)) / 199) as gx from kp, range(0, 200) t(i)),
kf as (select x, count(*) as c from kv group by 1)
select grid_index, round(gx, 6) as x, round(sum(c * exp(-0.5 * ((gx - x) / bw) * ((gx - x) / bw))) / (n * bw * sqrt(2 * pi())), 9) as density
from kg, kf, kp group by grid_index, gx, n, bw""")
def q_kde_event_value(spark, sf_dir):
    k = ST.kde(table(spark, sf_dir, "events"), "value", 200)
    return k.select("grid_index", r6("x").alias("x"), F.round("density", 9).alias("density"))


# ---------------------------------------------------------------------------
# F4-F18 scalar rules
# ---------------------------------------------------------------------------
from gearlens.functions import bands as BD  # noqa: E402
from gearlens.sources.requests import DIAGNOSTIC_SLOT, FUEL_BY_PRIORITY, requests_from_inspections, service_inspections  # noqa: E402


@register("name_tokens", with_insp(f"""
select column_name,
       case when contains(column_name, '_') then regexp_extract(column_name, '.*_(.*)$', 1) end as suffix,
       regexp_replace(column_name, '_[0-9]+_N$', '') as base_n,
       contains(column_name, '_N') as has_n
from (select distinct column_name || '_' || value as column_name
      from (select '{SLOT_COLUMNS[0]}' as column_name, {SLOT_COLUMNS[0]} as value from insp) where value is not null)"""))
def q_name_tokens(spark, sf_dir):
    # encoded column names as data (name = column + '_' + value)
    names = (EN.category_vocabulary_df(inspections(spark, sf_dir), [SLOT_COLUMNS[0]])
               .select(F.concat_ws("_", "column_name", "value").alias("column_name")))
    return names.select("column_name", BD.suffix_token("column_name").alias("suffix"),
                        BD.base_name("column_name", "N").alias("base_n"),
                        BD.contains_token("column_name", "N").alias("has_n"))


_SCORE = "(rating_engineTransmission * 1.3 - 0.7)"


@register("clamp_score", with_insp(f"""
select appointmentId, case when {_SCORE} is not null then round(greatest(0.0, least(5.0, {_SCORE})), 6) end as clamped,
       case when {_SCORE} is not null then round(greatest(0.0, {_SCORE}), 6) end as floored from insp"""))
def q_clamp_score(spark, sf_dir):
    x = F.col(S.TARGET) * 1.3 - 0.7
    return inspections(spark, sf_dir).select(S.KEY, r6(BD.clamp(x)).alias("clamped"), r6(BD.floor_zero(x)).alias("floored"))


@register("grade_threshold", with_insp("""
select appointmentId, case when rating_engineTransmission >= 4.5 then 'Excellent' when rating_engineTransmission >= 3.5 then 'Very Good'
       when rating_engineTransmission >= 2.5 then 'Average' when rating_engineTransmission >= 1.5 then 'Below Average'
       when rating_engineTransmission is not null then 'Poor' end as grade from insp"""))
def q_grade_threshold(spark, sf_dir):
    return inspections(spark, sf_dir).select(S.KEY, BD.grade_threshold(S.TARGET).alias("grade"))


@register("grade_rounded", with_insp("""
select appointmentId, case g when 5 then 'Excellent' when 4 then 'Very Good' when 3 then 'Average'
       when 2 then 'Below Average' when 1 then 'Poor' when 0 then 'Critical' end as grade
from (select appointmentId, case when rating_engineTransmission is not null then
        greatest(0, least(5, cast(round_even(rating_engineTransmission, 0) as int))) end as g from insp)"""))
def q_grade_rounded(spark, sf_dir):
    return inspections(spark, sf_dir).select(S.KEY, BD.grade_rounded(S.TARGET).alias("grade"))


_FAILED = " + ".join(f"coalesce(({c} = 'R')::int, 0)" for c in DIAGNOSTIC_SLOT.values())


@register("health", with_insp(f"""
select cast(appointmentId as varchar) as request_id, failed as failed_checks, 6 - failed as healthy_checks,
       round((6 - failed) / 6.0 * 100, 6) as health_pct,
       cast(cast(round_even((6 - failed) / 6.0 * 100, 0) as int) as varchar) || '%' as health_text,
       case when failed > 0 then '-' || cast(failed as varchar) || ' Flags' else 'Optimal' end as health_delta
from (select appointmentId, {_FAILED} as failed from insp)"""))
def q_health(spark, sf_dir):
    req = requests_from_inspections(inspections(spark, sf_dir))
    cols = BD.health_columns("diagnostics")
    out = req.select("request_id", *cols)
    return out.withColumn("health_pct", r6("health_pct"))


@register("component_scores", with_insp("\nunion all\n".join(
    f"select cast(appointmentId as varchar) as request_id, '{label}' as component, "
    f"case when {DIAGNOSTIC_SLOT[key]} = 'R' then {score} else 100 end as score from insp"
    for label, key, score in S.COMPONENT_SCORES)))
def q_component_scores(spark, sf_dir):
    req = requests_from_inspections(inspections(spark, sf_dir))
    return BD.component_scores(req, "diagnostics", keep=["request_id"])


@register("usage_band", with_insp("""
select appointmentId, case when odometer_reading is null then null when odometer_reading > 100000 then 'High' else 'Normal' end as usage
from insp"""))
def q_usage_band(spark, sf_dir):
    return inspections(spark, sf_dir).select(S.KEY, BD.usage_band(S.ODOMETER).alias("usage"))


@register("result_card_bands", with_insp("""
select appointmentId,
       case when rating_engineTransmission >= 4 then 'green' when rating_engineTransmission >= 3 then 'yellow' when rating_engineTransmission is not null then 'red' end as color,
       case when rating_engineTransmission > 4 then 'optimal' when rating_engineTransmission > 2.5 then 'acceptable'
            when rating_engineTransmission is not null then 'critical' end as condition,
       case when rating_engineTransmission > 4 then 'High' when rating_engineTransmission > 2 then 'Medium'
            when rating_engineTransmission is not null then 'Low' end as market_value
from insp"""))
def q_result_card_bands(spark, sf_dir):
    return inspections(spark, sf_dir).select(
        S.KEY, BD.rating_color(S.TARGET).alias("color"), BD.condition_text(S.TARGET).alias("condition"),
        BD.market_value_band(S.TARGET).alias("market_value"))


_FUEL_OF = "case fuel_type " + " ".join(f"when '{k}' then '{v}'" for k, v in FUEL_BY_PRIORITY.items()) + " end"


@register("fuel_flags", with_insp("select request_id, " + ", ".join(
    f"coalesce((fuel = '{choice}')::int, 0) as {name}" for choice, name in S.FUEL_FLAGS.items())
    + f" from (select cast(appointmentId as varchar) as request_id, {_FUEL_OF} as fuel from insp)"))
def q_fuel_flags(spark, sf_dir):
    req = requests_from_inspections(inspections(spark, sf_dir))
    return req.select("request_id", *BD.fuel_flags("fuel_type"))


@register("diagnostic_flags", with_insp("select cast(appointmentId as varchar) as request_id, " + ", ".join(
    f"coalesce(({DIAGNOSTIC_SLOT[key]} = 'R')::int, 0) as {name}" for key, name in S.DIAGNOSTIC_FLAGS.items())
    + " from insp"))
def q_diagnostic_flags(spark, sf_dir):
    req = requests_from_inspections(inspections(spark, sf_dir))
    return req.select("request_id", *BD.diagnostic_flags("diagnostics"))


@register("round_display", with_insp("""
select appointmentId, round_even(rating_engineTransmission / 3, 2) as rating_2dp,
       case when rating_engineTransmission is not null then printf('%.1f', round_even(rating_engineTransmission / 3, 1)) end as rating_text from insp"""))
def q_round_display(spark, sf_dir):
    x = F.col(S.TARGET) / 3
    return inspections(spark, sf_dir).select(S.KEY, BD.round_display(x, 2).alias("rating_2dp"),
                                             BD.format_display(x, 1).alias("rating_text"))


# ---------------------------------------------------------------------------
# Named pipelines (production = training job, explore = notebook)
# ---------------------------------------------------------------------------
from gearlens.plans import pipelines as PL  # noqa: E402

_PRIORITIES = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]   # '1-URGENT' is dropped first


@register("production_features", with_insp(f"""
select appointmentId, year, month, odometer_reading, cast(hour(inspectionStartTime) as int) as inspection_hour,
       cast(month(inspectionStartTime) as int) as inspection_mon,
       {_flag(CONDITION_COLUMN, 'Yes')} as {_B}battery_value_Yes_Yes,
       {_any(SLOT_COLUMNS, 'N')} as {_B}battery_cc_value_N,
       {_any(SLOT_COLUMNS, 'R')} as {_B}battery_cc_value_R,
       {_flag(COMMENT_COLUMN, 'O')} as {_B}comments_value_O,
       """ + ",\n       ".join(f"{_flag('fuel_type', p)} as fuel_type_{P.sanitize_name(p)}" for p in _PRIORITIES) + """,
       rating_engineTransmission
from insp"""))
def q_production_features(spark, sf_dir):
    return PL.production_features(inspections(spark, sf_dir)).df


@register("explore_features", with_insp(f"""
select appointmentId, year, month, odometer_reading, cast(hour(inspectionStartTime) as int) as inspection_hour,
       cast(month(inspectionStartTime) as int) as inspection_mon,
       """ + ",\n       ".join(f"{_flag('fuel_type', p)} as \"fuel_type_{p}\"" for p in _PRIORITIES) + f""",
       {_flag(CONDITION_COLUMN, 'Yes')} as {_B}battery_value_Yes_Yes_1,
       {_any(SLOT_COLUMNS, 'N')} as {_B}battery_cc_value_N_1,
       {_any(SLOT_COLUMNS, 'R')} as {_B}battery_cc_value_R_1,
       rating_engineTransmission
from f2""", _iqr_sql("insp", "year", "f1") + ",\n" + _iqr_sql("f1", "odometer_reading", "f2")))
def q_explore_features(spark, sf_dir):
    return PL.explore_features(inspections(spark, sf_dir)).df


# ---------------------------------------------------------------------------
# Split, models, scoring, streaming (rows-only beyond M1/U1)
# ---------------------------------------------------------------------------
import uuid  # noqa: E402
from contextlib import contextmanager  # noqa: E402

from pyspark import StorageLevel  # noqa: E402

from gearlens.plans import booster as BO  # noqa: E402
from gearlens.plans import model as ML  # noqa: E402
from gearlens.plans import score as SC  # noqa: E402

_SQL_BUCKET = "cast((('0x' || substr(md5(cast(appointmentId as varchar)), 1, 8))::bigint % 100) as int)"


@register("split", with_insp(f"""
select appointmentId, b as bucket,
       case when b < 64 then 'train' when b < 80 then 'validation' else 'test' end as part
from (select appointmentId, {_SQL_BUCKET} as b from insp)"""))
def q_split(spark, sf_dir):
    return ML.with_split(inspections(spark, sf_dir).select(S.KEY)).select(S.KEY, "bucket", "part")


@register("append_rows", with_insp(f"""
select appointmentId, 'train' as part from insp where {_SQL_BUCKET} < 64
union all
select appointmentId, 'validation' as part from insp where {_SQL_BUCKET} >= 64 and {_SQL_BUCKET} < 80"""))
def q_append_rows(spark, sf_dir):
    tr, va, _ = ML.split(inspections(spark, sf_dir).select(S.KEY))
    return P.append_rows(tr.withColumn("part", F.lit("train")), va.withColumn("part", F.lit("validation")))


_MODEL_CACHE: dict = {}
_FRAME_CACHE: dict = {}


@contextmanager
def _split_features(spark, sf_dir):
    """Feature names and the train, validation and test parts of one derivation
    of the feature table, kept while the fits of a query read them."""
    ff = PL.production_features(inspections(spark, sf_dir))
    rows = ff.df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield ff.features, ML.split(rows)
    finally:
        rows.unpersist()


@contextmanager
def _kept_inspections(spark, sf_dir):
    """Within it the inspections are derived once, whoever reads them: the vocabulary,
    the fit and the requests.  They are kept on disk, as the fit needs the memory, and
    in the partitions of their join, so a fit samples the same rows as from the join."""
    insp = inspections(spark, sf_dir)
    if insp.storageLevel.useDisk:       # a caller keeps them
        yield
        return
    insp.persist(StorageLevel.DISK_ONLY)
    try:
        yield
    finally:
        insp.unpersist()


def _service_features(spark, sf_dir):
    """Features whose flags are the ones that scoring requests set."""
    key = (sf_dir, spark.sparkContext.applicationId)
    if key not in _FRAME_CACHE:     # the plan only; its vocabulary is one pass over the table
        _FRAME_CACHE[key] = PL.production_features(service_inspections(inspections(spark, sf_dir)))
    return _FRAME_CACHE[key]


def _model(spark, sf_dir):
    key = (sf_dir, spark.sparkContext.applicationId)
    if key not in _MODEL_CACHE:
        with _kept_inspections(spark, sf_dir):
            ff = _service_features(spark, sf_dir)
            # train and validation rows as one range of buckets: one derivation, no union
            fit, _ = ML.split(ff.df, weights=(0.80, 0.20))
            m = ML.train(fit, ff.features, "boosted", int_target=True)
        _MODEL_CACHE[key] = (m, ff.features)
    return _MODEL_CACHE[key]


@register("compare_models")
def q_compare_models(spark, sf_dir):
    with _split_features(spark, sf_dir) as (features, (tr, va, _)):
        return ML.compare_models(tr, va, features, kinds=("decision_tree", "random_forest", "boosted", *ML.BOOSTERS))


@register("random_search")
def q_random_search(spark, sf_dir):
    """Both searches of the notebook over the whole training part."""
    out = []
    with _split_features(spark, sf_dir) as (features, (tr, _, _)):
        for search, (base, n, space) in BO.SPACES.items():
            found = BO.boosted_search(tr, features, space, n, folds=3, base=base)
            out.append(BO.search_table(spark, found, space).withColumn("search", F.lit(search)))
    return out[0].unionByName(out[1])


@register("final_fit")
def q_final_fit(spark, sf_dir):
    with _split_features(spark, sf_dir) as (features, (tr, va, te)):
        _, metrics = ML.final_fit(tr, va, te, features)
    return metrics


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    m, cols = _model(spark, sf_dir)
    return ML.feature_importance(m, cols, 10)


def _requests(spark, sf_dir):
    return requests_from_inspections(inspections(spark, sf_dir), with_registration=True)


@register("score")
def q_score(spark, sf_dir):
    m, cols = _model(spark, sf_dir)
    scored, _ = SC.score_requests(_requests(spark, sf_dir), m, cols)
    return scored


@register("score_rejects", with_insp("""
select cast(appointmentId as varchar) as request_id, strftime(inspectionStartTime, '%Y-%m-%dT%H:%M') as inspectionStartTime,
       coalesce(cast(cast(trunc(odometer_reading) as bigint) as varchar), 'x') as odometer_reading,
       case when inspectionStartTime is null then 'bad inspectionStartTime' else 'bad odometer_reading' end as reject_reason
from insp where odometer_reading is null or inspectionStartTime is null"""))
def q_score_rejects(spark, sf_dir):
    return SC.reject_records(_requests(spark, sf_dir))


@register("degradation")
def q_degradation(spark, sf_dir):
    m, cols = _model(spark, sf_dir)
    return SC.degradation(_requests(spark, sf_dir), m, cols)


@register("residual_outliers")
def q_residual_outliers(spark, sf_dir):
    m, cols = _model(spark, sf_dir)
    return SC.residual_outliers(_service_features(spark, sf_dir).df, m)


@register("score_stream")
def q_score_stream(spark, sf_dir):
    from gearlens.session import shared_folder
    from gearlens.streaming.score_stream import run_to_completion, score_stream
    run = shared_folder(spark, f"score-stream-{uuid.uuid4().hex}")
    with _kept_inspections(spark, sf_dir):
        m, cols = _model(spark, sf_dir)
        _requests(spark, sf_dir).write.mode("overwrite").json(f"{run}/in")
    qs = score_stream(spark, f"{run}/in", f"{run}/out", m, cols, checkpoint=f"{run}/ck")
    run_to_completion(qs)
    return spark.read.parquet(f"{run}/out/scored").drop("batch")


# ---------------------------------------------------------------------------
# T7 on the histogram inputs: rating, hour of day, daily counts (violin)
# ---------------------------------------------------------------------------
def _kde_sql(src_sql: str, grid: int = 200) -> tuple[str, str]:
    ctes = f"""kv as ({src_sql}),
ks as (select count(*) as n, stddev_samp(x) as sd, min(x) as lo, max(x) as hi from kv),
kp as (select n, sd * pow(n, -0.2) as bw, lo, hi from ks),
kg as (select cast(i as int) as grid_index, (lo - 3 * bw) + i * (((hi + 3 * bw) - (lo - 3 * bw)) / {grid - 1}) as gx
       from kp, range(0, {grid}) t(i)),
kf as (select x, count(*) as c from kv group by 1)"""
    body = """select grid_index, round(gx, 6) as x,
       round(sum(c * exp(-0.5 * ((gx - x) / bw) * ((gx - x) / bw))) / (n * bw * sqrt(2 * pi())), 9) as density
from kg, kf, kp group by grid_index, gx, n, bw"""
    return ctes, body


def _kde_out(k: DataFrame) -> DataFrame:
    return k.select("grid_index", r6("x").alias("x"), F.round("density", 9).alias("density"))


_c, _b = _kde_sql("select rating_engineTransmission::double as x from insp where rating_engineTransmission is not null")
@register("kde_rating", with_insp(_b, _c))
def q_kde_rating(spark, sf_dir):
    return _kde_out(ST.kde(inspections(spark, sf_dir), S.TARGET, 200))


_c, _b = _kde_sql("select hour(inspectionStartTime)::double as x from insp where inspectionStartTime is not null")
@register("kde_hour", with_insp(_b, _c))
def q_kde_hour(spark, sf_dir):
    df = TF.time_features(inspections(spark, sf_dir).select(S.TIME))
    return _kde_out(ST.kde(df, S.HOUR, 200))


_c, _b = _kde_sql("""select count(*)::double as x from insp where inspectionStartTime is not null
                     group by cast(inspectionStartTime as date)""")
@register("daily_intensity_kde", with_insp(_b, _c))
def q_daily_intensity_kde(spark, sf_dir):
    daily = TR.daily_volume(inspections(spark, sf_dir), count_col=None)
    return _kde_out(ST.kde(daily, "n_inspections", 200))


@register("outliers_events", """with bq as (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3
            from events where value is not null),
bf as (select q1 - 1.5 * (q3 - q1) as lower_fence, q3 + 1.5 * (q3 - q1) as upper_fence from bq)
select event_id, value from events, bf where value < lower_fence or value > upper_fence""")
def q_outliers_events(spark, sf_dir):
    return PR.outliers(table(spark, sf_dir, "events"), "value").select("event_id", "value")


@register("box_summary_events", "with " + _box_sql("events", "value", None) + f"\nselect {_BOX_SEL} from bx")
def q_box_summary_events(spark, sf_dir):
    return _box_out(PR.box_summary(table(spark, sf_dir, "events"), "value"))


# Notebook flow: ANOVA of the rating over the rolled-up flags (as text) of the
# cleaned table (slot nulls filled with 'yes', IQR filters on year, odometer).
_FILLED = [f"coalesce({c}, 'yes')" for c in SLOT_COLUMNS]


def _any_filled(v):
    return "case when " + " or ".join(f"{c} = '{v}'" for c in _FILLED) + " then 1 else 0 end"


_ROLLUP_LONG = "\nunion all\n".join([
    f"select '{_B}battery_value_Yes_Yes' as feature, cast({_flag(CONDITION_COLUMN, 'Yes')} as varchar) as value, "
    "rating_engineTransmission as y from f2",
    *[f"select '{_B}battery_cc_value_{v}' as feature, cast({_any_filled(v)} as varchar) as value, "
      "rating_engineTransmission as y from f2" for v in ("N", "R", "yes")]])
_AR = _anova_sql(_ROLLUP_LONG).split("|")


@register("anova_rollup", with_insp(_AR[1], _iqr_sql("insp", "year", "f1") + ",\n"
                                    + _iqr_sql("f1", "odometer_reading", "f2") + ",\n" + _AR[0]))
def q_anova_rollup(spark, sf_dir):
    tbl, names = PL.anova_table(inspections(spark, sf_dir))
    a = ST.anova_stats(ST.moments(ST._long(tbl, names, S.TARGET)))
    return a.select("feature", "k", F.col("N").cast("bigint").alias("N"), r6("statistic").alias("statistic"), "df1", "df2")


# ---------------------------------------------------------------------------
# T6 oracle: closed-form inverse of the 4 x 4 correlation matrix in SQL
# (Leibniz determinant and cofactors), VIF_j = inv(R)_jj, and the constant's
# VIF = 1 + n/(n-1) z' inv(R) z with z = mean / sd.
# ---------------------------------------------------------------------------
import itertools  # noqa: E402


def _perm_sign(p):
    s, p = 1, list(p)
    for i in range(len(p)):
        while p[i] != i:
            j = p[i]
            p[i], p[j] = p[j], p[i]
            s = -s
    return s


def _det_sql(idx, cell):
    terms = []
    for perm in itertools.permutations(range(len(idx))):
        prod = " * ".join(cell(idx[a], idx[b]) for a, b in enumerate(perm))
        terms.append(("+ " if _perm_sign(perm) > 0 else "- ") + f"({prod})")
    return "(" + " ".join(terms).lstrip("+ ") + ")"


def _vif_sql(cols) -> str:
    k = len(cols)

    def cell(i, j):
        return f"r{min(i, j)}{max(i, j)}"

    rcols = ", ".join(f"{'1.0::double' if i == j else f'corr({cols[i]}, {cols[j]})'} as r{i}{j}"
                      for i in range(k) for j in range(i, k))
    zcols = ", ".join(f"avg({c}) / stddev_samp({c}) as z{i}" for i, c in enumerate(cols))
    det = _det_sql(list(range(k)), cell)

    def cof(i, j):
        rows = [a for a in range(k) if a != i]
        cs = [b for b in range(k) if b != j]
        minor = _det_sql(list(range(k - 1)), lambda a, b: cell(rows[a], cs[b]))
        return f"{'' if (i + j) % 2 == 0 else '-'}{minor}"

    quad = " + ".join(f"z{i} * z{j} * {cof(i, j)}" for i in range(k) for j in range(k))
    sel = [f"select 'const' as feature, round(1 + n / (n - 1.0) * ({quad}) / d, 4) as vif from m"]
    sel += [f"select '{c}' as feature, round({cof(i, i)} / d, 4) as vif from m" for i, c in enumerate(cols)]
    nonnull = " and ".join(f"{c} is not null" for c in cols)
    return f"""vx as (select {", ".join(f"cast({c} as double) as {c}" for c in cols)} from insp where {nonnull}),
mm as (select count(*) as n, {rcols}, {zcols} from vx),
m as (select *, {det} as d from mm)
""" + "\nunion all\n".join(sel)


_VIF_COLS = [S.REG_YEAR, S.REG_MONTH, S.ODOMETER, S.TARGET]
_VIF = _vif_sql(_VIF_COLS).split("\n", 3)


@register("vif", with_insp(_VIF[3], "\n".join(_VIF[:3])))
def q_vif(spark, sf_dir):
    # 4 decimals: the constant's VIF is large (its z-scores are ~1e3)
    v = ST.vif(inspections(spark, sf_dir), _VIF_COLS)
    return v.select("feature", F.round("vif", 4).alias("vif"))


@register("vif_encoded")
def q_vif_encoded(spark, sf_dir):
    """All encoded columns of the notebook's modelling table but those that are
    constant in the rows without a null."""
    ff = PL.explore_features(inspections(spark, sf_dir))
    flat = set(PR.constant_flags(ff.df.dropna(subset=ff.features), ff.features))
    v = ST.vif(ff.df, [c for c in ff.features if c not in flat])
    return v.select("feature", F.round("vif", 4).alias("vif"))


_ENCODED = [S.REG_YEAR, S.REG_MONTH, S.ODOMETER, S.HOUR, S.MON, *[f"fuel_type_{p}" for p in _PRIORITIES],
            f"{_B}battery_value_Yes_Yes_1", f"{_B}battery_cc_value_N_1", f"{_B}battery_cc_value_R_1"]
_CORR = "select '{a}' as col_a, '{b}' as col_b, case when stddev_pop(a) > 0 and stddev_pop(b) > 0 then round(corr(a, b), 6) end as corr " \
        "from (select \"{a}\"::double as a, \"{b}\"::double as b from ex where \"{a}\" is not null and \"{b}\" is not null)"


@register("pearson_encoded", "with ex as (" + ORACLE["explore_features"] + ")\n" + "\nunion all ".join(_CORR.format(a=a, b=b) for a in _ENCODED for b in _ENCODED))
def q_pearson_encoded(spark, sf_dir):
    """Correlations of all encoded columns of the notebook's modelling table."""
    ff = PL.explore_features(inspections(spark, sf_dir))
    return PR.pearson_wide(ff.df, ff.features).withColumn("corr", r6("corr"))
