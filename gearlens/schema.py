"""Column names, name patterns, request schema and fixed lookup values."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Column names of the inspection table.
# ---------------------------------------------------------------------------
KEY = "appointmentId"
TIME = "inspectionStartTime"
REG_YEAR = "year"
REG_YEAR_ALT = "registrationYear"
REG_MONTH = "month"
ODOMETER = "odometer_reading"
FUEL = "fuel_type"
TARGET = "rating_engineTransmission"

SLOT_PREFIX = "engineTransmission_"   # every condition/slot column carries it
SLOT_MARK = "_cc_value"               # "current condition" slot columns
COMMENT_MARK = "comments"

# Derived time features.
HOUR = "inspection_hour"
MON = "inspection_mon"
DATE = "inspection_date"
DOW = "inspection_dow"
MONTH_NUM = "inspection_month_num"
MONTH_NAME = "inspection_month_name"

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for equal results.
# ---------------------------------------------------------------------------
# Two slot columns that are completely empty and dropped in the exploration
# pipeline; a constant feature and a rare one dropped before modelling.
EMPTY_SLOT_COLUMNS = ["engineTransmission_engine_cc_value_10", "engineTransmission_engineOil_cc_value_9"]
META_DROP_COLUMNS = [
    "appointmentId",
    "inspectionStartTime",
    "inspection_dow",
    "inspection_date",
    "index",
    "engineTransmission_battery_cc_value_yes",
    "engineTransmission_exhaustSmoke_cc_value_Leakage from manifold",
]
SLOT_FILL_VALUE = "yes"
UNKNOWN_VALUE = "Unknown"

# Fuel choice of a scoring request -> trained feature flag (Diesel and anything
# else map to no flag).
FUEL_FLAGS = {
    "Petrol": "fuel_type_Petrol",
    "CNG": "fuel_type_Petrol___CNG",
    "LPG": "fuel_type_Petrol___LPG",
    "Electric": "fuel_type_Electric",
    "Hybrid": "fuel_type_Hybrid",
}

# Diagnostic key of a scoring request -> trained feature flag.
DIAGNOSTIC_FLAGS = {
    "battery_jump_start": "engineTransmission_battery_cc_value_Jump_Start",
    "engine_oil_leak": "engineTransmission_engineOil_cc_value_Leaking",
    "engine_sound_abnormal": "engineTransmission_engineSound_cc_value_Engine_Auxiliary_Noise",
    "exhaust_smoke_white": "engineTransmission_exhaustSmoke_cc_value_White",
    "clutch_hard": "engineTransmission_clutch_cc_value_Hard",
    "gear_shifting_hard": "engineTransmission_gearShifting_cc_value_Not_Engaging",
}

# Health-profile component: (label, diagnostic key, score when flagged);
# a component that is not flagged scores 100.
COMPONENT_SCORES = [
    ("Battery", "battery_jump_start", 40),
    ("Oil System", "engine_oil_leak", 30),
    ("Sound", "engine_sound_abnormal", 50),
    ("Exhaust", "exhaust_smoke_white", 40),
    ("Clutch", "clutch_hard", 60),
    ("Transmission", "gear_shifting_hard", 60),
]

# Grade by threshold (scoring service): lower bound -> text, else "Poor".
GRADE_THRESHOLDS = [(4.5, "Excellent"), (3.5, "Very Good"), (2.5, "Average"), (1.5, "Below Average")]
GRADE_FLOOR_TEXT = "Poor"
# Grade by half-even rounding (dashboard): rounded score -> text.
GRADE_ROUNDED = {5: "Excellent", 4: "Very Good", 3: "Average", 2: "Below Average", 1: "Poor", 0: "Critical"}

# Result-card bands.
RATING_COLORS = [(4.0, "green"), (3.0, "yellow")]          # >= bound, else red
CONDITION_TEXT = [(4.0, "optimal"), (2.5, "acceptable")]   # >  bound, else critical
MARKET_VALUE = [(4.0, "High"), (2.0, "Medium")]            # >  bound, else Low
HIGH_USAGE_KM = 100000                                     # >  bound is High
WEAK_RATING_MAX = 2                                        # <= bound is weak
TOTAL_CHECKS = 6

# Records view: source column -> display name, in display order.
RECORD_COLUMNS = {
    "inspectionStartTime": "Inspection Date",
    "year": "Year",
    "rating_engineTransmission": "Engine Rating",
    "odometer_reading": "Odometer (km)",
    "fuel_type": "Fuel Type",
}

# Degradation what-if: odometer step and number of points (0 .. +50,000 km).
DEGRADATION_STEP_KM = 10000
DEGRADATION_POINTS = 6

# ---------------------------------------------------------------------------
# Scoring request (batch JSON and stream share it).  ``year``/``month`` are an
# addition: the original service never sets them (they stay 0).
# ---------------------------------------------------------------------------
REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.StringType(), True),
    T.StructField("inspectionStartTime", T.StringType(), True),
    T.StructField("odometer_reading", T.StringType(), True),
    T.StructField("fuel_type", T.StringType(), True),
    T.StructField("diagnostics", T.MapType(T.StringType(), T.BooleanType()), True),
    T.StructField("year", T.IntegerType(), True),
    T.StructField("month", T.IntegerType(), True),
])
