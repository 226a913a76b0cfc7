"""Scoring requests: reader (S6) and requests derived from inspections.

A request is ``{inspectionStartTime, odometer_reading, fuel_type,
diagnostics{key: bool}}`` plus our optional ``year``/``month``.  The same
schema serves the batch reader and the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gearlens import schema as S
from gearlens.sources.driver_tables import SLOT_COLUMNS

# Fixture mapping from order priority to a fuel choice of the request form.
FUEL_BY_PRIORITY = {
    "1-URGENT": "Petrol",
    "2-HIGH": "CNG",
    "3-MEDIUM": "LPG",
    "4-NOT SPECIFIED": "Diesel",
    "5-LOW": "Electric",
}
# Fixture mapping from a diagnostic key to the slot whose 'R' value sets it.
DIAGNOSTIC_SLOT = {
    "battery_jump_start": SLOT_COLUMNS[0],
    "engine_oil_leak": SLOT_COLUMNS[2],
    "engine_sound_abnormal": SLOT_COLUMNS[3],
    "exhaust_smoke_white": SLOT_COLUMNS[4],
    "clutch_hard": SLOT_COLUMNS[5],
    "gear_shifting_hard": SLOT_COLUMNS[6],
}


# The same priorities as fuel values of an inspection table whose trained flags
# are the ones that requests set (every other '5-LOW' is a hybrid).
SERVICE_FUEL = {"1-URGENT": "Petrol", "2-HIGH": "Petrol + CNG", "3-MEDIUM": "Petrol + LPG", "4-NOT SPECIFIED": "Diesel", "5-LOW": "Electric"}
# Diagnostic key -> (slot column, value of 'R', value of 'A'); 'N' is no finding.
_E = "engineTransmission_"
SERVICE_SLOTS = {
    "battery_jump_start": (f"{_E}battery_cc_value_0", "Jump Start", "Discharged"),
    "engine_oil_leak": (f"{_E}engineOil_cc_value_0", "Leaking", "Dirty"),
    "engine_sound_abnormal": (f"{_E}engineSound_cc_value_0", "Engine Auxiliary Noise", "Critical"),
    "exhaust_smoke_white": (f"{_E}exhaustSmoke_cc_value_0", "White", "Black"),
    "clutch_hard": (f"{_E}clutch_cc_value_0", "Hard", "Burning"),
    "gear_shifting_hard": (f"{_E}gearShifting_cc_value_0", "Not Engaging", "Hard"),
}


def service_inspections(insp: DataFrame) -> DataFrame:
    """The inspections in the words of the scoring service, for the model that
    requests are scored with: fuel values and findings under the names behind
    ``FUEL_FLAGS`` and ``DIAGNOSTIC_FLAGS``.  Each finding that a request can
    name lowers the rating by half a step."""
    fuel = F.coalesce(*[F.when(F.col(S.FUEL) == k, F.lit(v)) for k, v in SERVICE_FUEL.items()])
    fuel = F.when((F.col(S.FUEL) == "5-LOW") & (F.col(S.KEY) % 2 == 1), "Hybrid").otherwise(fuel)
    bad = sum(F.coalesce((F.col(DIAGNOSTIC_SLOT[k]) == "R").cast("int"), F.lit(0)) for k in SERVICE_SLOTS)
    rest = [F.col(c) for c in insp.columns if c not in (S.FUEL, S.TARGET, *SLOT_COLUMNS)]
    slots = [F.when(F.col(DIAGNOSTIC_SLOT[k]) == "R", r).when(F.col(DIAGNOSTIC_SLOT[k]) == "A", a).alias(c)
             for k, (c, r, a) in SERVICE_SLOTS.items()]
    return insp.select(*rest, fuel.alias(S.FUEL), F.when(F.col(S.TARGET).isNotNull(), F.greatest(F.col(S.TARGET) - 0.5 * bad, F.lit(0.0))).alias(S.TARGET), *slots)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines scoring requests with the fixed request schema; a
    missing ``diagnostics`` becomes an empty map."""
    df = spark.read.schema(S.REQUEST_SCHEMA).json(path)
    return with_default_diagnostics(df)


def with_default_diagnostics(df: DataFrame) -> DataFrame:
    empty = F.create_map().cast("map<string,boolean>")
    return df.withColumn("diagnostics", F.coalesce(F.col("diagnostics"), empty))


def requests_from_inspections(insp: DataFrame, with_registration: bool = False) -> DataFrame:
    """Request records derived from inspection rows (one per inspection).

    Time as the form sends it (ISO minutes), odometer as text ("x" when it is
    missing, a record for the reject path), fuel from the priority, and a
    diagnostics map that only holds keys whose slot is filled.
    """
    fuel = F.coalesce(*[F.when(F.col(S.FUEL) == k, F.lit(v)) for k, v in FUEL_BY_PRIORITY.items()])
    entries = F.array(*[F.struct(F.lit(k).alias("key"), (F.col(c) == "R").alias("value"))
                        for k, c in DIAGNOSTIC_SLOT.items()])
    kept = F.filter(entries, lambda e: e["value"].isNotNull())
    diag = F.map_from_entries(kept)
    return insp.select(
        F.col(S.KEY).cast("string").alias("request_id"),
        F.date_format(S.TIME, "yyyy-MM-dd'T'HH:mm").alias("inspectionStartTime"),
        F.coalesce(F.col(S.ODOMETER).cast("bigint").cast("string"), F.lit("x")).alias("odometer_reading"),
        fuel.alias("fuel_type"),
        diag.alias("diagnostics"),
        (F.col(S.REG_YEAR) if with_registration else F.lit(None).cast("int")).alias("year"),
        (F.col(S.REG_MONTH) if with_registration else F.lit(None).cast("int")).alias("month"),
    )
