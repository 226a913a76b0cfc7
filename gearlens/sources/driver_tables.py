"""The ``insp`` inspection table, derived by Spark from the driver tables.

The reference works on one table of vehicle inspections that is not shipped.
For tests and benchmarks an inspection table with the same shape is derived
from the TPC-H-like driver tables; its size grows with theirs:

* one inspection per order, with time and rating from the ``events`` row of its
  key (null where there is none),
* registration year/month from the order date, odometer from the order total
  (null for every 97th id), fuel type from the order priority,
* a 0-5 half-step rating from the ``k`` field of ``events.props``,
* seven sparse defect slots pivoted from ``lineitem`` (line number -> slot),
  one Yes/No condition column and one comment column.

``INSP_CTE`` is the same table as DuckDB SQL, used by the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gearlens.session import input_bytes

#: Size of the files up to which a side of the inspections' joins may be broadcast.
HELD_BYTES = 4 * 1024 * 1024
# Slot column for each lineitem line number (fixed naming of this fixture).
SLOT_BY_LINE = {
    1: "engineTransmission_battery_cc_value_0",
    2: "engineTransmission_battery_cc_value_1",
    3: "engineTransmission_engineOil_cc_value_0",
    4: "engineTransmission_engineOil_cc_value_1",
    5: "engineTransmission_coolant_cc_value_0",
    6: "engineTransmission_clutch_cc_value_0",
    7: "engineTransmission_clutch_cc_value_1",
}
SLOT_COLUMNS = list(SLOT_BY_LINE.values())
CONDITION_COLUMN = "engineTransmission_battery_value"
COMMENT_COLUMN = "engineTransmission_comments_value_0"
INSP_COLUMNS = [
    "appointmentId", "inspectionStartTime", "year", "month", "odometer_reading",
    "fuel_type", "rating_engineTransmission", CONDITION_COLUMN, *SLOT_COLUMNS, COMMENT_COLUMN,
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _side(df: DataFrame) -> DataFrame:
    """A side that grows with the inspections is never broadcast beyond ``HELD_BYTES`` of
    files: a few columns of a well packed file look small enough for it, and would go
    through the driver row by row."""
    return df.hint("merge") if input_bytes(df) > HELD_BYTES else df


def inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build the ``insp`` table lazily (no action is run)."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "props")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    lines = (table(spark, sf_dir, "lineitem")
             .select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
             # only line numbers that feed a slot; pushed into the parquet scan
             .where(F.col("l_linenumber").between(1, len(SLOT_BY_LINE))))
    # (l_orderkey, l_linenumber) is not unique, so the pivot takes the max.
    # The flags are one ASCII letter each, so the max is taken over the
    # character code and turned back into the letter afterwards: an int buffer
    # keeps this a hash aggregate, partial on the map side (hot keys combined
    # early), where a max over strings would sort every lineitem row first.
    def code_max(line, c):
        return F.max(F.when(F.col("l_linenumber") == line, F.ascii(c)))

    slot_aggs = [code_max(i, "l_returnflag").alias(name) for i, name in SLOT_BY_LINE.items()]
    slot_aggs.append(code_max(1, "l_linestatus").alias(COMMENT_COLUMN))
    slots = lines.groupBy("l_orderkey").agg(*slot_aggs)
    slots = slots.select("l_orderkey", *[F.char(c).alias(c) for c in SLOT_COLUMNS + [COMMENT_COLUMN]])

    k = F.get_json_object("props", "$.k").cast("int")
    base = orders.join(_side(events), orders.o_orderkey == events.event_id, "left")
    insp = base.join(_side(slots), base.o_orderkey == slots.l_orderkey, "left")
    return insp.select(
        F.col("o_orderkey").alias("appointmentId"),
        F.col("ts").alias("inspectionStartTime"),
        F.year("o_orderdate").cast("int").alias("year"),
        F.month("o_orderdate").cast("int").alias("month"),
        F.when(F.col("o_orderkey") % 97 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("o_totalprice")).alias("odometer_reading"),
        F.col("o_orderpriority").alias("fuel_type"),
        (F.floor(k * 11 / 100) / F.lit(2.0)).cast("double").alias("rating_engineTransmission"),
        F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("No").alias(CONDITION_COLUMN),
        *[F.col(c) for c in SLOT_COLUMNS],
        F.col(COMMENT_COLUMN),
    )


def _slot_sql() -> str:
    parts = [f"chr(max(case when l_linenumber = {i} then ascii(l_returnflag) end)) as {name}"
             for i, name in SLOT_BY_LINE.items()]
    parts.append(f"chr(max(case when l_linenumber = 1 then ascii(l_linestatus) end)) as {COMMENT_COLUMN}")
    return ",\n         ".join(parts)


# DuckDB text of the same table, as two CTEs (``slots``, ``insp``).
INSP_CTE = f"""slots as (
  select l_orderkey,
         {_slot_sql()}
  from lineitem
  group by l_orderkey),
insp as (
  select o.o_orderkey as appointmentId,
         e.ts as inspectionStartTime,
         cast(year(o.o_orderdate) as int) as year,
         cast(month(o.o_orderdate) as int) as month,
         case when o.o_orderkey % 97 = 0 then null else o.o_totalprice end as odometer_reading,
         o.o_orderpriority as fuel_type,
         ((cast(json_extract_string(e.props, '$.k') as int) * 11) // 100) / 2.0::double as rating_engineTransmission,
         case when o.o_orderstatus = 'F' then 'Yes' else 'No' end as {CONDITION_COLUMN},
         {", ".join("s." + c for c in SLOT_COLUMNS)},
         s.{COMMENT_COLUMN}
  from orders o
  left join events e on e.event_id = o.o_orderkey
  left join slots s on s.l_orderkey = o.o_orderkey)"""


def with_insp(sql_body: str, extra_ctes: str = "") -> str:
    """Prefix an oracle query with the ``insp`` CTEs (and optional more)."""
    extra = f",\n{extra_ctes}" if extra_ctes else ""
    return f"with {INSP_CTE}{extra}\n{sql_body}"
