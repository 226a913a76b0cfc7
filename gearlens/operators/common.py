"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame


def sorted_small(df: DataFrame, *order) -> DataFrame:
    """Total order for a result with a known small bound (one row per column,
    month, hour, year, bin, grid point or group of a checked count).

    One partition sorted locally: no range-partition sampling job, which a
    global ``orderBy`` would run.  The exchange stands after the last
    aggregation, so only finished rows meet in the one task.  Never use it on a
    result that grows with the number of input rows.
    """
    return df.repartition(1).sortWithinPartitions(*order)
