"""Reading the inspection table and writing result tables.

S4/S5 (model and feature-list persistence) live in ``plans.model``; S6
(scoring requests) in ``sources.requests``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".jsonl": "json", ".orc": "orc"}


def format_of(path: str) -> str:
    """Format by extension; an unknown extension reads as CSV."""
    p = path.rstrip("/").lower()
    for ext, fmt in FORMATS.items():
        if p.endswith(ext):
            return fmt
    return "csv"


def read_inspections(spark: SparkSession, path: str, schema: StructType | None = None,
                     fmt: str | None = None, alternatives=()) -> DataFrame:
    """The inspection table from CSV (header), parquet or JSON.

    With ``schema`` no inference pass runs (use it in production).  When the
    path does not exist, each of ``alternatives`` is tried in turn; if none
    exists Spark's path-not-found error is raised.
    """
    last = None
    for p in [path, *alternatives]:
        try:
            return _read(spark, p, schema, fmt or format_of(p))
        except AnalysisException as e:   # missing path: try the next one
            if "PATH_NOT_FOUND" not in str(e) and "Path does not exist" not in str(e):
                raise
            last = e
    raise last


def _read(spark, path, schema, fmt) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        r = r.option("header", True)
        if schema is None:
            r = r.option("inferSchema", True)
        return r.csv(path)
    if fmt == "json":
        return r.json(path)
    return r.format(fmt).load(path)


def write_records_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """S3: export records as CSV with a header and no index column.

    ``single_file`` gathers the output into one part file; use it only for a
    bounded (filtered) result.
    """
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, partition_by=()) -> None:
    """Write a result table as parquet (optionally partitioned)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
