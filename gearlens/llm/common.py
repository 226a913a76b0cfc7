"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gearlens.session import shared_folder

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Separators of the plain word rule `[^\x20\x09-\x0D]+`.
SPACE = r"[\x20\x09-\x0D]+"


def ship_by_value(module_name: str) -> None:
    """Send a module's task functions to the executors by value, so that they
    need no copy of this repository on their path."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: later
    steps scan the files, so a lost executor costs only the running tasks."""
    spark = df.sparkSession
    path = f"{shared_folder(spark, 'llm')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, every other character untouched."""
    return F.translate(c, ASCII_UPPER, ASCII_UPPER.lower())


def split_words(c: Column, separators: str = SPACE) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.array_remove(F.split(c, separators), ""), F.array().cast("array<string>"))


def text_key(c: Column) -> Column:
    """Tells apart rows that share an id but not a text."""
    return F.xxhash64(c)


ship_by_value(__name__)
