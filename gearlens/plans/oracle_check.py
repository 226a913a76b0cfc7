"""Local stand-in for the driver's correctness compare.

Runs a registered query in Spark and its oracle SQL in DuckDB over the same
parquet files and compares row count, column names and the multiset of rows
(columns sorted by name, doubles rounded to 6 places).
"""

from __future__ import annotations

import math
from collections import Counter

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


_SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "smallint": "SMALLINT", "tinyint": "TINYINT",
                  "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN",
                  "date": "DATE", "timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP"}


def type_mismatches(sdf, rel) -> dict:
    """Columns whose Spark type and DuckDB type differ."""
    s = {f.name: _SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
    d = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    return {c: (s.get(c), d.get(c)) for c in set(s) | set(d) if s.get(c) != d.get(c)}


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, fn, sql: str, sf_dir: str) -> dict:
    sdf = fn(spark, sf_dir)
    types = type_mismatches(sdf, con.sql(sql))
    s_names = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    cur = con.execute(sql)
    d_names = [d[0] for d in cur.description]
    d_rows = cur.fetchall()
    res = {"query": name, "spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "names_match": sorted(s_names) == sorted(d_names), "type_mismatches": types}
    res["values_match"] = res["names_match"] and rows_of(s_names, s_rows) == rows_of(d_names, d_rows)
    if not res["values_match"]:
        a, b = rows_of(s_names, s_rows), rows_of(d_names, d_rows)
        res["only_spark"] = list((a - b).items())[:3]
        res["only_oracle"] = list((b - a).items())[:3]
        res["spark_names"], res["oracle_names"] = sorted(s_names), sorted(d_names)
    return res
