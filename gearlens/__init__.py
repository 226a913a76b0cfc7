"""gearlens — vehicle-inspection analytics as plain Spark DataFrame operators.

Every public operator takes and returns a ``pyspark.sql.DataFrame`` and leaves
planning to Catalyst.  Sub-packages:

* ``sources``   — readers/writers (CSV/parquet/JSON, model persistence, the
                  ``insp`` inspection view derived from the driver tables)
* ``functions`` — column expressions (time features, name rules, bands) and
                  scalar tail probabilities
* ``operators`` — profiling, cleaning, encoding, aggregates, windows, statistics
* ``plans``     — Spark ML training/scoring and the named pipelines
* ``streaming`` — Structured Streaming scoring
"""

__version__ = "0.1.0"
