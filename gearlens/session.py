"""Session helper and checkpoint-folder resolution."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every gearlens job relies on.  Session time zone is pinned to UTC so
# that wall-clock fields of LTZ timestamps never depend on the host zone.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # long sessions run many small jobs: let the cleaner reclaim shuffle files
    # and broadcasts of finished queries regularly
    "spark.cleaner.periodicGC.interval": "1min",
}


def get_session(master: str = "local[*]", shuffle_partitions: int = 8,
                app_name: str = "gearlens", extra: dict | None = None) -> SparkSession:
    """Local/test session.  On a cluster, build the session with the
    cluster's own settings and call :func:`configure` on it instead."""
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("GEARLENS_DRIVER_MEMORY", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


TARGET_PARTITION_BYTES = 256 * 1024 * 1024


def scale_conf(input_bytes: int, target_partition_bytes: int = TARGET_PARTITION_BYTES) -> dict:
    """Shuffle and scan sizing for an input of ``input_bytes`` (compressed
    parquet): about 256 MB per scan split and per shuffle partition after AQE
    coalescing, starting from enough partitions that the largest stage never
    spills a whole partition; skewed partitions (5x the median and above
    1 GB) are split by AQE's skew join."""
    parts = max(200, -(-int(input_bytes) * 3 // target_partition_bytes))   # ~3x expansion when decoded
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
    }


def configure(spark: SparkSession, input_bytes: int | None = None) -> SparkSession:
    """Apply the runtime-settable part of BASE_CONF (and, given the input
    size, the sizing of :func:`scale_conf`) to an existing session."""
    conf = {k: v for k, v in BASE_CONF.items() if k.startswith("spark.sql.")}
    if input_bytes:
        conf.update(scale_conf(input_bytes))
    for k, v in conf.items():
        spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def input_bytes(df) -> int:
    """Bytes of the files a DataFrame scans, from the optimizer's statistics of
    its leaf relations (metadata only, no job).  The root estimate is not used:
    without cost-based statistics a join's estimate is the product of its
    inputs."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared folder and is always honoured.
    Only a local master may leave it unset: its one machine gets a scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="gearlens-ckpt-")
    sc.setCheckpointDir(local)
    return local


def shared_folder(spark: SparkSession, name: str) -> str:
    """A sub-folder of the checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"
