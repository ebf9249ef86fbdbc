"""Session helpers: one place for the settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter at any scale. AQE re-plans joins from runtime sizes,
# splits skewed join partitions and coalesces small shuffle partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files of materialised intermediates are removed once unused
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # HotSpot does not JIT-compile methods over 8,000 bytes; wide cleaning
    # stages generate more, so such a stage falls back to per-expression code
    # (compiled) instead of one interpreted whole-stage method
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# Sizing for a large cluster (~1000 executors, ~100 TB of Parquet): scan
# splits of 256 MB (~400k scan tasks), a high initial shuffle partition count
# that AQE coalesces to ~256 MB partitions, skew splitting above 512 MB, and
# broadcasts up to 64 MB behind Spark's own size estimate.
CLUSTER_CONF = {
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.decommission.enabled": "true",
}


def build_session(
    master: str | None = None,
    app_name: str = "incident-analytics",
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
    cluster: bool = False,
) -> SparkSession:
    """Create (or reuse) a session with the library defaults.

    On a cluster pass ``master=None`` and ``cluster=True`` and let
    spark-submit decide the rest; tests use ``local[N]`` with a shuffle
    partition count close to N.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if cluster:
        settings.update(CLUSTER_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediates.

    In order: the folder already given to ``setCheckpointDir``, the session's
    ``spark.checkpoint.dir``, and, only under a ``local`` master with neither,
    a new local folder. Any other master must name a folder that the driver
    and every executor reach, so there a missing setting is an error, raised
    when a step first needs the folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # remote (Connect) sessions have no local context; the server's setting applies
        if not configured:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share") from None
        return configured
    # getCheckpointDir() names the application's sub-folder of the given one
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured
    if current is not None:
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="incident-analytics-ckpt-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder for one written table."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"
