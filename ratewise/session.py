"""SparkSession construction and shared-storage settings.

On a cluster the session is created by the platform; the library only
reads its settings.  ``get_spark`` is for tests, benches and local runs.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every plan in this package relies on.  AQE re-plans joins from
# runtime sizes, coalesces small shuffle partitions and splits skewed ones.
_REQUIRED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.session.timeZone": "UTC",
}


def get_spark(
    app: str = "ratewise",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Return the active session, or build a local one for tests/benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 4)
    builder = (
        SparkSession.builder.appName(app)
        .master(master or f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.driver.memory", os.environ.get("RATEWISE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in {**_REQUIRED_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; that value is used
    as is.  Only when it is unset (local tests) a scratch folder is made.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.conf.get("spark.master", "") or ""
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder shared by all executors "
                               "(a machine-local scratch folder is only used in local mode)")
        configured = tempfile.mkdtemp(prefix="ratewise-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    try:  # RDD checkpoints (iterative ML fits) use the same folder; absent under Spark Connect
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
    except Exception:  # noqa: BLE001
        pass
    return configured
