"""Session helpers.

Cluster settings (``spark.checkpoint.dir``, shuffle partitions, memory) belong to
whoever launches the job; the helpers here only fill in values that are unset, so
that tests and the local bench get a sane single-machine session.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

_LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # ANSI mode stays on (Spark 4 default); every cast of untrusted text is a try_cast.
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "raceboard") -> SparkSession:
    """Return the active session, or build a local one with defaults for tests/bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _LOCAL_DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("RACEBOARD_DRIVER_MEMORY", "8g"))
    if os.environ.get("RACEBOARD_CHECKPOINT_DIR"):
        builder = builder.config("spark.checkpoint.dir", os.environ["RACEBOARD_CHECKPOINT_DIR"])
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_FALLBACK_DIR: dict[str, str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local default only when it is unset (tests).

    ``spark.checkpoint.dir`` cannot be changed on a running session, so when it is
    missing the fallback is kept here and handed to ``setCheckpointDir`` instead.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.conf.get("spark.master", "local")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir is not set; on {master} it must name a folder that all executors share")
    app = application_id(spark)
    if app not in _FALLBACK_DIR:
        _FALLBACK_DIR[app] = os.environ.get("RACEBOARD_CHECKPOINT_DIR", "/tmp/raceboard-checkpoints")
        try:
            spark.sparkContext.setCheckpointDir(_FALLBACK_DIR[app])
        except Exception:  # noqa: BLE001 - no SparkContext on a remote (Connect) session
            pass
    return _FALLBACK_DIR[app]


def application_id(spark: SparkSession) -> str:
    """The running application's id (works on classic and remote sessions)."""
    return spark.conf.get("spark.app.id", None) or str(id(spark))


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package from the folder the driver has it in.

    A cluster that got the package with ``--py-files`` or an installed wheel does not need
    this; it matters when the driver only has the folder on its own path.
    """
    context = getattr(spark, "_sc", None)  # none on a remote (Connect) session
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if context is not None and root not in context.environment.get("PYTHONPATH", "").split(os.pathsep):
        context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, context.environment.get("PYTHONPATH")]))


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for written intermediates (the cluster-wide checkpoint dir)."""
    return ensure_checkpoint_dir(spark).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint dir."""
    return f"{checkpoint_root(spark)}/raceboard/{name}-{uuid.uuid4().hex[:12]}"
