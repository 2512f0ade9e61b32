"""Spark session helpers.

The library never hard-codes a scratch location: lineage cuts and snapshot
tables go to the shared folder named by ``spark.checkpoint.dir``. Only callers
that run without a cluster (tests, the local bench) pass a fallback.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    app: str = "leadsmith",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    checkpoint_dir: str | None = None,
    extra_conf: dict | None = None,
) -> SparkSession:
    """Create (or reuse) a session with AQE on and the UI off.

    ``checkpoint_dir`` is applied only when the cluster did not set
    ``spark.checkpoint.dir`` itself.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if checkpoint_dir and not _configured_checkpoint(spark):
        spark.conf.set("spark.checkpoint.dir", checkpoint_dir)
        spark.sparkContext.setCheckpointDir(checkpoint_dir)
    return spark


def _configured_checkpoint(spark: SparkSession) -> str | None:
    value = spark.conf.get("spark.checkpoint.dir", None)
    if value:
        return value
    try:
        return spark.sparkContext.getCheckpointDir() or None
    except Exception:  # noqa: BLE001 - no SparkContext on a remote session
        return None


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and snapshot tables.

    Raises if the session has none: a machine-local temp folder is never a
    valid substitute on a cluster.
    """
    root = _configured_checkpoint(spark)
    if not root:
        raise RuntimeError(
            "spark.checkpoint.dir is not set; configure a shared folder for the cluster"
        )
    try:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(root)
    except Exception:  # noqa: BLE001 - remote session: the server-side setting applies
        pass
    return root.rstrip("/")


def ensure_checkpoint_root(spark: SparkSession) -> str:
    """``checkpoint_root``, falling back to a fresh temp folder only when the
    session runs on a local master (tests, local runs). On a cluster an unset
    ``spark.checkpoint.dir`` is an error: a machine-local folder is not shared."""
    if _configured_checkpoint(spark):
        return checkpoint_root(spark)
    try:
        master = spark.sparkContext.master
    except Exception:  # noqa: BLE001 - remote session
        master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        return checkpoint_root(spark)  # raises with a clear message
    import tempfile
    root = tempfile.mkdtemp(prefix="leadsmith-ckpt-")
    spark.conf.set("spark.checkpoint.dir", root)
    try:
        spark.sparkContext.setCheckpointDir(root)
    except Exception:  # noqa: BLE001
        pass
    return checkpoint_root(spark)


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A new, unique folder under the checkpoint root for one run's tables."""
    import uuid
    root = ensure_checkpoint_root(spark)
    return "/".join([root, *[p.strip("/") for p in parts], uuid.uuid4().hex])
