"""Session helper with the settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "noteflow", partitions: int | None = None) -> SparkSession:
    """Session with UTC times and adaptive execution; cluster settings are left alone."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    spark = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint(df, spark: SparkSession | None = None):
    """Cut lineage on storage that survives an executor.

    The directory is the cluster's ``spark.checkpoint.dir``.  A temporary one is
    set only where the session names none and the master is local, where driver
    and executors are one process; elsewhere that is an error, as executors
    could not read each other's part.
    """
    _shared(spark or df.sparkSession)
    return df.checkpoint()


def _shared(spark: SparkSession) -> str:
    """The context's checkpoint folder, set on first use."""
    import tempfile

    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="noteflow-ckpt-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below the shared checkpoint folder, for tables written and read again."""
    import uuid

    return f"{_shared(spark)}/{tag}-{uuid.uuid4().hex}"
