"""Session helpers.

The library never starts servers: the UI is off.  Lineage is cut with
``DataFrame.checkpoint()`` into the folder named by ``spark.checkpoint.dir``;
a folder is only chosen here when the session does not name one (tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "scrubspark",
              shuffle_partitions: int | None = None, conf: dict | None = None) -> SparkSession:
    """A session with the UI off, UTC, and adaptive execution (partition
    coalescing, skew-join splitting).  ``conf`` adds settings, e.g. the
    cluster sizing in the README."""
    master = master or os.environ.get("SCRUB_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (conf or {}).items():
        builder = builder.config(k, str(v))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        checkpoint_dir(spark)
    except ValueError:
        # No shared folder named: fine until something checkpoints, which
        # then raises the same error.
        pass
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only when none is configured."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the folder
        if not configured:
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not configured:
        # A cluster names a shared folder itself; only a local session (tests)
        # may fall back to a folder of its own.
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="scrub-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()
