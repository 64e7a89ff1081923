"""Session settings the engine relies on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app_name: str = "runlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the reports assume (UTC clock, AQE on).

    Everything else, such as executor sizes, the number of shuffle partitions
    and the broadcast threshold, belongs to the cluster and is left alone unless
    the caller passes it.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """All stored timestamps are UTC, so the session clock has to be UTC too."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    ``spark.checkpoint.dir`` decides. Only a local-master session, as in tests,
    gets a folder of its own when that setting is missing: on a cluster a
    machine-local path would be lost with the executor that wrote it.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = sc.getCheckpointDir() or tempfile.mkdtemp(prefix="runlens-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured.rstrip("/")


def work_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/runlens-{purpose}-{uuid.uuid4().hex}"
