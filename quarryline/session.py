"""Session settings and the shared folder that jobs write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", app: str = "quarryline", settings: dict[str, str] | None = None) -> SparkSession:
    """A single-machine session for tests and the benchmark.

    A cluster brings its own session; nothing in the library depends on these settings.
    """
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .config(map=settings or {})
        .getOrCreate()
    )


def workspace(spark: SparkSession, label: str) -> str:
    """A new folder name for one run's files, below the session's shared checkpoint folder.

    Tables written here are how a job cuts its lineage, so the folder must be one every executor
    sees. Only a local session without that setting gets a temporary folder of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="quarryline-")
    return f"{shared.rstrip('/')}/quarryline/{label}-{uuid.uuid4().hex}"
