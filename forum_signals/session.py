"""Session helpers: a tuned builder for tests/benches and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Shuffle files go when the write that made them has ended, and not when the driver happens to collect its garbage. Rows of a few
# kinds go to one file per kind as they come: sorted by kind first, a task's texts would be spilled.
LEAN_WRITES = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.maxConcurrentOutputFileWriters": "8",
}


def local_session(cores: str | int = "*", app: str = "forum-signals", **conf: str) -> SparkSession:
    """A single-machine session. On a cluster the submitter's own session is used instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8" if cores == "*" else str(cores))
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@contextmanager
def lean_writes(spark: SparkSession) -> Iterator[None]:
    """For writes that should keep little beside their result; the session's own settings come back afterwards."""
    before = {key: spark.conf.get(key, None) for key in LEAN_WRITES}
    try:
        for key, value in LEAN_WRITES.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in its configuration.

    Where none is named, a folder of the warehouse serves, which all executors reach as well. A warehouse on the machine's own disk
    does only if the session runs on one machine; on a cluster it is refused.
    """
    if folder := spark.conf.get(CHECKPOINT_KEY, None):
        return folder.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if warehouse.startswith("file:") and not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors of {master} reach; {warehouse} is local")
    return f"{warehouse}/_scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table in the shared folder."""
    return f"{shared_dir(spark)}/forum_signals/{name}-{uuid.uuid4().hex}"
