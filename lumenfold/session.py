"""Session settings that the library's results rely on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(name: str = "lumenfold", cpus: int | None = None, memory: str = "12g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def with_workers(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this machine import the library where it isn't installed."""
    root, held = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if root not in held.get("PYTHONPATH", ""):
        held["PYTHONPATH"] = ":".join(filter(None, [root, held.get("PYTHONPATH")]))
    return spark
