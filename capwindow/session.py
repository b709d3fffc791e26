"""Session helpers: the settings every query of the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that hold at every scale. Shuffle width and broadcast sizes are the cluster's business.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(cpus: int | None = None, app: str = "capwindow") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{n}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(n))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
