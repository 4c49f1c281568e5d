"""Session helper for local runs and tests; on a cluster the caller's session is used."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", app: str = "hazardry", **conf: str) -> SparkSession:
    """A local session with UTC time and adaptive execution."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("HAZARDRY_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send the package's code to the executors, once a context, so that Python functions can be imported there."""
    import shutil
    import tempfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_hazardry_shipped", False):
        return
    root = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory(prefix="hazardry-code-") as folder:
        staged = Path(folder, "stage", root.name)
        shutil.copytree(root, staged, ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="hazardry-zip-"), "hazardry")), "zip", staged.parent)
    sc.addPyFile(archive)
    sc._hazardry_shipped = True
