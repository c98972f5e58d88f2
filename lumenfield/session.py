"""Session helpers: building a session and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def build_session(cpus: int = 8, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session with the settings that tests and benchmarks share."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lumenfield")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Give executors this package through Spark's file server, once for each application.

    Python workers import the functions they run by module name; nothing has to be installed
    on the executors beforehand.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="lumenfield-ship-"), "lumenfield_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(_PACKAGE.rglob("*.py")):
            archive.write(path, path.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
