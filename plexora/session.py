"""Session factory and the settings every plan in this package relies on."""

from __future__ import annotations

import atexit
import os

from pyspark.sql import SparkSession


def get_spark(app: str = "plexora", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, ANSI mode, AQE with skew handling and Arrow on.

    On a cluster the submitting side names the master and the sizes; only where none is given does this fall back to
    local mode.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def local_spark(cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and the bench."""
    n = cpus or os.cpu_count() or 4
    base = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    return get_spark(master=f"local[{n}]", **{**base, **conf})


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once per context, so that Python workers can import it wherever they run."""
    import shutil
    import tempfile
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_plexora_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="plexora-package-")
    target = os.path.join(folder, "plexora.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("plexora") / p.relative_to(root))
    sc.addPyFile(target)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc._plexora_shipped = True
