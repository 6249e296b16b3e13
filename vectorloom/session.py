"""Sessions, and this package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def session(app: str = "vectorloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that results depend on (time zone, base64 without line breaks) and small Arrow batches.

    Pools of BLAS threads are held at one each: tasks are the parallelism."""
    builder = SparkSession.builder.appName(app)
    builder = builder.master(master) if master else builder
    settings = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.legacy.chunkBase64String.enabled": "false", "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.executorEnv.OMP_NUM_THREADS": "1", "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
    return builder.config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once for each application, unless their path has it already."""
    app = spark.sparkContext.applicationId
    if app in _shipped or str(PACKAGE.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _shipped.add(app)
    at = Path(tempfile.mkdtemp(prefix="vectorloom-")) / "vectorloom.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(str(at))
