"""The package on executors that have no copy of this repository."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()
#: Rows go to Python in batches of about so many bytes unless the session says otherwise: ten thousand long texts at once, held by the JVM and by the worker, would be most of an executor's memory.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once an application. They fetch it from the driver as long as that lives; no data lies in its folder. Batches of the session are bounded in bytes."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    at = tempfile.mkdtemp(prefix="quarryline-")
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    path = os.path.join(at, "quarryline_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(_PACKAGE):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
