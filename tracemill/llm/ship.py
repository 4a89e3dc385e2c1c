"""Sends this package to executors on which it isn't installed, and keeps the batches that go to them small."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of a batch of whole texts: it stands several times in a task's JVM and Python worker.
BATCH, _BYTES = "8m", "spark.sql.execution.arrow.maxBytesPerBatch"
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a zipped Python file, once for each application, and bounds Arrow batches of the session by BATCH bytes unless the application bounds them itself."""
    if spark.sparkContext.getConf().get(_BYTES) is None:
        spark.conf.set(_BYTES, BATCH)
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="tracemill-")) / "tracemill.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, Path(package.name) / path.relative_to(package))
    spark.sparkContext.addPyFile(str(target))
    _sent.add(app)
