"""Make the package importable where its functions run."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once an application: they need not share the driver's import path."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="docloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves it until it ends
    archive = Path(folder) / "docloom_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, str(Path(root.name) / path.relative_to(root)))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)
