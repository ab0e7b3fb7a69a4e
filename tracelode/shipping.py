"""Makes the package importable in Python workers that do not share the driver's path."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip to ``spark``, once for each application; Spark's file server hands it to the executors."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    if str(root.parent) not in (sc.environment.get("PYTHONPATH", "") + ":" + os.environ.get("PYTHONPATH", "")).split(":"):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as bundle:
            for path in sorted(root.rglob("*.py")):
                bundle.write(path, path.relative_to(root.parent))
        target = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
        target.write_bytes(buffer.getvalue())
        sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
