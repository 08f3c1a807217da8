"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import hashlib
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add the package's sources to the session's Python files, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        files = sorted(root.rglob("*.py"))
        digest = hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()[:12]
        target = Path(tempfile.mkdtemp()) / f"voltaloom-{digest}.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in files:
                z.write(p, str(p.relative_to(root.parent)))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
    return spark
