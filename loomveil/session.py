"""Makes the package known to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's code to the executors, unless they find it by PYTHONPATH."""
    if str(_ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    path = Path(tempfile.mkdtemp(prefix="loomveil-")) / "loomveil.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in [*(_ROOT / "loomveil").rglob("*.py"), *_ROOT.glob("corpus_pipeline.py")]:
            z.write(f, f.relative_to(_ROOT))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
