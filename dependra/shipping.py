"""Makes the package importable on executors, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED = "_dependra_shipped"


def ship(spark: SparkSession) -> None:
    """Once for a Spark context: send the package's sources as an archive that workers import from."""
    sc = spark.sparkContext
    if getattr(sc, _SHIPPED, False):
        return
    package = Path(__file__).resolve().parent
    target = Path(os.path.realpath(tempfile.mkdtemp(prefix="dependra-"))) / "dependra_core.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(target))
    setattr(sc, _SHIPPED, True)
