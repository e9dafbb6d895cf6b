"""Ships the library to the executors, so that Python workers find it wherever the driver was started."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application. The archive is made on the driver; Spark's own file server hands it out."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="affinis-")) / "affinis.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted([*ROOT.glob("affinis/**/*.py"), *ROOT.glob("corpus_pipeline.py")]):
            z.write(path, path.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(application)
