"""The package on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_MARK = "spark.tallyfold.shipped"


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors of a context once, so that their workers can import it."""
    context = spark.sparkContext
    if spark.conf.get(_MARK, None) == context.applicationId:
        return
    home = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tallyfold-")) / "tallyfold_package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(home.rglob("*.py")):
            archive.write(source, Path(home.name) / source.relative_to(home))
    context.addPyFile(str(target))
    spark.conf.set(_MARK, context.applicationId)
