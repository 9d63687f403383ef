"""What an entry point sees to before it runs library code."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def name_folder(spark: SparkSession) -> None:
    """Names a folder for intermediates where none is: a temporary one, if one machine is the whole
    cluster. The library itself takes the folder that spark.checkpoint.dir names, or fails."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None and spark.conf.get("spark.checkpoint.dir", None) is None:
        if context.master.startswith("local") and not context.master.startswith("local-cluster"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="reviewlens-"))


# Applications whose workers have been given the package.
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives the package to the Python workers, wherever the driver was started and whatever is installed
    on the executors: Spark hands them a copy of its files."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="reviewlens-package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for file in sorted(package.rglob("*.py")):
            packed.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
