"""What a session needs before Python workers can run the library."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import hushlake

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once per application.

    A worker on another machine, or one started from another folder, cannot
    import the library from the driver's path.  The driver serves the archive.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(hushlake.__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="hushlake-"), "hushlake.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
