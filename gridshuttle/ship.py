"""Makes this code importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession, package_file: str = __file__) -> None:
    """On one machine workers get the folder of the package in their path;
    elsewhere a zip of the package travels with the job (once a context)."""
    sc = spark.sparkContext
    package = os.path.dirname(os.path.abspath(package_file))
    root = os.path.dirname(package)
    done = sc.__dict__.setdefault("_shipped_packages", set())
    if package in done:
        return
    done.add(package)
    if sc.master.startswith("local"):
        paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        if root not in paths:
            sc.environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
        return
    sc.addPyFile(zipped(package, tempfile.mkdtemp()))


def zipped(package: str, folder: str) -> str:
    """A zip of the package's sources in ``folder``."""
    path = os.path.join(folder, os.path.basename(package) + ".zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(top, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    return path
