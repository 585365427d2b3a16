"""A PySpark-native engine for spatio-temporal sensor data."""

from __future__ import annotations

import os
import tempfile
import zipfile

_shipped: set[str] = set()


def ship(spark) -> None:
    """Make this package importable on the executors, once for each application.

    Grouped and Arrow functions are pickled by reference; where the executors do not have the package on
    their path, this sends it along.
    """
    sc = spark.sparkContext
    here = os.path.dirname(os.path.abspath(__file__))
    if sc.applicationId in _shipped or not os.path.isdir(here):
        return
    folder = os.path.realpath(tempfile.mkdtemp(prefix="voxloom-ship-"))
    path = os.path.join(folder, "voxloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.join("voxloom", os.path.relpath(full, here)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
