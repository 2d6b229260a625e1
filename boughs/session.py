"""What a session needs before Python workers can run this package's code."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see, by ``spark.checkpoint.dir``. Only on a local master may it be a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not re.match(r"local(\[[^-]*\])?$", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = tempfile.mkdtemp(prefix="boughs-")
        folder = _own[context.applicationId]
    return folder.rstrip("/")


def ship_code(spark: SparkSession) -> None:
    """Send this package to all executors, once per application, so that it needs no installation there."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="boughs-code-"), "boughs.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("boughs", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(path)
    _sent.add(app)
