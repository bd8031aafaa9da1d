"""What a plan needs from the cluster it runs on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to Python workers that would not find it on their path."""
    home = Path(__file__).resolve().parents[2]
    if str(home) in os.environ.get("PYTHONPATH", "").split(":") or spark.sparkContext.applicationId in _shipped:
        return
    out = Path(tempfile.mkdtemp(prefix="terravane-")) / "terravane.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted((home / "terravane").rglob("*.py")):
            z.write(f, f.relative_to(home))
    spark.sparkContext.addPyFile(str(out))
    _shipped.add(spark.sparkContext.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder.

    Where none is set, a session on one machine gets a temporary one, which is
    also set for checkpoints; on a cluster that is an error, as executors would
    write to disks that others cannot read.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    java = spark.sparkContext._jsc.sc()
    if not java.getCheckpointDir().isDefined():
        if not java.isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="terravane-"))
    return java.getCheckpointDir().get()
