"""A folder for what a query writes and reads back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir; a local session without one has a temporary folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        if "dir" not in _own:
            _own["dir"] = tempfile.mkdtemp(prefix="papyra-")
            atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
        root = f"file://{_own['dir']}"
    return f"{root.rstrip('/')}/papyra-{label}-{uuid.uuid4().hex}"
