"""A folder that driver and executors share, for tables that a plan writes and
reads again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in ``spark.checkpoint.dir``.  Where that is unset, a local
    folder if everything runs in one process, as in tests; else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="lexloom-")
        found = _OWN[app]
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"
