"""The folder executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession


@cache
def _local_root(application: str) -> str:
    return tempfile.mkdtemp(prefix="leaseloom-")


def shared_root(spark: SparkSession) -> str:
    """The folder named in `spark.checkpoint.dir`, else the one set on the context. Without either, a local session gets a temporary
    folder; on a cluster every executor would write to a disk of its own, so that is an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if context.master.startswith("local["):
        return _local_root(context.applicationId)
    raise ValueError("no shared folder: name one in spark.checkpoint.dir")


def shared_folder(spark: SparkSession) -> str:
    """A new path under the shared folder."""
    return f"{shared_root(spark)}/leaseloom/{uuid.uuid4().hex}"
