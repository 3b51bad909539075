"""The folder that all machines of a cluster see."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A path, unique for each call, in the folder that spark.checkpoint.dir names; where that is unset, in a temporary one in local mode, else an error."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[[^\[]*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not root:
        root = _OWN.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="marlpit-"))
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
