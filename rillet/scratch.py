"""Tables that cut a plan's lineage, kept where every executor can read them."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Only a local master may go without that setting; it then gets a temporary
    folder, removed when the process ends. A cluster without it is an error,
    for a machine-local folder would not outlive its machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="rillet-"))
            atexit.register(shutil.rmtree, _own[0], True)
        base = "file://" + _own[0]
    return f"{base.rstrip('/')}/rillet-{uuid.uuid4().hex}"


def cut(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` written below ``folder`` as Parquet and read again."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_path(uri: str) -> str:
    return uri[len("file://") :] if uri.startswith("file://") else os.fspath(uri)
