"""The shared folder for snapshots (spark.checkpoint.dir, or one of the session's own where all runs in one process), and small text files beside it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

from quernix.errors import DeltaError


def folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise DeltaError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quernix-"))
        root = sc.getCheckpointDir()
    return f"{root}/state-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A file that is there whole or not at all."""
    part, fs = _at(spark, f"{path}.part-{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    whole, _ = _at(spark, path)
    fs.delete(whole, False)
    if not fs.rename(part, whole):
        raise DeltaError(f"cannot write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    at, fs = _at(spark, path)
    stream = fs.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    at, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, True)
