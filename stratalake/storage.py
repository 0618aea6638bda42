"""Tables computed once, in the folder that driver and executors share, and files that tasks open themselves."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path
from typing import BinaryIO

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); on one machine a temporary one stands in."""
    if not spark.sparkContext.getCheckpointDir():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(root or tempfile.mkdtemp(prefix="stratalake-"))
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df computed once: checkpointed in the folder that driver and executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_file(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for one file that the driver writes and tasks read; the folder is a mounted one."""
    root = shared_folder(spark)
    if ":" in root and not root.startswith("file:"):
        raise ValueError(f"{root} is no mounted folder")
    folder = Path("/" + root[5:].lstrip("/") if root.startswith("file:") else root) / uuid.uuid4().hex
    folder.mkdir(parents=True)
    return str(folder / name)


def open_file(path: str) -> BinaryIO:
    """A file for reading at any place: a local path, or a URI of a file system that Arrow knows."""
    scheme = path.partition(":")[0] if ":" in path else ""
    if scheme in ("", "file"):
        return pafs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/") if scheme else path)
    fs, at = pafs.FileSystem.from_uri("s3" + path[3:] if scheme == "s3a" else path)
    return fs.open_input_file(at)
