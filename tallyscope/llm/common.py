"""What the corpus operators share: reading, splitting, and tables between stages."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.sources.readers import write_between_stages

#: A word is a run of anything but these ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a session inside one JVM (a test) gets a temporary folder; a cluster is
    refused, as its executors would not see a folder of the driver's machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="tallyscope-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, kept when an executor is lost."""
    shared_folder(df.sparkSession)
    return write_between_stages(df, name)


def checksum(doc_id: str) -> Column:
    """``crc32(doc_id as text)``; a null id counts as the empty text (0)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def remainder(doc_id: str, modulus: int) -> Column:
    """``crc32(doc_id as text) mod modulus``; a null id counts as the empty text (remainder 0)."""
    return checksum(doc_id) % modulus


def uri_of(folder: str) -> str:
    """A folder as a URI: local paths with ``file://``, others as they are."""
    return f"file://{folder}" if folder.startswith("/") else re.sub(r"^file:/(?!/)", "file:///", folder)
