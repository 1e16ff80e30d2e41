"""Reading the stored tables: Parquet folders or files, one per table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from tidelog.session import hadoop


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def file_stamps(spark: SparkSession, path: str) -> str:
    """A digest of names, lengths and times of a table's files: another one as soon as a file is added or replaced."""
    fs, at = hadoop(spark, path)
    files = fs.listFiles(at, True)
    digest = hashlib.md5()
    names = []
    while files.hasNext():
        f = files.next()
        names.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    digest.update("\n".join(sorted(names)).encode())
    return digest.hexdigest()
