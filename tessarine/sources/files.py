"""Small files on whatever file system a path names, through Hadoop: lists, texts, and replacement at once."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def list_files(spark: SparkSession, folder: str, ending: str) -> list[str]:
    """Paths of the files of a folder, in order of their names."""
    fs, there = _at(spark, folder)
    return sorted(s.getPath().toString() for s in fs.listStatus(there) if s.isFile() and s.getPath().getName().endswith(ending))


def exists(spark: SparkSession, path: str) -> bool:
    fs, there = _at(spark, path)
    return fs.exists(there)


def age_seconds(spark: SparkSession, path: str) -> float:
    """Seconds since a file was written."""
    fs, there = _at(spark, path)
    return (spark._jvm.java.lang.System.currentTimeMillis() - fs.getFileStatus(there).getModificationTime()) / 1000


def read_text(spark: SparkSession, path: str) -> str:
    fs, there = _at(spark, path)
    source = fs.open(there)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode("utf-8")
    finally:
        source.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a file beside ``path`` and rename it over it, so that readers see the old text or the new one."""
    fs, there = _at(spark, path)
    _, beside = _at(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(there.toUri() if there.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    overwrite = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    choices = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    choices[0] = overwrite
    context.rename(beside, there, choices)
