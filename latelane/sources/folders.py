"""Small files and folders in whatever file system a path names, through Hadoop's own client."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession


def _opened(spark: SparkSession, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()), place


def _is(error: Py4JJavaError, *names: str) -> bool:
    return any(error.java_exception.getClass().getName().endswith(n) for n in names)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the visible entries of a folder, sorted; none if it does not exist."""
    system, place = _opened(spark, folder)
    try:
        found = [s.getPath().getName() for s in system.listStatus(place)]
    except Py4JJavaError as exc:
        if _is(exc, "FileNotFoundException"):
            return []
        raise
    return sorted(n for n in found if n[0] not in "._")


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that must not exist yet; false if it does."""
    system, place = _opened(spark, path)
    try:
        out = system.create(place, False)
    except Py4JJavaError as exc:
        if _is(exc, "FileAlreadyExistsException"):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, or None if it has gone."""
    try:
        row = spark.read.text(path, wholetext=True).first()
        return row[0] if row else ""
    except (PySparkException, Py4JJavaError):
        if names(spark, path.rsplit("/", 1)[0]).count(path.rsplit("/", 1)[1]):
            raise
        return None


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder with all it holds; nothing happens if it is not there."""
    system, place = _opened(spark, path)
    system.delete(place, True)
