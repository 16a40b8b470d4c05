"""Files and folders through Hadoop's file systems: markers, listings and facts of files."""
from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _at(spark, path)
    return fs.exists(target)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, target = _at(spark, path)
    return fs.getFileStatus(target).isDirectory()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder; none if there is no such folder."""
    fs, target = _at(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files below a folder."""
    fs, target = _at(spark, path)
    return fs.getContentSummary(target).getLength() if fs.exists(target) else 0


def file_facts(spark: SparkSession, path: str) -> tuple[str, int, int]:
    """Path, length and time of change of a file."""
    fs, target = _at(spark, path)
    status = fs.getFileStatus(target)
    return str(status.getPath().toString()), status.getLen(), status.getModificationTime()


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file unless there is one of that name, in one step; False if another writer was first.

    Local files are created by the operating system's exclusive create, others by the file
    system's create without overwriting, which HDFS and stores with conditional writes do in one step.
    """
    fs, target = _at(spark, path)
    fs.mkdirs(target.getParent())
    jvm = spark._jvm
    try:
        if fs.getUri().getScheme() == "file":
            local = jvm.java.io.File(fs.makeQualified(target).toUri().getPath())
            if not local.createNewFile():
                return False
            out = jvm.java.io.FileOutputStream(local)
        else:
            out = fs.create(target, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    fs, target = _at(spark, path)
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _at(spark, path)
    fs.delete(target, True)
