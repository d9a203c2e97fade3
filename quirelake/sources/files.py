"""Small files by Spark's own file access: any store that Spark reads will do."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def path_of(spark: SparkSession, path: str):
    """Hadoop's path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = path_of(spark, path)
    return bool(fs.exists(where))


def names(spark: SparkSession, path: str) -> list[str]:
    """What is in a folder; nothing if there is none."""
    where, fs = path_of(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    where, fs = path_of(spark, path)
    fs.delete(where, True)


def size_of(spark: SparkSession, path: str) -> int:
    where, fs = path_of(spark, path)
    return int(fs.getFileStatus(where).getLen())


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as it names the same file from anywhere."""
    where, fs = path_of(spark, path)
    return fs.makeQualified(where).toString()


def read_json(spark: SparkSession, path: str) -> dict | None:
    """The object of a small JSON file; None without one, or if it isn't a whole one."""
    if not exists(spark, path):
        return None
    try:
        value = json.loads("\n".join(r.value for r in spark.read.text(path).collect()))
    except ValueError:
        return None
    except Py4JJavaError as e:
        if "ChecksumException" not in str(e):
            raise
        return None
    return value if isinstance(value, dict) else None


def write_json(spark: SparkSession, path: str, value: dict, replace: bool = True) -> bool:
    """Writes a small JSON file beside its place and renames it, so that it is whole or
    not there; False if there is one already and it isn't to be replaced."""
    where, fs = path_of(spark, path)
    beside, _ = path_of(spark, f"{where.getParent().toString()}/_{uuid.uuid4().hex}.tmp")
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    out.close()
    if replace and fs.exists(where):
        fs.delete(where, False)
    done = not fs.exists(where) and fs.rename(beside, where)
    if not done:
        fs.delete(beside, False)
    return bool(done)
