"""Incremental loads: a file stream of metadata, put into tables batch by batch."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Graph, GraphError, empty
from ..scratch import dropped, written
from ..sources import files, tables
from ..sources.metadata import graph_of, transform

R = TypeVar("R")


def with_retry(call: Callable[[], R], retries: int = 5, base: float = 1.0, most: float = 20.0, errors: tuple[type[Exception], ...] = (Exception,), sleep: Callable[[float], None] = time.sleep, when: Callable[[Exception], bool] = lambda e: True) -> R:
    """``call``'s result, after waits that double, with up to a quarter added, for
    ``errors`` of which ``when`` holds."""
    for attempt in range(retries + 1):
        try:
            return call()
        except errors as e:
            if attempt == retries or not when(e):
                raise
            sleep(min(most, base * 2**attempt) * (1 + random.uniform(0, 0.25)))
    raise AssertionError


def is_transient(error: Exception) -> bool:
    """Whether an error is one of a store or an executor, which may go away."""
    return isinstance(error, OSError) or any(x in str(error) for x in ("java.io.IOException", "java.net.", "ExecutorLostFailure", "FetchFailed")) and "not a JSON object" not in str(error)


def current(spark: SparkSession, path: str) -> Graph:
    """The newest version of the tables below ``path``; empty without one."""
    return tables.read(spark, path) or empty(spark)


def newest(spark: SparkSession, path: str) -> int | None:
    """The highest version that was committed."""
    return max(tables.versions(spark, path), default=None)


def _sizes(spark: SparkSession, source: str) -> DataFrame:
    """(path, length, modificationTime) of a folder's files, without reading them."""
    return spark.read.format("binaryFile").load(source).select("path", "length", "modificationTime")


def _known(spark: SparkSession, folder: str) -> DataFrame | None:
    """The files as the last run that ended found them."""
    done = [n for n in files.names(spark, folder) if files.exists(spark, f"{folder}/{n}/_SUCCESS")]
    return spark.read.parquet(f"{folder}/{max(done, key=lambda n: int(n[2:]))}") if done else None


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, replace_edges: bool = False, retries: int = 5) -> int:
    """Puts the files of ``source`` that weren't read yet, and those that have changed
    since, into the tables of ``target``; how many records there were.

    A batch of the stream is a version, whose manifest names it, so one that is run
    again changes nothing.  A file that the stream has read but whose size or time
    differs from the last run's is read anew, whole.  Errors of the store are retried; a
    batch that fails for good is an error that names its files' lines.
    """
    total, failed = [0], []

    def put(batch: DataFrame, number: int | None) -> None:
        rows = batch.filter(F.trim("value") != "")
        lines = rows.select(F.struct("file", "block", F.monotonically_increasing_id().alias("id")).alias("seq"), F.col("value").alias("line"))
        done = (tables.manifest(spark, target) or {"applied": {}})["applied"].get(checkpoint, -1)
        if number is not None and done >= number:
            return
        lines = written(lines, "batch-lines")
        try:
            n = lines.count()
            if n:
                new = graph_of(transform(parse_lines(lines)))
                with_retry(lambda: tables.put(spark, target, new, replace_edges, {} if number is None else {checkpoint: number}), retries, when=is_transient)
            total[0] += n
        except Exception as e:
            failed.append(GraphError("LOAD_FAILED", f"batch {number}: {line_ranges(lines)}: {e}"))
            raise failed[-1] from e
        finally:
            dropped(lines)

    control = f"{checkpoint}/_files"
    now, before = written(_sizes(spark, source), "files"), _known(spark, control)
    located = lambda df: df.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    try:
        located(spark.readStream.format("text").load(source)).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    except Exception as e:
        raise (failed[0] if failed else e) from None
    if before is not None:
        old = before.select("path", F.col("length").alias("l"), F.col("modificationTime").alias("t"))
        changed = [r.path for r in now.join(old, "path").filter((F.col("length") != F.col("l")) | (F.col("modificationTime") != F.col("t"))).select("path").orderBy("path").collect()]  # names of files
        if changed:
            put(located(spark.read.text(changed)), None)
    version = max([int(n[2:]) for n in files.names(spark, control)], default=-1) + 1
    now.coalesce(1).write.parquet(f"{control}/v={version}")
    dropped(now)
    return total[0]


def line_ranges(lines: DataFrame, most: int = 5) -> str:
    """The files of a batch's lines, with how many there are of each, and the first of
    them that isn't a JSON object, for a message."""
    bad = ~(F.get_json_object("line", "$").isNotNull() & F.col("line").rlike(r"^\s*\{"))
    files = lines.groupBy("seq.file").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(bad, F.col("seq"))).alias("bad")).orderBy(F.col("bad").isNull(), "file").limit(most).collect()
    out = []
    for r in files:
        place = lines.filter((F.col("seq.file") == r.file) & (F.col("seq") <= F.struct(F.lit(r.bad.file), F.lit(r.bad.block).cast("long"), F.lit(r.bad.id).cast("long")))).count() if r.bad else 0
        out.append(f"{r.file} lines 1 to {r.n} that aren't blank" + (f", number {place} isn't a JSON object" if place else ""))
    return "; ".join(out)


def parse_lines(lines: DataFrame) -> DataFrame:
    """(seq, record) of (seq, line); a line that isn't a JSON object is an error."""
    from ..schema import RAW

    ok = F.get_json_object("line", "$").isNotNull() & F.col("line").rlike(r"^\s*\{")
    line = F.when(ok, F.col("line")).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("line", 1, 80))))
    return lines.select("seq", F.from_json(line, RAW).alias("record"))


def counts_by_window(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, event_type, n, value) of an event stream (ts, event_type, value), by
    tumbling windows with a watermark; batch tables work too."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if stamped.isStreaming:
        stamped = stamped.withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


__all__ = ["counts_by_window", "current", "ingest", "is_transient", "newest", "parse_lines", "with_retry"]
