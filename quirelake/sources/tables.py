"""The graph's tables in buckets of keys, with a manifest for each version.

``<table>/g=<version>/b=<bucket>`` has a bucket's rows as a version wrote them, and
``_manifest/<version>.json`` says which version has each bucket's newest rows.  A batch
reads and writes the buckets that its keys are in, and then its manifest, which is what
makes it count: one that ends before has changed nothing.  Rows of a paper are in
buckets of one number in all tables.  ``vacuum`` deletes what no kept version needs.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TABLES, Graph, GraphError
from ..scratch import dropped, written
from . import files
from .metadata import EDGES, upsert

#: Buckets of a new graph: a batch copies the buckets it touches, so a large graph needs
#: many (see ``rebucket``).
BUCKETS = 16
#: Tables of a batch that are written at the same time.
TABLES_AT_ONCE = 4


def bucket(name: str, buckets: int) -> Column:
    """The bucket of a table's row: by paper if it has one, else by key."""
    key = ["arxiv_id"] if "arxiv_id" in _columns(name) else TABLES[name][0]
    return F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in key)), F.lit(buckets)).cast("int")


def _columns(name: str) -> list[str]:
    return [c.split()[0] for c in TABLES[name][1].split(", ")]


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that were committed and are still there."""
    return [int(n[:-5]) for n in files.names(spark, f"{path}/_manifest") if n.endswith(".json") and n[:-5].isdigit()]


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """What a version (the newest, unless it is given) has where; None without any."""
    have = versions(spark, path)
    if not have or version is not None and version not in have:
        return None
    found = files.read_json(spark, f"{path}/_manifest/{max(have) if version is None else version:012d}.json")
    if found is None:
        raise GraphError("BAD_MANIFEST", path)
    return found


def _read(spark: SparkSession, path: str, name: str, where: dict[str, int], only: set[int] | None = None) -> DataFrame:
    paths = [f"{path}/{name}/g={g}/b={b}" for b, g in sorted(where.items()) if only is None or int(b) in only]
    rows = spark.read.schema(TABLES[name][1]).parquet(*paths) if paths else spark.createDataFrame([], TABLES[name][1])
    return rows.select(*_columns(name))


def read(spark: SparkSession, path: str, version: int | None = None) -> Graph | None:
    """The graph of a version (the newest, unless it is given); None without any."""
    found = manifest(spark, path, version)
    return found and Graph(**{name: _read(spark, path, name, found["tables"].get(name, {})) for name in TABLES})


def _put_table(spark: SparkSession, path: str, name: str, rows: DataFrame, where: dict[str, int], version: int, many: int, papers: DataFrame | None) -> dict[str, int]:
    """Writes the buckets of one table that ``rows`` are in; which version has which
    bucket then.  Old rows of ``papers`` go."""
    staged = written(rows.select(*_columns(name)).withColumn("b", bucket(name, many)), f"batch-{name}")
    changed = staged.select("b") if papers is None else staged.select("b").union(papers.select(bucket("papers", many).alias("b")))
    touched = {r.b for r in changed.distinct().collect()}  # ``many`` at most
    out = {b: g for b, g in where.items() if int(b) not in touched}
    if touched:
        have = _read(spark, path, name, where, touched)
        if papers is not None:
            have = have.join(papers, "arxiv_id", "left_anti").select(*have.columns)
        merged = upsert(have, staged.drop("b"), name, ("name",) if name == "entities" else ())
        target = f"{path}/{name}/g={version}"
        merged.withColumn("b", bucket(name, many)).repartition("b").sortWithinPartitions("b", *TABLES[name][0]).write.mode("overwrite").partitionBy("b").parquet(target)
        out |= {n[2:]: version for n in files.names(spark, target) if n.startswith("b=")}
    dropped(staged)
    return out


def _commit(spark: SparkSession, path: str, before: dict, new: Graph, papers: DataFrame | None, applied: dict) -> int:
    version, many = before["version"] + 1, before["buckets"]
    with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:  # a table's jobs are small in most batches
        jobs = {name: pool.submit(_put_table, spark, path, name, rows, before["tables"].get(name, {}), version, many, papers if name in EDGES else None) for name, rows in new.tables().items()}
        tables = before["tables"] | {name: job.result() for name, job in jobs.items()}
    made = {"version": version, "buckets": many, "tables": tables, "applied": {**before["applied"], **applied}}
    if not files.write_json(spark, f"{path}/_manifest/{version:012d}.json", made, replace=False):
        raise GraphError("CONFLICT", f"{path} has a version {version} already")
    return version


def put(spark: SparkSession, path: str, new: Graph, replace_edges: bool = False, applied: dict | None = None, buckets: int = BUCKETS) -> int:
    """Puts the rows of ``new`` into the tables and commits; the version.

    Rows replace those of their keys (an entity keeps its name); with ``replace_edges``
    the other edges of papers that ``new`` has are deleted.  ``applied`` (any names and
    values) is kept with the version.  ``buckets`` are those of a new graph.  Of two
    that commit the same version, the second is an error and changes nothing.
    """
    before = manifest(spark, path) or {"version": -1, "buckets": buckets, "tables": {}, "applied": {}}
    papers = written(new.papers.select("arxiv_id"), "batch-papers") if replace_edges and new.papers is not None else None
    try:
        return _commit(spark, path, before, new, papers, applied or {})
    finally:
        if papers is not None:
            dropped(papers)


def rebucket(spark: SparkSession, path: str, buckets: int) -> int:
    """Writes all tables anew in another number of buckets, as a graph has grown; the
    version."""
    before = manifest(spark, path)
    if before is None:
        raise GraphError("NO_GRAPH", path)
    return _commit(spark, path, {**before, "buckets": buckets, "tables": {}}, read(spark, path), None, {})


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Deletes the manifests but the last ``keep``, and the buckets that those don't
    name; how many buckets.  What is newer than the last manifest stays, as it may be
    about to be committed."""
    have = sorted(versions(spark, path))
    if not have:
        return 0
    kept = [manifest(spark, path, v) for v in have[-max(1, keep) :]]
    named = {(name, f"g={g}", f"b={b}") for m in kept for name, where in m["tables"].items() for b, g in where.items()}
    for v in have[: -max(1, keep)]:
        files.delete(spark, f"{path}/_manifest/{v:012d}.json")
    gone = 0
    for name in TABLES:
        for g in files.names(spark, f"{path}/{name}"):
            if not g.startswith("g=") or int(g[2:]) > have[-1]:
                continue
            own = [b for b in files.names(spark, f"{path}/{name}/{g}") if b.startswith("b=")]
            old = [b for b in own if (name, g, b) not in named]
            if len(old) == len(own):
                files.delete(spark, f"{path}/{name}/{g}")
            else:
                for b in old:
                    files.delete(spark, f"{path}/{name}/{g}/{b}")
            gone += len(old)
    return gone
