"""Mixing sources to target weights.

Every document gets a key by a hash of its id and the seed.  Rows are range-sorted by
source and key, running sums of sizes give how much of its source comes before each
document, and the cut is at each source's exact budget: as many whole epochs as fit,
then documents in order of their keys until the rest is spent.  The document at the cut
gives its first words alone.  A source with a third of all rows spans many ranges.

Targets: sources share ``share`` of all sizes by weight, but none gets more than
``epochs`` times its size; what is over is shared anew by weight among the others.

Nulls, empty and odd rows: a null text has size 0 and takes nothing; a null source is
one of its own, the last; a null id has a key as well; a very long text is counted
whole; repeated rows count each, and rows of one key come by size and then id, so equal
rows may change places, which changes no result; a source of size 0 has target 0; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, table, written
from .running import running

#: By which sources weigh, in order, again and again.
WEIGHTS = (5.0, 2.0, 1.0)
#: Times that a document may be taken.
EPOCHS = 3
#: Sources whose targets are broadcast.
BROADCAST_SOURCES = 100_000

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weighted(sources: DataFrame, weights: tuple[float, ...] | dict[str | None, float] = WEIGHTS) -> DataFrame:
    """``sources`` (source, source_size) with weights: a mapping's (others weigh 0), or
    those given again and again, in order of code points, null last."""
    if isinstance(weights, dict):
        given = sources.sparkSession.createDataFrame(list(weights.items()), "__s string, weight double")
        return sources.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("__s")), "left").select("source", "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    numbered = running(sources.withColumn("__one", F.lit(1).cast("long")).withColumn("__all", F.lit(0)), ["__all"], [F.col("source").asc_nulls_last()], ["__one"], tag="source-ranks")
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    return numbered.select("source", "source_size", F.element_at(cycle, (F.pmod("__one_before", F.lit(len(weights))) + 1).cast("int")).alias("weight"))


def targets(sources: DataFrame, share: float = 1.0, epochs: int = EPOCHS) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``.  The level, i.e. the
    target of weight 1, rises from round to round as sources reach their limit; it is
    all that the driver keeps."""
    full = lambda level: F.col("weight") * F.lit(level) > F.col("source_size") * epochs
    total, free = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    total, taken, level = total or 0, 0, 0.0
    while free:
        level = (total * share - epochs * taken) / free
        over, rest = sources.agg(F.sum(F.when(full(level), F.col("source_size"))), F.sum(F.when(~full(level), F.col("weight")))).first()
        if (over or 0, rest or 0) == (taken, free):
            break
        taken, free = over or 0, rest or 0
    target = F.when(F.lit(not free) & (F.col("weight") > 0) | full(level), (F.col("source_size") * epochs).cast("double")).otherwise(F.col("weight") * F.lit(level))
    return sources.withColumn("target", target)


def mix(docs: DataFrame, weights: tuple[float, ...] | dict[str | None, float] = WEIGHTS, share: float = 1.0, epochs: int = EPOCHS, seed: str = "", size: Column | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, before, taken) of ``docs`` (doc_id,
    text, source): ``taken`` words of each document, repeats counted; ``before`` is the
    size of what comes before it in its source."""
    own = words(F.col("text")) if size is None else size
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = written(docs.select("doc_id", F.col("source").cast("string").alias("source"), own.alias("size"), F.conv(F.substring(key, 1, 15), 16, 10).cast("long").alias("__key"), F.xxhash64(F.monotonically_increasing_id()).alias("__salt")), "mix-sizes")
    found = written(weighted(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights), "mix-sources")
    aims = targets(found, share, epochs).select(F.col("source").alias("__source"), "source_size", "target")
    ordered = running(sized, ["source"], [F.col(c).asc_nulls_first() for c in ("__key", "size", "doc_id", "__salt")], ["size"], tag="mix-order")
    if found.count() <= BROADCAST_SOURCES:
        aims = F.broadcast(aims)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.floor(budget / F.col("source_size")).cast("long")
    rest = budget % F.col("source_size") - F.col("size_before")
    taken = F.when(F.col("source_size") > 0, whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))).otherwise(0)
    out = ordered.join(aims, F.col("source").eqNullSafe(F.col("__source")))
    out = written(out.select("doc_id", "source", "size", "source_size", "target", F.col("size_before").alias("before"), taken.cast("long").alias("taken")), "mix")
    dropped(sized, found, ordered)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT source, n, r, CAST(CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w FROM s),
o AS (SELECT *, sum(w) OVER (ORDER BY n / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free, CAST((SELECT sum(n) FROM w) - 3 * coalesce(sum(n) OVER (ORDER BY n / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS left_over FROM w),
v AS (SELECT coalesce((SELECT left_over / free FROM o WHERE w * (left_over / free) <= 3 * n ORDER BY n / w, r LIMIT 1), 0) AS level),
t AS (SELECT source, n, CASE WHEN w * level > 3 * n THEN CAST(3 * n AS DOUBLE) ELSE w * level END AS target FROM w CROSS JOIN v),
b AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM t),
p AS (SELECT d.*, CAST(sum(size) OVER (PARTITION BY source ORDER BY k, size, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before FROM d)
SELECT doc_id, size, n AS source_size, target, CASE WHEN n = 0 THEN 0 ELSE CAST((budget // n) * size + greatest(0, least(size, budget % n - before)) AS BIGINT) END AS taken
FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source"""
