"""Sources of paper metadata: JSON lines in, the graph's node and edge tables out."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import RAW, TABLES, Graph, GraphError
from ..scratch import dropped, written
from . import files

#: Splits of files whose line counts are broadcast.
BROADCAST_SPLITS = 1_000_000
#: Tables of a paper's edges.
EDGES = {"authored", "in_category", "versions", "submitted", "published_in", "has_report"}


def _scanned(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, id, line) of all lines; ``id`` grows within a split of a file."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))


def _splits(lines: DataFrame, *counts: Column) -> DataFrame:
    """(file, block, first, before, ...): a row for each split of a file, with how many
    of its file's lines come before it."""
    found = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), *counts)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")


def _filled(line: str = "line") -> Column:
    """Whether a line isn't blank."""
    return F.trim(F.regexp_replace(line, r"\s", " ")) != ""


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, file, line_no, line) of each non-blank line: ``seq`` orders all lines of all
    files, ``line_no`` counts a file's lines from 1, blank ones too.

    Files are ordered by path and lines by their place.  A line's number is its place
    in its split of the file and the lines of the splits before: a small table that
    is counted without reading the lines again in any order.
    """
    splits = _splits(_scanned(spark, path))
    if splits.count() <= BROADCAST_SPLITS:
        splits = F.broadcast(splits)
    found = _scanned(spark, path).join(splits, ["file", "block"])
    number = F.col("before") + F.col("id") - F.col("first") + 1
    return found.filter(_filled()).select(F.struct("file", "block", "id").alias("seq"), "file", number.alias("line_no"), "line")


def _placed(raw: DataFrame) -> DataFrame:
    """(seq, file, line_no, place, line) of the non-blank lines of a stored scan of one
    file: ``place`` counts them from 0."""
    number = F.col("before") + F.col("id") - F.col("first") + 1
    lines = raw.join(F.broadcast(_splits(raw)), ["file", "block"]).filter(_filled())  # a row for each split of one file
    rows = lines.select(F.struct("file", "block", "id").alias("seq"), "file", number.alias("line_no"), "line")
    return numbered(rows, "line_no")  # the range tables are dropped by the caller


def _object(line: str = "line") -> Column:
    """Whether a line is a JSON object."""
    return F.get_json_object(line, "$").isNotNull() & F.col(line).rlike(r"^\s*\{")


def read_metadata(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(seq, record, file, line_no) of a JSON-lines file, by an explicit schema.

    Blank lines are skipped, but counted.  A line that isn't a JSON object is an error
    that names it, or left out without ``strict``.
    """
    return _parsed(numbered_lines(spark, path), strict)


def _parsed(rows: DataFrame, strict: bool = True) -> DataFrame:
    parsed = F.from_json("line", RAW, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = rows.withColumn("ok", _object())
    if strict:
        where = F.format_string("%s line %d: not a JSON object: %s", "file", "line_no", F.substring("line", 1, 80))
        rows = rows.withColumn("line", F.when(F.col("ok"), F.col("line")).otherwise(F.raise_error(where)))
    else:
        rows = rows.filter("ok")
    return rows.select("seq", parsed.alias("record"), "file", "line_no")


def peek(spark: SparkSession, path: str) -> DataFrame:
    """(line): the first line of a text file, as it is."""
    return spark.read.text(path).limit(1).withColumnRenamed("value", "line")


def write_lines(lines: DataFrame, path: str, column: str = "line") -> None:
    """Raw lines as text files."""
    lines.select(column).write.mode("overwrite").text(path)


def _control(folder: str, source: str) -> str:
    return f"{folder}/{hashlib.sha256(source.encode()).hexdigest()[:16]}.json"


def read_control(spark: SparkSession, folder: str, source: str) -> dict | None:
    """How far a source was loaded: path, size, last_line, last_id and ``prefix``, the
    hash of its lines so far.  None without a whole row of just that source."""
    source = files.qualified(spark, source)
    row = files.read_json(spark, _control(folder, source))
    kinds = {"path": str, "size": int, "last_line": int, "prefix": int}
    return row if row and all(isinstance(row.get(k), t) for k, t in kinds.items()) and row["path"] == source else None


def load_batches(spark: SparkSession, path: str, put: Callable[[DataFrame], None], control: str, batch: int = 1_000_000, resume: bool = True) -> int:
    """Gives ``put`` the records (seq, record, file, line_no) of one file, ``batch`` of
    them at a time in order; how many there were.

    After each batch the source's row in the folder ``control`` gets its last line and
    id, from behind which the next call goes on if the lines up to there are the same:
    a file that was replaced or edited is loaded whole, one that has grown from where it
    ended, and a row that isn't readable counts as none.  A batch that fails leaves the
    row as it is and is an error that names its lines.

    The file is read once; its numbered lines are written, and batches are ranges of them.
    """
    raw = written(_scanned(spark, path), "source-lines")
    placed = _placed(raw)
    lines = written(placed, "numbered-lines")
    dropped(raw, placed)
    row, source = read_control(spark, control, path) if resume else None, files.qualified(spark, path)
    prefix = lambda last: lines.filter(F.col("line_no") <= last).agg(F.coalesce(F.bit_xor(F.xxhash64("line_no", "line")), F.lit(0)).alias("x")).first().x
    same = row is not None and prefix(row["last_line"]) == row["prefix"]
    last, seen = (row["last_line"], row["prefix"]) if same else (0, 0)
    last, total, size = int(last), 0, files.size_of(spark, path)
    first_place = lines.filter(F.col("line_no") > last).agg(F.min("place")).first()[0]
    try:
        while first_place is not None:
            own = lines.filter((F.col("place") >= first_place) & (F.col("place") < first_place + batch))
            ends = own.agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.bit_xor(F.xxhash64("line_no", "line")).alias("x"), F.max_by("line", "line_no").alias("line")).first()
            if not ends["n"]:
                break
            try:
                put(_parsed(own))
            except Exception as e:
                raise GraphError("LOAD_FAILED", f"{path} lines {ends['first']} to {ends['last']}: {e}") from e
            first_place, total, seen = first_place + batch, total + ends["n"], seen ^ ends["x"]
            name = json.loads(ends["line"]).get("id")
            files.write_json(spark, _control(control, source), {"path": source, "size": size, "last_line": ends["last"], "last_id": name, "prefix": seen})
        return total
    finally:
        dropped(lines)


def read_mark(spark: SparkSession, path: str) -> dict | None:
    """What ``write_mark`` wrote, if it did."""
    return files.read_json(spark, path)


def write_mark(spark: SparkSession, path: str, value: dict) -> None:
    """A small JSON file, in place of the one that is there."""
    files.write_json(spark, path, value)


def with_category(records: DataFrame, code: str = "cs.AI") -> DataFrame:
    """Records that have ``code`` as an exact category."""
    return records.filter(F.array_contains(T.category_tokens(F.col("record.categories")), code))


def first_with_category(records: DataFrame, code: str = "cs.AI") -> DataFrame:
    """The first record if it has ``code``, else none."""
    return with_category(records.orderBy("seq").limit(1), code)


def sample_lines(lines: DataFrame, n: int, seed: int, key: str = "line") -> DataFrame:
    """``n`` rows (all, if fewer), the same ones for equal content, n and seed."""
    return lines.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def valid_lines(lines: DataFrame) -> DataFrame:
    """Rows whose line is a JSON object."""
    return lines.filter(_object())


def filter_snapshot(records: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(arxiv_id, title, abstract) of wanted records, the first of each id, by id;
    and the wanted ids (arxiv_id) that there are none of."""
    wanted = ids.select(F.trim("arxiv_id").alias("arxiv_id")).filter("arxiv_id <> ''").distinct()
    text = lambda c: F.coalesce(T.clean_text(F.col(f"record.{c}")), F.lit(""))
    rows = records.select("seq", F.trim(F.col("record.id")).alias("arxiv_id"), text("title").alias("title"), text("abstract").alias("abstract"))
    found = rows.join(wanted, "arxiv_id", "left_semi").groupBy("arxiv_id").agg(F.min_by(F.struct("title", "abstract"), "seq").alias("r"))
    return found.select("arxiv_id", "r.*").orderBy("arxiv_id"), wanted.join(rows.select("arxiv_id"), "arxiv_id", "left_anti").orderBy("arxiv_id")


def transform(records: DataFrame) -> DataFrame:
    """One row for each record with its parts as structs and arrays."""
    r = lambda c: T.clean_text(F.col(f"record.`{c}`"))
    versions = F.transform(
        F.coalesce("record.versions", F.array().cast("array<struct<version: string, created: string>>")),
        lambda v, i: F.struct(
            F.coalesce(T.clean_text(v["version"]), F.concat(F.lit("v"), (i + 1).cast("string"))).alias("label"),
            T.version_number(F.coalesce(T.clean_text(v["version"]), F.lit("")), i + 1).alias("version_number"),
            T.created_at(v["created"]).alias("created_at"),
        ),
    )
    authors = F.transform(
        F.coalesce("record.authors_parsed", F.array().cast("array<array<string>>")),
        lambda a, i: F.when(
            F.size(a) > 0,
            F.struct(
                (i + 1).alias("position"),
                F.coalesce(T.clean_text(F.get(a, F.lit(0))), F.lit("")).alias("family_name"),
                F.coalesce(T.clean_text(F.get(a, F.lit(1))), F.lit("")).alias("given_names"),
                T.clean_text(F.get(a, F.lit(2))).alias("suffix"),
                T.display_name(F.get(a, F.lit(1)), F.get(a, F.lit(0)), F.get(a, F.lit(2))).alias("display_name"),
            ),
        ),
    )
    return records.select(
        "seq",
        F.trim(F.col("record.id")).alias("arxiv_id"),
        *(r(c).alias(c) for c in ("title", "abstract", "comments", "doi", "license", "submitter")),
        r("journal-ref").alias("journal_reference_raw"),
        r("report-no").alias("report_number"),
        F.to_date(r("update_date")).alias("update_date"),
        F.lit("arXiv").alias("source"),
        F.filter(authors, lambda a: a.isNotNull()).alias("authors"),
        F.transform(T.category_tokens(F.col("record.categories")), lambda c, i: F.struct(c.alias("code"), (i + 1).alias("position"), (i == 0).alias("primary"))).alias("categories"),
        versions.alias("versions"),
    )


def _last(df: DataFrame, key: list[str]) -> DataFrame:
    """The last row by ``seq`` of each key."""
    rest = [c for c in df.columns if c not in (*key, "seq")]
    if not rest:
        return df.select(*key).distinct()
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), "seq").alias("r")).select(*key, *(F.col(f"r.{c}").alias(c) for c in rest))


def graph_of(rows: DataFrame) -> Graph:
    """The tables of transformed records: the last record wins for each node and
    edge, by line and then by place in the line."""
    first, count = lambda c: F.get(c, F.lit(0)), F.size("versions")
    each = lambda column, *more: rows.select(F.struct("seq", F.lit(0).alias("i")).alias("s"), "arxiv_id", *more, F.posexplode(column).alias("i", "x")).select(F.struct(F.col("s.seq").alias("a"), F.col("i").alias("b")).alias("seq"), "arxiv_id", *more, "x.*")
    papers = rows.select("seq", "arxiv_id", "title", "abstract", "comments", "doi", "license", "update_date", first("versions")["created_at"].alias("first_submitted_at"), F.when(count > 0, F.element_at("versions", -1)["label"]).alias("latest_version"), count.alias("version_count"), "source")
    authors = each("authors").withColumn("normalized_name", T.normalize_names("display_name"))
    authors = authors.withColumn("author_id", T.stable_id("author", "normalized_name"))
    categories = each("categories")
    versions = each("versions").withColumn("version_id", F.concat("arxiv_id", F.lit("-v"), F.col("version_number").cast("string")))
    named = lambda column, prefix, key: rows.filter(F.col(column).isNotNull()).withColumn("name", F.col(column)).withColumn("normalized_name", T.normalize_names(column)).withColumn(key, T.stable_id(prefix, "normalized_name"))
    submitters, journals = named("submitter", "submitter", "submitter_id"), named("journal_reference_raw", "journal", "journal_id")
    reports = rows.filter(F.col("report_number").isNotNull())
    made = {
        "papers": papers,
        "authors": authors,
        "submitters": submitters,
        "versions": versions,
        "categories": categories,
        "journals": journals,
        "reports": reports,
        "authored": authors,
        "in_category": categories,
        "submitted": submitters.withColumn("submitted_at", first("versions")["created_at"]),
        "published_in": journals,
        "has_report": reports,
    }
    out = {}
    for name, df in made.items():
        key, ddl = TABLES[name]
        columns = [c.split()[0] for c in ddl.split(", ")]
        out[name] = _last(df.select("seq", *columns), key).select(*columns)
    return Graph(**out)


def upsert(old: DataFrame, new: DataFrame, name: str, keep_first: tuple[str, ...] = ()) -> DataFrame:
    """``old`` with ``new`` rows put in by key: a new row replaces an old one, but for
    the columns of ``keep_first``, whose first value ever stays.  Nothing is deleted."""
    key = TABLES[name][0]
    rest = [c for c in old.columns if c not in key]
    both = old.withColumn("__new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("__new", F.lit(1)))
    if not rest:
        return both.select(*key).distinct()
    pick = [(F.min_by if c in keep_first else F.max_by)(F.struct(c), "__new")[c].alias(c) for c in rest]
    return both.groupBy(*key).agg(*pick).select(*old.columns)


def merge_graph(old: Graph, new: Graph, replace_edges: bool = False) -> Graph:
    """``old`` with ``new`` put in; with ``replace_edges`` the old edges of papers
    that ``new`` has are deleted first (an extension: by default they stay)."""
    out = {}
    for name, have in old.tables().items():
        more = getattr(new, name)
        if more is None:
            out[name] = have
            continue
        if replace_edges and name in EDGES:
            have = have.join(new.papers.select("arxiv_id"), "arxiv_id", "left_anti").select(*have.columns)
        out[name] = upsert(have, more, name, ("name",) if name == "entities" else ())
    return Graph(**out)


def eligible(papers: DataFrame) -> DataFrame:
    """Papers with a title and an abstract that isn't blank."""
    return papers.filter(F.col("title").isNotNull() & F.col("abstract").isNotNull() & (F.trim("abstract") != ""))


def export_papers(papers: DataFrame, limit: int | None = None) -> DataFrame:
    """(arxiv_id, title, abstract) of eligible papers by id."""
    found = eligible(papers).select("arxiv_id", "title", "abstract").orderBy("arxiv_id")
    return found if limit is None else found.limit(limit)


def export_ids(papers: DataFrame, limit: int | None = None) -> DataFrame:
    """(arxiv_id) of all papers by id."""
    found = papers.select("arxiv_id").orderBy("arxiv_id")
    return found if limit is None else found.limit(limit)


def missing_embedding(papers: DataFrame, embeddings: DataFrame, name: str = "embedding", after: str | None = None, limit: int | None = None) -> DataFrame:
    """Eligible papers without the embedding ``name``, by id, from behind ``after``."""
    found = eligible(papers).join(embeddings.filter(F.col("property") == name).select("arxiv_id"), "arxiv_id", "left_anti")
    if after is not None:
        found = found.filter(F.col("arxiv_id") > after)
    found = found.orderBy("arxiv_id")
    return found if limit is None else found.limit(limit)


def numbered(rows: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """``rows`` with ``name``: their places from 0 in the given order.

    The sorted ranges are written with each row's place in its range, which with the
    sizes of the ranges before gives its place among all: no window over all rows is
    needed, and both steps see the same ranges.
    """
    place = F.monotonically_increasing_id()  # the range above bit 33, the place in it below
    ranged = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", place), "ranges")
    part = F.shiftright("__place", 33)
    counts = ranged.groupBy(part.alias("__part")).count()  # a row for each range
    before = counts.select("__part", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    out = ranged.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + own).drop("__part", "__before", "__place")
    out.written_to = ranged.written_to  # for ``dropped``, when the places aren't read any more
    return out


def shard_numbers(papers: DataFrame, size: int = 1000) -> DataFrame:
    """``papers`` with ``shard``: exactly ``size`` rows each, in order of id."""
    placed = numbered(papers, "arxiv_id", name="shard")
    out = placed.withColumn("shard", F.floor(F.col("shard") / size).cast("int"))
    out.written_to = placed.written_to
    return out


def write_shards(papers: DataFrame, path: str, size: int = 1000) -> None:
    """JSON lines in a folder for each shard."""
    found = shard_numbers(papers, size)
    found.write.mode("overwrite").partitionBy("shard").json(path)
    dropped(found)


def update_embeddings(old: DataFrame, new: DataFrame, papers: DataFrame) -> DataFrame:
    """``old`` with the vectors of papers that there are; others are dropped."""
    return upsert(old, new.join(papers.select("arxiv_id"), "arxiv_id", "left_semi"), "embeddings")


def seek(column: str, last: str | None) -> Column:
    """Keys behind ``last``; all without one."""
    return F.lit(True) if last is None else F.col(column) > last
