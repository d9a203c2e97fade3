"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Each text is searched for three kinds of candidates.  A candidate's value, hashed,
is then counted over the whole corpus: in how many repositories and by how many
distinct owners it stands.  What many owners share, or two owners in many
repositories, is a copied example (``shared``); what belongs to few is a live-looking
credential (``owned``), however often its one owner repeats it.  These verdicts are
spans of their own, over the value; the candidates' spans stay as they are.

Spark has no function for the places of matches, so they are summed up from the
lengths of the matches and of the stretches between them, by doubling steps: n matches
take n log n operations.

Counting goes by (value, owner, repository) first.  Verdicts of values that stand in
more than one in ``HOT_VALUES`` of all findings are broadcast, so there are no more of
them than that, and a value that a third of all rows hold doesn't meet in one task.
The findings are written once, with a row number, and the texts are read once.

Nulls, empty and odd rows: a null text counts as empty and has no spans; a very long
text is searched whole; a null owner is one owner and a null repository one repository
of its owner; repeated rows give repeated results and count as one repository if they
share its id; spans that start together are in the order of ``KINDS``; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

# The kinds, their patterns, the group that holds the value and the
# least length of that group.
KINDS = ["assign", "access", "hex", "owned", "shared"]
PATTERNS = [
    (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    (r"(AKIA[A-Z0-9]{16,})", 1, 20),
    (r"([0-9a-f]{24,})", 1, 24),
]
#: Every match of the first pattern has one of these, in some case.
KEYWORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
#: Owners from which on a value counts as shared, and repositories from which on one
#: of two owners does.
SHARED_OWNERS, SHARED_REPOSITORIES = 3, 10
#: Most values whose verdicts are broadcast.
HOT_VALUES = 1 << 16
#: Documents with owned values, and spans of these, that are broadcast (about 20 bytes
#: a span).
BROADCAST_ROWS, BROADCAST_SPANS = 200_000, 1 << 20
#: Characters of a piece of a text that is rewritten.
PIECE = 4096

_FOUND = "array<struct<start:int,kind:int,end:int,from:int,value:binary>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def _scan(numbers: Column, join: Callable[[Column, Column], Column]) -> Column:
    """An array's running totals by ``join``, in doubling steps."""
    steps = F.filter(F.array(*(F.lit(1 << k) for k in range(31))), lambda p: p < F.size(numbers))
    return F.aggregate(steps, numbers, lambda done, p: F.transform(done, lambda x, i: F.when(i >= p, join(x, F.get(done, i - p))).otherwise(x)))


def _matches(text: Column, kind: int) -> Column:
    """(start, kind, end, from, value) of all a pattern's matches in ``text``; ``from``
    is where the value begins, which always ends with the match; the value, hashed, is
    null where it is too short."""
    pattern, group, least = PATTERNS[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    hashed = lambda v: F.when(F.length(v) >= least, F.unhex(F.sha2(v.cast("binary"), 256)))
    sizes = F.transform(F.arrays_zip(between.alias("b"), whole.alias("w"), value.alias("v")), lambda x: F.struct((F.length(x["b"]) + F.coalesce(F.length(x["w"]), F.lit(0))).alias("both"), F.length(x["w"]).alias("size"), F.length(x["v"]).alias("own"), hashed(x["v"]).alias("value")))

    def placed(s: Column, ends: Column) -> Column:
        span = lambda x, i: F.struct((F.get(ends, i) - x["size"]).alias("start"), F.lit(kind).alias("kind"), F.get(ends, i).alias("end"), (F.get(ends, i) - x["own"]).alias("from"), x["value"].alias("value"))
        return F.filter(F.transform(s, span), lambda x: x["start"].isNotNull())  # the stretch behind the last match has none

    return _let(sizes, lambda s: _let(_scan(F.transform(s, lambda x: x["both"]), lambda x, y: x + y), lambda ends: placed(s, ends)))


def findings(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """(row, doc_id, owner, repository, found, text_hash) of every row of ``docs``;
    found has the kinds one after the other, text_hash is null where it is empty."""
    none = F.array().cast(_FOUND)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lower = docs.withColumn("lower", F.lower("text"))
    keyword = F.lit(False)
    for word in KEYWORDS:
        keyword = keyword | F.contains("lower", F.lit(word))
    marked = lower.select("doc_id", "owner", "repository", "text", keyword.alias("k0"), F.contains("text", F.lit("AKIA")).alias("k1"), F.col("text").rlike("[0-9a-f]{24}").alias("k2"))
    found = F.concat(*(F.when(F.col(f"k{i}"), _matches(F.col("text"), i)).otherwise(none) for i in range(len(PATTERNS))))
    some = F.col("k0") | F.col("k1") | F.col("k2")
    return marked.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repository", F.when(some, found).otherwise(none).cast(_FOUND).alias("found"), F.when(some, F.sha2(F.col("text").cast("binary"), 256)).alias("text_hash"))


def ownership(found: DataFrame) -> DataFrame:
    """(value, findings, n_repositories, n_owners) of each candidate value of
    ``findings``; a repository is one owner's."""
    each = found.select("owner", "repository", F.explode("found").alias("f")).select(F.col("f.value").alias("value"), "owner", "repository").filter("value IS NOT NULL")
    by_owner = each.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("rows")).groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows"))
    return by_owner.groupBy("value").agg(F.sum("rows").alias("findings"), F.sum("n").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", shared_owners: int = SHARED_OWNERS, shared_repositories: int = SHARED_REPOSITORIES) -> DataFrame:
    """(row, doc_id, base, all, text_hash): arrays of (start, kind, end), without and
    with the verdicts, for every row of ``docs``."""
    found = written(findings(docs, owner, repository), "secrets")
    copied = (F.col("n_owners") >= shared_owners) | (F.col("n_owners") > 1) & (F.col("n_repositories") >= shared_repositories)
    verdicts = written(ownership(found).select("value", "findings", F.when(copied, F.lit(4)).otherwise(F.lit(3)).alias("verdict")), "secret-verdicts")
    bound = max(1000, (verdicts.agg(F.sum("findings")).first()[0] or 0) // HOT_VALUES)
    hot, rest = F.broadcast(verdicts.filter(F.col("findings") > bound).drop("findings")), verdicts.filter(F.col("findings") <= bound).drop("findings")
    some = found.filter(F.size("found") > 0)
    each = some.select("row", F.posexplode("found").alias("at", "f")).select("row", "at", F.col("f.value").alias("value"))
    # one that is too short has no verdict, but its place
    judged = each.join(hot, "value").union(each.join(hot, "value", "left_anti").join(rest, "value", "left"))
    judged = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "verdict"))).alias("told"))
    base = F.array_sort(F.transform(F.filter("found", lambda x: x["value"].isNotNull()), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    more = F.filter(F.transform("found", lambda x, i: F.struct(x["from"].alias("start"), F.get(F.col("told"), i)["verdict"].alias("kind"), x["end"].alias("end"))), lambda x: x["kind"].isNotNull())
    once = _let(F.array_sort(more), lambda s: F.filter(s, lambda x, i: (i == 0) | (x != F.get(s, i - 1))))
    spans = some.join(judged, "row").select("row", "doc_id", base.alias("base"), once.alias("more"), "text_hash").select("row", "doc_id", "base", F.array_sort(F.concat("base", "more")).alias("all"), "text_hash")
    return found.filter(F.size("found") == 0).select("row", "doc_id", base.alias("base"), base.alias("all"), "text_hash").union(spans)


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _between(pieces: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` to ``end``, of a text's pieces of ``PIECE`` characters."""
    i, j = F.floor(start / F.lit(PIECE)).cast("int"), F.floor(end / F.lit(PIECE)).cast("int")
    of = lambda k: F.coalesce(F.get(pieces, k), F.lit(""))
    several = F.concat(F.substring(of(i), start - i * PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(of(j), F.lit(1), end - j * PIECE))
    return F.when(i == j, F.substring(of(i), start - i * PIECE + 1, end - start)).otherwise(several)


def redact(docs: DataFrame, owner: str = "source", mark: str = "[secret]", shared_owners: int = SHARED_OWNERS, shared_repositories: int = SHARED_REPOSITORIES) -> DataFrame:
    """``docs`` with ``mark`` in the place of each owned value; all rows and columns
    stay.  Rows are known again by doc_id and the hash of their text."""
    owned = F.transform(F.filter("all", lambda x: x["kind"] == 3), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    spans = scan(docs, owner, shared_owners=shared_owners, shared_repositories=shared_repositories).select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), owned.alias("__owned")).filter(F.size("__owned") > 0).dropDuplicates(["__doc", "__hash"])
    spans = written(spans, "secret-spans")
    sizes = spans.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("__owned")).alias("spans")).first()
    if sizes.rows <= BROADCAST_ROWS and (sizes.spans or 0) <= BROADCAST_SPANS:
        spans = F.broadcast(spans)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.sha2(F.col("text").cast("binary"), 256) == F.col("__hash"))
    text = F.col("text").cast("string")

    def rewritten(own: Column, upto: Column, pieces: Column) -> Column:
        """``upto``: the furthest end of the spans up to each one."""
        before = lambda i: F.when(i > 0, F.get(upto, i - 1)).otherwise(F.lit(0))
        parts = F.transform(own, lambda x, i: F.when(x["start"] >= before(i), F.concat(_between(pieces, before(i), x["start"]), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(parts, ""), _between(pieces, F.get(upto, F.size(own) - 1), F.length(text)))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    ends = _scan(F.transform("__owned", lambda x: x["end"]), F.greatest)
    clean = _let(pieces, lambda p: _let(ends, lambda e: rewritten(F.col("__owned"), e, p)))
    return docs.join(spans, same, "left").select(*(F.when(F.col("__owned").isNotNull(), clean).otherwise(text).alias("text") if c == "text" else docs[c] for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all ``documents``."""
    found = scan(table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), span_text(F.col("all")).alias("spans"))


def _oracle() -> str:
    kinds = [
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", "(AKIA[A-Z0-9]+)", 1, 20),
        ("hex", "([0-9a-f]+)", 1, 24),
    ]
    parts = " UNION ALL ".join(
        f"""SELECT row, doc_id, source, {i} AS kind, unnest(list_transform(range(1, len(w) + 1), lambda k: {{'start': list_sum(list_transform(b[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:k-1], lambda x: length(x))), 0), 'size': length(w[k]), 'value': v[k]}})) AS f
        FROM (SELECT row, doc_id, source, regexp_extract_all(text, '{p}', 0) AS w, regexp_extract_all(text, '{p}', {g}) AS v, string_split_regex(text, '{p}') AS b FROM d{i}) WHERE len(w) > 0"""
        for i, (_, p, g, _) in enumerate(kinds)
    )
    least = " ".join(f"WHEN {i} THEN {n}" for i, (_, _, _, n) in enumerate(kinds))
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents),
d0 AS (SELECT * FROM d WHERE regexp_matches(text, '(?i:password|passwd|secret|token|api)')),
d1 AS (SELECT * FROM d WHERE contains(text, 'AKIA')),
d2 AS (SELECT * FROM d WHERE regexp_matches(text, '[0-9a-f]{{24}}')),
m AS ({parts}),
f AS (SELECT row, doc_id, source, kind, CAST(f.start AS BIGINT) AS s, CAST(f.start AS BIGINT) + f.size AS e, f.value AS v FROM m WHERE length(f.value) >= CASE kind {least} END),
r AS (SELECT DISTINCT v, source, doc_id FROM f),
o AS (SELECT v, count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) AS n, count(*) AS r FROM r GROUP BY v),
j AS (SELECT DISTINCT row, CASE WHEN o.n >= {SHARED_OWNERS} OR o.n > 1 AND o.r >= {SHARED_REPOSITORIES} THEN 4 ELSE 3 END AS kind, e - length(f.v) AS s, e FROM f JOIN o ON f.v = o.v),
n AS (SELECT row, kind, s, e, {'{'}'k': ['assign', 'access', 'hex', 'owned', 'shared'][kind + 1]{'}'} AS x FROM (SELECT row, kind, s, e FROM f UNION ALL SELECT row, kind, s, e FROM j)),
t AS (SELECT row, count(*) FILTER (WHERE kind = 0) AS a, count(*) FILTER (WHERE kind = 1) AS c, count(*) FILTER (WHERE kind = 2) AS h,
  string_agg(x.k || ':' || s || ':' || e, ',' ORDER BY s, kind, e) FILTER (WHERE kind < 3) AS b, string_agg(x.k || ':' || s || ':' || e, ',' ORDER BY s, kind, e) AS p FROM n GROUP BY row)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(p, '') AS spans
FROM d LEFT JOIN t ON d.row = t.row
"""


ORACLE = _oracle()
