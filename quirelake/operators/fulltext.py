"""Full-text search with BM25 over an inverted index that is a table.

Tokens are runs of letters and digits in lower case.  A leaf's score is summed over the
fields; idf = ln(1 + (N - df + 0.5) / (df + 0.5)), k1 = 1.2, b = 0.75.  Queries know
``term``, ``"a phrase"``, ``prefix*``, ``te?t`` and ``*ing``, ``term~`` and ``term~1``
(edits, 2 at most), ``[a TO c]`` and ``{a TO c}`` (terms between), ``field:``, ``+``,
``-``, AND, OR, NOT, groups in parentheses, ``^2`` behind any of them and ``\\`` before a
character; what is malformed is an error.  What may match several terms scores 1 for
each field, as there is no one term's frequency.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import GraphError
from ..scratch import dropped, written
from ..sources import files

K1, B = 1.2, 0.75
#: Tokens that one step of a Python worker groups at a time.
STEP_TOKENS = 2_000_000
#: Postings of a pack.
PACK = 64
_TOKEN = r"([\p{L}\p{N}]+)"


def tokens(text: Column | str) -> Column:
    """The tokens of a text, none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(1)), F.array().cast("array<string>"))


def _words(text: str) -> list[str]:
    out, own = [], ""
    for c in text.lower() + " ":
        if c.isalnum():
            own += c
        elif own:
            out.append(own)
            own = ""
    return out


@dataclass(frozen=True)
class Leaf:
    """What texts are searched for: words one behind the other, or one pattern."""

    words: tuple[str, ...]
    kind: str = "words"  # or prefix, wildcard, fuzzy, range
    field: str | None = None
    edits: int = 0
    ends: tuple[bool, bool] = (True, True)  # whether a range has its ends
    boost: float = 1.0

    def test(self, term: Column) -> Column:
        """Whether a pattern matches a term."""
        word = self.words[0]
        if self.kind == "prefix":
            return term.startswith(word)
        if self.kind == "wildcard":
            return term.rlike("^" + "".join({"*": ".*", "?": "."}.get(c, c) for c in word) + "$")
        if self.kind == "fuzzy":
            near = F.levenshtein(term, F.lit(word), self.edits) >= 0
            return F.length(term).between(len(word) - self.edits, len(word) + self.edits) & near
        low, high = self.words
        above = F.lit(True) if low == "*" else term >= low if self.ends[0] else term > low
        return above & (F.lit(True) if high == "*" else term <= high if self.ends[1] else term < high)


@dataclass(frozen=True)
class Group:
    """Parts that must (+), must not (-) or should (a space) match."""

    parts: tuple[tuple[str, Leaf | Group], ...]
    boost: float = 1.0


_PIECES = re.compile(r"""(?P<space>\s+)|(?P<quote>"[^"]*")|(?P<range>[\[{][^\]}]*[\]}])|(?P<mark>[()])|(?P<sign>[+-](?=\S))|(?P<field>\w+):(?=[^\s:])|(?P<boost>\^\d+(\.\d+)?)|(?P<fuzzy>~\d*)|(?P<word>(?:\\.|[^\s()\[\]{}"^~:\\])+)""", re.S)


def _pieces(query: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(query):
        m = _PIECES.match(query, at)
        # a sign, or what could be one, inside of a word belongs to it
        if m is None:
            raise ValueError(f"unsupported syntax at {query[at:at + 10]!r}")
        out.append((m.lastgroup if m.lastgroup != "boost" else "boost", m["field"] if m["field"] else m[0]))
        at = m.end()
    return out


def parse(query: str) -> Group | None:
    """The tree of a query, None if nothing could match it; a malformed one is a
    ValueError."""
    if not query.strip():
        raise ValueError("query is empty")
    pieces = _pieces(query.strip())
    at = 0

    def peek() -> tuple[str, str]:
        return pieces[at] if at < len(pieces) else ("end", "")

    def take() -> tuple[str, str]:
        nonlocal at
        at += 1
        return pieces[at - 1]

    def boost() -> float:
        return float(take()[1][1:]) if peek()[0] == "boost" else 1.0

    def group(field: str | None, inner: bool) -> Group | None:
        parts: list[tuple[str, Leaf | Group]] = []
        joined = negated = must = False
        operand = False  # whether something stands before
        while True:
            kind, text = peek()
            if kind == "space":
                take()
                continue
            if kind == "end" or text == ")":
                if (kind == "end") == inner or joined or negated:
                    raise ValueError("a group or an operator isn't complete")
                if inner:
                    take()
                return Group(tuple(parts), boost() if inner else 1.0) if any(o != "-" for o, _ in parts) else None
            if kind == "word" and text in ("AND", "OR", "NOT"):
                take()
                if negated or text != "NOT" and (not operand or joined):
                    raise ValueError(f"{text} has no operand")
                if text == "AND" and parts and parts[-1][0] == " ":
                    parts[-1] = ("+", parts[-1][1])
                joined, negated = joined or text != "NOT", text == "NOT"
                must = text == "AND" or text == "NOT" and must
                continue
            sign = take()[1] if kind == "sign" else " "
            found = part(field)
            occur = "-" if negated else "+" if joined and must and sign == " " else sign
            joined = negated = must = False
            operand = True
            if found is not None:
                parts.append((occur, found))

    def part(field: str | None) -> Leaf | Group | None:
        kind, text = take() if at < len(pieces) else ("end", "")
        if kind == "field":
            return part(text)
        if text == "(":
            return group(field, True)
        if kind == "quote":
            found = tuple(_words(text))
            if peek()[0] == "fuzzy":
                raise ValueError("a phrase can't be fuzzy")
            return Leaf(found, field=field, boost=boost()) if found else None
        if kind == "range":
            ends = text[1:-1].split()
            if len(ends) != 3 or ends[1] != "TO":
                raise ValueError("a range is [a TO b]")
            return Leaf((ends[0].lower(), ends[2].lower()), "range", field, ends=(text[0] == "[", text[-1] == "]"), boost=boost())
        if kind != "word":
            raise ValueError(f"unsupported syntax at {text!r}")
        plain = re.sub(r"\\(.)", lambda m: m[1] if m[1] not in "*?" else " ", text)
        if re.search(r"(?<!\\)[*?]", text):
            bare = re.sub(r"\\.", "", text).lower()
            if not all(c.isalnum() or c in "*?" for c in bare):
                raise ValueError("a pattern is one word")
            if re.fullmatch(r"[^*?]+\*", bare):
                return Leaf((bare[:-1],), "prefix", field, boost=boost())
            return Leaf((bare,), "wildcard", field, boost=boost())
        found = tuple(_words(plain))
        if peek()[0] == "fuzzy":
            edits = int(take()[1][1:] or 2)
            if len(found) != 1 or edits > 2:
                raise ValueError("a fuzzy term is one word with 2 edits at most")
            return Leaf(found, "fuzzy", field, edits, boost=boost()) if edits else Leaf(found, field=field, boost=boost())
        weight = boost()
        return Leaf(found, field=field, boost=weight) if found else None

    return group(None, False)


def leaves(tree: Leaf | Group) -> list[Leaf]:
    """The leaves of a tree, from left to right, each one once."""
    if isinstance(tree, Leaf):
        return [tree]
    return list(dict.fromkeys(x for _, p in tree.parts for x in leaves(p)))


def plain_words(text: str) -> list[str]:
    """The tokens of a text, as a query's are found."""
    return _words(text)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, field, t) as packs of postings: a document's places are grouped where
    it is, and then a term's documents of a step, ``PACK`` at most."""
    for batch in batches:
        counts = pc.list_value_length(batch.column(2)).to_numpy().astype(np.int64)
        upto = np.cumsum(counts)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + STEP_TOKENS, side="right")))
            own, n = batch.slice(start, stop - start), counts[start:stop]
            told, fields = own.column(2).flatten().dictionary_encode(), own.column(1).dictionary_encode()
            row = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            word = told.indices.to_numpy().astype(np.int64) * len(fields.dictionary) + fields.indices.to_numpy()[row]
            order = np.lexsort((row, word))  # places stay in order
            row, word, place = row[order], word[order], place[order]
            first = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(word, prepend=-1))  # of each posting
            if len(first):
                turn = np.flatnonzero(np.diff(word[first], prepend=-1))  # of each term's
                nth = np.arange(len(first)) - np.repeat(turn, np.diff(np.append(turn, len(first))))
                pack = np.flatnonzero(nth % PACK == 0)
                at, upto_pack = word[first[pack]], np.append(pack, len(first))
                tf = np.diff(np.append(first, len(order)))
                lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                columns = {
                    "term": told.dictionary.take(pa.array(at // len(fields.dictionary))),
                    "field": fields.dictionary.take(pa.array(at % len(fields.dictionary))),
                    "keys": lists(upto_pack, own.column(0).take(pa.array(row[first]))),
                    "lengths": lists(upto_pack, pa.array(n[row[first]], pa.int32())),
                    "tfs": lists(upto_pack, pa.array(tf, pa.int32())),
                    "ends": lists(upto_pack, pa.array(np.cumsum(tf) - np.repeat(first[pack], np.diff(upto_pack)), pa.int32())),
                    "places": lists(np.append(first[pack], len(order)), pa.array(place, pa.int32())),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
            start = stop


def _packs(docs: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(term, field, keys, lengths, tfs, ends, places): postings of ``docs``, a row for
    each document, in packs.  A term is written once in a pack, which is what makes the
    one exchange small."""
    rows = [docs.select(F.col(key).alias("key"), F.lit(f).alias("field"), tokens(f).alias("t")) for f in fields]
    each = reduce(DataFrame.unionByName, rows)
    kind = each.schema["key"].dataType.simpleString()
    return each.mapInArrow(_grouped, f"term string, field string, keys array<{kind}>, lengths array<int>, tfs array<int>, ends array<int>, places array<int>")


def _unpacked(packs: DataFrame, key: str) -> DataFrame:
    each = packs.select("*", F.posexplode("keys").alias("i", key))
    tf, end = F.get("tfs", F.col("i")), F.get("ends", F.col("i"))
    return each.select(key, "field", F.get("lengths", F.col("i")).alias("length"), "term", tf.cast("long").alias("tf"), F.slice("places", end - tf + 1, tf).alias("places"))


def postings(docs: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, length, term, tf, places): the index."""
    return _unpacked(_packs(docs, key, fields), key)


def lengths(docs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, n, mean): documents, and their mean number of tokens, by field."""
    sizes = docs.select(*(F.size(tokens(f)).alias(f) for f in fields)).agg(F.count(F.lit(1)).alias("n"), *(F.avg(f).alias(f) for f in fields))
    return sizes.select("n", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("mean")) for f in fields))).alias("x")).select("x.field", "n", "x.mean")


#: Segments that ``add_docs`` leaves before it merges them.
SEGMENTS = 10


def _state(spark: SparkSession, path: str) -> dict:
    have = [n for n in files.names(spark, f"{path}/_state") if n.endswith(".json")]
    found = files.read_json(spark, f"{path}/_state/{max(have)}") if have else None
    if found is None:
        raise GraphError("NO_INDEX", path)
    return found


def _commit(spark: SparkSession, path: str, state: dict) -> None:
    """What makes a change count: until it is there, readers see the state before."""
    if not files.write_json(spark, f"{path}/_state/{state['version']:012d}.json", state, replace=False):
        raise GraphError("CONFLICT", f"{path} has a state {state['version']} already")


def _put_segment(docs: DataFrame, path: str, segment: int, key: str, fields: Sequence[str]) -> dict[str, list[int]]:
    """Writes the postings of ``docs`` and their lengths; documents and tokens by field."""
    ranged = _packs(docs, key, fields).repartitionByRange("term", F.get("keys", F.lit(0))).sortWithinPartitions("term", F.get("keys", F.lit(0)))
    _unpacked(ranged, key).write.mode("overwrite").parquet(f"{path}/postings/s={segment}")
    docs.select(key, *(F.size(tokens(f)).alias(f) for f in fields)).write.mode("overwrite").parquet(f"{path}/docs/s={segment}")
    return _totals(docs.sparkSession.read.parquet(f"{path}/docs/s={segment}"), fields)


def _totals(docs: DataFrame, fields: Sequence[str]) -> dict[str, list[int]]:
    row = docs.agg(F.count(F.lit(1)).alias("n"), *(F.sum(f).alias(f) for f in fields)).first()
    return {f: [row.n, int(row[f] or 0)] for f in fields}


def _plus(a: dict[str, list[int]], b: dict[str, list[int]], sign: int = 1) -> dict[str, list[int]]:
    return {f: [x + sign * y for x, y in zip(a[f], b[f], strict=True)] for f in a}


def write_index(docs: DataFrame, path: str, key: str = "arxiv_id", fields: Sequence[str] = ("title", "abstract")) -> None:
    """Writes the index below ``path`` anew: postings in ranges of terms, sorted by term,
    so that a look-up reads the terms' row groups alone, and documents' lengths.  A
    frequent term has several ranges."""
    spark = docs.sparkSession
    have = [int(n[:-5]) for n in files.names(spark, f"{path}/_state") if n.endswith(".json")]
    segment = max((int(n[2:]) for n in files.names(spark, f"{path}/postings") if n.startswith("s=")), default=-1) + 1
    totals = _put_segment(docs, path, segment, key, fields)
    _commit(spark, path, {"version": max(have, default=-1) + 1, "key": key, "fields": list(fields), "segments": [segment], "next": segment + 1, "totals": totals, "deletions": []})


def _live(spark: SparkSession, path: str, state: dict, kind: str) -> DataFrame:
    """The rows of all segments whose documents weren't deleted since."""
    rows = spark.read.option("basePath", f"{path}/{kind}").parquet(*(f"{path}/{kind}/s={s}" for s in state["segments"]))
    if not state["deletions"]:
        return rows.drop("s")
    gone = spark.read.parquet(*(f"{path}/deletions/v={v}" for v in state["deletions"])).groupBy("__key").agg(F.max("before").alias("before"))
    return rows.join(gone, (F.col(state["key"]) == F.col("__key")) & (F.col("s") < F.col("before")), "left_anti").drop("s")


def _delete(spark: SparkSession, path: str, state: dict, ids: DataFrame, before: int) -> dict:
    """``state`` after the documents of ``ids`` are gone from segments before ``before``."""
    known = _live(spark, path, state, "docs").join(ids.select(state["key"]).distinct(), state["key"], "left_semi")
    version = state["version"] + 1
    found = written(known, "deleted")
    if found.count():
        found.select(F.col(state["key"]).alias("__key"), F.lit(before).alias("before")).write.mode("overwrite").parquet(f"{path}/deletions/v={version}")
        state = {**state, "deletions": [*state["deletions"], version], "totals": _plus(state["totals"], _totals(found, state["fields"]), -1)}
    dropped(found)
    return state


def add_docs(docs: DataFrame, path: str, most: int = SEGMENTS) -> None:
    """Puts documents into a stored index, in place of those of their keys, as a segment
    of its own: what is there isn't rewritten until there are more than ``most``."""
    spark = docs.sparkSession
    state = _state(spark, path)
    segment = state["next"]
    totals = _put_segment(docs, path, segment, state["key"], state["fields"])
    state = _delete(spark, path, state, docs, segment)
    state = {**state, "version": state["version"] + 1, "segments": [*state["segments"], segment], "next": segment + 1, "totals": _plus(state["totals"], totals)}
    _commit(spark, path, state)
    if len(state["segments"]) > most:
        merge_segments(spark, path)


def delete_docs(ids: DataFrame, path: str) -> None:
    """Deletes the documents of ``ids`` (the key) from a stored index."""
    spark = ids.sparkSession
    state = _state(spark, path)
    after = _delete(spark, path, state, ids, state["next"])
    if after is not state:
        _commit(spark, path, {**after, "version": state["version"] + 1})


def merge_segments(spark: SparkSession, path: str) -> None:
    """Writes all segments as one, without what was deleted.  Old ones stay until
    ``vacuum_index``, as somebody may be reading them."""
    state = _state(spark, path)
    segment, key = state["next"], state["key"]
    _live(spark, path, state, "postings").repartitionByRange("term", key).sortWithinPartitions("term", key).write.mode("overwrite").parquet(f"{path}/postings/s={segment}")
    _live(spark, path, state, "docs").write.mode("overwrite").parquet(f"{path}/docs/s={segment}")
    _commit(spark, path, {**state, "version": state["version"] + 1, "segments": [segment], "next": segment + 1, "deletions": []})


def vacuum_index(spark: SparkSession, path: str) -> None:
    """Deletes what the newest state doesn't name."""
    state = _state(spark, path)
    for kind, named in (("postings", {f"s={s}" for s in state["segments"]}), ("docs", {f"s={s}" for s in state["segments"]}), ("deletions", {f"v={v}" for v in state["deletions"]}), ("_state", {f"{state['version']:012d}.json"})):
        for name in set(files.names(spark, f"{path}/{kind}")) - named:
            files.delete(spark, f"{path}/{kind}/{name}")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The postings and lengths of a stored index as it is now."""
    state = _state(spark, path)
    sizes = [(f, n, total / n if n else None) for f, (n, total) in state["totals"].items()]
    return _live(spark, path, state, "postings"), spark.createDataFrame(sizes, "field string, n long, mean double")


def _checked(query: str, fields: Sequence[str], limit: int | None) -> Group | None:
    if limit is not None and limit > 100:
        raise GraphError("LIMIT_TOO_LARGE", "limit is at most 100")
    tree = parse(query)
    for x in leaves(tree) if tree else ():
        if x.field and x.field not in fields:
            raise ValueError(f"unknown field {x.field}")
    return tree


def _scored(tree: Leaf | Group, fields: Sequence[str], tf: Callable[[Leaf, str], Column], idf: Callable[[str, str], Column], relative: Callable[[str], Column]) -> tuple[Column, Column]:
    """The score of a row, 0 where it doesn't match, and whether it matches.  ``tf``: how
    often a leaf is in a field; ``relative``: a field's length by its mean."""
    if isinstance(tree, Leaf):
        own = [(f, tf(tree, f)) for f in fields if tree.field in (None, f)]
        score = F.lit(0.0)
        for f, n in own:
            if tree.kind != "words":
                score = score + n.cast("double")
                continue
            weight = reduce(Column.__add__, (idf(w, f) for w in tree.words))
            score = score + F.when(n > 0, weight * n * (K1 + 1) / (n + K1 * (1 - B + B * relative(f)))).otherwise(0.0)
        return score * tree.boost, reduce(Column.__or__, (n > 0 for _, n in own))
    found: dict[str, list[Column]] = {"+": [], "-": [], " ": []}
    score = F.lit(0.0)
    for occur, part in tree.parts:
        own, hit = _scored(part, fields, tf, idf, relative)
        found[occur].append(hit)
        if occur != "-":
            score = score + own
    wanted = found["+"] or [reduce(Column.__or__, found[" "])]
    matched = reduce(Column.__and__, [*wanted, *(~x for x in found["-"])])
    return F.when(matched, score * tree.boost).otherwise(0.0), matched


def _best(scored: DataFrame, key: str, limit: int | None) -> DataFrame:
    return scored if limit is None else scored.orderBy(F.desc("score"), key).limit(limit)


def search(docs: DataFrame, query: str, fields: Sequence[str] = ("title", "abstract"), key: str = "arxiv_id", limit: int | None = 10) -> DataFrame:
    """(key, score) of the best matches, 100 at most, ties by key; of all, in no order,
    without a limit.

    Without an index: one pass over the texts counts the query's terms in place, so
    nothing is exploded; the corpus's numbers are a one-row aggregate of a like pass.
    """
    tree = _checked(query, fields, limit)
    if tree is None:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    counted = docs.select(key, *(tokens(f).alias(f) for f in fields))

    def tf(c: Leaf, f: str) -> Column:
        own = F.col(f)
        if c.kind != "words":
            return F.exists(own, c.test).cast("int")
        if len(c.words) == 1:
            return F.size(F.filter(own, lambda x: x == c.words[0]))
        # tokens hold letters and digits alone, so they are their own pattern
        return F.regexp_count(F.concat(F.lit(" "), F.array_join(own, " "), F.lit(" ")), F.lit(f"(?<= ){c.words[0]}(?= {' '.join(c.words[1:])} )"))

    parts = [(c, f) for c in leaves(tree) for f in fields if c.field in (None, f)]
    words = sorted({(w, f) for c, f in parts if c.kind == "words" for w in c.words})
    rows = counted.select(key, *(F.size(f).alias(f"len_{f}") for f in fields), *(tf(c, f).alias(f"tf_{i}") for i, (c, f) in enumerate(parts)), *(F.array_contains(F.col(f), w).alias(f"has_{k}") for k, (w, f) in enumerate(words)))
    numbers = rows.agg(F.count(F.lit(1)).alias("n"), *(F.avg(f"len_{f}").alias(f"mean_{f}") for f in fields), *(F.count_if(f"has_{k}").alias(f"df_{k}") for k in range(len(words))))

    def idf(w: str, f: str) -> Column:
        df = F.col(f"df_{words.index((w, f))}")
        return F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))

    score, matched = _scored(tree, fields, lambda c, f: F.col(f"tf_{parts.index((c, f))}"), idf, lambda f: F.col(f"len_{f}") / F.col(f"mean_{f}"))
    return _best(rows.filter(matched).crossJoin(F.broadcast(numbers)).select(key, score.alias("score")), key, limit)


def search_index(index: DataFrame, sizes: DataFrame, query: str, key: str = "arxiv_id", limit: int | None = 10) -> DataFrame:
    """``search`` over ``postings`` and ``lengths`` that were written: only the postings
    of the query's terms and patterns are read."""
    means = {r.field: (r.n, r.mean) for r in sizes.collect()}  # a row for each field
    tree = _checked(query, list(means), limit)
    if tree is None:
        return index.select(key, F.lit(0.0).alias("score")).limit(0)
    words = sorted({w for c in leaves(tree) if c.kind == "words" for w in c.words})
    patterns = [c for c in leaves(tree) if c.kind != "words"]
    term = F.col("term")
    own = index.filter(reduce(Column.__or__, [term.isin(words), *(c.test(term) for c in patterns)]))
    df = {(r.term, r.field): r.n for r in own.filter(term.isin(words)).groupBy("term", "field").agg(F.count(F.lit(1)).alias("n")).collect()}  # the query's words by field
    in_ = lambda f, test: (F.col("field") == f) & test
    columns = [F.max(F.when(F.col("field") == f, F.col("length"))).alias(f"len_{f}") for f in means]
    columns += [F.first(F.when(in_(f, term == w), F.col("places")), True).alias(f"at_{k}_{f}") for k, w in enumerate(words) for f in means]
    columns += [F.max(F.when(in_(f, c.test(term)), 1)).alias(f"any_{k}_{f}") for k, c in enumerate(patterns) for f in means]

    def tf(c: Leaf, f: str) -> Column:
        if c.kind != "words":
            return F.coalesce(F.col(f"any_{patterns.index(c)}_{f}"), F.lit(0))
        # the places where all words of a phrase stand one behind the other
        back = lambda places, k: F.transform(places, lambda p: p - k)
        moved = [back(F.col(f"at_{words.index(w)}_{f}"), k) for k, w in enumerate(c.words)]
        return F.coalesce(F.size(reduce(F.array_intersect, moved)), F.lit(0))

    idf = lambda w, f: F.lit(math.log(1 + (means[f][0] - df.get((w, f), 0) + 0.5) / (df.get((w, f), 0) + 0.5)))
    score, matched = _scored(tree, list(means), tf, idf, lambda f: F.col(f"len_{f}") / F.lit(float(means[f][1] or 1)))
    return _best(own.groupBy(key).agg(*columns).filter(matched).select(key, score.alias("score")), key, limit)
