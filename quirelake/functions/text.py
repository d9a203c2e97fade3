"""Text functions: native columns, and plain twins where Spark has none."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_KEPT = re.compile(r"[^\w\s-]")


def normalize_name(value: str) -> str:
    """A name's form for matching: no accents, case, punctuation or extra space."""
    folded = unicodedata.normalize("NFKD", value).casefold()
    return " ".join(_KEPT.sub("", folded).split())


@F.pandas_udf(StringType())
def normalize_names(values: pd.Series) -> pd.Series:
    """``normalize_name`` of a column; Spark has no Unicode normalisation."""
    return values.map(lambda v: None if v is None else normalize_name(v))


def normalize_entity(value: Column | str) -> Column:
    """An entity's name in lower case with single spaces; accents and punctuation stay."""
    return F.trim(F.regexp_replace(F.lower(value), r"\s+", " "))


def clean_text(value: Column | str) -> Column:
    """Without white space at both ends; blank is null."""
    return F.nullif(F.regexp_replace(value, r"^\s+|\s+$", ""), F.lit(""))


def stable_id(prefix: str, value: Column | str) -> Column:
    """The prefix and the first 16 hex digits of the value's SHA-256."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.col(value) if isinstance(value, str) else value, 256), 1, 16))


def version_number(label: Column, fallback: Column) -> Column:
    """The number in v<number>, in either case; else the fallback."""
    return F.coalesce(F.nullif(F.regexp_extract(label, r"^[vV](\d+)$", 1), F.lit("")).cast("int"), fallback)


def created_at(value: Column) -> Column:
    """A timestamp from RFC 2822 text, else from ISO 8601 text, else null."""
    text = F.regexp_replace(clean_text(value), r"^[A-Za-z]{3},\s*", "")
    mail = F.coalesce(*(F.try_to_timestamp(text, F.lit(f"d MMM yyyy HH:mm:ss{zone}")) for zone in (" z", " Z", "")))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))))
    return F.coalesce(mail, iso)


def display_name(given: Column, family: Column, suffix: Column) -> Column:
    """Given, family, suffix, joined by a space; blank parts are left out."""
    return F.concat_ws(" ", clean_text(given), clean_text(family), clean_text(suffix))


def category_tokens(categories: Column) -> Column:
    """The codes between white space; none for null or blank."""
    return F.filter(F.split(F.coalesce(categories, F.lit("")), r"\s+"), lambda x: x != "")


def paper_text(title: Column | str, abstract: Column | str) -> Column:
    """What an encoder reads of a paper."""
    return F.concat(F.lit("Title: "), title, F.lit(".\nAbstract: "), abstract)


def preview(abstract: Column | str, size: int = 300) -> Column:
    """The first characters on one line, with three dots where some are missing."""
    line = F.regexp_replace(abstract, "\n", " ")
    return F.concat(F.substring(line, 1, size), F.when(F.length(line) > size, "...").otherwise(""))


def candidate_phrases(text: Column | str, least: int = 2, most: int = 6, limit: int = 25) -> Column:
    """Candidate phrases in order of appearance, distinct but for case.

    An approximation without a grammar model: runs of words that aren't stop words,
    by their whole length, not split further.
    """
    words = "a an the of in on for and or to with by from is are was were be been this that these those we our it its as at can which their than then into such using use used via not no".split()
    breaks = rf"(?i)(?<![\p{{L}}\p{{N}}-])(?:{'|'.join(words)})(?![\p{{L}}\p{{N}}-])|[^\p{{L}}\p{{N}}\s-]"
    runs = F.split(F.regexp_replace(F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"\s+", " "), breaks, "\n"), "\n")
    phrases = F.filter(F.transform(runs, lambda p: F.trim(p)), lambda p: F.size(F.split(p, " +")).between(least, most))
    none = F.array().cast("array<string>")
    return F.aggregate(phrases, none, lambda done, p: F.when((F.size(done) < limit) & ~F.exists(done, lambda x: F.lower(x) == F.lower(p)), F.concat(done, F.array(p))).otherwise(done))


# Fixed value: what stands before the candidates in a prompt.
HINT = "Candidate phrases from the text (not all are relevant; you are not limited to these): "


def user_prompt(title: Column | str, abstract: Column | str, candidates: Column | str) -> Column:
    """A prompt for one paper; the hint is there only with candidates."""
    hint = F.concat(F.lit("\n\n" + HINT), F.array_join(candidates, ", "))
    return F.concat(F.lit("Title: "), title, F.lit("\n\nAbstract: "), abstract, F.when(F.size(candidates) > 0, hint).otherwise(""))


def batch_prompt(papers: Column | str) -> Column:
    """A prompt for several papers: an array of (title, abstract, candidates)."""
    def one(p: Column, i: Column) -> Column:
        hint = F.concat(F.lit("\n" + HINT), F.array_join(p["candidates"], ", "))
        return F.concat(F.lit("=== Paper "), i.cast("string"), F.lit(" ===\nTitle: "), p["title"], F.lit("\n\nAbstract: "), p["abstract"], F.when(F.size(p["candidates"]) > 0, hint).otherwise(""))

    return F.array_join(F.transform(papers, one), "\n\n")


_ENTITY = "array<struct<name: string, type: string>>"


def valid_entities(found: Column) -> Column:
    """Those with a name and a known type."""
    return F.filter(found, lambda e: (F.coalesce(e["name"], F.lit("")) != "") & F.coalesce(e["type"].isin("method", "dataset", "topic"), F.lit(False)))


def parse_entities(answer: Column | str) -> Column:
    """Entities of a model's JSON answer; anything unusable gives none."""
    found = F.from_json(answer, f"struct<entities: {_ENTITY}>")["entities"]
    return F.coalesce(valid_entities(found), F.array().cast(_ENTITY))


def parse_batch_entities(answer: Column | str, papers: int) -> Column:
    """The entities of each of ``papers`` papers by index; missing ones have none, the
    last of several answers for one index counts, others are ignored."""
    items = F.from_json(answer, f"struct<papers: array<struct<index: int, entities: {_ENTITY}>>>")["papers"]
    none = F.array().cast(_ENTITY)
    return F.transform(F.sequence(F.lit(0), F.lit(papers - 1)), lambda i: F.coalesce(valid_entities(F.try_element_at(F.filter(items, lambda x: x["index"] == i), F.lit(-1))["entities"]), none))
