"""Language identification with spans of mixed-language text.

The model holds, for each language, log probabilities of hashed byte n-grams of
words (a naive Bayes score) and the scripts that the language is written in.  For
a text, each word's script narrows the candidates; a Viterbi pass over the words'
scores, with a penalty for each switch of language, then labels spans; the text's
language is the one whose spans hold most letters' bytes, and its score is their
share of all such bytes.

The model is fitted on labelled rows: all while there are no more than
``SAMPLE_ROWS``, else about so many, chosen by a hash of doc_id.  Of each language
about ``LANGUAGE_ROWS`` are taken at least (all if it has fewer, and the row of the
least hash in any case), so none is lost to a large table.  These bounds are the
only ones; every text, however long, is read whole, in fitting and in predicting.

Nulls, empty and odd rows: a null text or one without letters is ``und`` with
score 0; rows with a null lang aren't learned from; a text with letters of
scripts that no language was learned with gets the language with most training
text and score 0; ties go to the language that comes first by name; repeated rows
give repeated results; other columns are ignored; an empty table gives an empty
result, and without any labelled row every text is ``und``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import SLICE_BYTES, record_batch, slices, table, text_slices
from .words import told_apart

#: Labelled rows that a model is fitted on, at most (in expectation), but for those
#: that make up ``LANGUAGE_ROWS`` of each language.
SAMPLE_ROWS = 20_000
#: Rows of each language that are taken at least (in expectation), if there are.
LANGUAGE_ROWS = 500
#: Hash buckets of n-grams, and their lengths in bytes; a word stands between spaces.
BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
#: Nats that a switch of language costs.
SWITCH = 12.0
#: Least share of a language's letters for a script to count as its own.
SCRIPT_SHARE = 0.002
#: Words whose scores a worker remembers.
CACHED_WORDS = 200_000
UNDETERMINED = "und"

# First and last code point of the ranges of common scripts.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xB5, 0xB5), (0xBA, 0xBA), (0xC0, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
}
_NAMES = [*SCRIPTS, "other"]


def script_of(word: str) -> int:
    """The place in ``_NAMES`` of the script of most letters of ``word``, ties to
    the first; -1 without letters."""
    if word.isascii():
        return 0 if any(map(str.isalpha, word)) else -1
    found: Counter[int] = Counter()
    for c in word:
        if c.isalpha():
            p = ord(c)
            found[next((i for i, ranges in enumerate(SCRIPTS.values()) if any(a <= p <= b for a, b in ranges)), len(SCRIPTS))] += 1
    return min(found, key=lambda s: (-found[s], s)) if found else -1


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of ``words``, and the place of each one's word."""
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    space = data == 32
    owner = np.cumsum(space) - 1  # a space belongs to the word after it
    found, owners = [], []
    for n in ORDERS:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        inner = np.zeros(len(h), bool)
        for k in range(n):
            h = (h ^ data[k : k + len(h)]) * np.uint32(0x01000193)
            if 0 < k < n - 1:
                inner |= space[k : k + len(h)]
        if n == 2:
            inner |= space[: len(h)] & space[1 : 1 + len(h)]
        keep = np.flatnonzero(~inner)
        h = h[keep]
        found.append(((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.int64))
        owners.append(owner[keep])
    return np.concatenate(found), np.concatenate(owners)


@dataclass
class Model:
    """Languages by name, log probabilities (buckets x languages), allowed scripts
    (scripts x languages) and the place of the language with most text."""

    langs: list[str]
    weights: np.ndarray
    scripts: np.ndarray
    common: int


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, language_rows: int = LANGUAGE_ROWS) -> DataFrame:
    """(text, lang) of labelled rows: all, or about ``rows`` by a hash of doc_id, with
    about ``language_rows`` of each language at least."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    place = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 40))
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("least")).collect()
    n = sum(r.n for r in counts)
    if n > rows:
        # a row for each language, of which the model has a column each
        upto = [(r.lang, max(r.least, int(min(1.0, max(rows / n, language_rows / r.n)) * (1 << 40)) - 1)) for r in counts]
        bounds = docs.sparkSession.createDataFrame(upto, "lang string, upto long")
        labelled = labelled.join(F.broadcast(bounds), "lang").filter(place <= F.col("upto"))
    return labelled.select("text", "lang")


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """A model from ``docs`` (doc_id, text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        scripts: dict[str, Counter] = {}
        for batch, texts in slices(batches):
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column(batch.schema.get_field_index("lang")).to_pylist(), texts, strict=True):
                words.setdefault(lang, Counter()).update(text.decode().lower().split())
            for lang, found in words.items():
                own = {w: n for w, n in found.items() if (s := script_of(w)) >= 0 and not scripts.setdefault(lang, Counter()).update({s: n})}
                if not own:
                    continue
                grams, owner = _grams([w.encode() for w in own])
                n = np.fromiter(own.values(), np.float64, len(own))
                total[lang] = total.get(lang, 0) + np.bincount(grams, n[np.minimum(owner, len(n) - 1)], BUCKETS)
        for lang, x in total.items():
            yield record_batch({"lang": [lang], "grams": [x.astype(np.float32).tobytes()], "scripts": [[float(scripts[lang][i]) for i in range(len(_NAMES))]]}, pa.schema([("lang", pa.string()), ("grams", pa.binary()), ("scripts", pa.list_(pa.float64()))]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, g, s in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                grams[lang] = grams.get(lang, 0) + np.frombuffer(g, np.float32).astype(np.float64)
                scripts[lang] = scripts.get(lang, 0) + np.array(s)
        for lang, g in grams.items():
            yield record_batch({"lang": [lang], "grams": [g.tobytes()], "scripts": [scripts[lang].tolist()]}, pa.schema([("lang", pa.string()), ("grams", pa.binary()), ("scripts", pa.list_(pa.float64()))]))

    schema = "lang string, grams binary, scripts array<double>"
    found = sorted(sample(docs, rows).mapInArrow(count, schema).repartition("lang").mapInArrow(add, schema).collect(), key=lambda r: r.lang)
    if not found:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(_NAMES), 0), bool), -1)
    n = np.stack([np.frombuffer(r.grams, np.float64) for r in found], axis=1)
    weights = np.log((n + 0.5) / (n.sum(axis=0) + 0.5 * BUCKETS))
    used = np.stack([np.array(r.scripts) for r in found], axis=1)
    return Model([r.lang for r in found], (weights - weights.max(axis=1, keepdims=True)).astype(np.float32), used >= SCRIPT_SHARE * used.sum(axis=0), int(n.sum(axis=0).argmax()))


class Labeller:
    """Labels texts by a model, with a bounded cache of words' scores."""

    def __init__(self, model: Model, switch: float = SWITCH):
        self.model, self.switch = model, switch
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.langs)), np.float32)
        self.letters = np.zeros(0, np.int32)

    def learn(self, words: list[str]) -> None:
        lower = [w.lower() for w in words]
        scripts = np.array([script_of(w) for w in lower])
        grams, owner = _grams([w.replace(" ", "_").encode() for w in lower])
        scores = np.stack([np.bincount(owner, self.model.weights[grams, j], len(words) + 1)[: len(words)] for j in range(len(self.model.langs))], axis=1)
        allowed = self.model.scripts[scripts]
        scores[~allowed] = -200
        scores[(scripts < 0) | ~allowed.any(axis=1)] = 0
        known = (scripts >= 0) & allowed.any(axis=1)
        self.place.update(zip(words, range(len(self.letters), len(self.letters) + len(words)), strict=True))
        self.scores = np.concatenate([self.scores, scores.astype(np.float32)])
        # a word of letters of an unknown script has -1, so that it is still a letter
        self.letters = np.concatenate([self.letters, np.where(known, [len(w.encode()) for w in words], np.where(scripts >= 0, -1, 0)).astype(np.int32)])

    def paths(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text (large strings) its words' languages (by place) and their bytes,
        which are 0 for words without letters and -1 for those of unknown scripts.

        A path that switches gains the best scores of all words at most and loses a
        penalty, so a text that falls short of them by less in one language is of that
        one; only the others go through the Viterbi pass.
        """
        if len(self.place) > CACHED_WORDS:
            self.clear()
        words, at, counts = told_apart(texts)
        missing = [w for w in words if w not in self.place]
        if missing:
            self.learn(missing)
        flat = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))[at]
        ends = np.cumsum(counts)
        starts = ends - counts
        scores, letters = self.scores[flat], self.letters[flat]
        label = np.zeros(len(flat), np.int64)
        full = np.flatnonzero(counts)
        if len(full):
            sums = np.add.reduceat(scores, starts[full], axis=0, dtype=np.float64)
            most = np.add.reduceat(scores.max(axis=1), starts[full], dtype=np.float64)
            best = sums.argmax(axis=1)
            sure = sums[np.arange(len(full)), best] > most - self.switch + 1e-6
            for i, lang in zip(full[sure].tolist(), best[sure].tolist(), strict=True):
                label[starts[i] : ends[i]] = lang
            self._viterbi(full[~sure], starts, counts, scores, label)
        return [(label[a:b], letters[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    def _viterbi(self, which: np.ndarray, starts: np.ndarray, counts: np.ndarray, scores: np.ndarray, label: np.ndarray) -> None:
        """Writes the best paths of some texts into ``label``."""
        order = which[np.argsort(-counts[which], kind="stable")]
        size, first = counts[order], starts[order]
        n = len(self.model.langs)
        places = np.int8 if n < 128 else np.int32
        own = np.arange(n, dtype=places)
        held = np.cumsum(size) - size  # where each text's back pointers begin
        back = np.zeros((int(size.sum()), n), places)
        best = np.zeros((len(order), n), np.float32)
        active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
        for t, a in enumerate(active.tolist()):  # all texts that have a word there at once
            v = best[:a]
            top = v.argmax(axis=1)
            high = v[np.arange(a), top] - self.switch
            back[held[:a] + t] = np.where(v >= high[:, None], own, top[:, None])
            best[:a] = np.maximum(v, high[:, None]) + scores[first[:a] + t]
        last = best.argmax(axis=1)
        for t in range(len(active) - 1, -1, -1):
            a = active[t]
            label[first[:a] + t] = last[:a]
            last[:a] = back[held[:a] + t, last[:a]]

    def label(self, texts: pa.Array) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        if not self.model.langs:
            return [(UNDETERMINED, 0.0)] * len(texts)
        out = []
        for label, letters in self.paths(texts):
            share = np.bincount(label, np.maximum(letters, 0), len(self.model.langs))
            if not (letters != 0).any():
                out.append((UNDETERMINED, 0.0))
            elif not share.any():
                out.append((self.model.langs[self.model.common], 0.0))
            else:
                out.append((self.model.langs[int(share.argmax())], float(share.max() / share.sum())))
        return out

    def spans(self, texts: pa.Array) -> list[list[dict]]:
        """Each text's spans: code points from the first to after the last word of a
        stretch of one language."""
        out = []
        for text, (label, letters) in zip(texts.cast(pa.large_binary()).to_pylist(), self.paths(texts), strict=True):
            found: list[dict] = []
            at = 0
            for word, lang, n in zip(text.split(), label.tolist(), letters.tolist(), strict=True):
                start = text.index(word, at)
                at = start + len(word)
                if n <= 0:
                    continue
                if found and found[-1]["lang"] == self.model.langs[lang]:
                    found[-1]["end"] = at
                else:
                    found.append({"lang": self.model.langs[lang], "start": start, "end": at})
            points = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80) if found else None
            for x in found:
                x["start"], x["end"] = int(points[x["start"]]) - 1, int(points[x["end"] - 1])
            out.append(found)
        return out


def identify(docs: DataFrame, model: Model, with_spans: bool = False) -> DataFrame:
    """``docs`` with lang_pred and score, and with spans if asked for; columns of
    those names are replaced, the others carried."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "spans")]
    docs = docs.select(*names).withColumn("text", F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch, texts in text_slices(batches, most=SLICE_BYTES):
            found = labeller.label(texts)
            more = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            if with_spans:
                more.append(pa.array(labeller.spans(texts), span))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*names, "lang_pred", "score", *["spans"] * with_spans])

    out = StructType(docs.schema.fields[:]).add("lang_pred", "string").add("score", "double")
    if with_spans:
        out = out.add("spans", ArrayType(StructType().add("lang", "string").add("start", "long").add("end", "long")))
    return docs.mapInArrow(run, out)


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept out of fitting: crc32 of its id's text mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all ``documents``, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
