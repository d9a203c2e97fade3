"""Alignment of two tokenizers' tokens of the same text, by Spark's relational operators.

Neither tokenizer joins anything across the begin of white space, so a text is cut there
into stretches, which are aligned independently.  Texts go in slices of some megabytes;
a slice's distinct stretches are encoded twice where it is read, and its documents become
the numbers of their stretches.

Both token lists are exploded with their places, and running sums of byte lengths, by a
window, give where each token begins and ends.  A full outer equi-join on stretch and
begin, done by a second window as both sides are one stream, sorted by begins, gives a row
for each place where any token begins.  Such a row is a link: between it and the place
after it lie one token of either side, which are the last that began there or before (a
running ``last``).  So links are found without pairing tokens within a group, however
large that is.  Places where both begin are the cuts between groups.

Rows and windows have ``BLOCK`` stretches of a slice, as a window costs far more to begin
than a row of it.  Both sides have the same bytes, so a begin within the block tells the
stretch too.

Slices are dealt out once, by number, and everything up to a document's result happens
there: its stretches' places are put together in its order.  Links are counted for each
document and id pair before they are counted over the corpus.

Tokenizers that could join across white space have whole texts as stretches.

Nulls, empty and odd rows: a null or empty text, and one that either tokenizer doesn't
give back byte by byte, has no tokens: zeros and the empty string; a very long text is
one document like others; repeated rows are documents of their own; a
null id stays null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, free_memory, input_bytes, public_tokenizer, record_batch, table, text_slices, written
from .packing import _merges

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
#: Bytes of text of a slice, of whose distinct stretches each token becomes a row that is
#: sorted; and its documents at most.
TEXT_BYTES = 8 << 20
SLICE_DOCS = 1 << 20
#: Input bytes of a partition, of which a slice has several, and partitions at most.
PARTITION_BYTES = 2 << 20
MOST_PARTITIONS = 50_000
#: Stretches that are encoded one behind the other.
JOINED = 256
#: Stretches of a row, and of a window's partition.
BLOCK_BITS = 8
BLOCK = 1 << BLOCK_BITS
#: Links that are put together at a time.
LINKS = 1 << 18
#: Bounds ids.  As an id it stands for a stretch without tokens, as if of one byte.
NO_ID = 1 << 16
#: The bits of a token that are its id; above them its side and its stretch's number in
#: the block.
ID_BITS = 2 * NO_ID - 1
SIDE_BIT = 2 * NO_ID
TOKEN_BITS = 18 + BLOCK_BITS
#: Id pairs whose counts are broadcast.
BROADCAST_PAIRS = 500_000


def _path(name: str) -> str:
    return name if "/" in name else public_tokenizer(name)


class ByteLevel:
    """A byte-level BPE of the tokenizers library; special strings are plain text."""

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(_path(name))
        self.own.encode_special_tokens = True
        self.own.no_truncation()
        self.own.no_padding()
        # byte-level letters: printable bytes stand for themselves, others for 256 and on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        size = self.own.get_vocab_size()
        entries = [self.own.id_to_token(i) or "" for i in range(size)]
        self.bytes = [bytes(letters[c] for c in e) if all(c in letters for c in e) else e.encode() for e in entries]
        self.merges = _merges(self.own)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.behind([" " + t for t in texts])

    def parts(self) -> bool:
        """Whether tokens never go on where white space begins: GPT-2's pattern, by
        which white space is only at a token's begin."""
        return self.own.normalizer is None and [self.own.pre_tokenizer.pre_tokenize_str(t) for t in _PROBES] == _PROBED

    def behind(self, stretches: list[str]) -> list[list[int]]:
        """Ids of stretches of a text."""
        return [x.ids for x in self.own.encode_batch_fast(stretches, add_special_tokens=False)]

    def joined(self, text: str) -> np.ndarray:
        """Ids of stretches one behind the other."""
        return np.array(self.merges.encode_to_numpy(text) if self.merges else self.behind([text])[0], np.int32)


class Pieces:
    """A sentencepiece model, which puts a space before the text."""

    def __init__(self, name: str):
        from sentencepiece import SentencePieceProcessor

        self.own = SentencePieceProcessor(model_file=_path(name))
        piece = self.own.id_to_piece
        self.bytes = [bytes([int(piece(i)[3:5], 16)]) if self.own.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.own.get_piece_size())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.own.encode(texts, num_threads=1)

    def parts(self) -> bool:
        """Whether tokens never go on where white space begins: no piece has any behind
        something else, and none has a line end."""
        pieces = [self.own.id_to_piece(i) for i in range(self.own.get_piece_size())]
        return not any("\n" in p or " " in p or "▁" in p.lstrip("▁") for p in pieces) and self.own.encode("\n") == [self.own.piece_to_id("▁"), self.own.piece_to_id("<0x0A>")]

    def behind(self, stretches: list[str]) -> list[list[int]]:
        """Ids of stretches of a text, where ``parts``: a line end before them keeps the
        space that the model adds apart."""
        return [x[2:] for x in self.own.encode(["\n" + t for t in stretches], num_threads=1)]

    def joined(self, text: str) -> np.ndarray:
        """Ids of stretches one behind the other."""
        return np.array(self.own.encode("\n" + text)[2:], np.int32)


#: How the pattern of ``ByteLevel.parts`` cuts.
_PROBES = [" ab\n\nc  d. 12'll\t e", "a\n b\u3000 c"]
_PROBED = [
    [("Ġab", (0, 3)), ("Ċ", (3, 4)), ("Ċ", (4, 5)), ("c", (5, 6)), ("Ġ", (6, 7)), ("Ġd", (7, 9)), (".", (9, 10)), ("Ġ12", (10, 13)), ("'ll", (13, 16)), ("ĉ", (16, 17)), ("Ġe", (17, 19))],
    [("a", (0, 1)), ("Ċ", (1, 2)), ("Ġb", (2, 4)), ("ãĢĢ", (4, 5)), ("Ġc", (5, 7))],
]
#: Of this process.
_sides: dict[str, ByteLevel | Pieces] = {}


def _side(name: str) -> ByteLevel | Pieces:
    if name not in _sides:
        _sides[name] = ByteLevel(name) if name.endswith(".json") else Pieces(name)
        _sides[name].lengths = np.array([len(b) for b in _sides[name].bytes], np.int32)
    return _sides[name]


def tokens_of(texts: list[str], names: tuple[str, str]) -> list[tuple[list[int], list[int]]]:
    """Ids of both sides of each text; none if the bytes of either aren't the text's."""
    own = [_side(n) for n in names]
    found = []
    for text, a, b in zip(texts, own[0].encode(texts), own[1].encode(texts), strict=True):
        whole = b" " + text.encode()
        same = text and all(b"".join(map(s.bytes.__getitem__, ids)) == whole for s, ids in zip(own, (a, b), strict=True))
        found.append((a, b) if same else ([], []))
    return found


def starts(data: np.ndarray) -> np.ndarray:
    """Where stretches begin in UTF-8 bytes, after the first one: at a space or line end
    behind what isn't white space.  A few letters count as such by their last bytes, which
    leaves a stretch longer."""
    at = np.flatnonzero((data[1:] == 32) | (data[1:] == 10)) + 1
    return at[~_white(data[at - 1], data[np.maximum(at - 2, 0)])]


def _white(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Whether white space may end with these bytes."""
    return _WHITE[last] | (_WHITE_LAST[last] & _WHITE_BEFORE[before])


#: Last bytes of white space beyond ASCII, and the bytes before them.
_WHITE, _WHITE_LAST, _WHITE_BEFORE = (np.zeros(256, bool) for _ in range(3))
_WHITE[[*range(9, 14), *range(28, 33)]] = True
for _c in [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
    _WHITE_BEFORE[chr(_c).encode()[-2]] = _WHITE_LAST[chr(_c).encode()[-1]] = True


def stretches_of(texts: pa.Array, apart: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct stretches of ``texts`` (large strings without nulls), each text with a
    space before it; the places of each text's stretches among them; and how many it has.
    An empty text has none."""
    size = np.diff(np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8))
    held = np.flatnonzero(size > 0)
    spaced = pc.binary_join_element_wise(pa.scalar("", texts.type), texts.take(pa.array(held)), pa.scalar(" ", texts.type)) if len(held) else texts.slice(0, 0)
    offsets = np.frombuffer(spaced.buffers()[1], np.int64, len(spaced) + 1, spaced.offset * 8) if len(held) else np.zeros(1, np.int64)
    begins = offsets[:-1]
    if apart and len(held):
        data = np.frombuffer(spaced.buffers()[2], np.uint8, int(offsets[-1]))
        here = np.zeros(len(data), bool)
        here[begins] = here[starts(data)] = True
        begins = np.flatnonzero(here)
    counts = np.zeros(len(texts), np.int64)
    counts[held] = np.diff(np.searchsorted(begins, offsets))
    if not len(held):
        return spaced, np.zeros(0, np.int32), counts
    cut = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, offsets[-1]).astype(np.int64)), spaced.buffers()[2])
    told = cut.dictionary_encode()
    return told.dictionary, told.indices.to_numpy().astype(np.int32), counts


def one_of(parts: list[tuple[pa.Array, np.ndarray, np.ndarray]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """``stretches_of`` all texts from those of their parts."""
    if len(parts) == 1:
        return parts[0]
    told = pa.concat_arrays([x[0] for x in parts]).dictionary_encode()
    number, first = told.indices.to_numpy().astype(np.int32), np.cumsum([0, *(len(x[0]) for x in parts)])
    return told.dictionary, np.concatenate([number[low:][at] for low, (_, at, _) in zip(first, parts, strict=False)]), np.concatenate([x[2] for x in parts])


def ids_of(stretches: list[str], names: tuple[str, str], apart: bool) -> list[tuple[list[int], list[int]]]:
    """Ids of both sides of each stretch; none if the bytes of either aren't its own."""
    if not apart:
        return tokens_of([x[1:] for x in stretches], names)
    own = [_side(n) for n in names]
    found = []
    for text, a, b in zip(stretches, own[0].behind(stretches), own[1].behind(stretches), strict=True):
        whole = text.encode()
        found.append((a, b) if all(b"".join(map(s.bytes.__getitem__, ids)) == whole for s, ids in zip(own, (a, b), strict=True)) else ([], []))
    return found


def _flat(found: list[tuple[list[int], list[int]]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each side, all ids and how many each stretch has."""
    sides = []
    for own in ([x[i] for x in found] for i in (0, 1)):
        size = np.fromiter(map(len, own), np.int64, len(own))
        sides.append((np.fromiter(itertools.chain.from_iterable(own), np.int32, int(size.sum())), size))
    return sides


def sides_of(every: list[str], names: tuple[str, str], apart: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """``ids_of`` as arrays: for each side, all ids and how many each stretch has.
    Stretches are encoded one behind the other, ``JOINED`` at a time, and alone where one
    ends with white space or the bytes differ."""
    parts: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for start in range(0, len(every), JOINED):
        texts = every[start : start + JOINED]
        whole = "".join(texts)
        data = whole.encode()
        stop = np.cumsum([len(x.encode()) for x in texts])
        flat = np.frombuffer(data, np.uint8)
        found = []
        if apart and not _white(flat[stop - 1], flat[np.maximum(stop - 2, 0)]).any():
            for own in map(_side, names):
                ids = own.joined(whole)
                ends = np.cumsum(own.lengths[ids], dtype=np.int64)
                at = np.searchsorted(ends, stop)
                if not len(ends) or ends[-1] != len(data) or (ends[at] != stop).any() or b"".join(map(own.bytes.__getitem__, ids.tolist())) != data:
                    break
                found.append((ids, np.diff(at, prepend=-1)))
        parts.append(found if len(found) == 2 else _flat(ids_of(texts, names, apart)))
    return [tuple(np.concatenate([p[i][j] for p in parts]) for j in (0, 1)) for i in (0, 1)]


#: The stretches of this process's last slice, and its sides.
_last: dict[tuple, tuple[pa.Array, list[tuple[np.ndarray, np.ndarray]]]] = {}


def sides_after(told: pa.Array, names: tuple[str, str], apart: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """``sides_of`` a slice's distinct stretches; those of the slice before are taken
    from there."""
    had, sides = _last.pop((names, apart), (told.slice(0, 0), [(np.zeros(0, np.int32), np.zeros(0, np.int64))] * 2))
    at = pc.index_in(told, value_set=had)
    new = told.filter(at.is_null())
    parts = [sides, *(sides_of(new.slice(start, 200 * JOINED).to_pylist(), names, apart) for start in range(0, len(new), 200 * JOINED))]
    place = at.fill_null(-1).to_numpy().astype(np.int64)
    place[place < 0] = len(had) + np.arange(len(new))
    found = []
    for i in (0, 1):
        ids, size = (np.concatenate([x[i][j] for x in parts]) for j in (0, 1))
        begin, own = (np.cumsum(size) - size)[place], size[place]
        found.append((ids[np.repeat(begin - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))], own))
    _last.clear()
    if told.nbytes <= TEXT_BYTES:
        _last[names, apart] = told, found
    return found


_SLICES = "slice long, first int, side int, doc struct<doc_id: long, codes: binary>, tokens array<int>"


def _blocks(side: int, ids: np.ndarray, size: np.ndarray) -> pa.Array:
    """One side's tokens (see ``ID_BITS``) of each ``BLOCK`` of stretches, from all ids and
    how many each stretch has."""
    if (size == 0).any():
        ids = np.insert(ids, (np.cumsum(size) - size)[size == 0], NO_ID)
        size = np.maximum(size, 1)
    tokens = np.repeat(np.arange(len(size), dtype=np.int32) % BLOCK << TOKEN_BITS - BLOCK_BITS, size) | side * SIDE_BIT | ids
    ends = np.concatenate([[0], np.cumsum(size)])
    return pa.ListArray.from_arrays(pa.array(np.append(ends[:-1:BLOCK], ends[-1]), pa.int32()), pa.array(tokens.astype(np.int32)))


def _encoder(names: tuple[str, str]):
    def slices(batches: Iterator[pa.RecordBatch], apart: bool) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]]:
        """Documents' ids and, as of ``stretches_of``, their stretches, a slice at a time;
        only a fourth of a slice's texts are held at once."""
        ids: list[pa.Array] = []
        parts: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        size = 0
        for batch, texts in text_slices(batches, most=TEXT_BYTES // 4):
            ids.append(batch.column(0))
            parts.append(stretches_of(texts, apart))
            size += texts.nbytes
            if size >= TEXT_BYTES or sum(map(len, ids)) >= SLICE_DOCS // 2:
                yield pa.concat_arrays(ids), *one_of(parts)
                ids, parts, size = [], [], 0
        if ids:
            yield pa.concat_arrays(ids), *one_of(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("slice", pa.int64()), ("first", pa.int32()), ("side", pa.int32()), ("doc", pa.struct([("doc_id", pa.int64()), ("codes", pa.binary())])), ("tokens", pa.list_(pa.int32()))])
        apart = all(_side(n).parts() for n in names)
        place = TaskContext.get().partitionId() << 20
        for number, (doc_ids, told, at, counts) in enumerate(slices(batches, apart), place):
            for side, (ids, size) in enumerate(sides_after(told, names, apart)):
                ends = np.concatenate([[0], np.cumsum(size)])
                for start in range(0, len(size), 200 * BLOCK):
                    stop = min(start + 200 * BLOCK, len(size))
                    blocks = _blocks(side, ids[ends[start] : ends[stop]], size[start:stop])
                    n = len(blocks)
                    yield record_batch({"slice": pa.array(np.full(n, number)), "first": pa.array(start + BLOCK * np.arange(n), pa.int32()), "side": pa.array(np.full(n, side), pa.int32()), "doc": pa.nulls(n, schema.field("doc").type), "tokens": blocks}, schema)
            stop = np.concatenate([[0], np.cumsum(counts)]).tolist()
            n = len(doc_ids)
            for start in range(0, n, 2000):
                here = range(start, min(start + 2000, n))
                codes = pa.array([at[stop[i] : stop[i + 1]].tobytes() for i in here], pa.binary())
                m = len(here)
                yield record_batch({"slice": pa.array(np.full(m, number)), "first": pa.array(-1 - np.arange(start, start + m), pa.int32()), "side": pa.array(np.zeros(m), pa.int32()), "doc": pa.StructArray.from_arrays([doc_ids.slice(start, m), codes], names=["doc_id", "codes"]), "tokens": pa.nulls(m, schema.field("tokens").type)}, schema)

    return run


def places(docs: DataFrame, names: tuple[str, str] = (BYTE_BPE, PIECE_BPE)) -> DataFrame:
    """(slice, code, doc_id, codes, start, a, b, link_a, link_b): for each distinct stretch
    of a slice (``code``, from 0), the places where tokens begin, in order, counted from the
    begin of its block, the ids of those that begin there and the ids that lie behind it;
    one without tokens has one row of -1.  A document is a row with a negative code and its
    stretches' codes."""
    many = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTITIONS, input_bytes(docs) // PARTITION_BYTES + 1))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    encoded = texts.mapInArrow(_encoder(names), _SLICES).repartition(many, "slice")
    own = ["slice", "first", "doc"]
    tokens = encoded.select(*own, "side", F.posexplode_outer("tokens").alias("pos", "token"))
    lengths = [F.split(F.lit(",".join(map(str, _side(n).lengths.tolist()))), ",").cast("array<int>") for n in names]  # folded to one literal
    number = F.col("token").bitwiseAND(ID_BITS)
    length = F.coalesce(F.when(F.col("side") == 0, F.get(lengths[0], number)).otherwise(F.get(lengths[1], number)), F.lit(1)).cast("long")
    end = F.sum("length").over(Window.partitionBy("slice", "first", "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    begun = tokens.withColumn("length", length).select(*own, F.coalesce("token", F.lit(NO_ID)).alias("token"), (end - F.col("length")).alias("start"))
    # the full outer join of both sides on block and begin: those that begin together are
    # peers of the window, whose last tokens of either side they have
    so_far = Window.partitionBy("slice", "first").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    of_b = F.col("token").bitwiseAND(SIDE_BIT) != 0
    known = F.shiftleft("start", TOKEN_BITS).bitwiseOR(F.col("token").cast("long"))
    last_a, last_b = (F.last(F.when(side, known), True).over(so_far) for side in (~of_b, of_b))
    met = begun.select(*own, "token", "start", last_a.alias("last_a"), last_b.alias("last_b"))
    here = [F.shiftright(c, TOKEN_BITS) == F.col("start") for c in ("last_a", "last_b")]
    met = met.filter(~of_b | ~F.coalesce(here[0], F.lit(False)))
    link = [F.when(F.col(c).bitwiseAND(ID_BITS) == NO_ID, -1).otherwise(F.col(c).bitwiseAND(ID_BITS)).cast("int") for c in ("last_a", "last_b")]
    code = F.col("first") + F.shiftright("token", TOKEN_BITS - BLOCK_BITS)
    return met.select("slice", code.alias("code"), "doc.doc_id", "doc.codes", "start", F.when(here[0], link[0]).alias("a"), F.when(here[1], link[1]).alias("b"), link[0].alias("link_a"), link[1].alias("link_b"))


_DOCUMENTS = "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<a: int, b: int, n: int>>"


def _texts(a: np.ndarray, b: np.ndarray, tokens: np.ndarray, links: np.ndarray) -> pa.Array:
    """The groups of stretches as texts, each group with a semicolon behind it, from
    their places in order (-1: an id that doesn't begin there), and how many tokens and
    places each has; ``LINKS`` at a time."""
    words = pa.array([f"{i}{sign}" for sign in ",|;" for i in range(NO_ID)], pa.large_string())
    ends = np.concatenate([[0], np.cumsum(links)])
    parts, low = [pa.array([], pa.large_string())], 0
    while low < len(tokens):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + LINKS, side="right")) - 1)
        x, y = a[ends[low] : ends[high]], b[ends[low] : ends[high]]
        group = np.cumsum((x >= 0) & (y >= 0))
        at = [np.flatnonzero(own >= 0) for own in (x, y)]
        key = np.concatenate([2 * group[at[0]], 2 * group[at[1]] + 1])
        order = np.argsort(key, kind="stable")
        key, ids = key[order], np.concatenate([x[at[0]], y[at[1]]])[order]
        last = np.append(key[1:] != key[:-1], True)[: len(key)]
        taken = words.take(pa.array(ids + NO_ID * np.where(last, 1 + (key & 1), 0)))
        offsets = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)[np.concatenate([[0], np.cumsum(tokens[low:high])])]
        parts.append(pa.LargeStringArray.from_buffers(high - low, pa.py_buffer(offsets), taken.buffers()[2]))
        low = high
    return pa.concat_arrays(parts)


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A slice's documents from its packed places, see ``documents``."""
    parts: list[list[np.ndarray]] = [[], [], [], []]
    held: list[tuple[np.ndarray, pa.Array, pa.Array]] = []
    for batch in batches:
        number, place = batch["slice"][0].as_py(), batch["place"].to_numpy()
        if (place < 0).any():
            docs = batch.filter(pa.array(place < 0))
            held.append((place[place < 0] >> 34, docs["link"], docs["codes"]))
        parts[3].append(batch["link"].fill_null(-1).to_numpy()[place >= 0])
        place = place[place >= 0]
        for part, c in zip(parts, (place >> 34, (place >> 17 & ID_BITS) - 1, (place & ID_BITS) - 1), strict=False):
            part.append(c.astype(np.int32))
    # places come by codes and begins
    code, a, b, pair = (np.concatenate(parts.pop(0)) for _ in range(4))
    n = int(code[-1]) + 1 if len(code) else 0
    odd = np.zeros(n, bool)
    odd[code[pair < 0]] = True
    if odd.any():
        code, a, b, pair = (x[pair >= 0] for x in (code, a, b, pair))
    each = np.stack([np.bincount(code[x], minlength=n) for x in (a >= 0, b >= 0, (a >= 0) & (b >= 0), a >= -1)], axis=1).astype(np.int64)
    first = np.cumsum(each[:, 3]) - each[:, 3]
    text = _texts(a, b, each[:, 0] + each[:, 1], each[:, 3])
    del code, a, b
    free_memory()
    for codes, doc_ids, stretches in held:
        lists = [np.frombuffer(x, np.int32) for x in stretches.to_pylist()]
        lists = [x if not odd[x].any() else x[:0] for x in lists]
        sums = np.array([each[x].sum(axis=0) for x in lists], np.int64).reshape(len(lists), 4)
        key = (number << 20) - 1 - codes
        start, stop = 0, 0
        while start < len(lists):
            links = 0
            while stop < len(lists) and (stop == start or links + sums[stop, 3] <= LINKS):
                links += sums[stop, 3]
                stop += 1
            yield _some(key[start:stop], doc_ids.slice(start, stop - start), lists[start:stop], sums[start:stop], text, each[:, 3], first, pair)
            start = stop
    free_memory()


def _some(keys: np.ndarray, doc_ids: pa.Array, lists: list[np.ndarray], sums: np.ndarray, text: pa.Array, sizes: np.ndarray, first: np.ndarray, pair: np.ndarray) -> pa.RecordBatch:
    """Some documents from their stretches (``lists``), of which the texts, how many
    links each has and where its first is in ``pair`` are given."""
    shas = []
    for x in lists:
        whole = text.take(pa.array(x))
        offsets = np.frombuffer(whole.buffers()[1], np.int64, len(whole) + 1)
        shas.append(hashlib.sha256(memoryview(whole.buffers()[2])[offsets[0] : offsets[-1] - 1]).hexdigest() if len(x) else "")
    own = np.repeat(np.arange(len(lists), dtype=np.int64) << 32, [len(x) for x in lists]) | np.concatenate(lists)
    own, times = np.unique(own, return_counts=True)  # a document's distinct stretches
    size = sizes[own & 0xFFFFFFFF]
    at = np.repeat(first[own & 0xFFFFFFFF] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    link = np.repeat(own >> 32 << 32, size) | pair[at]
    by = np.argsort(link)
    link, times = link[by], np.repeat(times, size)[by]
    begins = np.flatnonzero(np.append(True, link[1:] != link[:-1])[: len(link)])
    link, times = link[begins], np.add.reduceat(times, begins) if len(begins) else times
    # one more row has in how many of these documents each pair is linked
    told, docs = np.unique(link & 0xFFFFFFFF, return_counts=True)
    ends = np.cumsum([0, *np.bincount(link >> 32, minlength=len(lists)).tolist(), len(told)])
    columns = [np.concatenate([x, y]) for x, y in ((link >> 16 & 0xFFFF, told >> 16), (link & 0xFFFF, told & 0xFFFF), (times, docs))]
    structs = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in columns], names=["a", "b", "n"])
    sums = np.concatenate([sums, np.zeros((1, 4), np.int64)])
    made = {c: pa.array(sums[:, i]) for i, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
    return pa.record_batch({"key": pa.array([*keys.tolist(), None], pa.int64()), "doc_id": pa.array([*doc_ids.to_pylist(), None], pa.int64()), **made, "groups_sha256": pa.array([*shas, None], pa.string()), "pairs": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)})


def documents(found: DataFrame) -> DataFrame:
    """(key, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs) from ``places``;
    pairs are a document's linked ids and how many links each has.  A row without a key
    has pairs of some documents of a slice, and in how many of them each is linked."""
    # few columns: a row's way to Python costs by columns
    long = lambda c, to: F.shiftleft(F.col(c).cast("long"), to)
    a, b = (F.coalesce(F.col(c), F.lit(-1)) + 1 for c in ("a", "b"))
    place = long("code", 34).bitwiseOR(F.shiftleft(a.cast("long"), 17)).bitwiseOR(b.cast("long"))
    link = F.when(F.col("code") < 0, F.col("doc_id")).otherwise(long("link_a", 16).bitwiseOR(F.col("link_b").cast("long")))
    return found.select("slice", place.alias("place"), link.alias("link"), "codes").groupBy("slice").applyInArrow(_put_together, _DOCUMENTS)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, docs, best) over the corpus: in how many documents a and b are linked, and
    whether no other id is linked with a in more."""
    pairs = aligned.filter("key IS NULL").select(F.explode("pairs").alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.n").alias("docs"))
    pairs = written(pairs, "pair-counts")
    top = pairs.groupBy("a").agg(F.max("docs").alias("top"))
    out = pairs.join(top, "a").select("a", "b", "docs", (F.col("docs") == F.col("top")).alias("best"))
    out.written_to = pairs.written_to
    return out


def align(docs: DataFrame, names: tuple[str, str] = (BYTE_BPE, PIECE_BPE)) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of ``docs``
    (doc_id, text), a row for each."""
    aligned = found = written(documents(places(docs, names)), "aligned")
    counts = written_counts = pair_counts(aligned)
    if counts.count() <= BROADCAST_PAIRS:
        counts = F.broadcast(counts)
    aligned = aligned.filter("key IS NOT NULL")
    links = aligned.select("key", F.explode("pairs").alias("p")).select("key", "p.a", "p.b", "p.n").join(counts, ["a", "b"])
    sums = links.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"))
    none = F.lit(0).cast("long")
    out = aligned.drop("pairs").join(sums, "key", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")
    out = written(out, "alignment")
    dropped(found, written_counts)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment of all ``documents``."""
    return align(table(spark, sf_dir, "documents"))
