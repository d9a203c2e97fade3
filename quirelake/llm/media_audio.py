"""Media columns: a text's bytes as audio, and features of that audio.

A payload is kept losslessly as an 8-bit mono WAV clip.  From the samples as they
are read back come, each over the whole clip:

- polyphase resampling to half the rate: the anti-alias filter's even and odd
  taps work on the even and odd samples, so only kept samples are computed;
- log-mel energies of overlapped frames (Hann window, half-overlapping);
- segments of activity by hysteresis: one opens where a frame's energy exceeds a
  high threshold and closes where it falls below a low one;
- a tensor of fixed shape (``SPANS`` x ``MELS``): the mean log-mel energies of
  the clip's equal spans of time, with each span's start and end in seconds.

Tensors and spans are stored as Arrow streams of fixed-shape tensors, a row for each
clip, and what is told of the features is derived from the stored form.

A clip is held whole, 14 bytes for each of its own at most; its frames are transformed
block by block.

Nulls, empty and odd rows: a null payload counts as empty; the payload is padded
with zero bytes to a positive multiple of 64, so the empty text gives 64 zeros; a very
long text is one clip, alone in its batch;
equal texts give equal values; repeated rows give repeated results; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import record_batch, slices, table

RATE = 16_000
UNIT = 64
TAPS = 16
FRAME, HOP = 256, 128
MELS = 16
SPANS = 8
#: Hysteresis: times the clip's mean energy at which a segment opens and closes.
OPEN, CLOSE = 1.1, 0.9
#: Frames that are transformed at once.
BLOCK = 4096


def payload(text: bytes) -> bytes:
    """``text`` with zero bytes up to a positive multiple of ``UNIT``."""
    return text + bytes(-len(text) % UNIT or (0 if text else UNIT))


def to_wav(data: bytes, rate: int = RATE) -> bytes:
    """An 8-bit mono clip of these samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(data)
    return out.getvalue()


def from_wav(clip: bytes) -> tuple[bytes, int]:
    """A clip's samples and their rate."""
    with wave.open(io.BytesIO(clip), "rb") as w:
        return w.readframes(w.getnframes()), w.getframerate()


def _low_pass(taps: int = TAPS) -> np.ndarray:
    """A windowed sinc that passes a quarter of the rate."""
    t = np.arange(taps) - (taps - 1) / 2
    h = np.sinc(t / 2) * np.hanning(taps + 2)[1:-1]
    return (h / h.sum()).astype(np.float32)


def _mel_bank(rate: float, mels: int = MELS, frame: int = FRAME) -> np.ndarray:
    """Triangular filters, equally spaced on the mel scale, by rows of bins."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.arange(frame // 2 + 1) * rate / frame
    up = (f[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[None, 2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


_FILTER = _low_pass()
_WINDOW = np.hanning(FRAME).astype(np.float32)
_BANK = _mel_bank(RATE / 2)


def resample(samples: np.ndarray) -> np.ndarray:
    """Half as many samples: the sum of the two phases' filters."""
    x = (samples.astype(np.float32) - 128) / 128
    x = np.concatenate([np.zeros(TAPS // 2, np.float32), x, np.zeros(TAPS // 2, np.float32)])
    n = len(samples) // 2
    return np.convolve(x[0::2], _FILTER[0::2], "valid")[:n] + np.convolve(x[1::2], _FILTER[1::2], "valid")[:n]


def log_mel(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies (frames x ``MELS``) and each frame's mean square."""
    n = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    x = np.concatenate([samples, np.zeros(max(0, (n - 1) * HOP + FRAME - len(samples)), np.float32)])
    frames = np.lib.stride_tricks.as_strided(x, (n, FRAME), (x.strides[0] * HOP, x.strides[0]), writeable=False)
    mel, energy = [], []
    for i in range(0, n, BLOCK):
        part = frames[i : i + BLOCK] * _WINDOW
        spectrum = np.fft.rfft(part, axis=1)
        mel.append(np.log(np.square(np.abs(spectrum)).astype(np.float32) @ _BANK + np.float32(1e-6)))
        energy.append(np.square(part).mean(axis=1))
    return np.concatenate(mel), np.concatenate(energy)


def segments(energy: np.ndarray, open_: float = OPEN, close: float = CLOSE) -> list[tuple[int, int]]:
    """(first frame, frame after the last) of each stretch that exceeded ``open_``
    times the mean and has not yet fallen below ``close`` times it."""
    mean = float(energy.mean())
    mark = np.where(energy > open_ * mean, 1, np.where(energy < close * mean, -1, 0))
    at = np.flatnonzero(mark)
    # what holds at a frame is the last mark up to it
    last = np.where(mark != 0, np.arange(len(mark)), -1)
    np.maximum.accumulate(last, out=last)
    on = (last >= 0) & (mark[np.maximum(last, 0)] > 0) if len(at) else np.zeros(len(mark), bool)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True))


def features(data: bytes) -> tuple[np.ndarray, list[tuple[float, float]], list[tuple[float, float]]]:
    """The clip's tensor, the spans of its rows and the segments, in seconds."""
    mel, energy = log_mel(resample(np.frombuffer(data, np.uint8)))
    step = HOP / (RATE / 2)
    cuts = [len(mel) * i // SPANS for i in range(SPANS + 1)]
    tensor = np.stack([mel[a : max(b, a + 1)].mean(axis=0) if a < len(mel) else mel[-1] for a, b in zip(cuts, cuts[1:], strict=False)])
    return tensor.astype(np.float32), [(a * step, b * step) for a, b in zip(cuts, cuts[1:], strict=False)], [(a * step, b * step) for a, b in segments(energy)]


#: The stored form's columns: tensors, and times in seconds.
TENSOR = pa.fixed_shape_tensor(pa.float32(), [SPANS, MELS])
TIMES = pa.fixed_shape_tensor(pa.float64(), [SPANS, 2])
STORED = pa.schema([("tensor", TENSOR), ("spans", TIMES), ("segments", pa.list_(pa.list_(pa.float64(), 2)))])


def _fixed(kind: pa.FixedShapeTensorType, parts: list) -> pa.Array:
    flat = np.stack(parts).reshape(-1) if parts else np.zeros(0)
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(flat, kind.value_type), int(np.prod(kind.shape))))


def store(found: list[tuple]) -> bytes:
    """An Arrow stream with a row for each clip's ``features``."""
    segments_ = pa.array([[list(x) for x in f[2]] for f in found], STORED.field("segments").type)
    out = io.BytesIO()
    with pa.ipc.new_stream(out, STORED) as w:
        w.write_batch(pa.RecordBatch.from_arrays([_fixed(TENSOR, [f[0] for f in found]), _fixed(TIMES, [f[1] for f in found]), segments_], schema=STORED))
    return out.getvalue()


def stored(data: bytes) -> list[tuple[np.ndarray, list[tuple[float, float]], list[tuple[float, float]]]]:
    """The features that ``store`` put into a stream."""
    back = pa.ipc.open_stream(data).read_all().combine_chunks()
    if not back.num_rows:
        return []
    tensors, spans = (back.column(c).chunk(0).to_numpy_ndarray() for c in ("tensor", "spans"))
    return [(t, [tuple(x) for x in s.tolist()], [tuple(x) for x in g]) for t, s, g in zip(tensors, spans, back.column("segments").to_pylist(), strict=True)]


def feature_string(tensor: np.ndarray, spans: list[tuple[float, float]], found: list[tuple[float, float]]) -> str:
    """A short text: the bands' mean energies to a tenth, the end of the spans, the
    segments' number and their seconds in all."""
    bands = ",".join(f"{x:.1f}" for x in tensor.mean(axis=0).tolist())
    return f"mel={bands};seconds={spans[-1][1]:.3f};segments={len(found)};active={sum(b - a for a, b in found):.3f}"


def audio_columns(docs: DataFrame) -> DataFrame:
    """(doc_id, media binary, features binary) of ``docs`` (doc_id, text): each clip, and
    its tensor, spans and segments as an Arrow stream of one row (``stored`` reads it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("media", pa.binary()), ("features", pa.binary())])
        for batch, texts in slices(batches):
            clips = [to_wav(payload(t)) for t in texts]
            yield record_batch({"doc_id": batch.column(0), "media": clips, "features": [store([features(from_wav(c)[0])]) for c in clips]}, schema)

    return _narrow(docs).mapInArrow(run, "doc_id long, media binary, features binary")


def digests(docs: DataFrame) -> DataFrame:
    """What ``query`` returns, hashed where the clips are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
        for batch, texts in slices(batches):
            clips = [to_wav(payload(t)) for t in texts]
            back = [from_wav(c)[0] for c in clips]
            found = stored(store([features(b) for b in back]))
            yield record_batch(
                {
                    "doc_id": batch.column(0),
                    "n_bytes": [len(t) for t in texts],
                    "payload_bytes": [len(b) for b in back],
                    "payload_sha256": [hashlib.sha256(b).hexdigest() for b in back],
                    "tail_crc32": [zlib.crc32(b[-UNIT:]) for b in back],
                    "media_bytes": [len(c) for c in clips],
                    "media_sha256": [hashlib.sha256(c).hexdigest() for c in clips],
                    "feature": [feature_string(*x) for x in found],
                },
                schema,
            )

    return _narrow(docs).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips and features of all ``documents``."""
    return digests(table(spark, sf_dir, "documents"))
