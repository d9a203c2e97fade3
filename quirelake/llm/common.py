"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..scratch import dropped, shared_dir, written

__all__ = ["dropped", "free_memory", "hf_tokenizer", "input_bytes", "public_tokenizer", "record_batch", "shared_dir", "slices", "table", "text_slices", "written"]

#: Rows of an Arrow batch that one step of a Python worker holds as objects.
SLICE_ROWS = 512
#: Bytes of text that one such step holds at most, unless one row has more.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Pieces of Arrow batches with their texts as UTF-8 (null: empty), a few
    megabytes at a time; a single longer text comes alone, whole."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        start, size = 0, 0
        texts: list[bytes] = []
        for i in range(batch.num_rows):
            value = column[i].as_py() or b""
            if texts and (size + len(value) > SLICE_BYTES or len(texts) >= SLICE_ROWS):
                yield batch.slice(start, len(texts)), texts
                start, size, texts = i, 0, []
            texts.append(value)
            size += len(value)
        if texts:
            yield batch.slice(start, len(texts)), texts
    free_memory()


def text_slices(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = 2 * SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Pieces of Arrow batches with their texts as an array of large strings (null:
    empty), of about ``most`` bytes; a single longer text comes alone, whole."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).fill_null("")
        size = np.cumsum(pc.binary_length(column).to_numpy())
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + most, side="right")))
            yield batch.slice(start, stop - start), column.slice(start, stop - start)
            start = stop
    free_memory()


def free_memory() -> None:
    """Gives a Python worker's unused memory back, as it goes on to other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def record_batch(columns: dict[str, list | pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    """A batch of ``schema`` from lists or arrays."""
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for f in schema], schema=schema)


_tokenizers: dict[str, object] = {}


def hf_tokenizer(path: str):
    """The tokenizers library's tokenizer of ``path`` (a name without a slash is
    an installed vocabulary file) without truncation or padding; one for each
    process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    if path not in _tokenizers:
        made = Tokenizer.from_file(path if "/" in path else public_tokenizer(path))
        made.no_truncation()
        made.no_padding()
        _tokenizers[path] = made
    return _tokenizers[path]


def public_tokenizer(name: str) -> str:
    """Where the installed vocabulary file ``name`` is, on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def input_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of the bytes that ``df`` reads, to size things by;
    1 GB where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 50 else 1 << 30
