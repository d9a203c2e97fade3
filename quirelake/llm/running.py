"""Running sums over groups of any size, without a group in one task.

Rows are range-sorted by group and order, so that a large group spans many ranges.
Each range is scanned once with numpy and stored with its own sums; a row for each
range tells what its first and last groups sum up to, from which the driver works out
what every range begins with.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import written

#: Rows that a range has, in expectation.
RANGE_ROWS = 1 << 21

_ENDS = "struct<head: binary, heads: array<bigint>, tail: binary, tails: array<bigint>, one: boolean>"


def range_count(df: DataFrame, rows: int) -> int:
    """Ranges for so many rows: of ``RANGE_ROWS``, or as many as a shuffle has."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // RANGE_ROWS + 1)


def new_groups(columns: list[pa.Array], before: tuple | None) -> np.ndarray:
    """Whether each row begins a group, i.e. differs from the row before it (null
    equals null); ``before`` is the group of the row before the first one."""
    out = np.zeros(len(columns[0]), bool)
    for c in columns:
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        out[1:] |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        out[1:] |= pc.not_equal(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
    out[0] = before is None or tuple(c[0].as_py() for c in columns) != before
    return out


def sums_before(values: np.ndarray, begins: np.ndarray, carry: np.ndarray) -> np.ndarray:
    """For each column of ``values``, the sum of its group's rows before each row; the
    rows before the first beginning go on from ``carry``."""
    total = np.cumsum(values, axis=0) - values
    at = np.maximum.accumulate(np.where(begins, np.arange(len(values)), -1))
    return np.where(at[:, None] < 0, total + carry, total - total[np.maximum(at, 0)])


def _scan(group: list[str], values: list[str], schema: pa.Schema):
    def name(key: tuple) -> bytes:
        return hashlib.md5(repr(key).encode()).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        head, last, carry, heads = None, None, np.zeros(len(values), np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(g)) for g in group]
            begins = new_groups(columns, last)
            own = np.stack([pc.fill_null(batch.column(batch.schema.get_field_index(v)), 0).to_numpy(zero_copy_only=False) for v in values], axis=1).astype(np.int64)
            before = sums_before(own, begins, carry)
            if last is None:
                head = tuple(c[0].as_py() for c in columns)
            first = np.cumsum(begins) == (1 if last is None else 0) if heads is None else np.zeros(len(begins), bool)
            if heads is None and not first.all():  # where the first group ends
                end = int(np.argmin(first))
                heads = before[end - 1] + own[end - 1] if end else carry
            last, carry = tuple(c[-1].as_py() for c in columns), before[-1] + own[-1]
            n = batch.num_rows
            made = [*batch.columns, *(pa.array(before[:, i]) for i in range(len(values))), pa.array(np.full(n, place, np.int32)), pa.array(first), pa.nulls(n, schema.field("__ends").type)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, schema, strict=True)], schema=schema)
        if last is not None:
            ends = {"head": name(head), "heads": (carry if heads is None else heads).tolist(), "tail": name(last), "tails": carry.tolist(), "one": heads is None}
            tail = {"__range": place, "__first": False, "__ends": ends}
            yield pa.RecordBatch.from_arrays([pa.array([tail.get(f.name)], f.type) for f in schema], schema=schema)

    return run


def _carries(ends: list, width: int, modulus: list[int | None]) -> list[list[int]]:
    """What the first group of each range (in order) sums up to before it."""
    out: list[list[int]] = []
    tail, tails = None, [0] * width
    for e in ends:
        carry = list(tails) if e["head"] == tail else [0] * width
        out.append(carry)
        tail, tails = e["tail"], [x + y for x, y in zip(e["tails"], carry if e["one"] else [0] * width, strict=True)]
        tails = [x % m if m else x for x, m in zip(tails, modulus, strict=True)]
    return out


def running(df: DataFrame, group: list[str], order: list[Column], values: list[str], modulus: dict[str, int] | None = None, rows: int | None = None, tag: str = "running") -> DataFrame:
    """``df`` with ``<value>_before`` for each of ``values`` (longs; null: 0), the sum
    over the rows of the same group that come before by ``order``, modulo ``modulus``
    where that has the value.

    ``df`` is counted and sorted, so it should be a written table; ``rows`` spares the
    count.  Rows that ``group`` and ``order`` can't tell apart are in any order: end
    ``order`` by what makes equal rows different, as they all meet in a range else.
    """
    modulus = modulus or {}
    spark = df.sparkSession
    by = [F.col(g).asc_nulls_last() for g in group] + order
    kinds = T.StructType([*df.schema.fields, *(T.StructField(f"{v}_before", T.LongType()) for v in values), T.StructField("__range", T.IntegerType()), T.StructField("__first", T.BooleanType()), T.StructField("__ends", T._parse_datatype_string(_ENDS))])
    kinds = T.StructType([T.StructField(f.name, f.dataType, True) for f in kinds])
    ranged = df.repartitionByRange(range_count(df, df.count() if rows is None else rows), *by).sortWithinPartitions(*by)
    stored = written(ranged.mapInArrow(_scan(group, values, to_arrow_schema(kinds)), kinds), tag)
    ends = sorted(((r["__range"], r["__ends"]) for r in stored.filter("__ends IS NOT NULL").select("__range", "__ends").collect()), key=lambda x: x[0])  # one of each range
    carries = _carries([e for _, e in ends], len(values), [modulus.get(v) for v in values])
    begin = spark.createDataFrame([(r, c) for (r, _), c in zip(ends, carries, strict=True)], "__range int, __carry array<bigint>")
    out = stored.filter("__ends IS NULL").join(F.broadcast(begin), "__range")
    for i, v in enumerate(values):
        whole = F.col(f"{v}_before") + F.when(F.col("__first"), F.col("__carry")[i]).otherwise(0)
        out = out.withColumn(f"{v}_before", F.pmod(whole, F.lit(modulus[v])) if v in modulus else whole)
    out = out.select(*df.columns, *(f"{v}_before" for v in values))
    out.written_to = stored.written_to
    return out
