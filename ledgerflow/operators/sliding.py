"""Distinct keys and quantiles of sliding time windows in n log n, without an entity in one task.

Spark computes a sliding frame's set or percentile anew for each row, which costs rows times frame. Here rows are dealt by entity and time
bucket, as long as the longest window; a bucket also holds the rows of the one before, which only its windows see. A task streams its rows in
order and takes whole buckets at a time, all of them at once:

- a window's first row is found by binary search over (bucket, time);
- a key is new in a window if its previous row lies before the window's first row: counting these is a dominance count;
- a window's k-th smallest value is a selection inside a range of rows.

Both are answered for all rows at once by the levels of a wavelet matrix, one bit of the values a level.

A row sees the rows of its own time that its tie puts before it, however many there are. Rows without a time get nulls; null keys and values don't
count; a window without values has no quantile.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Distinct:
    """How many different keys stand in the last `micros`."""

    column: str
    micros: int
    kind = T.LongType()


@dataclass(frozen=True)
class Quantile:
    """The interpolated quantile of a numeric column in the last `micros`."""

    column: str
    q: float
    micros: int
    kind = T.DoubleType()


def _levels(values: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of a wavelet matrix, from the highest bit: (bit, zeros among the first k values of the level)."""
    for bit in reversed(range(bits)):
        ones = (values >> bit) & 1 == 1
        yield bit, np.concatenate([[0], np.cumsum(~ones)])
        values = np.concatenate([values[~ones], values[ones]])


def count_below(values: np.ndarray, upto: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each query, how many of values[:upto] are less than bound; values and bounds are not negative."""
    bits = int(max(values.max(initial=0), bound.max(initial=0))).bit_length()
    low, high, found = np.zeros_like(upto), upto, np.zeros_like(upto)
    for bit, zeros in _levels(values, bits):
        one = (bound >> bit) & 1 == 1
        low0, high0 = zeros[low], zeros[high]
        found = found + np.where(one, high0 - low0, 0)
        low, high = np.where(one, zeros[-1] + low - low0, low0), np.where(one, zeros[-1] + high - high0, high0)
    return found


def kth_smallest(values: np.ndarray, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For each query, the k-th smallest (from 0) of values[low:high]; 0 <= k < high - low."""
    found = np.zeros_like(low)
    for bit, zeros in _levels(values, int(values.max(initial=0)).bit_length()):
        low0, high0 = zeros[low], zeros[high]
        one = k >= high0 - low0
        found = found | (one.astype(found.dtype) << bit)
        k = np.where(one, k - (high0 - low0), k)
        low, high = np.where(one, zeros[-1] + low - low0, low0), np.where(one, zeros[-1] + high - high0, high0)
    return found


def distinct_in(first: np.ndarray, group: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Different codes among the rows first[i]..i of a group; a negative code doesn't count."""
    n = len(codes)
    order = np.lexsort((np.arange(n), codes, group))
    same = (codes[order][1:] == codes[order][:-1]) & (group[order][1:] == group[order][:-1])
    previous = np.full(n, -1, dtype=np.int64)
    previous[order[1:][same]] = order[:-1][same]
    counts = codes >= 0
    # all rows before first[i] have their previous row before it too
    held = np.concatenate([[0], np.cumsum(counts)])
    before = previous[counts] + 1
    return count_below(before, held[np.arange(n) + 1], first + 1) - held[first]


def quantile_in(first: np.ndarray, values: np.ndarray, filled: np.ndarray, q: float) -> tuple[np.ndarray, np.ndarray]:
    """The interpolated quantile of the filled values among the rows first[i]..i, and where there is one."""
    held = np.concatenate([[0], np.cumsum(filled)])
    low, high = held[first], held[np.arange(len(values)) + 1]
    some = high > low
    known, ranks = np.unique(values[filled], return_inverse=True)
    place = (high - low - 1)[some] * q
    below = np.floor(place).astype(np.int64)
    at = lambda k: known[kth_smallest(ranks.astype(np.int64), low[some], high[some], k)]
    out = np.zeros(len(values))
    a = at(below)
    out[some] = a + (at(np.ceil(place).astype(np.int64)) - a) * (place - below)
    return out, some


def _changes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Where a value differs from the one before; a null differs from all values but null."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    differs = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(differs, pc.not_equal(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _measured(rows: pa.Table, measures: dict, names: list[str], longest: int) -> Iterator[pa.RecordBatch]:
    """Whole buckets, in order, with the measures of the rows that are their bucket's own."""
    starts = np.concatenate([[True], _changes(rows["__entity"]) | _changes(rows["__bucket"])])
    group = np.cumsum(starts) - 1
    bucket = rows["__bucket"].to_numpy()
    # times from the start of the bucket before: less than two windows long, so three apart keep groups apart
    since = rows["__time"].to_numpy() - (bucket - 1) * longest
    own = rows["__own"].to_numpy() == bucket
    ordered = group * (3 * longest) + since
    arrays = []
    for m in measures.values():
        first = np.searchsorted(ordered, ordered - m.micros, "left")
        column = rows[f"__in_{m.column}"].combine_chunks()
        if isinstance(m, Distinct):
            codes = pc.fill_null(pc.cast(column.dictionary_encode().indices, pa.int64()), -1).to_numpy(zero_copy_only=False)
            arrays.append(pa.array(distinct_in(first, group, codes)[own], pa.int64()))
        else:
            filled = pc.is_valid(column).to_numpy(zero_copy_only=False)
            values, some = quantile_in(first, pc.fill_null(column, 0.0).to_numpy(zero_copy_only=False), filled, m.q)
            arrays.append(pa.array(values[own], pa.float64(), mask=~some[own]))
    kept = rows.select(names).filter(pa.array(own))
    for name, a in zip(measures, arrays):
        kept = kept.append_column(name, a)
    yield from kept.combine_chunks().to_batches(max_chunksize=10_000)


def _streamed(batches: Iterator[pa.RecordBatch], measures: dict, names: list[str], longest: int, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Collects batches until a bucket is whole, and gives out whole buckets once there are enough rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            rows = pa.Table.from_batches(held)
            changed = np.flatnonzero(_changes(rows["__entity"]) | _changes(rows["__bucket"]))
            if len(changed):
                cut = int(changed[-1]) + 1
                yield from _measured(rows.slice(0, cut), measures, names, longest)
                rows = rows.slice(cut)
            held, n = rows.to_batches(), rows.num_rows
    if n:
        yield from _measured(pa.Table.from_batches(held), measures, names, longest)


def over_windows(df: DataFrame, measures: dict[str, Distinct | Quantile], entity: str = "cc_num", time: str = "us", tie: str = "transaction_id") -> DataFrame:
    """df with a column for each measure, over the rows of the entity in its last `micros`, this row and those tied before it included."""
    longest = max(m.micros for m in measures.values())
    inputs = {m.column: F.col(m.column).cast("double") if isinstance(m, Quantile) else F.col(m.column) for m in measures.values()}
    own = F.floor(F.col(time) / longest)
    rows = df.where(F.col(time).isNotNull()).withColumns({"__entity": F.col(entity), "__time": F.col(time), "__own": own} | {f"__in_{c}": v for c, v in inputs.items()})
    rows = rows.withColumn("__bucket", F.explode(F.array("__own", F.col("__own") + 1)))
    dealt = rows.repartition("__entity", "__bucket").sortWithinPartitions("__entity", "__bucket", "__time", tie)
    schema = T.StructType([*df.schema, *[T.StructField(name, m.kind) for name, m in measures.items()]])
    names = df.columns
    found = dealt.mapInArrow(lambda batches: _streamed(batches, measures, names, longest), schema)
    untimed = df.where(F.col(time).isNull()).withColumns({name: F.lit(None).cast(m.kind) for name, m in measures.items()})
    return found.unionByName(untimed)
