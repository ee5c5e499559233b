"""Pairs of users as packed bytes: every user is sent once with the later users of a list, in a few bytes each, to the task that counts its pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _bytes(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest bytes of whole numbers."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).ravel()


def _numbers(column: pa.BinaryArray, width: int) -> np.ndarray:
    """The whole numbers of all rows, from their lowest bytes."""
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)
    wide = np.zeros((len(data), 8), np.uint8)
    wide[:, :width] = data
    return wide.view("<u8").ravel()


def _binary(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """data cut at starts."""
    offsets = np.append(starts, len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def lists(batches, block: int):
    """(key, users) of rows that are sorted by key and user: the distinct users of a key, in lists of at most `block`; what a batch leaves open goes on in the next."""
    keys = users = names = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.column(1).to_numpy(zero_copy_only=False)
        keys, users = (batch.column(0), own) if keys is None else (pa.concat_arrays([keys, batch.column(0)]), np.concatenate([users, own]))
        names = batch.schema.names
        new = np.append(True, pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False).astype(bool))
        kept = np.flatnonzero(new | np.append(True, users[1:] != users[:-1]))
        keys, users, new = keys.take(pa.array(kept)), users[kept], new[kept]
        first = np.flatnonzero(new)
        place = np.arange(len(users)) - first[np.cumsum(new) - 1]
        starts = np.flatnonzero(place % block == 0)
        if len(starts) > 1:
            given = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(users[: starts[-1]]))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(starts[:-1])), given], names)
        keys, users = keys[int(starts[-1]) :], users[starts[-1] :]
    if keys is not None:
        yield pa.RecordBatch.from_arrays([keys[:1], pa.ListArray.from_arrays(pa.array([0, len(users)], pa.int32()), pa.array(users))], names)


def packed(batches, tasks: int, width: int, most: int = 1 << 21):
    """(task, owners, counts, others) of rows (xs, ys): each of xs owns its pairs with all of ys or, where these are null, with the later ones of xs."""
    names = ["task", "owners", "counts", "others"]
    for batch in batches:
        x, y = (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
        nx, ny = (c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
        values, row, after = np.concatenate([x, y]), np.repeat(np.arange(len(nx)), nx), np.arange(len(x)) + 1
        # where the users that a user is met with begin, and how many they are
        across = ny[row] > 0
        start = np.where(across, len(x) + (np.cumsum(ny) - ny)[row], after)
        count = np.where(across, ny[row], np.cumsum(nx)[row] - after)
        task = ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % tasks
        some = np.flatnonzero(count > 0)
        for piece in np.split(some, np.flatnonzero(np.diff(np.cumsum(count[some]) // most)) + 1):
            if not len(piece):
                continue
            order = piece[np.argsort(task[piece], kind="stable")]
            c = count[order]
            first = np.cumsum(c) - c
            others = values[np.repeat(start[order] - first, c) + np.arange(c.sum())]
            to, at = np.unique(task[order], return_index=True)
            columns = [_binary(_bytes(x[order], width), at * width), _binary(_bytes(c, 2), at * 2), _binary(_bytes(others, width), first[at] * width)]
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *columns], names)


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[starts], np.add.reduceat(counts[order], starts)


def counted(batches, low: int, width: int, most: int = 1 << 21, rows: int = 1 << 17):
    """(a, b, shared) of the packed pairs that a task got; what it holds is bounded by its distinct pairs, however often they come."""
    bits, held, n, keys, counts = np.uint64(8 * width), [], 0, np.empty(0, np.uint64), np.empty(0, np.int64)

    def met() -> tuple[np.ndarray, np.ndarray]:
        new, times = np.unique(np.concatenate(held), return_counts=True)
        return _added(np.concatenate([keys, new]), np.concatenate([counts, times])) if len(keys) else (new, times)

    for batch in batches:
        if not batch.num_rows:
            continue
        owners, times, others = (_numbers(batch.column(k), w) for k, w in ((1, width), (2, 2), (3, width)))
        held.append(np.repeat(owners, times.astype(np.int64)) << bits | others)
        n += len(others)
        if n >= max(most, len(keys)):
            keys, counts = met()
            held, n = [], 0
    if held:
        keys, counts = met()
    for k in range(0, len(keys), rows):
        own = keys[k : k + rows]
        a, b = (pa.array(v.astype(np.int64) + low) for v in (own >> bits, own & ((np.uint64(1) << bits) - np.uint64(1))))
        yield pa.RecordBatch.from_arrays([a, b, pa.array(counts[k : k + rows].astype(np.int64))], ["a", "b", "shared"])
