"""Exact nearest neighbours of every row among all rows, by pivots and the triangle inequality; numbers and names both count.

Two rows are apart by the root of the squares of their scaled numbers' differences, and of the median deviation for every name in which they
differ: a distance in a Euclidean space, so the triangle inequality holds. Rows alike in all columns are one point, whose first ids stand for it; no
number of equal rows makes a point larger. A bounded sample of the points are pivots, and each point belongs to its nearest pivot's cell. The cells'
radii bound how far a point's k-th neighbour can be, and that bound says which cells can hold one: a point is sent to these
cells alone, and there only meets points whose distance from the pivot is near enough to its own. Cells are cut into chunks, and the points that
search them into blocks, so that a task holds one chunk and streams the others past it.

Defined cases: a null number counts as 0, a null name as a name of its own; with k or fewer other rows all of them are neighbours; ties go to
the smaller id; ids are whole numbers, different for each row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import median

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.workspace import staged
from .graphs import heavy_join

#: Pivots at most; points of a cell that a task holds at once, and points that search them in one task.
PIVOTS, CHUNK, BLOCK = 1024, 4096, 1 << 16
#: Bounds are widened by this share, so that rounding loses no neighbour.
ROUNDING = 1e-9


@dataclass(frozen=True)
class Space:
    """The columns, how the numbers are scaled, and what a different name counts."""

    numbers: tuple[str, ...]
    names: tuple[str, ...]
    scales: tuple[float, ...]
    unlike: float


def space(rows: DataFrame, numbers: list[str], names: list[str], scaled: bool = True) -> Space:
    """Scales are the columns' sample deviations (1 where there is none); a different name counts their median, after scaling."""
    row = rows.agg(*[F.stddev_samp(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"d{k}") for k, c in enumerate(numbers)]).first()
    deviations = [d if d and np.isfinite(d) else 1.0 for d in row]
    return Space(tuple(numbers), tuple(names), tuple(deviations if scaled else [1.0] * len(numbers)), 1.0 if scaled else median(deviations))


def points(rows: DataFrame, own: Space, id_col: str, k: int) -> DataFrame:
    """(key, pid, x, names, ids): the different points, with their first k + 1 ids."""
    first = W.partitionBy("key").orderBy("id")
    ids = rows.select(_key(own).alias("key"), F.col(id_col).cast("long").alias("id")).withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= k + 1)
    found = ids.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    x = F.array(*[F.col(f"key.x{i}") / F.lit(float(s)) for i, s in enumerate(own.scales)])
    names = F.array(*[F.col(f"key.n{i}") for i in range(len(own.names))]).cast("array<string>")
    return staged(found.select("key", F.monotonically_increasing_id().alias("pid"), x.alias("x"), names.alias("names"), "ids"), "points")


def _key(own: Space):
    values = [(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) + F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(own.numbers)]
    return F.struct(*values, *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(f"n{i}") for i, c in enumerate(own.names)])


class Pivots:
    """Distances of points to the pivots, and of points to each other."""

    def __init__(self, x: np.ndarray, names: list[list[str]], unlike: float):
        self.x, self.unlike = x, unlike
        self.codes = [{v: k for k, v in enumerate(dict.fromkeys(column))} for column in zip(*names)]
        self.names = self.coded(names)

    def coded(self, names: list[list[str]]) -> np.ndarray:
        """Names as numbers; those that no pivot has are unlike every pivot."""
        return np.array([[c.get(v, -1) for c, v in zip(self.codes, row)] for row in names], dtype=np.int64).reshape(len(names), len(self.codes))

    def distances(self, x: np.ndarray, names: list[list[str]]) -> np.ndarray:
        coded = self.coded(names)
        squares = np.zeros((len(x), len(self.x)))
        for c in range(self.x.shape[1]):
            squares += (x[:, c, None] - self.x[None, :, c]) ** 2
        for c in range(len(self.codes)):
            squares += self.unlike**2 * (coded[:, c, None] != self.names[None, :, c])
        return np.sqrt(squares)


def _columns(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
    return batch.column("pid").to_numpy(), x, batch.column("names").to_pylist()


def _assigned(batches: Iterator[pa.RecordBatch], pivots: Pivots, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 1024):
            part = batch.slice(low, 1024)
            pid, x, names = _columns(part, width)
            d = pivots.distances(x, names)
            cell = d.argmin(axis=1)
            arrays = [pa.array(pid), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])]
            yield pa.RecordBatch.from_arrays(arrays, ["pid", "cell", "radius"])


def _searching(batches: Iterator[pa.RecordBatch], pivots: Pivots, width: int, farthest: np.ndarray, nearest: list[np.ndarray], between: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Each point with the cells that may hold one of its k + 1 nearest (it is one of them), its distance from their pivots, and its bound."""
    place = np.repeat(np.arange(len(nearest)), [len(t) for t in nearest])
    known = np.concatenate(nearest)
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            pid, x, names = _columns(batch.slice(low, 256), width)
            d = pivots.distances(x, names)
            own = d.argmin(axis=1)
            bound = np.full(len(d), np.inf)
            if len(known) > k:
                bound = np.partition(d[:, place] + known[None, :], k, axis=1)[:, k]
            bound = bound * (1 + ROUNDING) + ROUNDING
            home, gap = d[np.arange(len(d)), own][:, None], between[own]
            with np.errstate(divide="ignore", invalid="ignore"):
                side = np.where(gap > 0, (d**2 - home**2) / (2 * gap), 0.0)  # how far behind the plane between two pivots
            row, cell = np.nonzero((d - farthest[None, :] <= bound[:, None]) & (side <= bound[:, None] * (1 + ROUNDING) + ROUNDING))
            yield pa.RecordBatch.from_arrays([pa.array(pid[row]), pa.array(cell, pa.int32()), pa.array(d[row, cell]), pa.array(bound[row])], ["pid", "cell", "radius", "bound"])


def _met(batches: Iterator[pa.RecordBatch], width: int, unlike: float, k: int) -> Iterator[pa.RecordBatch]:
    """Chunks, each followed by the points that search it: the k + 1 nearest points that each of these finds there."""
    chunk, held, codes, table = None, [], [], None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("cell", "chunk", "block"))))
        kinds, radius, bound, first = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "radius", "bound", "first"))
        pid, x, names = _columns(batch, width)
        out = []
        for i, key in enumerate(keys):
            if key != chunk:
                chunk, held, table = key, [], None
                codes = [{} for _ in range(len(names[i]))]
            row = [c.setdefault(v, len(c)) for c, v in zip(codes, names[i])]
            if kinds[i] == 0:
                held.append((radius[i], pid[i], first[i], x[i], row))
                continue
            if not held:
                continue
            if table is None:
                r, p, f, xs, ns = zip(*held)
                table = np.array(r), np.array(p), np.array(f), np.array(xs), np.array(ns, dtype=np.int64).reshape(len(r), len(codes))
            r, p, f, xs, ns = table
            # the chunk is sorted by radius: who is farther off from it than the bound is farther from this point
            a, b = np.searchsorted(r, radius[i] - bound[i], "left"), np.searchsorted(r, radius[i] + bound[i], "right")
            squares = ((xs[a:b] - x[i]) ** 2).sum(axis=1) + unlike**2 * (ns[a:b] != np.array(row, dtype=np.int64)).sum(axis=1)
            gap = np.sqrt(squares)
            near = np.flatnonzero(gap <= bound[i])
            near = near[np.lexsort((f[a:b][near], gap[near]))[: k + 1]]
            out += [(pid[i], p[a + n], gap[n], f[a + n]) for n in near]
        yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64()))], ["pid", "other", "gap", "first"])


def nearest(rows: DataFrame, own: Space, id_col: str, k: int = 5, pivots: int = PIVOTS, chunk: int = CHUNK, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(id, near) of every row, near its k nearest other rows as (gap, id, pid), nearest first; and the points (pid, key, x, names, ids)."""
    spots = points(rows, own, id_col, k)
    wide, n, width = spots.select("pid", "x", "names"), spots.count(), len(own.numbers)
    chosen = wide.orderBy(F.xxhash64("pid"), "pid").limit(max(1, min(pivots, int(n**0.5) + 1))).collect()  # at most `pivots` rows
    if not chosen:
        return rows.select(F.col(id_col).alias("id"), F.array().cast("array<struct<gap: double, id: bigint, pid: bigint>>").alias("near")), spots
    centres = Pivots(np.array([r["x"] for r in chosen], float).reshape(len(chosen), width), [r["names"] for r in chosen], own.unlike)
    cells = staged(wide.mapInArrow(lambda b: _assigned(b, centres, width), "pid long, cell int, radius double"), "cells")
    inner = cells.withColumn("__r", F.row_number().over(W.partitionBy("cell").orderBy("radius"))).where(F.col("__r") <= k + 1)
    facts = cells.groupBy("cell").agg(F.max("radius").alias("far"), F.count(F.lit(1)).alias("n")).join(inner.groupBy("cell").agg(F.collect_list("radius").alias("near")), "cell").collect()  # a row a pivot
    farthest, closest = np.full(len(chosen), -np.inf), [np.empty(0)] * len(chosen)
    for f in facts:
        farthest[f["cell"]], closest[f["cell"]] = f["far"], np.array(f["near"])
    between = centres.distances(centres.x, [r["names"] for r in chosen])
    searching = staged(wide.mapInArrow(lambda b: _searching(b, centres, width, farthest, closest, between, k), "pid long, cell int, radius double, bound double"), "searches")
    sizes = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("chunks")).join(searching.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks")), "cell")
    sizes = F.broadcast(staged(sizes, "sizes"))  # a row a pivot
    part = lambda c, of: F.pmod(F.xxhash64(F.lit(of), "pid"), F.col(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    full = spots.select("pid", "x", "names", F.col("ids")[0].alias("first"))
    columns = ["cell", "chunk", "block", "kind", "pid", "radius", "bound", "first", "x", "names"]
    held = cells.join(sizes, "cell").withColumns({"chunk": part("pid", "chunks"), "kind": F.lit(0), "bound": F.lit(0.0)}).withColumn("block", every("blocks")).join(full, "pid")
    asks = searching.join(sizes, "cell").withColumns({"block": part("pid", "blocks"), "kind": F.lit(1)}).withColumn("chunk", every("chunks")).join(full, "pid")
    dealt = held.select(*columns).unionByName(asks.select(*columns)).repartition("cell", "chunk", "block").sortWithinPartitions("cell", "chunk", "block", "kind", "radius", "pid")
    unlike = own.unlike
    found = dealt.mapInArrow(lambda b: _met(b, width, unlike, k), "pid long, other long, gap double, first long")
    best = found.withColumn("__r", F.row_number().over(W.partitionBy("pid").orderBy("gap", "first"))).where(F.col("__r") <= k + 1)
    lists = best.join(spots.select(F.col("pid").alias("other"), "ids"), "other").select("pid", "gap", F.col("other"), F.explode("ids").alias("id"))
    near = lists.groupBy("pid").agg(F.slice(F.sort_array(F.collect_list(F.struct("gap", "id", F.col("other").alias("pid")))), 1, k + 1).alias("near"))  # (k + 1)^2 ids at most
    by_point = near.join(spots.select("pid", "key"), "pid").select("key", "near")
    keyed = rows.select(F.col(id_col).cast("long").alias("id"), _key(own).alias("key"))
    by_point = staged(by_point.join(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key"), "near")
    met = heavy_join(keyed, by_point, "key", "n")
    return met.select("id", F.slice(F.filter("near", lambda o: o["id"] != F.col("id")), 1, k).alias("near")), spots
