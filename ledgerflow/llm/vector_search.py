"""Nearest neighbours by an adaptive dimension scan of inverted lists.

Vectors are turned by a random orthogonal matrix, which spreads their length evenly over the dimensions, and lie in column blocks. For a
query the blocks of a list are read one after another. After each block a hypothesis test compares the distance over the
dimensions read so far, scaled up to all, with the K-th best distance found: candidates beyond (1 + EPSILON / sqrt(dimensions))
times that are abandoned. Those that remain get their exact distance on the original vectors. A query reads its nearest list
first; the K-th distance found there goes with it to the other lists as their bound, which each chunk tightens by the exact
distances of those that look nearest after the first block.

Lists are the cells of centroids fitted on a bounded sample, which also gives the number of lists to probe: the least
that holds TARGET of the sample's true neighbours. All rows are indexed. Equal vectors are scanned once and
stand for their K + 1 smallest ids (no query needs more of them); lists are cut into chunks by id, and the queries of a chunk too,
so that no task holds a list, however many vectors crowd in it.

Defined cases: vectors that are null, zero, hold null or non-finite components or have another length than the most
frequent take no part; fewer than K candidates give all of them; ties go to the smaller id; rows that repeat an id are one
candidate for each distinct vector; rows without an id take no part; further columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged, table

K = 10
#: Vectors that the index is fitted on at most, and their bytes; of the sample for each list at least; sample queries that set the probes.
SAMPLE, SAMPLE_BYTES, PER_LIST, TRIALS = 20_000, 64 << 20, 32, 400
TARGET = 0.99
#: Vectors of a chunk of a list, queries of a chunk, dimensions of a column block, and the slack of the test.
CHUNK, QUERIES, BLOCK, EPSILON = 8192, 4096, 16, 2.1
SEED = 11


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0)


class Index:
    """Centroids, the rotation and how many lists a query probes."""

    def __init__(self, sample: np.ndarray, k: int = K, total: int | None = None):
        rng = np.random.default_rng(SEED)
        n, d = sample.shape
        self.rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
        # lists grow with the table, as far as the sample can place them
        lists = int(max(1, min(np.sqrt(total or n), n // PER_LIST)))
        self.centroids = sample[rng.choice(n, lists, replace=False)]
        for _ in range(12):
            cell = self.cells(sample)
            sums = np.zeros((lists, d))
            np.add.at(sums, cell, sample)
            counts = np.bincount(cell, minlength=lists)
            self.centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], self.centroids)
        cell = self.cells(sample)
        trial = rng.choice(n, min(TRIALS, n), replace=False)
        far = _squares(sample[trial], sample)
        far[np.arange(len(trial)), trial] = np.inf
        near = np.argsort(far, axis=1)[:, : min(k, n - 1)]
        order = np.argsort(_squares(sample[trial], self.centroids), axis=1)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(lists)[None, :], axis=1)
        ranks = np.sort(np.take_along_axis(place, cell[near], axis=1).ravel())
        self.probes = int(ranks[min(len(ranks) - 1, int(np.ceil(TARGET * len(ranks))))]) + 1 if len(ranks) else lists

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([_squares(x[i : i + 4096], self.centroids).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)

    def probed(self, x: np.ndarray, sizes: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The lists that each query reads: first the nearest, until they hold k vectors, then up to `probes` of them."""
        order = np.argsort(_squares(x, self.centroids), axis=1)
        held = np.cumsum(sizes[order], axis=1)
        enough = [int(np.searchsorted(h, k)) + 1 for h in held]
        return [(o[:e], o[e : max(self.probes, e)]) for o, e in zip(order, enough)]


def scan(base: np.ndarray, turned: np.ndarray, query: np.ndarray, turned_query: np.ndarray, k: int, bound: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(places, exact squared distances) of the k nearest vectors of one list chunk that lie within bound (squared), found by the adaptive scan."""
    n, d = base.shape
    exact = lambda at: ((base[at] - query) ** 2).sum(1)
    alive, partial = np.arange(n), np.zeros(n)
    for start in range(0, d, BLOCK):
        end = min(d, start + BLOCK)
        partial += ((turned[start:end, alive] - turned_query[start:end, None]) ** 2).sum(0)
        if not start and n >= k:
            m = min(n, max(2 * k, 64))
            bound = min(bound, np.partition(exact(np.argpartition(partial, m - 1)[:m]), k - 1)[k - 1])
        keep = partial * d / end <= bound * (1 + EPSILON / np.sqrt(end)) ** 2 if end < d else partial <= bound * (1 + 1e-9)
        alive, partial = alive[keep], partial[keep]
        if not len(alive):
            break
    best = exact(alive)
    if len(best) > k:
        kept = best <= np.partition(best, k - 1)[k - 1]
        alive, best = alive[kept], best[kept]
    return alive, best


def nearest(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest rows, itself left out, by Euclidean distance."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q")).where(F.col("id").isNotNull() & usable(F.col("v")))
    rows = staged(rows.withColumn("h", F.md5(F.concat_ws(",", F.col("v").cast("array<string>")))), "vectors")
    empty = rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return empty
    d = common["d"]
    rows = rows.where(F.size("v") == d)
    # the smallest ids of each distinct vector
    ids = rows.select("h", "id").distinct().withColumn("r", F.row_number().over(W.partitionBy("h").orderBy("id"))).where(F.col("r") <= k + 1).select("h", "id")
    ids = staged(ids, "ids")
    distinct = staged(rows.groupBy("h").agg(F.min(F.struct("id", "v")).alias("m"), F.max("q").alias("q")).select("h", F.col("m.v").alias("v"), F.coalesce("q", F.lit(False)).alias("q")), "distinct")
    size = min(SAMPLE, SAMPLE_BYTES // (8 * d))
    sample = np.array([r["v"] for r in distinct.select("v", F.xxhash64("h").alias("o")).orderBy("o").limit(size).select("v").collect()])
    index = Index(sample, k, distinct.count())

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(list=index.cells(np.array(b["v"].tolist()).reshape(-1, d)).astype("int32"))

    placed = staged(distinct.mapInPandas(place, "h string, v array<double>, q boolean, list int"), "placed")
    counts = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}  # one row a list, at most SAMPLE / PER_LIST
    sizes = np.array([counts.get(j, 0) for j in range(len(index.centroids))])

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first, lists in enumerate(zip(*index.probed(np.array(b["v"].tolist()).reshape(-1, d), sizes, k + 1))):
                yield b[["h", "v"]].assign(list=lists, first=first == 0).explode("list").dropna(subset="list").astype({"list": "int32"})

    queries = staged(placed.where("q").select("h", "v").mapInPandas(probe, "h string, v array<double>, list int, first boolean"), "queries")
    chunks = staged(placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")), "chunks")
    one_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    keys = ["list", "chunk", "part"]

    def found(b: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if len(b) and len(q):
            x, y = np.array(b["v"].tolist()), np.array(q["v"].tolist())
            turned, turned_y, names = np.ascontiguousarray((x @ index.rotation).T), y @ index.rotation, b["h"].to_numpy()
            out = [scan(x, turned, y[j], turned_y[j], k + 1, bound * bound * (1 + 1e-9)) for j, bound in enumerate(q["bound"])]
            asked = np.repeat(q["h"].to_numpy(), [len(at) for at, _ in out])
            return pd.DataFrame({"asked": asked, "h": names[np.concatenate([at for at, _ in out])], "score": np.sqrt(np.concatenate([x for _, x in out]))})
        return pd.DataFrame({"asked": [], "h": [], "score": []})

    def scanned(asking: DataFrame) -> DataFrame:
        """The k + 1 nearest distinct vectors that each of asking (h, v, list, bound) finds in its lists; enough for every query with this vector."""
        loads = asking.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts"))
        loads = staged(loads.join(chunks, "list"), "loads")
        base = placed.join(loads, "list").withColumn("chunk", F.pmod(F.xxhash64("h"), F.col("chunks"))).withColumn("part", F.explode(one_of("parts"))).select("list", "chunk", "part", "h", "v")
        asked = asking.join(loads, "list").withColumn("part", F.pmod(F.xxhash64("h"), F.col("parts"))).withColumn("chunk", F.explode(one_of("chunks")))
        asked = asked.select("list", F.col("chunk").cast("long").alias("chunk"), F.col("part").cast("int").alias("part"), "h", "v", "bound")
        hits = base.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(found, "asked string, h string, score double")
        hits = hits.withColumn("r", F.rank().over(W.partitionBy("asked").orderBy("score"))).where(F.col("r") <= k + 1)
        return staged(hits.select("asked", "h", "score"), "hits")

    near = scanned(queries.where("first").withColumn("bound", F.lit(float("inf"))))
    bounds = near.groupBy("asked").agg(F.when(F.count(F.lit(1)) > k, F.max("score")).otherwise(float("inf")).alias("bound")).withColumnRenamed("asked", "h")
    hits = near.unionByName(scanned(queries.where("NOT first").join(bounds, "h")))
    hits = hits.withColumn("r", F.rank().over(W.partitionBy("asked").orderBy("score"))).where(F.col("r") <= k + 1)
    hits = staged(hits.select("asked", "h", "score"), "hits")
    members = hits.join(ids, "h").select("asked", F.col("id").alias("vec_id"), "score")
    order = W.partitionBy("asked").orderBy("score", "vec_id")
    members = staged(members.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).groupBy("asked").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near")), "near")
    asking = rows.where("q").select(F.col("id").alias("query_id"), F.col("h").alias("asked")).distinct()
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = asking.join(members, "asked").select("query_id", F.posexplode(others).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def op4_vector_search(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
