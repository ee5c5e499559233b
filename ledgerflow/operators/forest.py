"""Isolation forest as Spark jobs: hash-drawn samples, a tree for each group, scores by a broadcast node table.

A tree needs `sample` rows only, so its group is bounded whatever the table's size. The node table has at most
trees * 2 * sample rows. Scores are 2 ** (-mean path / expected path).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NODES = "tree int, node int, feature int, cut double, size double"


def expected_path(n: float) -> float:
    """Mean path of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _grow(rows: pd.DataFrame, columns: list[str], sample: int, seed: int) -> pd.DataFrame:
    tree = int(rows["tree"].iloc[0])
    x, rng = rows.sort_values("draw")[columns].to_numpy(float), np.random.default_rng([seed, tree])
    depth, out, todo = int(np.ceil(np.log2(max(sample, 2)))), [], [(1, np.arange(len(x)), 0)]
    while todo:
        node, at, level = todo.pop()
        low, high = (x[at].min(0), x[at].max(0)) if len(at) else (np.zeros(len(columns)), np.zeros(len(columns)))
        usable = np.flatnonzero(high > low)
        if level >= depth or len(at) <= 1 or not len(usable):
            out.append((tree, node, -1, 0.0, float(len(at))))
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(low[f], high[f]))
        out.append((tree, node, f, cut, float(len(at))))
        todo += [(2 * node, at[x[at, f] < cut], level + 1), (2 * node + 1, at[x[at, f] >= cut], level + 1)]
    return pd.DataFrame(out, columns=["tree", "node", "feature", "cut", "size"])


def fit(df: DataFrame, columns: list[str], id_col: str, trees: int = 100, sample: int = 256, seed: int = 5) -> DataFrame:
    """The node table. A row is drawn for a tree by a hash of both, with a margin that the exact size is then cut from."""
    n = df.count()
    share = min(1.0, 2.0 * sample / max(n, 1))
    draws = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))) if share >= 1 else None
    rows = df.select(F.col(id_col).cast("string").alias("id"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    if draws is None:
        # which trees take a row: those whose hash falls below the share
        low = int(share * 2**31)
        hit = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64(F.lit(seed), t, F.col("id")), F.lit(2**31)) < low)
        draws = F.explode(hit)
    drawn = rows.withColumn("tree", draws).withColumn("draw", F.xxhash64(F.lit(seed + 1), "tree", "id"))
    drawn = drawn.withColumn("r", F.row_number().over(W.partitionBy("tree").orderBy("draw", "id"))).where(F.col("r") <= sample).drop("r")
    return drawn.groupBy("tree").applyInPandas(lambda g: _grow(g, columns, sample, seed), NODES)


def _dense(tree: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a tree, by node number: feature (-1: a leaf), cut, and the path that a row which ends there counts."""
    node = tree["node"].to_numpy()
    feature, cut, path = np.full(node.max() + 1, -1), np.zeros(node.max() + 1), np.zeros(node.max() + 1)
    feature[node], cut[node] = tree["feature"], tree["cut"]
    path[node] = [n.bit_length() - 1 + expected_path(size) for n, size in zip(node.tolist(), tree["size"])]
    return feature, cut, path


def score(df: DataFrame, nodes: DataFrame, columns: list[str], sample: int = 256, out: str = "anomaly") -> DataFrame:
    """df with the anomaly score in (0, 1]; the node table's size is bounded by its parameters."""
    trees = [_dense(t) for _, t in nodes.toPandas().groupby("tree")]
    packed = df.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            x = np.array(b.tolist(), float).reshape(len(b), len(columns))
            row, total = np.arange(len(x)), np.zeros(len(x))
            for feature, cut, path in packed.value:
                at = np.ones(len(x), np.int64)
                while (inner := (f := feature[at]) >= 0).any():
                    at = np.where(inner, 2 * at + (x[row, f] >= cut[at]), at)
                total += path[at]
            yield pd.Series(2.0 ** (-total / max(len(packed.value), 1) / max(expected_path(sample), 1e-9)))

    return df.withColumn(out, run(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])))
