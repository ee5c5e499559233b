"""Supervised models over pyspark.ml: imputing, encoding, boosting, calibration, segments, attribution."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce
from itertools import product

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, OneHotEncoder, StandardScaler, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workspace import staged
from . import metrics, neighbours, select, shapley
from .quantiles import quantiles


def fit_imputer(df: DataFrame, numbers: list[str], names: list[str]) -> DataFrame:
    """One row: exact medians and most frequent values."""
    rows = [quantiles(df, c, {c: 0.5}) for c in numbers]
    for c in names:
        counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("__n"))
        rows.append(counts.orderBy(F.desc("__n"), c).limit(1).agg(F.max(c).alias(c)))
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), rows)  # one row each


def impute(df: DataFrame, fitted: DataFrame) -> DataFrame:
    cols = fitted.columns
    row = fitted.select(*[F.col(c).alias(f"__{c}") for c in cols])
    out = df.crossJoin(F.broadcast(row))  # one row
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in cols}).drop(*[f"__{c}" for c in cols])


def vocabulary(df: DataFrame, col: str, least: int = 10) -> DataFrame:
    """(value, place): all values with enough rows, numbered from the most frequent on; a table, however many there are."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return staged(select.global_index(counts.withColumn("down", -F.col("n")), "down", "value", out="place").select("value", "place"), "vocabulary")


def one_hot_frequent(df: DataFrame, col: str, words: DataFrame, out: str) -> DataFrame:
    """A sparse vector with a place for each value of a vocabulary; other values are zeros. The vocabulary meets the rows by a join."""
    n = words.count()
    placed = df.join(words.withColumnsRenamed({"value": "__value", "place": "__place"}), F.col(col).cast("string") == F.col("__value"), "left")
    known = placed.withColumn("__place", F.coalesce(F.col("__place").cast("double"), F.lit(float(n))))
    encoder = OneHotEncoder(inputCols=["__place"], outputCols=[out], dropLast=True)  # the last place is that of other values
    largest = df.sparkSession.createDataFrame([(float(n),)], "__place double")
    return encoder.fit(largest).transform(known).drop("__value", "__place")


def one_hot(df: DataFrame, col: str, words: list[str], out: str) -> DataFrame:
    """A vector with a place for each word; other values are zeros."""
    index = StringIndexerModel.from_labels(words or ["UNK"], inputCol=col, outputCol=f"__{col}", handleInvalid="keep")
    encoder = OneHotEncoder(inputCols=[f"__{col}"], outputCols=[out], dropLast=True)  # the last place is that of other values
    indexed = index.transform(df.withColumn(col, F.coalesce(F.col(col).cast("string"), F.lit(""))))
    return encoder.fit(indexed).transform(indexed).drop(f"__{col}")


def assemble(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="keep").transform(df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns if dict(df.dtypes)[c] not in ("vector",)}))


def standardise(df: DataFrame, columns: list[str], out: str = "scaled"):
    steps = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="__v"), StandardScaler(inputCol="__v", outputCol=out, withMean=True)])
    return steps.fit(df)


def with_weights(df: DataFrame, label: str) -> DataFrame:
    """weight: negatives over positives for positive rows, 1 for others."""
    ones = F.sum(F.col(label).cast("long"))
    row = df.agg(((F.count(F.lit(1)) - ones) / F.greatest(ones, F.lit(1))).alias("__w"))
    return df.crossJoin(F.broadcast(row)).withColumn("weight", F.when(F.col(label) == 1, F.col("__w")).otherwise(1.0)).drop("__w")


#: Rows of a task of a fit, which holds its rows as objects of some hundred bytes; rows that fits side by side hold together.
ROWS, SIDE = 1 << 18, 1 << 23


def learnt(train: DataFrame, columns: list[str], label: str, *more: str) -> DataFrame:
    """What a fit reads of its rows: features, label and more, in equal partitions of a bounded number of rows, however few files the rows come from.

    Rows are sorted inside a partition, as the fit's draws go by their places.
    """
    kinds = dict(train.dtypes)
    numbers = [c for c in columns if kinds[c] != "vector"]
    rows = train.select(*[c if kinds[c] == "vector" else F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns], F.col(label).cast("double").alias("label"), *more)
    n = rows.count()
    # few rows are few tasks: a fit of hundreds of rounds is thousands of small jobs
    even = rows.repartition(max(1, -(-n // ROWS), min(8, -(-n // (ROWS >> 2))))).sortWithinPartitions(*dict.fromkeys([*numbers, "label", *more]))
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(even).select("features", "label", *more)


def fit_boosted(train: DataFrame, columns: list[str], label: str, depth: int = 8, rounds: int = 300, rate: float = 0.1, least: int = 1, gain: float = 0.0, held: str | None = None, tolerance: float = 0.01) -> GBTClassificationModel:
    """Boosted trees weighed by class. least: rows of a leaf; gain: what a split must gain. held: a boolean column; its rows are not learnt from, and rounds stop where their error falls by less than the tolerance."""
    df = learnt(with_weights(train, label), columns, label, "weight", *([held] if held else []))
    trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxDepth=depth, maxIter=rounds, stepSize=rate, minInstancesPerNode=least, minInfoGain=gain, seed=3)
    return (trees.setParams(validationIndicatorCol=held, validationTol=tolerance) if held else trees).fit(df)


def probability(model, df: DataFrame, columns: list[str], out: str = "p") -> DataFrame:
    scored = model.transform(assemble(df, columns))
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def fit_forest(train: DataFrame, columns: list[str], label: str, trees: int = 20):
    df = learnt(with_weights(train, label), columns, label, "weight")
    return RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees, seed=3).fit(df)


def fit_calibration(df: DataFrame, score: str, label: str):
    return IsotonicRegression(featuresCol=score, labelCol="label").fit(df.withColumn("label", F.col(label).cast("double")))


def calibrated(model, df: DataFrame, score: str, out: str = "calibrated") -> DataFrame:
    return model.transform(df).withColumn(out, F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0))).drop("prediction")


def by_segment(df: DataFrame, key: str, columns: list[str], label: str, top: int = 4, least: int = 1000, **params) -> DataFrame:
    """Train and score a model for each of the most frequent keys and one for the rest; segments with few rows score 0.

    df has part (train or test); the test rows come back with p.
    """
    df = staged(select.segments(df, key, top), "segments")
    sizes = {r["segment"]: r["n"] for r in df.where("part = 'train'").groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}  # top + 1 rows

    def scored(segment: str) -> DataFrame:
        own = df.where(F.col("segment") == segment)
        test = own.where("part = 'test'")
        return probability(fit_boosted(own.where("part = 'train'"), columns, label, **params), test, columns) if sizes[segment] >= least else test.withColumn("p", F.lit(0.0))

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), together([partial(scored, s) for s in sorted(sizes)]))


def beside(df: DataFrame) -> int:
    """How many fits of df's rows run at once: small ones leave the cluster idle between their jobs, large ones fill it and its memory by themselves."""
    return max(1, min(8, SIDE // max(1, df.count())))


def together(tasks: list, at_once: int = 4) -> list:
    """The results of functions that start Spark jobs, some at once, so that the cluster isn't idle while one fit ends."""
    with ThreadPoolExecutor(at_once) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(SparkSession.getActiveSession())(t)) for t in tasks]]


def grid(df: DataFrame, columns: list[str], label: str, order: list[str], tie: str, options: dict[str, list]) -> DataFrame:
    """(options, fold, ap): every combination over expanding time folds, which are written once; fits run side by side."""
    folds = staged(select.expanding_folds(df, *order), "folds")

    def scored(params: dict, k: int) -> DataFrame:
        own = folds.where(F.col("fold") == k)
        found = staged(probability(fit_boosted(own.where("part = 'train'"), columns, label, **params), own.where("part = 'test'"), columns).select("p", label), "scored")
        return metrics.average_precision(found, "p", label).withColumn("fold", F.lit(k)).withColumns({n: F.lit(v) for n, v in params.items()})

    return reduce(DataFrame.unionByName, together([partial(scored, dict(zip(options, values)), k) for values in product(*options.values()) for k in (0, 1)], beside(folds)))


def ablation(train: DataFrame, test: DataFrame, blocks: dict[str, list[str]], label: str, tie: str, **params) -> DataFrame:
    """(block, ap, p_at): metrics as blocks of columns are added one after another."""
    train, test, names = staged(train, "train"), staged(test, "test"), list(blocks)

    def scored(k: int) -> DataFrame:
        columns = [c for name in names[: k + 1] for c in blocks[name]]
        found = staged(probability(fit_boosted(train, columns, label, **params), test, columns).select(tie, "p", label), "scored")
        return metrics.average_precision(found, "p", label).crossJoin(metrics.precision_at(found, "p", label, 0.01, tie).select(F.col("precision").alias("p_at"))).withColumn("block", F.lit(names[k]))

    return reduce(DataFrame.unionByName, together([partial(scored, k) for k in range(len(names))], beside(train)))


def compare_variants(train: DataFrame, test: DataFrame, variants: dict[str, list[str]], label: str, tie: str, fitted: dict[str, GBTClassificationModel] | None = None, **params) -> DataFrame:
    """(variant, features, ap, auc, p_at): a model for each list of columns, on the same rows; those that are fitted already are not fitted again."""
    train, test = staged(train, "train"), staged(test, "test")

    def compared(name: str, columns: list[str]) -> DataFrame:
        model = fitted[name] if fitted and name in fitted else fit_boosted(train, columns, label, **params)
        scored = staged(probability(model, test, columns).select(tie, "p", label), "variant")
        row = metrics.average_precision(scored, "p", label).crossJoin(metrics.roc_auc(scored, "p", label)).crossJoin(metrics.precision_at(scored, "p", label, 0.01, tie).select(F.col("precision").alias("p_at")))
        return row.select(F.lit(name).alias("variant"), F.lit(len(columns)).alias("features"), "ap", "auc", "p_at")

    return reduce(DataFrame.unionByName, together([partial(compared, *v) for v in variants.items()], beside(train)))


def selected_features(model: GBTClassificationModel, columns: list[str], share: float = 0.9) -> list[str]:
    """The most important columns that make up a share of the model's importance."""
    weights = sorted(zip(model.featureImportances.toArray(), columns), reverse=True)
    out, total = [], 0.0
    for weight, column in weights:
        if total >= share:
            break
        out, total = [*out, column], total + weight
    return out


def candidate_lift(df: DataFrame, base: list[str], candidates: dict[str, list[str]], label: str, order: list[str], tie: str, needed: dict[str, float] | None = None, **params) -> DataFrame:
    """(candidate, p_half, p_one, lifts, take): precision at 0.5 and 1 % with each candidate's columns added to the base, averaged over expanding time folds."""
    folds = staged(select.expanding_folds(df, *order), "folds")

    def scored(name: str, more: list[str], k: int) -> DataFrame:
        own, columns = folds.where(F.col("fold") == k), [*base, *more]
        found = staged(probability(fit_boosted(own.where("part = 'train'"), columns, label, **params), own.where("part = 'test'"), columns).select(tie, "p", label), "scored")
        half, one = (metrics.precision_at(found, "p", label, share, tie).select(F.col("precision").alias(n)) for n, share in (("p_half", 0.005), ("p_one", 0.01)))
        return half.crossJoin(one).withColumns({"candidate": F.lit(name), "fold": F.lit(k)})  # one row each

    rows = reduce(DataFrame.unionByName, together([partial(scored, name, more, k) for name, more in {"": [], **candidates}.items() for k in (0, 1)], beside(folds)))
    return metrics.lift_table(rows, "candidate", "", ["p_half", "p_one"], needed or {"p_half": 0.01, "p_one": 0.02})


def contributions(model: GBTClassificationModel, df: DataFrame, columns: list[str], id_col: str, top: int | None = 5) -> DataFrame:
    """(id, feature, contribution): the features' Shapley values in the model's margin, the largest `top` of a row; all sum to the margin less `expected_margin`.

    The trees' leaves are bounded by depth and rounds; rows are scored in Arrow batches.
    """
    import numpy as np
    import pandas as pd

    trees, many = shapley.trees(model), len(columns) if top is None else top

    def run(batches):
        for b in batches:
            x = np.array(b["x"].tolist(), float).reshape(len(b), len(columns))
            total = shapley.values(trees, x)
            order = np.argsort(-np.abs(total), axis=1, kind="stable")[:, :many]
            yield pd.DataFrame({"id": np.repeat(b["id"].to_numpy(), order.shape[1]), "feature": np.array(columns)[order].ravel(), "contribution": np.take_along_axis(total, order, 1).ravel()})

    kind = dict(df.dtypes)[id_col]
    out = df.select(F.col(id_col).alias("id"), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]).alias("x")).mapInPandas(run, f"id {kind}, feature string, contribution double")
    return out.withColumnRenamed("id", id_col)


def expected_margin(model: GBTClassificationModel) -> float:
    """The mean margin of the rows that the trees were grown on, as their nodes' counts tell it: what a row without any feature would get."""
    return shapley.expectation(shapley.trees(model))


def importance(contributed: DataFrame) -> DataFrame:
    return contributed.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"), F.count(F.lit(1)).alias("n"))


def reconstruction_error(df: DataFrame, vector: str, k: int, out: str = "error") -> DataFrame:
    """Mean square of what a projection on k principal components leaves of the centred vector."""
    v = df.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    scaler = StandardScaler(inputCol="__v", outputCol="__c", withMean=True, withStd=False).fit(v)
    centred = scaler.transform(v)
    pca = PCA(k=k, inputCol="__c", outputCol="__p").fit(centred)
    projected = pca.transform(centred)
    square = lambda c: F.aggregate(vector_to_array(c), F.lit(0.0), lambda a, x: a + x * x)
    return projected.withColumn(out, F.greatest(square("__c") - square("__p"), F.lit(0.0)) / F.size(vector_to_array("__c"))).drop("__v", "__c", "__p")


def fit_ranker(train: DataFrame, columns: list[str], relevance: str, weight: str, depth: int = 4, rounds: int = 15):
    """A pointwise ranker, rows weighed by inverse propensity."""
    df = learnt(train, columns, relevance, weight)
    return GBTRegressor(featuresCol="features", labelCol="label", weightCol=weight, maxDepth=depth, maxIter=rounds, seed=3).fit(df)


def ranked(model, df: DataFrame, columns: list[str], session: str, tie: str) -> DataFrame:
    from pyspark.sql import Window as W

    scored = model.transform(assemble(df, columns)).drop("features").withColumnRenamed("prediction", "score")
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(session).orderBy(F.desc("score"), tie)))


def smote(df: DataFrame, label: str, numbers: list[str], names: list[str], id_col: str, share: float = 0.1, k: int = 5) -> DataFrame:
    """Minority rows made between a row and one of its k nearest neighbours, until the minority has its share; numbers interpolate, names take the neighbours' mode.

    Neighbours are exact, by numbers and names (`neighbours`); a null number counts as 0.
    """
    rare = df.where(F.col(label) == 1)
    ones, n = rare.count(), df.count()
    want = max(0.0, share * (n - ones) / (1 - share) - ones)
    if not ones or not want:
        return df.select(*numbers, *names, label).limit(0)
    rare = staged(rare.select(id_col, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in numbers], *names), "minority")
    near, spots = neighbours.nearest(rare, neighbours.space(rare, numbers, names), id_col, k)
    # a neighbour's values are its point's
    values = spots.select("pid", F.struct(*[F.col(f"key.x{i}").alias(c) for i, c in enumerate(numbers)], *[F.when(F.col(f"key.n{i}") != "", F.expr(f"substring(key.n{i}, 2)")).alias(c) for i, c in enumerate(names)]).alias("o"))
    each = near.select("id", F.posexplode("near").alias("r", "other")).select("id", "r", F.col("other.pid").alias("pid")).join(values, "pid")
    lists = each.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("r", "o"))).alias("near"), *[F.mode(f"o.{c}", True).alias(c) for c in names])
    groups = rare.select(F.col(id_col).cast("long").alias("id"), *numbers).join(lists, "id")
    copies = int(-(-want // ones))
    made = groups.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).where(F.pmod(F.xxhash64("id", "copy"), F.lit(10_000)) < int(10_000 * want / (ones * copies)))
    pick = F.element_at("near", (F.pmod(F.xxhash64(F.lit(1), "id", "copy"), F.size("near")) + 1).cast("int"))["o"]
    t = F.pmod(F.xxhash64(F.lit(2), "id", "copy"), F.lit(1_000_003)) / 1_000_003.0
    return made.select(*[(F.col(c) + t * (pick[c] - F.col(c))).alias(c) for c in numbers], *[F.col(c).cast(df.schema[c].dataType).alias(c) for c in names], F.lit(1).alias(label))
