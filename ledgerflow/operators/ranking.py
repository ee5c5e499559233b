"""Ranking: coverage features, relevance, diversity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import joins, models

# Fixed values of the ranking features.
INCOMES = {"low": 30_000, "medium": 60_000, "high": 120_000}


def coverage(chronic: Column, prescriptions: Column, family: Column, dental: Column, vision: Column, smoker: Column, plan: Column) -> Column:
    add = lambda hit, points: F.when(hit, points).otherwise(0.0)
    return add(chronic > 0, 0.3) + add(prescriptions, 0.2) + add((family > 2) & dental, 0.2) + add((family > 2) & vision, 0.1) + add(smoker & plan.isin("Gold", "Platinum"), 0.2)


def age_fit(age: Column, plan: Column) -> Column:
    young, middle, old = age < 30, (age >= 30) & (age < 55), age >= 55
    return F.when((young & plan.isin("Bronze", "Silver")) | (middle & plan.isin("Silver", "Gold")) | (old & plan.isin("Gold", "Platinum")), 1).otherwise(0)


def eligible(plans: DataFrame, postcode: Column, codes: str, price: str, most: Column) -> DataFrame:
    return plans.where(F.array_contains(codes, postcode) & (F.col(price) <= most))


def switching(has_policy: Column, insurer: Column, current: Column) -> Column:
    return F.when(has_policy & (insurer != current), 1).otherwise(0)


def rank_items(customers: DataFrame, items: DataFrame, features: dict[str, Column], model, customer: str, item: str, top: int | None = None) -> DataFrame:
    """(customer, item, score, rank): every customer with every item of a catalogue, featurised, scored by a fitted ranker and sorted; ties by item."""
    pairs = joins.pair_all(customers, items).withColumns(features)
    out = models.ranked(model, pairs, list(features), customer, item).select(customer, item, "score", "rank")
    return out if top is None else out.where(F.col("rank") <= top)


def diversified(df: DataFrame, session: str, item: str, score: str, vector: str, k: int = 10, share: float = 0.7) -> DataFrame:
    """Maximal marginal relevance: each place goes to the item with the best score less its likeness to those chosen. One session is one small group."""
    kinds = dict(df.dtypes)

    def order(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([score, item], ascending=[False, True]).reset_index(drop=True)
        x = np.array(g[vector].tolist(), float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        worth, like, chosen = share * g[score].to_numpy(float), np.zeros(len(g)), []
        while len(chosen) < min(k, len(g)):
            value = worth - (1 - share) * like
            value[chosen] = -np.inf
            best = int(np.argmax(value))  # the first of equals
            chosen.append(best)
            like = np.maximum(like, x @ x[best]) if len(chosen) > 1 else x @ x[best]
        return pd.DataFrame({session: g[session].iloc[0], item: g[item].iloc[chosen].to_numpy(), "place": np.arange(1, len(chosen) + 1, dtype="int32")})

    return df.select(session, item, score, vector).groupBy(session).applyInPandas(order, f"{session} {kinds[session]}, {item} {kinds[item]}, place int")
