"""Rows of a query against rows of its SQL, in any order."""

from __future__ import annotations

import math


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.isoformat() if hasattr(v, "isoformat") else v


def assert_same(df, result):
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    left = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    right = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in result.fetchall()), key=repr)
    assert left == right
