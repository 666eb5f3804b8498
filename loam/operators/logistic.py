"""Logistic regression with its sums made by Spark: each round is one aggregate over the rows, and only the sums (a square of the
features' number) reach the driver, which takes a Newton step."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _step(h: np.ndarray, g: np.ndarray, now: np.ndarray, free: np.ndarray) -> np.ndarray:
    """The d that minimises g d + d h d / 2 with now + d >= 0 where not free, by cycling through the coordinates."""
    if free.all():
        return np.linalg.lstsq(h, -g, rcond=None)[0]
    d = np.zeros(len(g))
    for _ in range(2000):
        last = d.copy()
        for i in range(len(d)):
            if h[i, i] > 0:
                best = d[i] - (g[i] + h[i] @ d) / h[i, i]
                d[i] = best if free[i] else max(-now[i], best)
        if np.abs(d - last).max() < 1e-12:
            break
    return d


def fit(rows: DataFrame, features: Sequence[str], label: str, penalty: float, standardise: bool = False, non_negative: bool = False, rounds: int = 40) -> dict[str, float] | None:
    """Weights by feature and `bias` that minimise the mean logistic loss + penalty / (2 n) times the squared weights; the bias is free.

    standardise: the penalty is on weights of features of variance one; non_negative: no weight is below 0. The weights are
    for the features as given. None without rows. rows should be a table, as each round reads it."""
    x = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]
    y = F.col(label).cast("double")
    first = rows.agg(F.count(F.lit(1)), *[F.avg(c) for c in x], *[F.stddev_pop(c) for c in x]).first()
    n, k = first[0], len(x)
    if not n:
        return None
    mean = np.array(first[1 : k + 1]) if standardise else np.zeros(k)
    scale = np.array(first[k + 1 :]) + 1e-9 if standardise else np.ones(k)
    z = [F.lit(1.0), *[(c - float(m)) / float(s) for c, m, s in zip(x, mean, scale, strict=True)]]
    table = rows.select(y.alias("y"), F.array(*z).alias("z"))
    ridge = np.append(0.0, np.full(k, penalty / n))
    free = np.append(True, np.full(k, not non_negative))

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        at = F.lit(0.0)
        for i, v in enumerate(w):
            at = at + float(v) * F.col("z")[i]
        t = table.select("y", "z", F.greatest(F.lit(-60.0), F.least(F.lit(60.0), at)).alias("t")).withColumn("p", 1.0 / (1.0 + F.exp(-F.col("t"))))
        zs = [F.col("z")[i] for i in range(k + 1)]
        weight = F.col("p") * (1.0 - F.col("p"))
        upper = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
        loss = F.avg(F.log1p(F.exp(-F.abs("t"))) + F.greatest("t", F.lit(0.0)) - F.col("y") * F.col("t"))
        got = t.agg(loss, *[F.avg((F.col("p") - F.col("y")) * c) for c in zs], *[F.avg(weight * zs[i] * zs[j]) for i, j in upper]).first()
        h = np.zeros((k + 1, k + 1))
        for (i, j), v in zip(upper, got[k + 2 :], strict=True):
            h[i, j] = h[j, i] = v
        return got[0] + float(ridge @ (w * w)) / 2, np.array(got[1 : k + 2]) + ridge * w, h + np.diag(ridge)

    w = np.zeros(k + 1)
    loss, g, h = sums(w)
    for _ in range(rounds):
        d = _step(h, g, w, free)
        size = 1.0
        while True:
            now = sums(w + size * d)
            if now[0] <= loss + 1e-12 or size < 1e-3:
                break
            size /= 2
        w = w + size * d
        done = loss - now[0] < 1e-12
        loss, g, h = now
        if done:
            break
    raw = w[1:] / scale
    return dict(zip(features, raw.tolist(), strict=True)) | {"bias": float(w[0] - raw @ mean)}
