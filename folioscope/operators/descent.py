"""Logistic regression over folds as an iterative Spark job.

Every step is one aggregation: each partition adds up its own share of the sums, and a row of sums for
each fold reaches the driver, whatever the number of rows. The weights go back as a table of one row
for each fold. Rows are stored once; equal rows come as one with their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import stored


class Folds:
    """Training rows of each test fold: all rows of the other folds. ``features`` must not be null."""

    def __init__(self, df: DataFrame, features: list[str], label: str, fold: str) -> None:
        self.spark, self.width = df.sparkSession, len(features)
        x = [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
        y = F.col(label).cast("double").alias("y")
        counted = df.select(F.col(fold).alias("own"), *x, y).groupBy("own", *[f"x{i}" for i in range(self.width)], "y").agg(F.count(F.lit(1)).alias("many"))
        self.rows = stored(counted, "descent")
        self.tests = sorted(r[0] for r in self.rows.select("own").distinct().collect())
        self.inputs = [F.col(f"x{i}") for i in range(self.width)] + [F.lit(1.0)]

    def sums(self, weights: dict[int, np.ndarray], second: bool) -> Iterator[tuple[int, float, np.ndarray, np.ndarray | None]]:
        """(test fold, rows, sum of gradients, sum of second derivatives) at the weights of each fold; the bias comes last.

        A fold without training rows is left out.
        """
        names = [f"w{i}" for i in range(self.width + 1)]
        table = self.spark.createDataFrame([(t, *map(float, w)) for t, w in weights.items()], "test long, " + ", ".join(f"{n} double" for n in names))
        # one row for each fold: the only thing that is broadcast
        each = self.rows.join(F.broadcast(table), F.col("own") != F.col("test"))
        z = sum((F.col(n) * x for n, x in zip(names, self.inputs, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
        each = each.select("test", "many", *self.rows.columns[1:-2], (F.col("many") * (p - F.col("y"))).alias("error"), (F.col("many") * p * (1 - p)).alias("spread"))
        totals = [F.sum("many").alias("n"), *[F.sum(F.col("error") * x).alias(f"g{i}") for i, x in enumerate(self.inputs)]]
        pairs = list(combinations_with_replacement(range(self.width + 1), 2)) if second else []
        totals += [F.sum(F.col("spread") * self.inputs[i] * self.inputs[j]).alias(f"h{i}_{j}") for i, j in pairs]
        for r in each.groupBy("test").agg(*totals).collect():
            bend = None
            if second:
                bend = np.zeros((self.width + 1, self.width + 1))
                for i, j in pairs:
                    bend[i, j] = bend[j, i] = r[f"h{i}_{j}"]
            yield r["test"], float(r["n"]), np.array([r[f"g{i}"] for i in range(self.width + 1)]), bend

    def result(self, weights: dict[int, np.ndarray]) -> DataFrame:
        rows = [(int(t), [round(float(v), 4) for v in w[:-1]], round(float(w[-1]), 4)) for t, w in sorted(weights.items())]
        return self.spark.createDataFrame(rows, "test int, weights array<double>, bias double")


def by_descent(df: DataFrame, features: list[str], label: str, fold: str, epochs: int = 6000, rate: float = 0.15, penalty: float = 1e-3) -> DataFrame:
    """(test fold, weights, bias): full-batch gradient descent, the L2 penalty on all but the bias; a job a step."""
    data = Folds(df, features, label, fold)
    weights = {t: np.zeros(data.width + 1) for t in data.tests}
    shrink = np.append(np.full(data.width, penalty), 0.0)
    for _ in range(epochs):
        for t, n, gradient, _none in list(data.sums(weights, second=False)):
            weights[t] = weights[t] - rate * (gradient / n + shrink * weights[t])
    return data.result(weights)


def optimum(df: DataFrame, features: list[str], label: str, fold: str, penalty: float = 1e-3, most: int = 50, close: float = 1e-9) -> DataFrame:
    """(test fold, weights, bias): the point that the descent of ``by_descent`` goes to, by Newton steps.

    The aim has one minimum, as the penalty makes it strictly convex in the weights, and some ten jobs
    find it where descent takes thousands. Where features hardly differ, descent that stops early is
    still on its way: take ``by_descent`` for its very place. A training set of one class has no
    minimum in the bias; its steps are bounded, and ``most`` of them are taken.
    """
    data = Folds(df, features, label, fold)
    weights = {t: np.zeros(data.width + 1) for t in data.tests}
    shrink, open_folds = np.append(np.full(data.width, penalty), 0.0), set(data.tests)
    for _ in range(most):
        seen = list(data.sums({t: weights[t] for t in open_folds}, second=True)) if open_folds else []
        open_folds = set()
        for t, n, gradient, bend in seen:
            slope = gradient / n + shrink * weights[t]
            if np.abs(slope).max() <= close:
                continue
            step = np.linalg.solve(bend / n + np.diag(shrink) + 1e-12 * np.eye(len(slope)), slope)
            weights[t] = weights[t] - step * min(1.0, 2.0 / np.abs(step).max())
            open_folds.add(t)
        if not open_folds:
            break
    return data.result(weights)
