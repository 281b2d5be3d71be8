"""Ridge regression in closed form from sums that Spark adds up.

The squared weights of the standardised numeric features and of one column per category value count ``alpha`` times; the intercept is
free. Two aggregates over the rows (means and deviations; then the sums per category value and the products of features) hold all that
the solution needs: category columns meet in no row, so their weights are eliminated one by one and a system of
``features + 1`` equations is left, whatever the number of values.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RidgeModel:
    """``transform`` adds the column ``prediction``; a category value that the training rows don't have adds nothing."""
    features: tuple[str, ...]
    category: str
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float
    values: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        own = df.sparkSession.createDataFrame(list(self.values.items()), "__value string, __own double")
        line = sum((F.lit(w / s) * (F.col(c) - F.lit(m)) for c, m, s, w in zip(self.features, self.means, self.scales, self.weights)), F.lit(self.intercept))
        return df.join(own, df[self.category] == own["__value"], "left").withColumn("prediction", line + F.coalesce("__own", F.lit(0.0))).drop("__value", "__own")

    def save(self, spark: SparkSession, folder: str) -> None:
        spark.createDataFrame([(json.dumps(self.__dict__),)], "facts string").write.mode("overwrite").parquet(folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> RidgeModel:
        facts = json.loads(spark.read.parquet(folder).first()[0])
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in facts.items()})


def fit_ridge(train: DataFrame, features: list[str], category: str, label: str, alpha: float) -> RidgeModel:
    """Least squares plus ``alpha`` times the squared weights; deviations are those of the population, constant features keep scale 1."""
    k = len(features)
    told = train.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(features)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features))).first()
    means, scales = [told[f"m{i}"] or 0.0 for i in range(k)], [told[f"s{i}"] or 1.0 for i in range(k)]
    scaled = train.select(F.col(category).alias("value"), F.col(label).cast("double").alias("y"),
                          *(((F.col(c) - F.lit(m)) / F.lit(s)).alias(f"x{i}") for i, (c, m, s) in enumerate(zip(features, means, scales))))
    xs = [F.col(f"x{i}") for i in range(k)]
    per = scaled.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), *(F.sum(x).alias(f"x{i}") for i, x in enumerate(xs)),
                                      *(F.sum(x * F.col("y")).alias(f"xy{i}") for i, x in enumerate(xs)),
                                      *(F.sum(xs[i] * xs[j]).alias(f"xx{i}_{j}") for i in range(k) for j in range(i + 1)))
    rows = per.orderBy("value").toPandas()
    own = rows[rows.value.notna()]
    sums = np.column_stack([rows.n, *(rows[f"x{i}"] for i in range(k))]).astype(float)
    gram, right = np.zeros((k + 1, k + 1)), np.concatenate([[rows.y.sum()], [rows[f"xy{i}"].sum() for i in range(k)]])
    gram[0] = gram[:, 0] = sums.sum(axis=0)
    for i in range(k):
        for j in range(i + 1):
            gram[i + 1, j + 1] = gram[j + 1, i + 1] = rows[f"xx{i}_{j}"].sum()
    named = np.column_stack([own.n, *(own[f"x{i}"] for i in range(k))]).astype(float)
    share = named / (own.n.to_numpy(float) + alpha)[:, None]
    left = gram - named.T @ share + alpha * np.diag([0.0] + [1.0] * k)
    found = np.linalg.lstsq(left, right - share.T @ own.y.to_numpy(float), rcond=None)[0]
    values = (own.y.to_numpy(float) - named @ found) / (own.n.to_numpy(float) + alpha)
    return RidgeModel(tuple(features), category, tuple(means), tuple(scales), tuple(map(float, found[1:])), float(found[0]), dict(zip(own.value, map(float, values))))
