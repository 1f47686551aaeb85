"""Fitted models: recalibrators from MLlib, and ridge."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-6


def platt(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """`df` with `platt`: a logistic fit on the logit, penalty 1e-6 (C = 1e6)."""
    q = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), F.col(p)))
    x = VectorAssembler(inputCols=["logit_"], outputCol="x_").transform(df.withColumn("logit_", F.log(q / (1 - q))))
    fitted = LogisticRegression(featuresCol="x_", labelCol=y, regParam=1e-6, probabilityCol="q_", predictionCol="h_", rawPredictionCol="r_").fit(x)
    return fitted.transform(x).withColumn("platt", vector_to_array("q_")[1]).drop("logit_", "x_", "q_", "h_", "r_")


def isotonic(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """`df` with `isotonic`: a monotone fit; outside the fitted range it is held at its ends."""
    fitted = IsotonicRegression(featuresCol=p, labelCol=y, predictionCol="isotonic").fit(df)
    return fitted.transform(df)


def ridge(df: DataFrame, group: str, features: list[str], label: str, penalty: float = 1.0) -> DataFrame:
    """`df` with `pred` of a standardised ridge fitted to all other groups.

    Gram sums by group are one aggregate; only they (a few numbers a group) reach the solver, one group at a time."""
    names = [*features, label]
    cells = [F.sum(F.col(a) * F.col(b)).alias(f"g_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    sums = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{i}") for i, c in enumerate(names)], *cells)
    whole = sums.agg(*[F.sum(c).alias(f"{c}_all") for c in sums.columns[1:]])
    rest = sums.crossJoin(F.broadcast(whole)).select(group, *[(F.col(f"{c}_all") - F.col(c)).cast("double").alias(c) for c in sums.columns[1:]])  # one row
    k = len(features)

    def solve(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                n, mean = r["n"], np.array([r[f"s_{i}"] for i in range(k + 1)]) / max(r["n"], 1)
                gram = np.array([[r[f"g_{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)]) - n * np.outer(mean, mean)
                sd = np.sqrt(np.maximum(np.diag(gram)[:k] / max(n, 1), 0))
                sd = np.where(sd > 1e-12, sd, 1.0)  # a constant feature stays at zero
                z = gram[:k, :k] / np.outer(sd, sd) + penalty * np.eye(k)
                beta = np.linalg.solve(z, gram[:k, k] / sd) / sd
                out.append([*beta.tolist(), float(mean[k] - beta @ mean[:k])])
            yield pd.DataFrame({group: pdf[group], "beta": out})

    kind = rest.schema[group].dataType.simpleString()
    fitted = rest.mapInPandas(solve, f"{group} {kind}, beta array<double>")
    value = F.element_at("beta", k + 1)
    for i, c in enumerate(features):
        value = value + F.element_at("beta", i + 1) * F.col(c)
    return df.join(fitted, group).withColumn("pred", value).drop("beta")
