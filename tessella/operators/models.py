"""Linear models over wide feature tables, with group-aware choice of the penalty."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.metrics import auroc

GRID = (0.01, 0.1, 1.0, 10.0)


class Classifier:
    """Standardised features, L2 logistic regression, classes balanced by weight."""

    def __init__(self, features: list[str], c: float = 1.0):
        self.features, self.c = features, c
        self.scaler: StandardScalerModel | None = None
        self.model: LogisticRegressionModel | None = None

    def _assembled(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.features, outputCol="__raw", handleInvalid="error").transform(df)

    def fit(self, df: DataFrame, label: str) -> Classifier:
        """The penalty is that of a sum of weighted losses times C, so it is divided by C and the weights' sum."""
        counts = df.groupBy(label).agg(F.count("*").alias("n")).collect()  # two rows
        total = sum(r.n for r in counts)
        weight = F.when(F.lit(False), 1.0)
        for r in counts:
            weight = weight.when(F.col(label) == r[label], total / (len(counts) * r.n))
        rows = self._assembled(df).withColumn("__w", weight)
        self.scaler = StandardScaler(inputCol="__raw", outputCol="__x", withMean=True).fit(rows)
        self.model = LogisticRegression(
            featuresCol="__x", labelCol=label, weightCol="__w", regParam=1 / (self.c * total), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9
        ).fit(self.scaler.transform(rows))
        return self

    def score(self, df: DataFrame, out: str) -> DataFrame:
        rows = self.model.transform(self.scaler.transform(self._assembled(df)))
        return rows.select(*df.columns, vector_to_array("probability")[1].alias(out))

    def contributions(self) -> list[tuple[str, float]]:
        """Features by weight on the standardised scale, the largest first."""
        return sorted(zip(self.features, self.model.coefficients.tolist(), strict=True), key=lambda x: -abs(x[1]))


def choose_penalty(df: DataFrame, features: list[str], label: str, fold: str, grid: tuple[float, ...] = GRID) -> float:
    """The C of the greatest mean AUROC over the given folds (the first on a tie). Folds must hold both classes: others raise."""
    classes = df.groupBy(fold).agg(F.count_distinct(label).alias("n")).collect()  # one row a fold
    if any(r.n < 2 for r in classes):
        raise ValueError("a fold holds one class only")
    best = (-1.0, 0.0)
    for c in grid:
        found = []
        for r in classes:
            model = Classifier(features, c).fit(df.filter(F.col(fold) != r[fold]), label)
            scored = model.score(df.filter(F.col(fold) == r[fold]), "__p").withColumn("__all", F.lit(1))
            found.append(auroc(scored, ["__all"], "__p", label).first().auroc)
        mean = sum(found) / len(found)
        if mean > best[0] + 1e-12:
            best = (mean, c)
    return best[1]
