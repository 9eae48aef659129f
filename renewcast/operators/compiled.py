"""Fitted models as column expressions: scoring without vectors, UDFs or a per-row model call.

A logistic model becomes one arithmetic expression over the feature columns, its terms added pairwise so that the
expression is as deep as the logarithm of their number.  Each tree of a forest becomes nested CASE expressions, as deep as the
tree, of which a row evaluates one path; every split stands in the plan once, so filters on the probability may be pushed through it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel, RandomForestClassificationModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewcast.session import scratch_path


@dataclass
class Tree:
    """Nodes by number, the root is 0: value <= cut of the feature goes left; leaves have themselves as children.
    ``value`` is the probability of class 1."""
    feature: list[int]
    cut: list[float]
    left: list[int]
    right: list[int]
    value: list[float]

    def expression(self, columns: Sequence[str]) -> str:
        """SQL of the value of the leaf a row reaches; ``columns`` is the SQL of every feature."""
        def at(n: int) -> str:
            if self.left[n] == n:
                return f"double('{self.value[n]!r}')"
            return f"CASE WHEN {columns[self.feature[n]]} <= double('{self.cut[n]!r}') THEN {at(self.left[n])} ELSE {at(self.right[n])} END"

        return at(0)


def constant(values: Sequence[int] | Sequence[float], kind: str) -> str:
    """SQL of an array of numbers as one constant of the plan (``kind`` int or double); floats keep all their digits."""
    if not all(math.isfinite(v) for v in values):
        raise ValueError("only finite numbers")
    return f"CAST(split('{','.join(map(repr, values))}', ',') AS ARRAY<{kind}>)"


def number(c: str) -> Column:
    """A feature as a double; null counts as NaN, as in an assembled vector that keeps invalid rows."""
    return F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan")))


def add_pairwise(terms: Sequence[Column]) -> Column:
    terms = list(terms)
    while len(terms) > 1:
        terms = [a + b[0] if b else a for a, *b in (terms[i:i + 2] for i in range(0, len(terms), 2))]
    return terms[0]


def logistic_probability(names: Sequence[str], weights: Sequence[float], intercept: float) -> Column:
    """P(1) of a row with the features ``names`` as columns; features of weight 0 are not read."""
    used = [number(n) * F.lit(float(w)) for n, w in zip(names, weights, strict=True) if w]
    margin = add_pairwise([*used, F.lit(float(intercept))])
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def with_forest_probability(df: DataFrame, names: Sequence[str], trees: Sequence[Tree], name: str) -> DataFrame:
    """Adds the mean over trees of the reached leaf's value.  NaN goes right, as in Spark's trees.  A column ``name`` is replaced."""
    columns = [f"coalesce(CAST(`{n}` AS DOUBLE), double('NaN'))" for n in names]
    votes = add_pairwise([F.expr(t.expression(columns)) for t in trees])
    return df.withColumn(name, votes / len(trees))


def spark_trees(model: RandomForestClassificationModel) -> list[Tree]:
    """The trees of a fitted Spark forest, read from its saved node table; splits on categories are not supported."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "forest_nodes")
    model.write().overwrite().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    out = []
    for t in sorted({r["treeID"] for r in rows}):
        nodes = sorted((r for r in rows if r["treeID"] == t), key=lambda r: r["id"])
        if any(r["split"]["numCategories"] >= 0 for r in nodes if r["leftChild"] >= 0):
            raise ValueError("splits on categories")
        inner = [r["leftChild"] >= 0 for r in nodes]
        out.append(Tree([r["split"]["featureIndex"] if i else 0 for r, i in zip(nodes, inner)],
                        [float(r["split"]["leftCategoriesOrThreshold"][0]) if i else 0.0 for r, i in zip(nodes, inner)],
                        [r["leftChild"] if i else r["id"] for r, i in zip(nodes, inner)],
                        [r["rightChild"] if i else r["id"] for r, i in zip(nodes, inner)],
                        [float(r["impurityStats"][1] / sum(r["impurityStats"])) if sum(r["impurityStats"]) else 0.0 for r in nodes]))
    return out


def with_probability(df: DataFrame, model: object, name: str = "probability") -> DataFrame | None:
    """Adds P(1) by the compiled form of a fitted model; None for a model that has none."""
    from renewcast.operators.forest import GrownForest

    if isinstance(model, GrownForest):
        return with_forest_probability(df, model.features, model.trees, name)
    if isinstance(model, PipelineModel) and len(model.stages) == 2:
        assembler, last = model.stages
        names = assembler.getInputCols()
        if isinstance(last, LogisticRegressionModel) and last.numClasses == 2:
            return df.withColumn(name, logistic_probability(names, last.coefficients.toArray().tolist(), last.intercept))
        if isinstance(last, RandomForestClassificationModel) and last.numClasses == 2:
            return with_forest_probability(df, names, spark_trees(last), name)
    return None
