"""Trained classifiers over feature tables: scaling, projection, boosted trees, search.

Feature columns are chosen by prefix. Everything is fitted by Spark's own
estimators, over all rows.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chosen(df: DataFrame, prefixes: tuple[str, ...]) -> list[str]:
    """The columns whose names begin with any of the prefixes, in order."""
    return sorted(c for c in df.columns if c.startswith(prefixes))


def projected(df: DataFrame, features: list[str], k: int = 2, fit_on: DataFrame | None = None) -> DataFrame:
    """`df` with `pca`: its features scaled to unit deviation and projected on the first k axes,
    both fitted on `fit_on` (the training rows) or on all rows."""
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), PCA(k=k, inputCol="scaled", outputCol="pca")])
    return model.fit(df if fit_on is None else fit_on).transform(df).drop("raw", "scaled")


def train(df: DataFrame, features: list[str], label: str, depth: int = 4, step: float = 0.1, rounds: int = 20) -> PipelineModel:
    """Boosted trees for a label of 0 and 1."""
    trees = GBTClassifier(featuresCol="features", labelCol=label, maxDepth=depth, stepSize=step, maxIter=rounds, seed=1)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), trees]).fit(df)


def searched(df: DataFrame, features: list[str], label: str, depths: tuple[int, ...] = (2, 4), steps: tuple[float, ...] = (0.1, 0.3), folds: int = 5) -> tuple[PipelineModel, float]:
    """The best of a grid by the mean F1 of cross-validation, and that mean."""
    trees = GBTClassifier(featuresCol="features", labelCol=label, maxIter=10, seed=1)
    line = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), trees])
    grid = ParamGridBuilder().addGrid(trees.maxDepth, list(depths)).addGrid(trees.stepSize, list(steps)).build()
    found = CrossValidator(estimator=line, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(labelCol=label, metricName="f1"), numFolds=folds, seed=1).fit(df)
    return found.bestModel, max(found.avgMetrics)


def baseline(df: DataFrame, label: str) -> float:
    """The commonest label (the least of equals), which a dummy classifier gives to all."""
    return df.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.desc("count"), label).first()[label]


def predicted(model: PipelineModel, df: DataFrame) -> DataFrame:
    """`df` with `prediction` and the probability of 1."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(df).withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability")


def split(df: DataFrame, by: list[str], key: str, train_share: float = 0.3, valid_share: float = 0.2, rare: int = 5) -> DataFrame:
    """`df` with `part`: train, valid or test, by shares inside each class; classes under `rare` rows are test.

    Rows rank by the key's hash: inside one of 1,024 spans of it, after the rows of lower spans, so
    that no class lies in one task. Null classes are a class. Columns named __span or __key are not allowed.
    """
    rows = df.withColumn("__span", F.shiftright(F.xxhash64(key), 54))
    held = rows.groupBy(*by, "__span").agg(F.count("*").alias("c"))
    of = Window.partitionBy(*by)
    sums = held.select(
        F.struct(*by, "__span").alias("__key"), F.sum("c").over(of).alias("__n"), (F.sum("c").over(of.orderBy("__span").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("__below")
    )
    rows = rows.join(sums, F.struct(*by, "__span").eqNullSafe(F.col("__key")))
    rn = F.col("__below") + F.row_number().over(Window.partitionBy(*by, "__span").orderBy(F.xxhash64(key), key))
    n = F.col("__n")
    part = F.when(n < rare, "test").when(rn <= n * train_share, "train").when(rn <= n * (train_share + valid_share), "valid").otherwise("test")
    return rows.withColumn("part", part).select(*df.columns, "part")


def prediction_counts(df: DataFrame, key: str, label: str, n_labels: int) -> DataFrame:
    """One row a key with `pred_0` ... : how many of its segments each label was given to."""
    return df.groupBy(key).agg(*[F.count_if(F.col(label) == i).alias(f"pred_{i}") for i in range(n_labels)])


def crosstab(df: DataFrame, label: str, guess: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """(label, guess, n) over rows that have both, after mapping labels to coarser ones (others stay)."""
    table = F.create_map(*[F.lit(x) for pair in (mapping or {}).items() for x in pair]) if mapping else None
    to = lambda c: F.col(c).cast("string") if table is None else F.coalesce(F.try_element_at(table, F.col(c).cast("string")), F.col(c).cast("string"))
    both = df.where(F.col(label).isNotNull() & F.col(guess).isNotNull())
    return both.groupBy(to(label).alias("label"), to(guess).alias("guess")).agg(F.count("*").alias("n"))


def report(counts: DataFrame) -> DataFrame:
    """(label, prec, rec, f1, support) from `crosstab`; 0 where a share has no rows below it."""
    rows = counts.select(F.explode(F.array(F.struct(F.col("label").alias("label"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("guessed"), F.when(F.col("label") == F.col("guess"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("guess").alias("label"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("guessed"), F.lit(0).cast("long").alias("hit")))).alias("x")).select("x.*")
    t = rows.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("actual", "guessed", "hit")])
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return t.select("label", share(F.col("hit"), F.col("guessed")).alias("prec"), share(F.col("hit"), F.col("actual")).alias("rec"), share(2 * F.col("hit"), F.col("actual") + F.col("guessed")).alias("f1"), F.col("actual").alias("support"))


def weighted_f1(reported: DataFrame) -> DataFrame:
    """One row: F1 weighted by support, balanced accuracy over labels that occur, accuracy."""
    return reported.where("support > 0").agg((F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"), F.avg("rec").alias("balanced_accuracy"), (F.sum(F.col("rec") * F.col("support")) / F.sum("support")).alias("accuracy"))
