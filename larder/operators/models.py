"""Risk classifiers: features, split, weights, fits, reports.  Logistic models are MLlib's; forests grow in tasks of their own (operators.forest)."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators import dimensions
from larder.operators import forest as forests
from larder.operators.scoring import NUTRIENTS
from larder.sources.shared import cut, cut_in_passes, exists

FEATURES = [*NUTRIENTS.values(), "ingredient_coverage_pct"]
#: Stands for no limit, as MLlib's deepest trees do.
DEEPEST = 30
#: There is no least size of a node that is split.
GRID = {"numTrees": [100, 200, 300, 500], "maxDepth": [DEEPEST, 10, 20], "featureSubsetStrategy": ["sqrt", "log2"], "minInstancesPerNode": [1, 2, 4]}


def features(scores: DataFrame) -> DataFrame:
    df = scores.where("data_status = 'calculated'").withColumns({c: F.col(c).try_cast("double") for c in FEATURES}).dropna(subset=FEATURES)
    return df if "label" in df.columns else df.withColumn("label", F.col("weighted_risk_level"))


def narrow(scores: DataFrame) -> DataFrame:
    """What models are fitted on, and no more, stored.  A recipe's scores come from its own lines, so they are worked out in passes."""
    return cut_in_passes(features(scores).select("recipe_id", "label", *FEATURES), "recipe_id")


def merged(scores: DataFrame) -> DataFrame:
    """High and Very High as one class, Elevated."""
    return features(scores).withColumn("label", F.when(F.col("weighted_risk_level").isin("High", "Very High"), "Elevated").otherwise(F.col("weighted_risk_level")))


def hashed(key: str, seed: int) -> list[Column]:
    """An order of rows by a hash of id and seed, for splits that repeat."""
    return [F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))), F.col(key)]


def split(df: DataFrame, label: str, share: float = 0.8, seed: int = 42, key: str = "recipe_id") -> DataFrame:
    """train: the share of each class that comes first by a hash of id and seed."""
    out = dimensions.ranked(df, label, hashed(key, seed), "_rn", "_all")
    return out.withColumn("train", F.col("_rn") <= F.round(F.lit(share) * F.col("_all")).cast("long")).drop("_rn", "_all")


def class_weights(df: DataFrame) -> DataFrame:
    """Balanced: rows over classes times rows of the class."""
    n = df.groupBy("label").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("rows"), F.count("*").alias("classes"))
    return n.crossJoin(total).select("label", (F.col("rows").cast("double") / (F.col("classes") * F.col("n"))).alias("weight"))


def logistic(c: float = 1.0) -> Callable[[float], list]:
    """Stages for a sum of weights: MLlib averages the losses, so a penalty of 1/c on their sum is one of 1/(c * sum) here."""
    return lambda total: [LogisticRegression(featuresCol="scaled", labelCol="y", weightCol="weight", family="multinomial", maxIter=1000, regParam=1 / (c * max(total, 1.0)))]


def forest(trees: int = 200, depth: int = DEEPEST) -> forests.Trees:
    return forests.Trees(trees, depth)


@dataclass(frozen=True)
class Forest:
    """A forest over rows whose part is not the one held out.  It grows when something is asked of it; its trees are kept only for those who save it or predict other rows."""

    rows: forests.Rows
    how: forests.Trees
    held: int = 1
    seed: int = 42

    @cached_property
    def trees(self) -> DataFrame:
        return cut(forests.trees_of(self.rows, self.how, self.held, self.seed))


@dataclass(frozen=True)
class SavedForest:
    """What a saved forest predicts with."""

    rows: forests.Rows
    trees: DataFrame


def evaluated(scores: DataFrame, stages: forests.Trees | list | Callable[[float], list]) -> tuple[PipelineModel | Forest, DataFrame]:
    """The model fitted on the training part, scaler included, and its predictions on the rest: recipe_id, label, predicted."""
    df = cut(split(narrow(scores), "label"))
    weights = cut(class_weights(df.where("train")))
    if isinstance(stages, forests.Trees):
        train = df.where("train")
        balanced = {r.label: r.weight for r in weights.collect()}  # a row a class
        rows = forests.binned(df.withColumn("part", (~F.col("train")).cast("int")), "part", FEATURES, balanced, forests.edges_of(train, FEATURES), held=1)
        model = Forest(rows, stages)
        return model, forests.predictions(rows, stages, model.held, model.seed)
    df = df.join(F.broadcast(weights), "label")  # a row a class
    if callable(stages):  # balanced weights add up to the rows
        stages = stages(float(df.where("train").count()))
    before = [StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc"), VectorAssembler(inputCols=FEATURES, outputCol="vector"), StandardScaler(inputCol="vector", outputCol="scaled", withMean=True)]
    model = Pipeline(stages=[*before, *stages]).fit(df.where("train"))
    return model, predicted(model, df.where("not train"))


def save(model: PipelineModel | Forest, path: str) -> None:
    """Scaler, labels and classifier as one model, in place of what the path holds."""
    if not isinstance(model, Forest):
        model.write().overwrite().save(path)
        return
    trees, rows = model.trees, model.rows
    rows.chunks.sparkSession.createDataFrame([(rows.labels, rows.weights, rows.edges)], "labels array<string>, weights array<double>, edges array<array<double>>").write.mode("overwrite").parquet(f"{path}/forest")
    trees.write.mode("overwrite").parquet(f"{path}/trees")


def saved(path: str) -> PipelineModel | SavedForest:
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    if not exists(spark, f"{path}/forest"):
        return PipelineModel.load(path)
    r = spark.read.parquet(f"{path}/forest").first()
    return SavedForest(forests.Rows(None, 0, r.labels, r.weights, r.edges), spark.read.parquet(f"{path}/trees"))


def predicted(model: PipelineModel | Forest | SavedForest, df: DataFrame) -> DataFrame:
    """df(recipe_id, label, features) -> recipe_id, label, predicted."""
    if isinstance(model, (Forest, SavedForest)):
        old = model.rows
        rows = forests.binned(df.withColumn("part", F.lit(1)), "part", FEATURES, dict(zip(old.labels, old.weights, strict=True)), old.edges, held=1)
        return forests.most_voted(rows, forests.votes_of(rows, model.trees, 1, forests.tasks(df)), "recipe_id")
    names = F.array(*(F.lit(x) for x in model.stages[0].labels))
    return model.transform(df).select("recipe_id", "label", F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted"))


def metrics(predictions: DataFrame) -> DataFrame:
    """precision, recall, F1 and support of each class, and the macro average as class ``macro``."""
    c = predictions.groupBy("label", "predicted").agg(F.count("*").alias("n"))
    flat = c.select(F.col("label").alias("class"), F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).alias("called"))
    flat = flat.union(c.select(F.col("predicted"), F.lit(0), F.lit(0), F.col("n")))
    each = flat.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("called").alias("called"))
    p, r = F.coalesce(F.try_divide("tp", "called"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    each = each.select("class", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support")
    macro = each.agg(F.lit("macro").alias("class"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support"))
    return each.union(macro)


def coefficients(model: PipelineModel) -> DataFrame:
    """(label, feature, coefficient, place): features of each class by size."""
    from pyspark.sql import SparkSession

    labels, matrix = model.stages[0].labels, model.stages[-1].coefficientMatrix.toArray()
    rows = [(labels[i], f, float(matrix[i, j]), k + 1) for i in range(len(labels)) for k, j in enumerate(sorted(range(len(FEATURES)), key=lambda j: -abs(matrix[i, j]))) for f in [FEATURES[j]]]
    return SparkSession.active().createDataFrame(rows, "label string, feature string, coefficient double, place int")


def importances(model: Forest) -> DataFrame:
    found = forests.importances(model.rows, model.how, model.held, model.seed)
    return model.rows.chunks.sparkSession.createDataFrame(sorted(zip(FEATURES, found, strict=True), key=lambda x: -x[1]), "feature string, importance double")


def macro_f1(counts: dict[tuple[int, int], int]) -> float:
    """The mean of the classes' F1 over (class, predicted class) -> rows, as metrics() has it."""
    if not counts:
        return 0.0
    each = []
    for c in {x for pair in counts for x in pair}:
        hit, support, called = counts.get((c, c), 0), sum(n for (y, _), n in counts.items() if y == c), sum(n for (_, p), n in counts.items() if p == c)
        each.append(2 * hit / (support + called))
    return sum(each) / len(each)


def random_search(scores: DataFrame, combos: int = 30, folds: int = 5, seed: int = 42, grid: dict | None = None, parallelism: int = 4) -> DataFrame:
    """(combo, parameters, macro_f1): mean macro F1 of sampled parameter sets over stratified folds, the same folds for every set.

    A task grows the forests of some sets and folds, and there are ``parallelism`` tasks at least; the classes' shares are those of each fold, so the weights of all rows are too.  Ends of bins are of all rows.
    """
    grid = grid or GRID
    r = random.Random(seed)
    sets = [{k: r.choice(v) for k, v in grid.items()} for _ in range(combos)]
    df = dimensions.ranked(narrow(scores), "label", hashed("recipe_id", seed), "_rn")
    df = cut(df.withColumn("fold", (F.col("_rn") % folds).cast("int")).drop("_rn"))
    weights = {x.label: x.weight for x in class_weights(df).collect()}  # a row a class
    rows = forests.binned(df, "fold", FEATURES, weights, forests.edges_of(df, FEATURES))
    how = [forests.Trees(p["numTrees"], p["maxDepth"], p.get("featureSubsetStrategy", "auto"), p.get("minInstancesPerNode", 1)) for p in sets]
    found = forests.confusions(rows, how, folds, seed, parallelism)
    means = [sum(macro_f1(found.get((i, f), {})) for f in range(folds)) / folds for i in range(combos)]
    return df.sparkSession.createDataFrame([(i, str(sorted(p.items())), x) for i, (p, x) in enumerate(zip(sets, means, strict=True))], "combo int, parameters string, macro_f1 double")
