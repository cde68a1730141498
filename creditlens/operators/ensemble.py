"""Tree ensembles per fold, their combined probability, split counts, grid search."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool
from operator import add

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from creditlens.session import new_path

# --- fixed values ---------------------------------------------------------------------------

STEP_SIZE = 0.05
MAX_DEPTH = 5
ROW_SHARE = 0.75
COLUMN_SHARE = "0.9"
ROUNDS = 100
PATIENCE = 25
MAX_BINS = 256
# What a boosted-tree learner keeps per row: objects for its bins, residual, sample count and errors, and each bin.
POINT_BYTES = 180
BIN_BYTES = 4
FOREST_TREES = 10
FOREST_LEAF_SIZES = [5, 10]


def rounds_until_stop(losses: list[float], patience: int = PATIENCE) -> int:
    """Number of rounds until ``patience`` of them in a row brought no lower loss; those rounds count too."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return i + 1
    return len(losses)


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The model of the first ``n`` rounds."""
    known = model._java_obj
    jvm = SparkSession.active().sparkContext._jvm
    java_model = jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        known.uid(), known.trees()[0:n], known.treeWeights()[0:n], known.numFeatures(), known.numClasses()
    )
    out = model._copyValues(GBTClassificationModel(java_model))
    out._transfer_params_to_java()
    return out


def storage_memory(spark: SparkSession) -> int:
    """Bytes in which the executors can keep blocks; those of the driver count if there is no other."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getExecutorMemoryStatus().iterator()
    sizes = {}
    while found.hasNext():
        entry = found.next()
        sizes[entry._1()] = entry._2()._1()
    driver = sc._jvm.org.apache.spark.SparkEnv.get().blockManager().blockManagerId().hostPort()
    return sum(n for at, n in sizes.items() if at != driver) or sizes.get(driver, 0)


def side_by_side(rows: DataFrame, folds: int, features: str, parallelism: int) -> int:
    """How many fits run at a time: as many as can keep the rows they learn from in memory, but at least one.

    A fit reads its rows in some 500 passes. If the rows of all fits do not fit together, each drives those of the others to disk.
    """
    widths = rows.select(F.size(vector_to_array(features)).alias("width")).first()
    if widths is None:
        return 1
    # Of the folds, a model learns from all but one.
    points = rows.count() * (folds - 1) // folds
    bytes_each = points * (POINT_BYTES + widths["width"] * BIN_BYTES)
    return max(1, min(folds, parallelism, storage_memory(rows.sparkSession) // max(1, bytes_each)))


def fit_folds(
    rows: DataFrame,
    folds: int,
    label: str = "target",
    features: str = "features",
    rounds: int = ROUNDS,
    weight: str | None = None,
    seed: int = 1,
    parallelism: int = 5,
    patience: int = PATIENCE,
) -> list:
    """One boosted-tree model per fold, validated on the fold that it does not learn from.

    ``rows`` carries ``fold`` (null for synthetic rows) and ``blocked``, the folds whose models must
    not learn from the row. All rounds are fitted; those after ``patience`` rounds without a lower loss
    on the held-out fold are not used. The fits run side by side as far as memory allows, which does not change the models.
    """
    learner = GBTClassifier(
        labelCol=label, featuresCol=features, maxIter=rounds, maxDepth=MAX_DEPTH, stepSize=STEP_SIZE,
        subsamplingRate=ROW_SHARE, featureSubsetStrategy=COLUMN_SHARE, maxBins=MAX_BINS, seed=seed,
    )
    if weight:
        learner = learner.setWeightCol(weight)

    def fit(f: int):
        model = learner.fit(rows.where(~F.array_contains("blocked", f)))
        used = rounds_until_stop(model.evaluateEachIteration(rows.where(F.col("fold") == f)), patience)
        return model if used == model.getNumTrees else first_trees(model, used)

    # The fits are independent jobs; side by side they fill the gaps between each other's small stages.
    with ThreadPool(side_by_side(rows, folds, features, parallelism)) as pool:
        return pool.map(inheritable_thread_target(rows.sparkSession)(fit), range(folds), chunksize=1)


def combine(columns: list[Column], method: str = "max") -> Column:
    """One probability out of several: their maximum, at least 0, or their mean."""
    if method == "max":
        return F.greatest(F.lit(0.0), *columns)
    if method == "mean":
        return reduce(add, columns) / len(columns)
    raise ValueError(f"unknown method {method}")


def dense(vector: str) -> Column:
    """The vector with every entry in its place. Trees look entries up one at a time, which is a search in a sparse vector."""
    return array_to_vector(vector_to_array(vector))


def member_probabilities(df: DataFrame, models: list, features: str = "features") -> tuple[DataFrame, list[str]]:
    """Add the positive-class probability of each model; works for any probabilistic classifier."""
    names = [f"_p{i}" for i in range(len(models))]
    out = df.withColumn("_dense", dense(features))
    for name, model in zip(names, models):
        quiet = model.copy().setFeaturesCol("_dense").setProbabilityCol(name).setRawPredictionCol("").setPredictionCol("")
        out = quiet.transform(out).withColumn(name, vector_to_array(name)[1])
    return out.drop("_dense"), names


def ensemble_probability(
    df: DataFrame, models: list, method: str = "max", features: str = "features", out: str = "pd"
) -> DataFrame:
    scored, names = member_probabilities(df, models, features)
    return scored.withColumn(out, combine([F.col(n) for n in names], method)).drop(*names)


def node_table(models: list) -> DataFrame:
    """Nodes of all trees: (model, tree, node, prediction, gain, left, right, feature, threshold).

    Read from the models as saved in the shared folder; a leaf has no feature.
    """
    spark = SparkSession.active()
    tables = []
    for i, model in enumerate(models):
        path = new_path(spark, "model")
        model.write().save(path)
        n = F.col("nodeData")
        leaf = n["leftChild"] < 0
        tables.append(spark.read.parquet(f"{path}/data").select(
            F.lit(i).alias("model"), F.col("treeID").alias("tree"), n["id"].alias("node"),
            n["prediction"].alias("prediction"), n["gain"].alias("gain"),
            F.when(~leaf, n["leftChild"]).alias("left"), F.when(~leaf, n["rightChild"]).alias("right"),
            F.when(~leaf, n["split"]["featureIndex"]).alias("feature"),
            F.when(~leaf, F.get(n["split"]["leftCategoriesOrThreshold"], 0)).alias("threshold"),
        ))
    return reduce(DataFrame.unionByName, tables)


def split_importance(models: list, names: list[str]) -> DataFrame:
    """Number of splits on each feature, averaged over the models; 0 for a feature never used."""
    splits = node_table(models).where("feature is not null").groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    spark = splits.sparkSession
    spine = spark.createDataFrame(list(enumerate(names)), "feature int, name string")
    return (
        spine.join(splits, "feature", "left")
        .select(F.col("name").alias("feature"), (F.coalesce("n", F.lit(0)) / len(models)).alias("importance"))
        .orderBy(F.desc("importance"), "feature")
    )


def forest_grid_search(
    rows: DataFrame,
    folds: int,
    label: str = "target",
    features: str = "features",
    weight: str = "weight",
    fold: str = "fold",
    leaf_sizes: list[int] = FOREST_LEAF_SIZES,
    seed: int = 1,
):
    """Random forests over leaf sizes, scored by accuracy on given folds.

    Returns the table (leaf_size, mean_accuracy, std_accuracy) and the best model.
    """
    forest = RandomForestClassifier(
        labelCol=label, featuresCol=features, weightCol=weight, numTrees=FOREST_TREES, seed=seed
    )
    grid = ParamGridBuilder().addGrid(forest.minInstancesPerNode, leaf_sizes).build()
    search = CrossValidator(
        estimator=forest, estimatorParamMaps=grid, numFolds=folds, foldCol=fold, parallelism=2, seed=seed,
        evaluator=MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy"),
    ).fit(rows)
    table = rows.sparkSession.createDataFrame(
        list(zip(leaf_sizes, map(float, search.avgMetrics), map(float, search.stdMetrics))),
        "leaf_size int, mean_accuracy double, std_accuracy double",
    )
    return table, search.bestModel
