"""Number of boosting rounds that are used."""

import threading
import time

import numpy as np
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector, Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditlens.operators import ensemble as M
from creditlens.operators import explain as X
from creditlens.session import new_path

SCHEMA = T.StructType([
    T.StructField("features", VectorUDT()), T.StructField("target", T.IntegerType()), T.StructField("fold", T.IntegerType()),
    T.StructField("blocked", T.ArrayType(T.IntegerType())),
])


def test_rounds_until_stop():
    assert M.rounds_until_stop([3.0, 2.0, 2.5, 1.0, 1.0, 1.2, 0.5], 2) == 6
    assert M.rounds_until_stop([3.0, 2.0, 2.5, 1.0, 1.0, 1.2, 0.5], 3) == 7
    assert M.rounds_until_stop([1.0] * 100) == 26 and M.rounds_until_stop([float(-i) for i in range(100)]) == 100


def test_noisy_rounds_do_not_end_boosting(spark):
    rng = np.random.default_rng(7)
    rows = [(Vectors.dense(*map(float, rng.normal(size=3))), int(rng.integers(0, 2)), i % 2, [i % 2]) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = M.fit_folds(df, 2, rounds=12)
    assert [m.getNumTrees for m in whole] == [12, 12]
    short = M.fit_folds(df, 2, rounds=12, patience=2)
    for f, (a, b) in enumerate(zip(whole, short)):
        held = df.where(F.col("fold") == f)
        losses = a.evaluateEachIteration(held)
        assert b.getNumTrees == M.rounds_until_stop(losses, 2) < 12
        assert b.evaluateEachIteration(held) == losses[: b.getNumTrees]
        path = new_path(spark, "short")
        b.write().save(path)
        again = GBTClassificationModel.load(path)
        p = [[r[0] for r in M.ensemble_probability(held, [m], out="p").select("p").collect()] for m in (b, again, a)]
        assert p[0] == p[1] != p[2]


class Probe:
    """Stands for a classifier and keeps the vector that it is given."""

    def copy(self):
        return self

    def setFeaturesCol(self, name):
        self.features = name
        return self

    def setProbabilityCol(self, name):
        self.probability = name
        return self

    def setRawPredictionCol(self, name):
        return self

    setPredictionCol = setRawPredictionCol

    def transform(self, df):
        self.seen = df.select(self.features).first()[0]
        return df.withColumn(self.probability, array_to_vector(F.array(F.lit(0.25), F.lit(0.75))))


def test_members_look_entries_up_in_dense_vectors(spark):
    df = spark.createDataFrame([(1, Vectors.sparse(40, {3: 2.5, 17: -1.0}))], ["id", "features"])
    probe = Probe()
    scored, names = M.member_probabilities(df, [probe])
    assert isinstance(probe.seen, DenseVector)
    assert probe.seen == Vectors.sparse(40, {3: 2.5, 17: -1.0})
    assert scored.columns == ["id", "features", *names] and scored.first()[names[0]] == 0.75


def test_explanations_look_entries_up_in_dense_vectors(spark, monkeypatch):
    class Leaves(Probe):
        treeWeights = [1.0]

        def setLeafCol(self, name):
            self.leaf = name
            return self

        def transform(self, df):
            self.seen = df.select(self.features).first()[0]
            return df.withColumn(self.leaf, array_to_vector(F.array(F.lit(1.0))))

    monkeypatch.setattr(X, "leaf_contributions", lambda model, names: [(0, 0, [9.0, 9.0]), (0, 1, [0.5, -2.0])])
    df = spark.createDataFrame([(1, Vectors.sparse(40, {3: 2.5}))], ["id", "features"])
    probe = Leaves()
    got = {r["feature"]: r["contribution"] for r in X.explain_rows(df, probe, ["a"], "id").collect()}
    assert isinstance(probe.seen, DenseVector)
    assert got == {"a": 0.5, X.INTERCEPT: -2.0}


def test_fits_run_side_by_side_as_far_as_memory_allows(spark, monkeypatch):
    running, most, lock = [0], [0], threading.Lock()

    class Learner:
        getNumTrees = 1

        def __init__(self, **options):
            pass

        def fit(self, rows):
            with lock:
                running[0] += 1
                most[0] = max(most[0], running[0])
            time.sleep(0.5)
            with lock:
                running[0] -= 1
            return self

        def evaluateEachIteration(self, rows):
            return [1.0]

    monkeypatch.setattr(M, "GBTClassifier", Learner)
    rows = spark.createDataFrame([(Vectors.sparse(5, {1: 1.0}), 0, i % 5, [i % 5]) for i in range(1000)], SCHEMA)
    each = 800 * (M.POINT_BYTES + 5 * M.BIN_BYTES) if hasattr(M, "POINT_BYTES") else 0
    for memory, fits in ((5 * each, 5), (2 * each + 1, 2), (each // 2, 1)):
        most[0] = 0
        monkeypatch.setattr(M, "storage_memory", lambda spark: memory, raising=False)
        assert len(M.fit_folds(rows, 5)) == 5 and most[0] == fits
    assert M.side_by_side(rows.limit(0), 5, "features", 5) == 1


def test_storage_memory_is_that_of_the_session(spark):
    assert 0 < M.storage_memory(spark) < 1 << 40
