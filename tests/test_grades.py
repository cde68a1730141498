"""Clusters of scores against all possible cuts, and the grades that are learned from them."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from creditlens.catalog import check_queries as checks
from creditlens.catalog import model_queries
from creditlens.operators import grading as G
from creditlens.plans.training import Scorer


def spread(values):
    mean = sum(values) / len(values)
    return sum((v - mean) ** 2 for v in values)


def least_spread(values, k):
    """The least sum of squared distances over all ways to cut the different values into at most k intervals."""
    distinct = sorted(set(values))
    ways = itertools.combinations(range(1, len(distinct)), min(k, len(distinct)) - 1)
    best = None
    for cut in ways:
        limits = [distinct[c] for c in cut]
        groups = [[] for _ in range(len(limits) + 1)]
        for v in values:
            groups[sum(v >= x for x in limits)].append(v)
        total = sum(map(spread, groups))
        best = total if best is None else min(best, total)
    return best


@pytest.mark.parametrize("seed", range(4))
def test_clusters_are_the_best_intervals(spark, seed):
    rng = random.Random(seed)
    values = [round(rng.choice([0.01, 0.2, 0.7]) + rng.random() / 5, 2) for _ in range(60)]
    values = [v for v in values if v in sorted(set(values))[:14]]
    for k in (1, 2, 3, 5, 40):
        df = spark.createDataFrame([(v,) for v in values], "pd double")
        groups = {}
        for r in G.cluster_scores(df, "pd", k).collect():
            groups.setdefault(r.cluster, []).append(r.pd)
        assert sorted(groups) == list(range(min(k, len(set(values)))))
        assert sum(map(spread, groups.values())) == pytest.approx(least_spread(values, min(k, len(set(values)))), abs=1e-9)
        ordered = [groups[c] for c in sorted(groups)]
        assert all(max(a) < min(b) for a, b in zip(ordered, ordered[1:]))


def test_more_values_than_cells(spark):
    df = spark.range(5000).select((F.col("id") / 5000).alias("pd"))
    got = G.cluster_scores(df, "pd", 4, cells=100).groupBy("cluster").agg(F.count("*").alias("n"), F.min("pd").alias("a"), F.max("pd").alias("b")).orderBy("cluster").collect()
    assert [r.n for r in got] == [1250] * 4 and all(x.b < y.a for x, y in zip(got, got[1:]))


def test_missing_scores_have_no_cluster(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (0.1,), (0.1,), (0.9,)], "pd double")
    assert [r.cluster for r in G.cluster_scores(df, "pd", 3).collect()] == [None, None, 0, 0, 1]
    assert G.cluster_scores(df.where("false"), "pd").count() == 0


def scored(spark, rates, n=200):
    rows = [(c / 10 + i / 10_000, int(i < rate * n)) for c, rate in enumerate(rates) for i in range(n)]
    return spark.createDataFrame(rows, "pd double, target int")


def test_neighbours_with_falling_defaults_are_pooled(spark):
    df = scored(spark, [0.01, 0.05, 0.04, 0.10, 0.30, 0.20, 0.15])
    grades = G.learn_grades(df, "pd", "target", 7).orderBy("Rating").collect()
    assert [g.Total for g in grades] == [200, 400, 200, 600]
    assert [g["PD(%)"] for g in grades] == sorted(g["PD(%)"] for g in grades)
    rules = G.GradeRules(spark.createDataFrame(grades))
    graded = df.withColumn("rating", rules.rating(F.col("pd"))).groupBy("rating").count().orderBy("rating").collect()
    # The upper end of the last grade but one belongs to the last.
    assert [tuple(r) for r in graded] == [(1, 200), (2, 400), (3, 199), (4, 601)]


def test_too_few_grades_are_refused(spark):
    with pytest.raises(ValueError):
        G.learn_grades(scored(spark, [0.3, 0.2, 0.1]), "pd", "target", 3)


def test_grades_are_saved_with_the_scorer(spark, tmp_path):
    from pyspark.ml import PipelineModel

    grades = G.learn_grades(scored(spark, [0.01, 0.05, 0.10, 0.30]), "pd", "target", 4)
    for own in (None, grades):
        path = str(tmp_path / ("with" if own is not None else "without"))
        Scorer(PipelineModel([]), [], "mean", own).save(path)
        loaded = Scorer.load(path)
        assert loaded.method == "mean" and (loaded.grades is None) == (own is None)
        if own is not None:
            assert sorted(loaded.grades.collect()) == sorted(own.collect())


def test_two_grades_are_enough(spark):
    df = scored(spark, [0.0, 0.0, 0.5])
    rules = G.GradeRules(G.learn_grades(df, "pd", "target", 3))
    got = {r["pd"]: (r["rating"], r["score"]) for r in df.select("pd", rules.rating(F.col("pd")).alias("rating"), rules.score(F.col("pd")).alias("score")).collect()}
    assert {r for r, _ in got.values()} == {1, 2} and all(s is not None for _, s in got.values())
    assert max(p for p, (r, _) in got.items() if r == 1) < min(p for p, (r, _) in got.items() if r == 2)


def test_the_check_of_grades_knows_tables_of_two(spark):
    columns = "Rating int, Proba_MIN double, Proba_MAX double, Score_MIN double, Score_MAX double"
    grades = spark.createDataFrame([(1, 0.1, 0.3, 400.0, 1000.0), (2, 0.4, 0.9, 0.0, 200.0)], columns)
    df = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.2, 0.3, 0.35, 0.4, 0.9, 1.0)], "pd double")
    rows = checks._graded(G.add_grades(df, grades), grades).collect()
    assert [r.rating for r in rows] == [1, 1, 1, 1, 2, 2, 2, 2]
    assert all(r.grade_holds for r in rows)
    wrong = G.add_grades(df, grades).withColumn("rating", 3 - F.col("rating"))
    assert not any(r.grade_holds for r in checks._graded(wrong, grades).collect())


def test_scores_are_made_once_for_their_clusters(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    scores = spark.range(50).select(F.col("id").alias("id_aplikasi"), F.udf(counted, "double")(F.col("id") / 100).alias("pd"))
    monkeypatch.setattr(model_queries, "_probabilities", lambda *_: scores)
    rows = model_queries.h15(spark, "").collect()
    assert sorted(r.id_aplikasi for r in rows) == list(range(50)) and {r.cluster for r in rows} == set(range(8))
    assert seen.value == 50
