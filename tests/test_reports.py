"""Risk tables, weights of evidence, curves and grades."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from creditlens import schemas as S
from creditlens.operators import curves as C
from creditlens.operators import explore as E
from creditlens.operators import grading as G
from creditlens.operators import risk as K
from creditlens.operators import woe as W

RNG = np.random.default_rng(11)
SCORES = RNG.beta(2, 12, 900).round(3)
LABELS = (RNG.random(900) < SCORES * 2).astype(int)


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(i, float(p), int(b)) for i, (p, b) in enumerate(zip(SCORES, LABELS))]
    return spark.createDataFrame(rows, "id long, pd double, bad int").repartition(4).cache()


def by_bucket(df):
    return df.orderBy("bucket").toPandas()


def test_ks_table(scored):
    table = by_bucket(K.ks_table(scored, "pd", "bad"))
    buckets = pd.qcut(pd.Series(SCORES), 10, labels=False) + 1
    pdf = pd.DataFrame({"b": buckets, "bad": LABELS, "p": SCORES}).groupby("b").agg(
        lo=("p", "min"), bad=("bad", "sum"), n=("bad", "size"))
    good = pdf["n"] - pdf["bad"]
    gap = (pdf["bad"] / LABELS.sum()).cumsum() - (good / (1 - LABELS).sum()).cumsum()
    assert table["min_scr"].tolist() == pdf["lo"].tolist()
    assert table["tot_bad"].tolist() == pdf["bad"].tolist()
    assert table["total"].sum() == 900
    assert table["ks"].tolist() == pytest.approx(gap.round(4).abs().tolist())
    marks = table["max_ks"] == "<----"
    assert marks.any() and (marks == (table["ks"] == table["ks"].max())).all()


def test_empty_buckets_and_rows_outside(spark):
    df = spark.createDataFrame([(0.0, 1), (0.5, 0), (0.6, 1), (2.5, 0), (9.0, 1)], "x double, bad int")
    table = by_bucket(K.pd_table(df, "x", "bad", bins=[0, 1, 2, 3]))
    assert table["total"].tolist() == [2, 0, 1]
    assert table["tot_bad"].tolist() == [1, 0, 0]
    assert table["pct_bad"].tolist() == pytest.approx([1 / 3, 0, 0])  # all three bads are in the total
    assert math.isnan(table["PD_min"][1])


def test_odds_text(spark):
    df = spark.createDataFrame([(10, 3), (5, 0), (0, 0), (0, 4)], "good long, bad long")
    assert [r["o"] for r in df.select(K.format_odds(F.col("good"), F.col("bad")).alias("o")).collect()] == ["3.33", "inf", "nan", "0.00"]


def test_woe_of_one_sided_buckets(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 0), (4.0, 1), (4.0, 0), (4.0, 0)], "x double, bad int")
    table = by_bucket(K.woe_numeric(df, "x", "bad", bins=[0, 1, 2, 3, 5]))
    assert table["WoE"][0] == math.inf and table["WoE"][1] == -math.inf
    assert math.isnan(table["WoE"][2])
    assert table["WoE"][3] == pytest.approx(math.log((1 / 2) / (2 / 3)))
    assert K.total_iv(K.woe_numeric(df, "x", "bad", bins=[0, 1, 2, 3, 5])).first()["iv"] == math.inf


def test_iv_is_never_negative(scored):
    table = K.woe_numeric(scored, "pd", "bad", bins=[0, 0.05, 0.1, 0.2, 1.0])
    assert all(r["IV"] >= 0 for r in table.collect())


def test_limited_woe(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0), ("c", 1), ("c", 0), (None, 0)], "x string, y int")
    got = {r["value"]: r for r in W.woe_single(df, "x", "y").collect()}
    assert set(got) == {"a", "b", "c"}
    assert got["a"]["woe"] == 20 and got["b"]["woe"] == -20
    assert got["c"]["woe"] == pytest.approx(math.log((1 / 2) / (1 / 3)))
    own = {r["value"]: r["woe"] for r in W.woe_single(df, "x", "y", event=0, low=-3, high=3).collect()}
    assert own["a"] == -3 and own["b"] == 3


def test_label_must_be_binary(spark):
    df = spark.createDataFrame([(0,), (1,), (2,)], "y int")
    with pytest.raises(ValueError, match="binary"):
        W.check_binary(df, "y")
    W.check_binary(df.where("y < 2"), "y")


def test_woe_replace_keeps_unknown_values(spark):
    learn = spark.createDataFrame([(1, 1, 1.0), (1, 0, 2.0), (2, 0, 1.0), (2, 1, 2.0), (2, 0, 2.0)], "x int, y int, z double")
    table = W.woe_table(learn, ["x", "z"], "y")
    woe = {(r["feature"], r["value"]): r["woe"] for r in table.collect()}
    rows = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (2, 77, 1.0)], "i int, x int, z double")
    got = {r["i"]: r for r in W.woe_replace(rows, ["x", "z"], table).collect()}
    assert got[0]["x"] == woe["x", 1.0] and got[1]["x"] == woe["x", 2.0] and got[2]["x"] == 77
    assert got[1]["z"] == woe["z", 2.0]


def test_combination_keys(spark):
    df = spark.createDataFrame([(1, 11, 1), (11, 1, 0), (2, 2, 1)], "a int, b int, y int")
    assert {r["value"] for r in W.combined_iv(df, ["a", "b"], "y").collect()} == {"111", "22"}
    assert W.combined_iv(df, ["a", "b"], "y", sep="|").count() == 3


@pytest.mark.parametrize("options", [{}, {"rows_per_range": 60, "max_ranges": 8}])
def test_auc_is_the_rank_formula(scored, options):
    bad, good = SCORES[LABELS == 1], SCORES[LABELS == 0]
    wins = (bad[:, None] > good[None, :]).sum() + 0.5 * (bad[:, None] == good[None, :]).sum()
    got = C.auc(scored, "pd", "bad", **options).first()
    assert got["auc"] == pytest.approx(wins / (len(bad) * len(good)))
    assert got["gini"] == pytest.approx(2 * got["auc"] - 1)


@pytest.mark.parametrize("options", [{}, {"rows_per_range": 60, "max_ranges": 8}])
def test_ks_statistic(scored, options):
    points = np.unique(SCORES)
    a = np.searchsorted(np.sort(SCORES[LABELS == 0]), points, side="right") / (LABELS == 0).sum()
    b = np.searchsorted(np.sort(SCORES[LABELS == 1]), points, side="right") / (LABELS == 1).sum()
    got = C.ks_two_sample(scored, "pd", F.col("bad") == 1, **options).first()
    assert got["statistic"] == pytest.approx(np.abs(a - b).max())
    assert 0 <= got["p_value"] <= 1


def test_kolmogorov_tail(spark):
    got = spark.range(1).select(*[C.kolmogorov_tail(F.lit(x)).alias(str(i)) for i, x in enumerate([0.0, 0.5, 1.0, 1.36, 3.0])]).first()
    assert list(got) == pytest.approx([1.0, 0.9639452436648751, 0.26999967167735456, 0.0494859, 3.0459959e-8], rel=1e-4)


def test_confusion_has_all_cells(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1)], "p double, y int")
    got = {(r["true_label"], r["pred_label"]): r["n"] for r in C.confusion_counts(df, "p", "y", 0.8).collect()}
    assert got == {(0, 0): 0, (0, 1): 0, (1, 0): 1, (1, 1): 1}
    report = {r["label"]: r for r in C.classification_report(df, "p", "y", 0.8).collect()}
    assert report[1]["precision"] == 1 and report[1]["recall"] == 0.5 and report[0]["support"] == 0


def test_histogram_matches_numpy(scored):
    table = E.histogram(scored, "pd").orderBy("bin").toPandas()
    bins = math.ceil(math.sqrt(1000))
    want, edges = np.histogram(SCORES, bins=np.linspace(SCORES.min(), SCORES.max(), bins + 1))
    assert table["n"].tolist() == want.tolist()
    assert table["lo"].tolist() == pytest.approx(edges[:-1].tolist())


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(2.0,)] * 5, "x double")
    assert E.histogram(df, "x").agg(F.sum("n")).first()[0] == 5


def test_density_sums_to_one(scored):
    table = E.class_density(scored, "pd", "bad")
    for r in table.groupBy("bad").agg(F.sum(F.col("density") * (F.col("hi") - F.col("lo"))).alias("area")).collect():
        assert r["area"] == pytest.approx(1.0)


def test_edges_end_at_one(scored):
    edges = [r["edge"] for r in E.edge_builder(scored, "pd").orderBy("position").collect()]
    assert len(edges) == 11 and edges[0] == SCORES.min() and edges[-1] == 1.0


# Grades --------------------------------------------------------------------------------------


def graded(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, pd double")
    return [(r["rating"], r["score"]) for r in G.add_grades(df, G.default_grades(spark)).orderBy("i").collect()]


def test_published_example(spark):
    (rating, score), = graded(spark, [0.10587982833385468])
    assert rating == 4 and score == pytest.approx(788.0156983267789, abs=1e-9)


def test_band_ends(spark):
    uppers = [g[2] for g in S.GRADES]
    ratings = [r for r, _ in graded(spark, uppers[:7])]
    assert ratings == [1, 2, 3, 4, 5, 6, 8]
    got = graded(spark, [0.0, 1.0, -0.1, 1.1, None])
    assert got[0][0] == 1 and got[0][1] > 1000
    assert got[1] == (8, 0.0)
    assert got[2:] == [(None, None)] * 3


def test_score_falls_as_probability_rises(spark):
    scores = [s for _, s in graded(spark, [i / 1000 for i in range(0, 1000, 7)])]
    assert all(a > b for a, b in zip(scores, scores[1:]))


def test_grades_must_rise(spark):
    rows = [list(g) for g in S.GRADES]
    rows[3][2] = 0.01
    with pytest.raises(ValueError, match="rise"):
        G.GradeRules(spark.createDataFrame([tuple(r) for r in rows], S.GRADE_SCHEMA))


def test_grade_scores_follow_from_the_probabilities(spark):
    points = [(g[0], p, 1 if i < g[0] else 0) for g in S.GRADES for i, p in enumerate((g[1], g[2], g[2], g[2], g[2], g[2], g[2], g[2]))]
    df = spark.createDataFrame(points, "cluster int, pd double, bad int")
    got = [(r["Rating"], r["Score_MIN"], r["Score_MAX"]) for r in G.build_grades(df, "pd", "bad").orderBy("Rating").collect()]
    assert got == [(g[0], g[3], g[4]) for g in S.GRADES]


def test_clusters_are_repeatable(scored):
    a = G.cluster_scores(scored, "pd").select("id", "cluster").collect()
    b = G.cluster_scores(scored, "pd").select("id", "cluster").collect()
    assert sorted(a) == sorted(b) and len({r["cluster"] for r in a}) == 8
