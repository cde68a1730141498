"""Curves of train and test side by side, exact samples, explanations without a shuffle, saved fill values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditlens.operators import curves as C
from creditlens.operators.explore import sample_rows
from creditlens.operators.impute import FillValues
from creditlens.operators.ranges import running_totals

RNG = np.random.default_rng(11)
SLICES = {"rows_per_range": 40, "max_ranges": 12}
N = 1500
# Two thirds of the rows are one part, a third one score; one part has a null name, one only good rows.
PART = [None if i % 23 == 0 else "few" if i % 31 == 0 else "train" if i % 3 else "test" for i in range(N)]
SCORE = [0.5 if i % 3 == 0 else round(float(x), 2) for i, x in enumerate(RNG.random(N))]
LABEL = [0 if p == "few" else int(RNG.random() < 0.2 + s / 3) for p, s in zip(PART, SCORE)]


@pytest.fixture(scope="module")
def parts(spark):
    rows = [*zip(PART, SCORE, LABEL), ("train", None, 1), ("train", float("nan"), 0), ("test", 0.3, None)]
    return spark.createDataFrame(rows, "part string, pd double, bad int").repartition(7)


def of(part):
    pick = np.array([p == part for p in PART])
    return np.array(SCORE)[pick], np.array(LABEL)[pick]


def area(score, label):
    bad, good = score[label == 1], score[label == 0]
    if not len(bad) or not len(good):
        return None
    wins = (bad[:, None] > good[None, :]).sum() + 0.5 * (bad[:, None] == good[None, :]).sum()
    return wins / (len(bad) * len(good))


def gap(score, label):
    bad, good = score[label == 1], score[label == 0]
    return max(abs((good <= x).mean() - (bad <= x).mean()) for x in set(score)) if len(bad) and len(good) else None


@pytest.mark.parametrize("options", [{}, SLICES])
def test_totals_start_anew_in_each_part(parts, options):
    got = {}
    for r in running_totals(parts.where("bad is not null"), "pd", {"n": F.lit(1)}, by=["part"], **options).collect():
        got.setdefault(r["part"], []).append((r["pd"], r["n"], r["n_before"]))
    assert set(got) == set(PART)
    for part, rows in got.items():
        score, _ = of(part)
        assert sorted(rows) == [(x, int((score == x).sum()), int((score < x).sum())) for x in sorted(set(score))]


@pytest.mark.parametrize("options", [{}, SLICES])
def test_curves_of_each_part(parts, options):
    areas = {r["part"]: r["auc"] for r in C.auc(parts, "pd", "bad", by=["part"], **options).collect()}
    table = {r["part"]: r for r in C.evaluation(parts, "pd", "bad", ["part"], 0.5, **options).collect()}
    tests = {r["part"]: r for r in C.ks_two_sample(parts, "pd", F.col("bad") == 1, by=["part"], **options).collect()}
    points = {}
    for r in C.roc_points(parts, "pd", "bad", by=["part"], **options).collect():
        points.setdefault(r["part"], {})[r["threshold"]] = (r["fpr"], r["tpr"])
    assert set(areas) == set(table) == set(tests) == set(points) == set(PART)
    for part in areas:
        score, label = of(part)
        hit = score > 0.5
        row = table[part]
        assert (row["n"], row["bad"]) == (len(score), label.sum())
        assert row["accuracy"] == pytest.approx((hit == label).mean())
        assert row["precision"] == pytest.approx(label[hit].mean() if hit.any() else 0) and areas[part] == row["auc"]
        for found, want in ((row["auc"], area(score, label)), (row["ks"], gap(score, label)), (tests[part]["statistic"], gap(score, label))):
            assert found == (None if want is None else pytest.approx(want))
        assert row["recall"] == pytest.approx(hit[label == 1].mean() if label.any() else 0)
        assert tests[part]["p_value"] == row["p_value"]
        for x, (fpr, tpr) in points[part].items():
            assert fpr == pytest.approx((score[label == 0] >= x).mean())
            assert tpr == (pytest.approx((score[label == 1] >= x).mean()) if label.any() else None)


def test_evaluation_of_no_rows(parts):
    none = parts.where("false")
    assert C.evaluation(none, "pd", "bad", ["part"]).count() == C.auc(none, "pd", "bad", by=["part"]).count() == 0
    assert C.auc(none, "pd", "bad").first()["auc"] is None
    with pytest.raises(ValueError):
        C.evaluation(none, "pd", "bad", [])


def test_confusion_of_each_part(parts):
    got = {(r["part"], r["true_label"], r["pred_label"]): r["n"] for r in C.confusion_counts(parts, "pd", "bad", 0.5, ["part"]).collect()}
    for part in set(PART):
        score, label = of(part)
        # NaN is larger than any threshold for Spark.
        extra = int(part == "train")
        assert [got[part, t, p] for t in (0, 1) for p in (0, 1)] == [
            int(((label == t) & ((score > 0.5) == p)).sum()) + (extra if (t, p) == (0, 1) else 0) for t in (0, 1) for p in (0, 1)]


@pytest.mark.parametrize("n", [0, 1, 7, 500, 2999, 3000, 9999])
def test_samples_are_the_first_rows_by_hash(spark, n):
    from creditlens.functions.hashing import row_hash

    # Ids that differ by the modulus share their hash.
    ids = spark.range(1000).select(F.explode(F.array(*[F.col("id") + k * 2147483647 for k in range(3)])).alias("id")).repartition(5)
    want = [r["id"] for r in ids.orderBy(row_hash(F.col("id"), 3), "id").limit(n).collect()]
    got = sample_rows(ids, "id", n, 3)
    assert sorted(r["id"] for r in got.collect()) == sorted(want)
    assert "TakeOrdered" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_sample_takes_null_ids_first(spark):
    df = spark.createDataFrame([(5,), (None,), (6,)], "id long")
    assert sample_rows(df, "id", 1).collect() == [(None,)]
    assert sample_rows(df.where("false"), "id", 4).count() == 0


def test_fill_values_survive_a_table(spark, tmp_path):
    fill = FillValues({"a": "x", "b": 1.5, "c": None, "d": "", "e": 3})
    fill.to_table(spark).write.parquet(str(tmp_path / "fill"))
    assert FillValues.from_table(spark.read.parquet(str(tmp_path / "fill"))).values == {"a": "x", "b": 1.5, "c": None, "d": "", "e": 3.0}


@pytest.fixture(scope="module")
def graded(spark, sf_dir):
    from creditlens.plans.training import train_on_raw
    from creditlens.sources import views as V
    from creditlens.session import write_stage

    raw = write_stage(V.loan_raw(spark, sf_dir), "raw")
    return raw, train_on_raw(raw, "id_aplikasi", rounds=40)


def test_a_saved_scorer_scores_raw_applications(spark, graded, tmp_path):
    from creditlens.plans import preparation as P
    from creditlens.plans import scoring as R
    from creditlens.plans.training import Scorer

    raw, scorer = graded
    scorer.save(str(tmp_path / "scorer"))
    again = Scorer.load(str(tmp_path / "scorer"))
    key = lambda df: sorted((r["id_aplikasi"], str(tuple(r))) for r in df.collect())
    want = R.score_raw(raw, scorer, "id_aplikasi")
    assert key(R.score_raw(raw, again, "id_aplikasi")) == key(want)
    # One application alone gets what it gets among all others: nothing is learned from the rows to score.
    rows = {r["id_aplikasi"]: r for r in want.collect()}
    assert set(rows) == {r["id_aplikasi"] for r in raw.select("id_aplikasi").collect()}
    some = [i for i in sorted(rows) if rows[i]["error"] is None][:3] + [i for i in sorted(rows) if rows[i]["error"]][:2]
    for i in some:
        assert R.score_raw(raw.where(f"id_aplikasi = {i}"), again, "id_aplikasi").collect() == [rows[i]]
    # The rows of the segment score as the prepared table does.
    table = P.model_input(P.prepare(raw, "id_aplikasi"), "id_aplikasi")
    batch = R.score_applications(table, scorer, scorer.grades, ["id_aplikasi"])
    assert key(want.where("error is null")) == key(batch.where("error is null"))
    assert {r["error"] for r in rows.values()} >= {None, "not in the segment"}


def test_evaluation_of_a_scorer(spark, graded):
    from creditlens.plans import evaluation as V
    from creditlens.plans import preparation as P

    raw, scorer = graded
    table = P.model_input(P.prepare(raw, "id_aplikasi"), "id_aplikasi")
    last = scorer.grades.count() - 1
    found = {(r["model"], r["split"]): r for r in V.evaluate_at_grade(table, scorer, "id_aplikasi", last).collect()}
    assert set(found) == {(m, s) for m in [V.ENSEMBLE, *[f"fold {i}" for i in range(len(scorer.models))]] for s in ("train", "test")}
    scores = V.model_scores(table, scorer, "id_aplikasi").collect()
    for (model, split), row in found.items():
        own = [(r["pd"], r["target"]) for r in scores if (r["model"], r["split"]) == (model, split)]
        score, label = np.array([p for p, _ in own]), np.array([t for _, t in own])
        assert row["n"] == len(own) and row["auc"] == pytest.approx(area(score, label)) and row["ks"] == pytest.approx(gap(score, label))
        assert row["accuracy"] == pytest.approx(((score > row["threshold"]) == label).mean())
    with pytest.raises(ValueError):
        V.grade_threshold(scorer.grades, 99)


def test_explanations_need_no_shuffle(spark, graded):
    from creditlens.operators import encode as E
    from creditlens.operators import explain as X
    from creditlens.plans import preparation as P

    raw, scorer = graded
    table = P.model_input(P.prepare(raw, "id_aplikasi", scorer.fill), "id_aplikasi")
    vectors = E.encode(scorer.encoder, table).select("id_aplikasi", "features")
    plan = X.explain_rows(vectors, scorer.models[0], scorer.feature_names, "id_aplikasi")
    extra = plan._jdf.queryExecution().executedPlan().toString().count("Exchange") - vectors._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert extra == 0
