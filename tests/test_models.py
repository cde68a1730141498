"""Neighbours, synthetic rows, encoding, training, scoring, streaming."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from creditlens import schemas as S
from creditlens.catalog import QUERIES
from creditlens.operators import balance as B
from creditlens.operators import encode as E
from creditlens.operators import ensemble as M
from creditlens.operators import explain as X
from creditlens.operators import grading as G
from creditlens.operators import split as D
from creditlens.plans import preparation as P
from creditlens.plans import scoring as R
from creditlens.plans.training import Scorer, train
from creditlens.session import new_path, write_stage
from creditlens.sources import views as V
from creditlens.streaming.scoring import start_scoring

RNG = np.random.default_rng(3)


def brute_force(points, k):
    out = {}
    for i, (pid, v) in enumerate(points):
        d = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), other) for other, w in points if other != pid)
        out[pid] = [(n, dist) for dist, n in d[:k]]
    return out


@pytest.mark.parametrize("options", [{}, {"cell": 8, "block": 16}, {"cell": 4, "block": 6, "fanout": 3}, {"cell": 2, "block": 3, "fanout": 2, "depth": 1}])
def test_neighbours_with_a_third_of_copies(spark, options):
    vectors = [(3.0, 4.0)] * 50 + [tuple(map(float, v)) for v in RNG.integers(0, 12, (100, 2))]
    points = [(i * 3, v) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([(i, *v) for i, v in points], "id long, a double, b double").repartition(3)
    got = {}
    for r in B.nearest_neighbours(df, "id", ["a", "b"], 5, **options).collect():
        got.setdefault(r["id"], []).append((r["slot"], r["neighbour"], r["distance2"]))
    want = brute_force(points, 5)
    assert {i: [(n, d) for _, n, d in sorted(v)] for i, v in got.items()} == want


def test_neighbour_queries_use_every_feature(spark, sf_dir):
    rows = P.model_input(P.prepare(V.loan_raw(spark, sf_dir), "id_aplikasi"), "id_aplikasi").where("target is not null")
    model = E.fit_encoder(rows)
    names = E.feature_names(model)
    assert len(names) == 24
    vectors = E.wide(E.encode(model, rows).select("id_aplikasi", "target", "features"), names).where("target = 1").collect()
    value = {r["id_aplikasi"]: tuple(r[n] for n in names) for r in vectors}
    got = {}
    for r in QUERIES["h9_nearest_neighbours_all_features"](spark, sf_dir).collect():
        got.setdefault(r["id_aplikasi"], []).append((r["slot"], r["neighbour"], r["distance2"]))
    assert {i: [(n, d) for _, n, d in sorted(v)] for i, v in got.items()} == brute_force(list(value.items()), 5)
    new = QUERIES["h9_synthetic_minority_all_features"](spark, sf_dir).collect()
    assert new and set(names) < set(new[0].asDict())
    for r in new:
        assert r["neighbour"] in {n for _, n, _ in got[r["parent"]]}
        for j, c in enumerate(names):
            low, high = sorted((value[r["parent"]][j], value[r["neighbour"]][j]))
            assert low - 1e-6 <= r[c] <= high + 1e-6


def test_neighbours_of_few_rows(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 5.0)], "id long, a double")
    got = {(r["id"], r["slot"]): r["neighbour"] for r in B.nearest_neighbours(df, "id", ["a"]).collect()}
    assert got == {(1, 0): 2, (1, 1): 3, (2, 0): 1, (2, 1): 3, (3, 0): 2, (3, 1): 1}


def test_synthetic_rows_lie_between_their_parents(spark):
    rows = [(i, float(RNG.normal()), float(RNG.normal()), int(i % 12 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    new = B.synthetic_minority(df, "id", ["a", "b"], "y").collect()
    assert len(new) == int(550 * (0.15 / 0.85)) - 50
    value = {r[0]: r[1:3] for r in rows}
    for r in new:
        for j, c in enumerate(("a", "b")):
            low, high = sorted((value[r["parent"]][j], value[r["neighbour"]][j]))
            assert low - 1e-12 <= r[c] <= high + 1e-12
    per_parent = {p: sum(r["parent"] == p for r in new) for p in {r["parent"] for r in new}}
    assert max(per_parent.values()) - min(per_parent.values()) <= 1 and len(per_parent) <= 50
    again = B.synthetic_minority(df.repartition(7), "id", ["a", "b"], "y").collect()
    assert sorted(new) == sorted(again)


def test_class_cannot_shrink(spark):
    df = spark.createDataFrame([(i, 0.5, i % 2) for i in range(40)], "id long, a double, y int")
    with pytest.raises(ValueError, match="cut down"):
        B.synthetic_minority(df, "id", ["a"], "y")


def test_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "y int")
    got = {r["y"]: r["classWeightCol"] for r in B.balance_weights(df, "y").collect()}
    assert got == {0: pytest.approx(0.25), 1: pytest.approx(0.75)}


def test_split_does_not_depend_on_partitions(spark):
    ids = spark.range(2000)
    a = D.add_fold(D.add_split(ids.repartition(1), "id"), "id").collect()
    b = D.add_fold(D.add_split(ids.repartition(16), "id"), "id").collect()
    assert sorted(a) == sorted(b)
    assert 0.25 < sum(r["split"] == "test" for r in a) / 2000 < 0.35
    assert all(300 < sum(r["fold"] == f for r in a) < 500 for f in range(5))


def test_encoder(spark):
    df = spark.createDataFrame([("b", 1.5), ("a", 2.0), ("c", 0.0)], "x string, n double")
    model = E.fit_encoder(df, ["x"], ["n"])
    assert E.feature_names(model) == ["x_a", "x_b", "x_c", "n"]
    rows = E.wide(E.encode(model, df), E.feature_names(model)).collect()
    assert [(r["x_a"], r["x_b"], r["x_c"]) for r in rows] == [(0, 1, 0), (1, 0, 0), (0, 0, 1)]
    with pytest.raises(Exception):
        E.encode(model, df.withColumn("x", F.lit("z"))).collect()


def test_combine(spark):
    df = spark.createDataFrame([(-0.1, -0.2), (0.2, 0.6)], "a double, b double")
    cols = [F.col("a"), F.col("b")]
    assert [r[0] for r in df.select(M.combine(cols, "max")).collect()] == [0.0, 0.6]
    assert [r[0] for r in df.select(M.combine(cols, "mean")).collect()] == pytest.approx([-0.15, 0.4])


@pytest.fixture(scope="module")
def trained(spark, sf_dir):
    rows = write_stage(P.model_input(P.prepare(V.loan_raw(spark, sf_dir), "id_aplikasi"), "id_aplikasi"), "input")
    return train(rows, "id_aplikasi", folds=2, rounds=4), rows


def test_scorer_survives_saving(spark, trained):
    scorer, rows = trained
    path = new_path(spark, "scorer")
    scorer.save(path)
    again = Scorer.load(path)
    key = lambda df: sorted((r["id_aplikasi"], r["pd"]) for r in df.collect())
    assert key(R.add_probability(rows, scorer)) == key(R.add_probability(rows, again))


def test_probabilities(trained):
    scorer, rows = trained
    got = R.add_probability_pair(rows, scorer).select("proba").collect()
    assert all(0 <= r["proba"][1] <= 1 and r["proba"][0] == 1 - r["proba"][1] for r in got)


def test_contributions_add_up_to_the_log_odds(trained):
    scorer, rows = trained
    vectors = E.encode(scorer.encoder, rows).select("id_aplikasi", "features")
    model = scorer.models[0]
    odds = {r["id_aplikasi"]: math.log(r["p"] / (1 - r["p"])) for r in M.ensemble_probability(vectors, [model], out="p").collect()}
    sums = X.explain_rows(vectors, model, scorer.feature_names, "id_aplikasi").groupBy("id_aplikasi").agg(
        F.sum("contribution").alias("s")).collect()
    assert len(sums) == len(odds)
    for r in sums:
        assert r["s"] == pytest.approx(odds[r["id_aplikasi"]], abs=1e-9)


def test_contributions_are_added_up_a_batch_of_rows_at_once(spark, trained):
    scorer, rows = trained
    vectors = E.encode(scorer.encoder, rows).select(F.when(F.col("id_aplikasi") % 2 == 0, F.col("id_aplikasi")).alias("k"), "features")
    model = scorer.models[0]
    parts = {}
    for tree, leaf, changes in X.leaf_contributions(model, scorer.feature_names):
        parts[tree, leaf] = changes
    want = []
    for r in model.copy().setLeafCol("leaf").transform(vectors).select("k", "leaf").collect():
        sums = [0.0] * (len(scorer.feature_names) + 1)
        for tree, leaf in enumerate(r["leaf"]):
            sums = [a + b for a, b in zip(sums, parts[tree, int(leaf)])]
        want += [(r["k"], n, x) for n, x in zip([*scorer.feature_names, X.INTERCEPT], sums)]
    got = X.explain_rows(vectors, model, scorer.feature_names, "k")
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "aggregate(" not in plan and "Exchange" not in plan
    assert X.explain_rows(vectors.limit(0), model, scorer.feature_names, "k").count() == 0


def test_importance_counts_splits(trained):
    scorer, _ = trained
    table = {r["feature"]: r["importance"] for r in M.split_importance(scorer.models, scorer.feature_names).collect()}
    assert set(table) == set(scorer.feature_names)
    inner = M.node_table(scorer.models).where("feature is not null").count()
    assert sum(table.values()) * len(scorer.models) == pytest.approx(inner)


REQUEST = {
    "jangka_waktu": 18, "plafond": 9500000.0, "jenis_kelamin": "F", "pendidikan": "S1/S2/S3", "status_nikah": "Menikah",
    "jumlah_anak_dlm_tanggungan": 2, "kepemilikan_tempat_tinggal": "SewaKontrak", "debitur_lama": 0.0,
    "tujuan_penggunaan": "KMK", "lama_bekerja": 6, "simpanan": 420000.0, "usia": 37.0,
    "ratio_pendatapan_to_angsuran": 2.75, "punya_usaha_sampingan": 0.0,
}


def requests():
    texts = [json.dumps({**REQUEST, "extra": [1, 2]}), json.dumps({k: str(v) for k, v in REQUEST.items()})]
    texts += ["", "{}", "{oops", json.dumps({**REQUEST, "usia": "old"}), json.dumps({**REQUEST, "jenis_kelamin": "Z"})]
    return [t for t in texts]


def test_records(spark, trained):
    scorer, _ = trained
    df = spark.createDataFrame(list(enumerate(requests())), "i int, record string")
    got = R.score_records(df, "record", scorer, G.default_grades(spark)).orderBy("i").collect()
    assert [r["error"] for r in got] == [
        None, None, "empty record", "empty record", "malformed record", "usia", "unknown label"]
    assert got[0]["pd"] == got[1]["pd"] and got[0]["rating"] is not None
    assert all(r["pd"] is None and r["rating"] is None for r in got[2:])
    row = spark.createDataFrame([REQUEST], S.REQUEST_SCHEMA)
    assert R.score_applications(row, scorer, G.default_grades(spark)).first()["pd"] == got[0]["pd"]


def test_stream_equals_batch(spark, trained):
    scorer, _ = trained
    source, sink, checkpoint = (new_path(spark, n) for n in ("in", "out", "state"))
    lines = spark.createDataFrame([(t,) for t in requests() if t], "value string")
    for _ in range(2):  # files that arrive later are scored once
        lines.write.mode("append").text(source)
        start_scoring(spark, source, sink, checkpoint, scorer, G.default_grades(spark), once=True).awaitTermination()
    got = spark.read.schema(R.RESULT_SCHEMA).json(sink).collect()
    want = R.result_text(R.score_records(lines, "value", scorer, G.default_grades(spark))).collect()
    key = lambda rows: sorted(tuple(str(v) for v in r) for r in rows)
    assert key(got) == key(want * 2)


def test_table_with_bad_rows_is_scored(spark, trained):
    scorer, _ = trained
    rows = [{**REQUEST, "i": 0}, {**REQUEST, "i": 1, "usia": None}, {**REQUEST, "i": 2, "jenis_kelamin": "Z"}]
    df = spark.createDataFrame(rows, StructType([*S.REQUEST_SCHEMA.fields, StructField("i", IntegerType())]))
    got = {r["i"]: r for r in R.score_applications(df, scorer, G.default_grades(spark), keep=["i"]).collect()}
    assert [got[i]["error"] for i in range(3)] == [None, "missing number", "unknown label"]
    assert got[0]["pd"] is not None and got[1]["pd"] is None and got[2]["rating"] is None


def test_stream_results_carry_their_request(spark, trained):
    scorer, _ = trained
    source, sink, checkpoint = (new_path(spark, n) for n in ("in", "out", "state"))
    spark.createDataFrame([(t,) for t in requests() if t], "value string").write.text(source)
    start_scoring(spark, source, sink, checkpoint, scorer, G.default_grades(spark), once=True).awaitTermination()
    got = spark.read.json(sink)
    assert {r["request"] for r in got.collect()} == {t for t in requests() if t}
