"""Feature preparation, resampling, models, scoring."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from creditlens import schemas as S
from creditlens.catalog import sql as Q
from creditlens.catalog.registry import query
from creditlens.catalog.report_queries import LABELLED, rounded
from creditlens.operators import balance as B
from creditlens.operators import curves as C
from creditlens.operators import encode as E
from creditlens.operators import ensemble as M
from creditlens.operators import explain as X
from creditlens.operators import grading as G
from creditlens.operators import split as D
from creditlens.plans import preparation as P
from creditlens.plans import scoring as R
from creditlens.plans.evaluation import evaluate_at_grade
from creditlens.plans.training import train, training_rows
from creditlens.session import new_path, write_compiled, write_stage
from creditlens.sources import records
from creditlens.sources import views as V
from creditlens.streaming.scoring import start_scoring

# Trained once per application and data folder, as a scoring job would load its models once.
_TRAINED: dict = {}


def _input(spark, sf):
    return P.model_input(P.prepare(V.loan_raw(spark, sf), "id_aplikasi"), "id_aplikasi")


def _labelled(spark, sf, *features):
    return _input(spark, sf).where("target is not null").select("id_aplikasi", *(features or S.FEATURES), "target")


def _trained(spark, sf):
    """(scorer, written model input) for a data folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TRAINED:
        rows = write_compiled(_input(spark, sf), "model-input")
        _TRAINED[key] = (train(rows, "id_aplikasi"), rows)
    return _TRAINED[key]


def _encoded(spark, sf, part: str | None = None):
    """Encoded rows with a target, of one part of the split if named."""
    scorer, rows = _trained(spark, sf)
    known = D.add_split(rows.where("target is not null"), "id_aplikasi")
    if part:
        known = known.where(F.col("split") == part)
    return scorer, E.encode(scorer.encoder, known).select("id_aplikasi", "split", "target", "features")


def _probabilities(spark, sf, part: str | None = None):
    scorer, rows = _encoded(spark, sf, part)
    return M.ensemble_probability(rows, scorer.models, scorer.method).drop("features")


# Split and encoding --------------------------------------------------------------------------


@query("h1_train_test_split", f"""
SELECT o_orderkey, CASE WHEN {Q.unit_hash("o_orderkey", D.SPLIT_SEED)} < 0.3 THEN 'test' ELSE 'train' END AS split FROM orders""")
def h1(spark, sf):
    return D.add_split(V.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("h2_label_encoding", Q.with_view("model_input", "SELECT id_aplikasi, " + ", ".join(
    f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS {c}" for c in S.CATEGORICAL_FEATURES
) + " FROM model_input"))
def h2(spark, sf):
    rows = _input(spark, sf).select("id_aplikasi", *S.CATEGORICAL_FEATURES)
    model = E.fit_label_encoder(rows, S.CATEGORICAL_FEATURES)
    return E.label_encode(model, rows, S.CATEGORICAL_FEATURES)


_LEVELS = {
    "jenis_kelamin": ["F", "M"],
    "pendidikan": ["Akademi/Diploma", "S1/S2/S3", "SD/SMP/SMU/SMK", "TidakSekolah"],
    "status_nikah": ["BelumMenikah", "JandaDuda", "Menikah"],
    "kepemilikan_tempat_tinggal": ["MilikSendiri", "RumahDinas", "SewaKontrak"],
    "tujuan_penggunaan": ["KI", "KMK", "PMK"],
}


@query("h3_one_hot", Q.with_view("model_input", "SELECT id_aplikasi, " + ", ".join(
    [f"CAST(CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS DOUBLE) AS \"{c}_{v}\"" for c, vs in _LEVELS.items() for v in vs]
    + [f"round({c}, 6) AS {c}" for c in S.NUMERIC_FEATURES]
) + " FROM model_input"))
def h3(spark, sf):
    rows = _input(spark, sf)
    model = E.fit_encoder(rows)
    encoded = E.encode(model, rows).select("id_aplikasi", "features")
    return rounded(E.wide(encoded, E.feature_names(model)), *S.NUMERIC_FEATURES)


@query("h4_feature_names", Q.with_view("model_input", """
SELECT CAST(row_number() OVER (ORDER BY p, v) - 1 AS INTEGER) AS position, name FROM (""" + " UNION ALL ".join(
    [f"SELECT DISTINCT {i} AS p, {c} AS v, '{c}_' || {c} AS name FROM model_input" for i, c in enumerate(S.CATEGORICAL_FEATURES)]
    + [f"SELECT {100 + i}, '', '{c}'" for i, c in enumerate(S.NUMERIC_FEATURES)]
) + ")"))
def h4(spark, sf):
    names = E.feature_names(E.fit_encoder(_input(spark, sf)))
    return spark.createDataFrame(list(enumerate(names)), "position int, name string")


_SCALED = list(S.NUMERIC_FEATURES)


@query("h5_standard_scale", Q.with_view("model_input", "SELECT id_aplikasi, " + ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM model_input)) / (SELECT stddev_pop({c}) FROM model_input), 6) AS {c}" for c in _SCALED
) + " FROM model_input"))
def h5(spark, sf):
    return rounded(E.standard_scale(_input(spark, sf).select("id_aplikasi", *_SCALED), _SCALED), *_SCALED)


_ONE_HOT = {f"{c}_{v}": f"CAST(CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS DOUBLE)" for c, vs in _LEVELS.items() for v in vs}
_MATRIX = {**_ONE_HOT, **{c: c for c in S.NUMERIC_FEATURES}}


@query("h6_best_features", Q.with_view("model_input", f"""
SELECT feature, round(f, 6) AS f_score FROM (
  SELECT feature, (sum(n * (m - mm) * (m - mm)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f FROM (
    SELECT feature, target, count(*) AS n, avg(x) AS m, var_pop(x) AS v, any_value(mm) AS mm
    FROM (SELECT *, avg(x) OVER (PARTITION BY feature) AS mm FROM (
      {" UNION ALL ".join(f"SELECT '{c}' AS feature, target, {x} AS x FROM labelled" for c, x in _MATRIX.items())}))
    GROUP BY feature, target) GROUP BY feature)
ORDER BY f DESC, feature LIMIT 42""", LABELLED))
def h6(spark, sf):
    rows = write_stage(_labelled(spark, sf), "labelled")
    model = E.fit_encoder(rows)
    names = E.feature_names(model)
    matrix = write_stage(E.wide(E.encode(model, rows).select("target", "features"), names), "matrix")
    return rounded(E.best_features(matrix, names, "target"), "f_score")


# Balance -------------------------------------------------------------------------------------


@query("h7_balance_weights", Q.with_view("scored", """
SELECT row_id, label, round(CASE WHEN label = 0 THEN r ELSE 1 - r END, 6) AS "classWeightCol"
FROM scored, (SELECT 1 - count(*) FILTER (label = 0) / count(*) AS r FROM scored)"""))
def h7(spark, sf):
    return rounded(B.balance_weights(V.scored(spark, sf).select("row_id", "label"), "label"), "classWeightCol")


@query("h8_class_weights", Q.with_view("scored", """
SELECT row_id, label, CASE WHEN label = 1 THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM scored"""))
def h8(spark, sf):
    return B.class_weights(V.scored(spark, sf).select("row_id", "label"), "label")


_KNN = ["jangka_waktu", "plafond", "simpanan", "usia", "jumlah_anak_dlm_tanggungan"]
_DISTANCE = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in _KNN)
_MINORITY = "minority AS (SELECT * FROM labelled WHERE target = 1)"
_NEAREST = f"""nearest AS (
  SELECT * FROM (SELECT a.id_aplikasi AS parent, b.id_aplikasi AS neighbour, {_DISTANCE} AS distance2,
    CAST(row_number() OVER (PARTITION BY a.id_aplikasi ORDER BY {_DISTANCE}, b.id_aplikasi) - 1 AS INTEGER) AS slot
    FROM minority a JOIN minority b ON a.id_aplikasi <> b.id_aplikasi) WHERE slot < 5)"""
_DRAW = f"({Q.row_hash('parent', 47)} + copy)"
_COPIES = f"""sizes AS (SELECT CAST(floor(count(*) FILTER (target = 0) * (0.15::DOUBLE / (1 - 0.15::DOUBLE))) AS BIGINT)
    - count(*) FILTER (target = 1) AS wanted, count(*) FILTER (target = 1) AS n1 FROM labelled),
copies AS (SELECT parent, range AS copy FROM (
    SELECT id_aplikasi AS parent, wanted // n1
      + CASE WHEN row_number() OVER (ORDER BY {Q.row_hash("id_aplikasi", 42)}, id_aplikasi) <= wanted % n1 THEN 1 ELSE 0 END AS n
    FROM minority, sizes), range(0, 1000) WHERE range < n),
drawn AS (SELECT parent, copy, {Q.row_hash(_DRAW, 43)} % 5 AS slot, {Q.unit_hash(_DRAW, 44)} AS u FROM copies)"""


@query("h9_nearest_neighbours", Q.with_view("model_input", """
SELECT parent AS id_aplikasi, slot, neighbour, distance2 FROM nearest""", LABELLED, _MINORITY, _NEAREST))
def h9_neighbours(spark, sf):
    minority = write_stage(_labelled(spark, sf, *_KNN).where("target = 1"), "minority")
    return B.nearest_neighbours(minority, "id_aplikasi", _KNN)


@query("h9_synthetic_minority", Q.with_view("model_input", f"""
SELECT d.parent, n.neighbour, CAST(copy AS INTEGER) AS copy, round(u, 6) AS u,
  {", ".join(f"round(a.{c} + u * (b.{c} - a.{c}), 6) AS {c}" for c in _KNN)}, 1 AS target
FROM drawn d JOIN nearest n ON d.parent = n.parent AND d.slot = n.slot
JOIN minority a ON a.id_aplikasi = d.parent JOIN minority b ON b.id_aplikasi = n.neighbour""",
                                            LABELLED, _MINORITY, _NEAREST, _COPIES))
def h9(spark, sf):
    rows = write_stage(_labelled(spark, sf, *_KNN), "labelled")
    return rounded(B.synthetic_minority(rows, "id_aplikasi", _KNN, "target"), "u", *_KNN)


# The same over the whole encoded matrix, as oversampling before training sees it.
_WIDE = list(_MATRIX)
_WIDE_MINORITY = "minority AS (SELECT id_aplikasi, " + ", ".join(
    f'CAST({x} AS DOUBLE) AS "{c}"' for c, x in _MATRIX.items()) + " FROM labelled WHERE target = 1)"
_WIDE_DISTANCE = " + ".join(f'(a."{c}" - b."{c}") * (a."{c}" - b."{c}")' for c in _WIDE)
_WIDE_NEAREST = _NEAREST.replace(_DISTANCE, _WIDE_DISTANCE)


def _labelled_matrix(spark, sf):
    """Rows with a target as (id_aplikasi, target, one column per vector entry), and the names of these columns."""
    rows = write_stage(_labelled(spark, sf), "labelled")
    model = E.fit_encoder(rows)
    names = E.feature_names(model)
    return E.wide(E.encode(model, rows).select("id_aplikasi", "target", "features"), names), names


@query("h9_nearest_neighbours_all_features", Q.with_view("model_input", """
SELECT parent AS id_aplikasi, slot, neighbour, distance2 FROM nearest""", LABELLED, _WIDE_MINORITY, _WIDE_NEAREST))
def h9_neighbours_all(spark, sf):
    matrix, names = _labelled_matrix(spark, sf)
    return B.nearest_neighbours(write_stage(matrix.where("target = 1"), "minority"), "id_aplikasi", names)


@query("h9_synthetic_minority_all_features", Q.with_view("model_input", f"""
SELECT d.parent, n.neighbour, CAST(copy AS INTEGER) AS copy, round(u, 6) AS u,
  {", ".join(f'round(a."{c}" + u * (b."{c}" - a."{c}"), 6) AS "{c}"' for c in _WIDE)}, 1 AS target
FROM drawn d JOIN nearest n ON d.parent = n.parent AND d.slot = n.slot
JOIN minority a ON a.id_aplikasi = d.parent JOIN minority b ON b.id_aplikasi = n.neighbour""",
                                                         LABELLED, _WIDE_MINORITY, _WIDE_NEAREST, _COPIES))
def h9_all(spark, sf):
    matrix, names = _labelled_matrix(spark, sf)
    return rounded(B.synthetic_minority(write_stage(matrix, "matrix"), "id_aplikasi", names, "target"), "u", *names)


@query("h10_folds", f"""
SELECT o_orderkey, CAST({Q.row_hash("o_orderkey", D.FOLD_SEED)} % 5 AS INTEGER) AS fold FROM orders""")
def h10(spark, sf):
    return D.add_fold(V.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


# Models --------------------------------------------------------------------------------------


@query("h11_fold_models")
def h11(spark, sf):
    scorer, test = _encoded(spark, sf, "test")
    scored, names = M.member_probabilities(test, scorer.models)
    folds = F.array(*[
        F.struct(F.lit(i).alias("fold"), F.lit(model.getNumTrees).alias("trees"), F.col(name).alias("pd"))
        for i, (name, model) in enumerate(zip(names, scorer.models))
    ])
    scored = write_stage(scored.select("target", F.inline(folds)), "members")
    return C.auc(scored, "pd", "target", by=["fold", "trees"]).drop("gini")


@query("h12_combine", """
SELECT c_custkey, round(greatest(0, abs(c_acctbal) / 10000, c_custkey % 7 / 7, c_nationkey / 25), 6) AS pd_max,
  round((abs(c_acctbal) / 10000 + c_custkey % 7 / 7 + c_nationkey / 25) / 3, 6) AS pd_mean
FROM customer""")
def h12_combine(spark, sf):
    members = [F.abs("c_acctbal") / 10000, F.col("c_custkey") % 7 / 7, F.col("c_nationkey") / 25]
    return V.table(spark, sf, "customer").select(
        "c_custkey", F.round(M.combine(members, "max"), 6).alias("pd_max"),
        F.round(M.combine(members, "mean"), 6).alias("pd_mean"),
    )


@query("h12_ensemble_pd")
def h12(spark, sf):
    return _probabilities(spark, sf)


@query("h12_evaluation")
def h12_evaluation(spark, sf):
    scorer, rows = _trained(spark, sf)
    graded = replace(scorer, grades=_grades(spark, sf))
    # The cutoff is the upper end of the last grade but one of the model's own table.
    return evaluate_at_grade(rows, graded, "id_aplikasi", graded.grades.count() - 1)


@query("h13_forest_ensemble_pd")
def h13(spark, sf):
    _, rows = _encoded(spark, sf)
    train_rows = write_stage(D.add_fold(rows.where("split = 'train'"), "id_aplikasi"), "forest")
    forest = RandomForestClassifier(labelCol="target", numTrees=M.FOREST_TREES, seed=1)
    models = [forest.fit(train_rows.where(F.col("fold") != f)) for f in range(D.FOLDS)]
    return M.ensemble_probability(rows, models, "mean").drop("features")


@query("h14_split_importance")
def h14(spark, sf):
    scorer, _ = _trained(spark, sf)
    return M.split_importance(scorer.models, scorer.feature_names)


@query("h15_score_clusters")
def h15(spark, sf):
    # Written, as the clusters are found in several passes over the scores.
    scored = write_stage(_probabilities(spark, sf, "train").select("id_aplikasi", "pd"), "scored")
    return G.cluster_scores(scored, "pd").select("id_aplikasi", "pd", "cluster")


@query("h15_optimal_intervals", """
WITH nations AS (SELECT c_nationkey AS x, count(*) AS n FROM customer WHERE c_nationkey IS NOT NULL GROUP BY 1),
cuts AS (SELECT a.x AS second, b.x AS third FROM nations a, nations b WHERE a.x < b.x AND a.x > (SELECT min(x) FROM nations)),
pieces AS (
  SELECT second, third, CASE WHEN x < second THEN 0 WHEN x < third THEN 1 ELSE 2 END AS cluster, min(x) AS least, max(x) AS largest,
    sum(n)::BIGINT AS n, sum(n * x * x) - sum(n * x) * sum(n * x) / sum(n) AS spread FROM cuts, nations GROUP BY ALL),
best AS (SELECT second, third FROM pieces GROUP BY ALL ORDER BY sum(spread) LIMIT 1)
SELECT cluster::INTEGER AS cluster, least, largest, n FROM pieces JOIN best USING (second, third)""")
def h15_intervals(spark, sf):
    customers = V.table(spark, sf, "customer").select("c_nationkey")
    return G.cluster_scores(customers, "c_nationkey", 3).where("cluster IS NOT NULL").groupBy("cluster").agg(
        F.min("c_nationkey").alias("least"), F.max("c_nationkey").alias("largest"), F.count("*").alias("n"))


def _grades(spark, sf):
    """The grade table of the trained model: its clusters on the training rows, in the order of their probabilities."""
    scored = write_stage(_probabilities(spark, sf, "train").select("id_aplikasi", "pd", "target"), "graded")
    return G.learn_grades(scored, "pd", "target")


@query("h16_grades_of_clusters")
def h16_clusters(spark, sf):
    return _grades(spark, sf)


@query("h17_explanation")
def h17(spark, sf):
    scorer, rows = _encoded(spark, sf, "train")
    return X.explain_rows(rows, scorer.models[0], scorer.feature_names, "id_aplikasi")


@query("h18_forest_grid_search")
def h18(spark, sf):
    scorer, rows = _encoded(spark, sf, "train")
    rows = training_rows(rows.drop("split"), scorer.feature_names, "id_aplikasi", oversample_before_folds=True)
    table, _ = M.forest_grid_search(B.class_weights(rows, "target"), D.FOLDS)
    return table


# Scoring -------------------------------------------------------------------------------------


@query("s1_probability_pair")
def s1(spark, sf):
    scorer, rows = _trained(spark, sf)
    return R.add_probability_pair(rows, scorer).select(
        "id_aplikasi", F.col("proba")[0].alias("p0"), F.col("proba")[1].alias("p1"))


@query("s2_positive_probability")
def s2(spark, sf):
    scorer, rows = _trained(spark, sf)
    return R.add_probability(rows, scorer).select("id_aplikasi", "pd")


def _requests(spark, sf):
    """Model inputs as JSON requests, and besides them malformed, empty and incomplete ones with negative ids."""
    _, rows = _trained(spark, sf)
    typed = rows.withColumns({f: F.col(f).cast(S.REQUEST_SCHEMA[f].dataType) for f in S.NUMERIC_FEATURES})
    requests = records.to_json_records(typed.select("id_aplikasi", *S.FEATURES), S.FEATURES)
    k = F.col("id_aplikasi") % 97
    broken = F.when(k == 0, F.lit("{")).when(k == 1, F.lit("{}")).when(k == 2, F.lit('{"usia": 30.0}'))
    more = requests.select((-1 - F.col("id_aplikasi")).alias("id_aplikasi"), broken.alias("record")).where("record is not null")
    return requests.unionByName(more)


@query("s3_json_records")
def s3(spark, sf):
    scorer, _ = _trained(spark, sf)
    return write_compiled(R.score_records(_requests(spark, sf), "record", scorer, _grades(spark, sf)), "records")


@query("s5_batch_scoring")
def s5(spark, sf):
    scorer, rows = _trained(spark, sf)
    return write_compiled(R.score_applications(rows, scorer, _grades(spark, sf), keep=["id_aplikasi"]), "batch")


@query("s6_continuous_scoring")
def s6(spark, sf):
    scorer, _ = _trained(spark, sf)
    source, sink, checkpoint = (new_path(spark, n) for n in ("requests", "results", "stream"))
    _requests(spark, sf).select("record").write.text(source)
    start_scoring(spark, source, sink, checkpoint, scorer, _grades(spark, sf), once=True).awaitTermination()
    return spark.read.schema("request string, " + ", ".join(f"{f.name} string" for f in R.RESULT_SCHEMA)).json(sink)
