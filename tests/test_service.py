"""Scoring as a service: versions, two sinks, failures."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from creditlens import schemas as S
from creditlens import session
from creditlens.catalog import check_queries as K
from creditlens.catalog import model_queries as Q
from creditlens.operators import grading as G
from creditlens.plans import preparation as P
from creditlens.plans import scoring as R
from creditlens.plans.training import Scorer, train
from creditlens.session import new_path
from creditlens.sources import views as V
from creditlens.streaming import scoring as C
from creditlens.streaming.scoring import newest, publish, serve, start_scoring
from tests.test_models import requests


@pytest.fixture(scope="module")
def scorer(spark, sf_dir):
    rows = P.model_input(P.prepare(V.loan_raw(spark, sf_dir), "id_aplikasi"), "id_aplikasi").where("target is not null")
    made = train(rows, "id_aplikasi", folds=2, rounds=2)
    made.grades = G.default_grades(spark)
    return made


@pytest.fixture
def places(spark):
    return [new_path(spark, n) for n in ("in", "results", "rejects", "state", "registry")]


def arrive(spark, source, texts):
    spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1).write.mode("append").text(source)


def expected(spark, scorer, texts, version):
    df = spark.createDataFrame([(t, t) for t in texts], "request string, value string")
    rows = R.score_records(df, "value", scorer, scorer.grades).collect()
    good = sorted((r["request"], version, r["pd"], r["score"], r["rating"]) for r in rows if r["error"] is None)
    return good, sorted((r["request"], version, r["error"]) for r in rows if r["error"] is not None)


def sinks(spark, results, rejects):
    good = spark.read.schema("request string, version long, pd double, score double, rating string").json(results)
    bad = spark.read.schema("request string, version long, error string").json(rejects)
    return sorted(tuple(r)[:5] for r in good.drop("batch").collect()), sorted(tuple(r)[:3] for r in bad.drop("batch").collect())


def plain(rows):
    return [[tuple(str(v) for v in r) for r in part] for part in rows]


def test_a_new_version_serves_the_next_batch(spark, scorer, places):
    source, results, rejects, state, registry = places
    mean = Scorer(scorer.encoder, scorer.models, "mean", scorer.grades)
    texts = [t for t in requests() if t]
    assert publish(scorer, registry) == 1
    arrive(spark, source, texts)
    serve(spark, source, results, rejects, state, registry, once=True).awaitTermination()
    assert publish(mean, registry) == 2 and newest(spark, registry)[0] == 2
    arrive(spark, source, texts)
    serve(spark, source, results, rejects, state, registry, once=True).awaitTermination()
    want = [a + b for a, b in zip(expected(spark, scorer, texts, 1), expected(spark, mean, texts, 2))]
    assert plain(sinks(spark, results, rejects)) == plain([sorted(w) for w in want])
    assert {r[0] for r in sinks(spark, results, rejects)[0]} | {r[0] for r in sinks(spark, results, rejects)[1]} == set(texts)


def test_a_failed_batch_is_run_again_without_a_trace(spark, scorer, places, monkeypatch):
    source, results, rejects, state, registry = places
    publish(scorer, registry)
    texts = [t for t in requests() if t]
    arrive(spark, source, texts)
    original = DataStreamWriter.foreachBatch

    def breaking(writer, run):
        def run_and_fail(df, batch):
            run(df, batch)
            raise RuntimeError("lost after both sinks were written")

        return original(writer, run_and_fail)

    monkeypatch.setattr(DataStreamWriter, "foreachBatch", breaking)
    with pytest.raises(Exception):
        serve(spark, source, results, rejects, state, registry, once=True).awaitTermination()
    assert sinks(spark, results, rejects)[0]
    monkeypatch.undo()
    serve(spark, source, results, rejects, state, registry, once=True).awaitTermination()
    assert plain(sinks(spark, results, rejects)) == plain(expected(spark, scorer, texts, 1))


def test_scorers_without_grades_and_empty_registries_are_refused(spark, scorer, places):
    registry = places[-1]
    with pytest.raises(ValueError):
        publish(Scorer(scorer.encoder, scorer.models), registry)
    spark.createDataFrame([], "version long, path string").write.json(f"{registry}/versions")
    with pytest.raises(ValueError):
        newest(spark, registry)


def test_each_record_is_parsed_once(spark, scorer, places, monkeypatch):
    source, results, rejects, state, registry = places
    seen = spark.sparkContext.accumulator(0)
    original = R.parse_json

    def counted(text):
        seen.add(1)
        return text

    def parse(df, record, *rest):
        return original(df.withColumn(record, F.udf(counted, "string")(record)), record, *rest)

    monkeypatch.setattr(R, "parse_json", parse)
    texts = [t for t in requests() if t]
    publish(scorer, registry)
    arrive(spark, source, texts)
    serve(spark, source, results, rejects, state, registry, once=True).awaitTermination()
    assert seen.value == len(texts)
    monkeypatch.undo()
    assert plain(sinks(spark, results, rejects)) == plain(expected(spark, scorer, texts, 1))


@pytest.fixture
def unlimited(spark):
    """The session as one that ``build_session`` did not make, with no limit on generated methods."""
    before = spark.conf.get(session.METHOD_LIMIT)
    spark.conf.set(session.METHOD_LIMIT, "65535")
    yield spark
    spark.conf.set(session.METHOD_LIMIT, before)


def limit_in(df):
    return df.sparkSession.conf.get(session.METHOD_LIMIT)


def test_batches_of_a_stream_are_compiled_in_any_session(unlimited, scorer, places, monkeypatch):
    source, results, rejects, state, registry = places
    seen, score, start = [], C.score_checked, DataStreamWriter.start
    monkeypatch.setattr(C, "score_checked", lambda df, *rest: seen.append(limit_in(df)) or score(df, *rest))
    texts = [t for t in requests() if t]
    publish(scorer, registry)
    arrive(unlimited, source, texts)
    serve(unlimited, source, results, rejects, state, registry, once=True).awaitTermination()
    monkeypatch.undo()
    monkeypatch.setattr(DataStreamWriter, "start", lambda w: seen.append(unlimited.conf.get(session.METHOD_LIMIT)) or start(w))
    more, log = (new_path(unlimited, n) for n in ("results", "state"))
    start_scoring(unlimited, source, more, log, scorer, scorer.grades, once=True).awaitTermination()
    assert seen == ["8000", "8000"]
    assert unlimited.conf.get(session.METHOD_LIMIT) == "65535"
    assert plain(sinks(unlimited, results, rejects)) == plain(expected(unlimited, scorer, texts, 1))
    assert unlimited.read.schema("request string").json(more).count() == len(texts)


@pytest.mark.parametrize("query, passes", [(Q.s3, 1), (Q.s5, 1), (K.s3_checks, 2), (K.s5_checks, 1)])
def test_scored_rows_are_compiled_in_any_session(unlimited, sf_dir, scorer, monkeypatch, query, passes):
    monkeypatch.setitem(Q._TRAINED, (unlimited.sparkContext.applicationId, sf_dir), (scorer, Q._input(unlimited, sf_dir)))
    monkeypatch.setattr(Q, "_grades", lambda *_: scorer.grades)
    seen, write = [], session.write_stage
    monkeypatch.setattr(session, "write_stage", lambda df, name: seen.append(limit_in(df)) or write(df, name))
    # Nothing of the models is left to the session that reads the rows.
    assert "UDF" not in query(unlimited, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert seen == ["8000"] * passes
    assert unlimited.conf.get(session.METHOD_LIMIT) == "65535"
