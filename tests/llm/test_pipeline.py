"""The pipeline's stages against plain versions, each on what the one before kept; the registered queries with SQL."""

import collections

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from creditlens.llm import mixing, toxicity
from creditlens.llm.queries import ORACLES, QUERIES
from tests.compare import compare, duck
from tests.llm.test_operators import linked_components, sha, words

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SMALL).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_all_but_the_last_keep_the_columns(stages):
    for name, (before, after) in stages.items():
        assert name == "bpe" or before.columns == after.columns


def test_toxicity_stage(spark, stages):
    before, after = stages["toxicity"]
    model = toxicity.train(before, spark.read.parquet(f"{SMALL}/labels.parquet"))
    want = [i for i, t in rows(before, "doc_id", "text") if model.scores([(t or "").encode()])[0] < toxicity.THRESHOLD]
    assert sorted(r[0] for r in rows(after, "doc_id")) == sorted(want)


def test_exact_stage(stages):
    before, after = stages["exact_dedup"]
    best = {}
    for i, t in rows(before, "doc_id", "text"):
        key = (t or "").encode().lower()
        best[key] = max(best.get(key, i), i)
    assert sorted(r[0] for r in rows(after, "doc_id")) == sorted(best.values())


def test_jaccard_stage(stages):
    before, after = stages["jaccard_join"]
    comps = linked_components(rows(before, "doc_id", "text"))
    want = {c for (i, n, c) in comps if n} | {i for (i, n, c) in comps if not n}
    assert sorted(r[0] for r in rows(after, "doc_id")) == sorted(want)


def test_mixing_stage(stages):
    before, after = stages["mixing"]
    copies = {r.doc_id: r.copies for r in mixing.with_copies(before).collect()}
    assert collections.Counter(r[0] for r in rows(after, "doc_id")) == collections.Counter(copies)


def test_bpe_stage(stages):
    before, after = stages["bpe"]
    assert before.count() == after.count()
    for t, n, d in rows(after, "text", "n_tokens", "decoded_sha256"):
        assert d == sha(t or "") and n >= (1 if words(t) else 0)


def test_bpe_stage_holds_the_ids(stages):
    _, after = stages["bpe"]
    for ids, n, d in rows(after, "token_ids", "n_tokens", "ids_sha256"):
        assert len(ids) == n and d == sha(np.array(ids, "<u4").tobytes())


def test_every_operator_is_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    problems, n = compare(spark, duck(SMALL), QUERIES[name], ORACLES[name], SMALL)
    assert not problems and n > 0


def test_queries_return_all_documents(spark):
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for name in ("op2_jaccard_join", "op3_toxicity", "op6_bpe", "op9_pii"):
        assert QUERIES[name](spark, SMALL).count() == n


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SMALL)
    assert sorted(rows(got, "doc_id", "n_tokens", "ids_sha256")) == sorted(rows(stages["bpe"][1], "doc_id", "n_tokens", "ids_sha256"))
    assert np.all([r.n_tokens >= 0 for r in got.collect()])
