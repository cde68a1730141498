"""The filter audit against a plain version that runs all orders row by row."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from creditlens.llm import audit

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, labels):
    """All rows of the audit from (doc_id, text, lang) and (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = {}
    for i, t, lang in rows:
        t = t or ""
        w = WORDS.findall(t)
        fails = (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)),
            i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        )
        parts.setdefault(lang or "", []).append((fails, i in good, i in toxic))
    out = {}
    for part, docs in parts.items():
        removed_by = [0] * 5
        for order in itertools.permutations(range(5)):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                removed_by[f] += len(gone)
                out[part, "".join("ABCDE"[k] for k in order), step] = [
                    len(left), len(gone), sum(d[0][f] for d in docs) - len(gone), sum(d[0][f] and sum(d[0]) == 1 for d in docs),
                    sum(d[1] for d in gone), sum(d[2] for d in gone), f,
                ]
        for key, values in out.items():
            if key[0] == part:
                values[-1] = removed_by[values[-1]]
    return out


def found(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    got = {}
    for r in df.collect():
        key = r["part"], r["filter_order"], r["step"]
        assert key not in got
        got[key] = [r[n] for n in names]
    return got


def frames(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr(
        "*", "1 AS mask", "'x' AS part", "2 AS row_id", "true AS A", "3 AS kept", "'d' AS digest", "4 AS cells")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_random_rows(spark):
    rng = random.Random(11)
    texts = [
        None, "", " \n\t", "A", "a#b", "x " * 300, " ".join(f"w{i}" for i in range(250)), " ".join(f"W{i}" for i in range(250)), "a | b " * 120,
        " ".join(f"É{i % 120}" for i in range(240)), "\x1c\x85 " * 5,
    ]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["en", "", None, "de"])) for _ in range(300)]
    labels = [(rng.choice([None, *range(60)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(80)]
    want = plain(rows, labels)
    assert found(audit.audit_documents(*frames(spark, rows, labels))) == want and len(want) == 3 * 600


def test_hot_text_and_long_text(spark):
    """A third of all rows share one text; one text is long."""
    rows = [(i, "same words here", "en") for i in range(400)] + [(1000 + i, f"own {i} #", "fr") for i in range(60)] + [(5000, "w# " * 300_000, "fr")]
    labels = [(0, 1, 1), (1, 1, 0), (1, 0, 1), (5000, 1, 0)]
    assert found(audit.audit_documents(*frames(spark, rows, labels))) == plain(rows, labels)


def test_empty_table(spark):
    assert found(audit.audit_documents(*frames(spark, [], []))) == {}


def test_any_number_of_filters(spark):
    rows = [(p, *fails, m) for p in ("x", "y") for fails in itertools.product([True, False, None], repeat=3) for m in (True, False, None)]
    df = spark.createDataFrame(rows, "part string, p boolean, q boolean, r boolean, odd boolean")
    got = audit.audit(df, ["p", "q", "r"], ["odd"])
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "odd_lost", "shapley"]
    for r in got.collect():
        own = [x for x in rows if x[0] == r["part"]]
        order = ["pqr".index(c) + 1 for c in r["filter_order"]]
        left = [x for x in own if not any(x[i] for i in order[: r["step"]])]
        before = [x for x in own if not any(x[i] for i in order[: r["step"] - 1])]
        assert (r["kept"], r["removed"]) == (len(left), len(before) - len(left))
        assert r["odd_lost"] == sum(bool(x[4]) for x in before) - sum(bool(x[4]) for x in left)
    assert got.count() == 2 * 6 * 3
    with pytest.raises(ValueError):
        audit.audit(df, [], [])


def test_walk_toggles_one_filter_at_a_time():
    """Every state equals the survivors counted anew."""
    rng = random.Random(1)
    masks = list(range(32))
    counts = [[rng.randrange(9), rng.randrange(9)] for _ in masks]
    states = audit.gray_states(masks, counts, 5)
    for subset, state in enumerate(states):
        assert state == [sum(c[k] for m, c in zip(masks, counts) if not m & subset) for k in range(2)]


def test_marks_and_copies_meet_no_hot_key(spark):
    rows = spark.createDataFrame([(None, "d")] * 5 + [(2, "d"), (1, "d"), (1, "d"), (3, "e")], "row_id long, digest string")
    got = audit.with_later_copies(rows, "E").groupBy("row_id").agg(F.collect_set("E").alias("E")).collect()
    assert {r.row_id: r.E for r in got} == {None: [False], 1: [False], 2: [True], 3: [False]}
