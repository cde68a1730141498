"""Exploration, binning and credit-risk reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditlens import schemas as S
from creditlens.catalog import sql as Q
from creditlens.catalog.registry import query
from creditlens.functions.numbers import at_least, default_flag
from creditlens.operators import binning as B
from creditlens.operators import curves as C
from creditlens.operators import explore as E
from creditlens.operators import grading as G
from creditlens.operators import risk as K
from creditlens.operators import woe as W
from creditlens.plans import preparation as P
from creditlens.session import write_stage
from creditlens.sources import views as V

# Helpers -------------------------------------------------------------------------------------


def rounded(df, *columns, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _scored(spark, sf):
    """Scored applications, written once for the reports that read them several times."""
    return write_stage(V.scored(spark, sf), "scored")


def _v0(spark, sf, *columns):
    """Imputed applications, reduced to the columns a report needs."""
    return P.stage_clean(V.loan_raw(spark, sf), "id_aplikasi").select(*columns)


def _labelled(spark, sf, *features):
    """Model features of applications with a known target."""
    rows = P.model_input(P.prepare(V.loan_raw(spark, sf), "id_aplikasi"), "id_aplikasi")
    return rows.where("target is not null").select("id_aplikasi", *features, "target")


LABELLED = "labelled AS (SELECT * FROM model_input WHERE target IS NOT NULL)"


def quantile_list(n: int) -> str:
    return "[" + ", ".join(f"{i / n}::DOUBLE" for i in range(n + 1)) + "]"


def quantile_buckets(source: str, value: str, n: int) -> str:
    """Named expressions ``edges`` and ``bucketed`` over a source."""
    return f"""edges AS (SELECT quantile_cont({value}, {quantile_list(n)}) AS e FROM {source}),
bucketed AS (SELECT {source}.*, 1 + len(list_filter(e[2:{n}], lambda q: q < {value})) AS bucket FROM {source}, edges)"""


def fixed_case(value: str, edges: list[float]) -> str:
    whens = " ".join(f"WHEN {value} <= {e}::DOUBLE THEN {i}" for i, e in enumerate(edges[1:], 1))
    return f"CASE WHEN {value} <= {edges[0]}::DOUBLE THEN NULL {whens} END"


def fixed_buckets(source: str, value: str, edges: list[float]) -> str:
    return f"bucketed AS (SELECT *, {fixed_case(value, edges)} AS bucket FROM {source})"


def spine(n: int) -> str:
    return f"spine AS (SELECT CAST(range AS INTEGER) AS bucket FROM range(1, {n + 1}))"


# Exploration ---------------------------------------------------------------------------------


@query("e1_default_rate", Q.with_view("v0", """
SELECT status_bukti_kepemilikan_agunan, round(100.0 * count(*) FILTER (target = 1) / count(target), 6) AS percentage
FROM v0 GROUP BY 1 HAVING count(*) FILTER (target = 1) > 0"""))
def e1(spark, sf):
    f = "status_bukti_kepemilikan_agunan"
    return rounded(E.default_rate(_v0(spark, sf, f, "target"), f), "percentage")


@query("e1_default_rate_of_documents", """
SELECT lang, round(100.0 * count(*) FILTER (toxic = 1) / count(toxic), 6) AS percentage
FROM documents JOIN labels USING (doc_id) GROUP BY lang HAVING count(*) FILTER (toxic = 1) > 0""")
def e1_documents(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "lang")
    return rounded(E.default_rate(docs.join(V.table(spark, sf, "labels"), "doc_id"), "lang", "toxic"), "percentage")


_DENSITY = """limits AS (SELECT label, count(*) AS c, min(pd) AS lo, max(pd) AS hi,
  quantile_cont(pd, 0.75) - quantile_cont(pd, 0.25) AS iqr FROM scored GROUP BY label),
sized AS (SELECT *, CAST(least(ceil((hi - lo) / (2 * iqr / cbrt(c))), 50) AS BIGINT) AS n FROM limits)"""


@query("e2_class_density", Q.with_view("scored", """
SELECT sized.label, spine.range AS bin, count(pd) AS n, round(count(pd) / (any_value(c) * (any_value(hi) - any_value(lo)) / any_value(sized.n)), 6) AS density
FROM sized CROSS JOIN LATERAL (SELECT range FROM range(0, sized.n)) AS spine
LEFT JOIN scored ON scored.label = sized.label AND pd >= lo + spine.range * ((hi - lo) / sized.n)
  AND (pd < lo + (spine.range + 1) * ((hi - lo) / sized.n) OR spine.range + 1 = sized.n)
GROUP BY 1, 2""", _DENSITY))
def e2(spark, sf):
    table = E.class_density(_scored(spark, sf), "pd", "label")
    return rounded(table, "density").select("label", "bin", "n", "density")


@query("e3_class_counts", Q.with_view("loan_raw", """
SELECT CASE WHEN kolektibilitas > 2 THEN 1 WHEN kolektibilitas <= 2 THEN 0 END AS target, count(*) AS n
FROM loan_raw GROUP BY 1"""))
def e3(spark, sf):
    return E.class_counts(V.loan_raw(spark, sf).select(default_flag(F.col("kolektibilitas")).alias("target")))


@query("e4_sample", Q.with_view("scored", f"""
SELECT row_id, pd FROM scored WHERE {Q.unit_hash("row_id", 7)} < 0.25"""))
def e4(spark, sf):
    return E.sample_share(V.scored(spark, sf), "row_id", 0.25, seed=7).select("row_id", "pd")


@query("e4_sample_of_fixed_size", Q.with_view("scored", f"""
SELECT row_id, pd FROM scored ORDER BY {Q.row_hash("row_id", 7)}, row_id LIMIT 200"""))
def e4_fixed(spark, sf):
    return E.sample_rows(V.scored(spark, sf), "row_id", 200, seed=7).select("row_id", "pd")


_HIST = """limits AS (SELECT min(pd) AS lo, max(pd) AS hi, CAST(ceil(sqrt(ceil(count(*) / 1000.0) * 1000)) AS BIGINT) AS n
  FROM scored WHERE label = 0 AND split = 'train'),
edges AS (SELECT range AS bin, n, lo + range * ((hi - lo) / n) AS a,
  CASE WHEN range + 1 = n THEN hi ELSE lo + (range + 1) * ((hi - lo) / n) END AS b FROM limits, range(0, 100000) WHERE range < n)"""


@query("e5_histogram", Q.with_view("scored", """
SELECT bin, round(a, 6) AS lo, round(b, 6) AS hi, count(pd) AS n
FROM edges LEFT JOIN (SELECT pd FROM scored WHERE label = 0 AND split = 'train')
  ON pd >= a AND (pd < b OR (edges.bin + 1 = edges.n AND pd <= b)) GROUP BY ALL""", _HIST))
def e5(spark, sf):
    rows = _scored(spark, sf).where("label = 0 and split = 'train'")
    return rounded(E.histogram(rows, "pd"), "lo", "hi")


@query("e6_histogram_per_cluster", Q.with_view("graded", """
SELECT r.rating AS cluster, bin, count(pd) AS n
FROM (SELECT DISTINCT rating FROM graded) AS r CROSS JOIN edges
LEFT JOIN graded ON graded.rating = r.rating AND pd >= a AND (pd < b OR edges.bin = 499) GROUP BY ALL""",
"""edges AS (SELECT range AS bin, lo + range * ((hi - lo) / 500) AS a, lo + (range + 1) * ((hi - lo) / 500) AS b
  FROM (SELECT min(pd) AS lo, max(pd) AS hi FROM graded), range(0, 500))"""))
def e6(spark, sf):
    graded = G.add_grades(_scored(spark, sf), G.default_grades(spark)).withColumnRenamed("rating", "cluster")
    return E.histogram_shared(graded, "pd", "cluster").select("cluster", "bin", "n")


@query("e7_edge_builder", Q.with_view("scored", """
SELECT CAST(range AS INTEGER) AS position,
  round(CASE WHEN range = 10 THEN 1.0 ELSE lo + range * ((hi - lo) / 10) END, 6) AS edge
FROM (SELECT min(pd) AS lo, max(pd) AS hi FROM scored), range(0, 11)"""))
def e7(spark, sf):
    return rounded(E.edge_builder(_scored(spark, sf), "pd"), "edge")


# Buckets -------------------------------------------------------------------------------------


@query("f1_quantile_bucket", Q.with_view("scored", "SELECT row_id, CAST(bucket AS INTEGER) AS bucket FROM bucketed",
                                         quantile_buckets("scored", "pd", 10)))
def f1(spark, sf):
    bucketed, _ = B.add_bucket(_scored(spark, sf), "pd", 10)
    return bucketed.select("row_id", "bucket")


@query("f2_fixed_bucket", Q.with_view("scored", f"SELECT row_id, {fixed_case('pd', S.PD_EDGES)} AS bucket FROM scored"))
def f2(spark, sf):
    bucketed, _ = B.add_bucket(V.scored(spark, sf), "pd", bins=S.PD_EDGES)
    return bucketed.select("row_id", "bucket")


_FIFTHS = "[0.0::DOUBLE, 0.2::DOUBLE, 0.4::DOUBLE, 0.6::DOUBLE, 0.8::DOUBLE]"


@query("f3_fifths", f"""
SELECT o_orderkey, CAST(len(list_filter(e, lambda q: q <= o_totalprice)) AS INTEGER) AS bucket
FROM orders, (SELECT quantile_cont(o_totalprice, {_FIFTHS}) AS e FROM orders)""")
def f3(spark, sf):
    orders = V.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    points = B.exact_quantiles(orders, ["o_totalprice"], B.FIFTHS)["o_totalprice"]
    return orders.select("o_orderkey", B.fifth_bucket(F.col("o_totalprice"), points).alias("bucket"))


@query("f4_discretise", f"""
SELECT l_orderkey, l_linenumber, l_quantity,
  CAST(len(list_filter(p, lambda q: q <= l_extendedprice)) AS DOUBLE) AS l_extendedprice,
  CAST(len(list_filter(d, lambda q: q <= l_discount)) AS DOUBLE) AS l_discount
FROM lineitem, (SELECT quantile_cont(l_extendedprice, {_FIFTHS}) AS p, quantile_cont(l_discount, {_FIFTHS}) AS d FROM lineitem)""")
def f4(spark, sf):
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    lines = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *columns)
    return B.discretise(lines, columns)


# Risk tables ---------------------------------------------------------------------------------

_STATS = """stats AS (SELECT bucket, min(pd) AS lo, max(pd) AS hi, count(pd) AS total, coalesce(sum(label), 0) AS tot_bad,
  any_value(all_bad) AS all_bad, any_value(all_good) AS all_good
  FROM spine LEFT JOIN bucketed USING (bucket), (SELECT sum(label) AS all_bad, sum(1 - label) AS all_good FROM scored)
  GROUP BY bucket),
shares AS (SELECT *, total - tot_bad AS tot_good, tot_bad / all_bad AS pct_bad, (total - tot_bad) / all_good AS pct_good
  FROM stats),
sums AS (SELECT *, sum(pct_bad) OVER w AS cum_bad, sum(pct_good) OVER w AS cum_good FROM shares WINDOW w AS (ORDER BY bucket))"""

_KS = """
SELECT bucket, round(lo, 6) AS min_scr, round(hi, 6) AS max_scr, CAST(tot_bad AS BIGINT) AS tot_bad,
  CAST(tot_good AS BIGINT) AS tot_good, total, round(pct_bad, 6) AS pct_bad, round(pct_good, 6) AS pct_good,
  CASE WHEN tot_bad <> 0 THEN round(tot_good / tot_bad, 6) END AS odds, round(cum_bad, 6) AS cum_bad,
  round(cum_good, 6) AS cum_good, abs(round_even(cum_bad - cum_good, 4)) AS ks,
  CASE WHEN abs(round_even(cum_bad - cum_good, 4)) = max(abs(round_even(cum_bad - cum_good, 4))) OVER () THEN '<----'
    ELSE '' END AS max_ks
FROM sums"""


def _ks(table):
    # The text of the odds is tested apart; here they are a number.
    odds = F.when(F.col("tot_bad") != 0, F.col("tot_good") / F.nullif("tot_bad", F.lit(0)))
    return rounded(table.withColumn("odds", odds), "min_scr", "max_scr", "pct_bad", "pct_good", "odds", "cum_bad", "cum_good")


@query("g1_ks_table", Q.with_view("scored", _KS, quantile_buckets("scored", "pd", 10), spine(10), _STATS))
def g1(spark, sf):
    return _ks(K.ks_table(_scored(spark, sf), "pd", "label"))


@query("g1_ks_table_fixed_edges", Q.with_view("scored", _KS, fixed_buckets("scored", "pd", S.PD_EDGES), spine(5), _STATS))
def g1_fixed(spark, sf):
    return _ks(K.ks_table(V.scored(spark, sf), "pd", "label", bins=S.PD_EDGES))


_PD = """
SELECT bucket, round(lo, 6) AS "PD_min", round(hi, 6) AS "PD_max", CAST(tot_bad AS BIGINT) AS tot_bad, total,
  round(pct_bad, 6) AS pct_bad
FROM shares"""


@query("g2_pd_table", Q.with_view("scored", _PD, quantile_buckets("scored", "pd", 10), spine(10), _STATS))
def g2(spark, sf):
    return rounded(K.pd_table(_scored(spark, sf), "pd", "label"), "PD_min", "PD_max", "pct_bad")


@query("g2_pd_table_fixed_edges", Q.with_view("scored", _PD, fixed_buckets("scored", "pd", S.PD_EDGES), spine(5), _STATS))
def g2_fixed(spark, sf):
    return rounded(K.pd_table(V.scored(spark, sf), "pd", "label", bins=S.PD_EDGES), "PD_min", "PD_max", "pct_bad")


def _woe_sql(value: str, source: str, label: str) -> str:
    return f"""stats AS (SELECT bucket, min({value}) AS lo, max({value}) AS hi, count({value}) AS total,
  coalesce(sum({label}), 0) AS tot_bad, any_value(all_bad) AS all_bad, any_value(all_good) AS all_good
  FROM spine LEFT JOIN bucketed USING (bucket), (SELECT sum({label}) AS all_bad, sum(1 - {label}) AS all_good FROM {source})
  GROUP BY bucket),
shares AS (SELECT *, total - tot_bad AS tot_good, tot_bad / all_bad AS db, (total - tot_bad) / all_good AS dg FROM stats),
woe AS (SELECT *, CASE WHEN db = 0 AND dg = 0 THEN NULL WHEN db = 0 THEN '-inf'::DOUBLE WHEN dg = 0 THEN 'inf'::DOUBLE
  ELSE ln(db / dg) END AS w FROM shares)"""


_WOE = """
SELECT bucket, round(lo, 6) AS min_val, round(hi, 6) AS max_val, CAST(tot_bad AS BIGINT) AS tot_bad,
  CAST(tot_good AS BIGINT) AS tot_good, total, round(db, 6) AS distr_bad, round(dg, 6) AS distr_good,
  round(db - dg, 6) AS distr_margin, CASE WHEN NOT isinf(w) THEN round(w, 6) END AS "WoE",
  CASE WHEN NOT isinf(w) THEN round((db - dg) * w, 6) END AS "IV"
FROM woe"""


def _woe(table):
    finite = {c: F.when(F.abs(c) != float("inf"), F.round(c, 6)) for c in ("WoE", "IV")}
    table = rounded(table.withColumns(finite), "distr_bad", "distr_good", "distr_margin").drop("pct_bad", "pct_good", "lo", "hi")
    return rounded(table, "min_val", "max_val") if "min_val" in table.columns else table


@query("g3_woe_numeric", Q.with_view("scored", _WOE, quantile_buckets("scored", "pd", 10), spine(10),
                                     _woe_sql("pd", "scored", "label")))
def g3(spark, sf):
    return _woe(K.woe_numeric(_scored(spark, sf), "pd", "label"))


@query("g3_woe_numeric_of_documents", f"""
WITH source AS (SELECT doc_id, n_chars, toxic FROM documents JOIN labels USING (doc_id)),
{fixed_buckets("source", "n_chars", [0, 200, 500, 1000, 2000, 5000, 10_000_000])},
{spine(6)},
{_woe_sql("n_chars", "source", "toxic")}
{_WOE}""")
def g3_documents(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "n_chars").join(V.table(spark, sf, "labels"), "doc_id")
    return _woe(K.woe_numeric(docs, "n_chars", "toxic", bins=[0, 200, 500, 1000, 2000, 5000, 10_000_000]))


def _predicted(spark, sf, *features):
    """Features of the model input with the closed-form probability and its hard label."""
    rows = P.model_input(P.prepare(V.loan_raw(spark, sf), "id_aplikasi"), "id_aplikasi").select("id_aplikasi", *features)
    scores = V.scored(spark, sf).select(F.col("row_id").alias("id_aplikasi"), "pd")
    joined = rows.join(scores, "id_aplikasi")
    return joined.withColumn("bad", at_least(F.col("pd"), S.REPORT_CUTOFF))


_PREDICTED = """predicted AS (SELECT m.*, CAST(s.pd >= 0.15 AS INTEGER) AS bad
  FROM model_input m JOIN scored s ON m.id_aplikasi = s.row_id)"""


def _iv_sql(feature: str, edges: list[float] | None) -> str:
    bucket = fixed_case(feature, edges) if edges else feature
    return f"""SELECT '{feature}' AS feature, sum((db - dg) * w) AS iv FROM (
  SELECT db, dg, CASE WHEN db = 0 AND dg = 0 THEN NULL WHEN db = 0 THEN '-inf'::DOUBLE WHEN dg = 0 THEN 'inf'::DOUBLE
    ELSE ln(db / dg) END AS w FROM (
  SELECT b, sum(bad) / any_value(t.all_bad) AS db, sum(1 - bad) / any_value(t.all_good) AS dg
  FROM (SELECT {bucket} AS b, bad FROM predicted),
    (SELECT sum(bad) AS all_bad, sum(1 - bad) AS all_good FROM predicted) AS t WHERE b IS NOT NULL GROUP BY b))"""


_IV_CATEGORICAL = ["jenis_kelamin", "tujuan_penggunaan"]


@query("g3_g4_information_values", Q.with_view(
    "model_input",
    "SELECT feature, isinf(iv) AS infinite, CASE WHEN NOT isinf(iv) THEN round(iv, 6) END AS iv FROM ("
    + " UNION ALL ".join(_iv_sql(f, S.WOE_EDGES.get(f)) for f in [*S.WOE_EDGES, *_IV_CATEGORICAL]) + ")",
    Q.SCORED_SQL, _PREDICTED))
def g3_iv(spark, sf):
    rows = write_stage(_predicted(spark, sf, *S.WOE_EDGES, *_IV_CATEGORICAL), "predicted")
    tables = [
        K.woe_numeric(rows, f, "bad", bins=S.WOE_EDGES[f]).select(F.lit(f).alias("feature"), "IV") for f in S.WOE_EDGES
    ] + [K.woe_categorical(rows, f, "bad").select(F.lit(f).alias("feature"), "IV") for f in _IV_CATEGORICAL]
    together = tables[0]
    for t in tables[1:]:
        together = together.unionByName(t)
    infinite = F.abs("iv") == float("inf")
    return K.total_iv(together, "feature").select(
        "feature", infinite.alias("infinite"), F.when(~infinite, F.round("iv", 6)).alias("iv")
    )


@query("g4_woe_categorical", Q.with_view("model_input", """
SELECT pendidikan, CAST(b AS BIGINT) AS tot_bad, CAST(g AS BIGINT) AS tot_good, CAST(b + g AS BIGINT) AS total,
  round(b / ab, 6) AS distr_bad, round(g / ag, 6) AS distr_good, round(b / ab - g / ag, 6) AS distr_margin,
  round(ln((b / ab) / (g / ag)), 6) AS "WoE", round((b / ab - g / ag) * ln((b / ab) / (g / ag)), 6) AS "IV"
FROM (SELECT pendidikan, sum(target) AS b, sum(1 - target) AS g FROM labelled GROUP BY 1),
  (SELECT sum(target) AS ab, sum(1 - target) AS ag FROM labelled)""", LABELLED))
def g4(spark, sf):
    return _woe(K.woe_categorical(_labelled(spark, sf, "pendidikan"), "pendidikan", "target"))


def _limited(keys: str, source: str, label: str, low: int = -20, high: int = 20) -> str:
    """Grouped counts with limited weights of evidence: ``weights`` over a source with the given keys."""
    return f"""counts AS (SELECT {keys}, count(*) FILTER ({label} = 1) AS event_count,
  count(*) FILTER ({label} <> 1) AS non_event_count FROM {source} GROUP BY ALL),
weights AS (SELECT *, CASE WHEN event_count = 0 THEN {low} WHEN non_event_count = 0 THEN {high}
    ELSE ln((event_count / yes) / (non_event_count / no)) END AS woe, event_count / yes - non_event_count / no AS gap
  FROM counts, (SELECT sum(event_count) AS yes, sum(non_event_count) AS no FROM (
    SELECT count(*) FILTER ({label} = 1) AS event_count, count(*) FILTER ({label} <> 1) AS non_event_count FROM {source}
    {"GROUP BY feature LIMIT 1" if "feature" in keys else ""})))"""


_DOCS = "source AS (SELECT lang, source, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id))"


def _documents(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(V.table(spark, sf, "labels"), "doc_id")


@query("g5_woe_limited", f"""
WITH {_DOCS}, {_limited("source AS value", "source", "toxic")}
SELECT value, event_count, non_event_count, round(woe, 6) AS woe, round(gap * woe, 6) AS iv FROM weights""")
def g5(spark, sf):
    return rounded(W.woe_single(_documents(spark, sf), "source", "toxic"), "woe", "iv")


_G6_FEATURES = list(S.NUMERIC_FEATURES)


def _cells(features: list[str], cut: list[str]) -> str:
    """``cells``: one row per application and feature, the continuous features cut into fifths."""
    parts = []
    for f in features:
        if f in cut:
            parts.append(f"""SELECT id_aplikasi, '{f}' AS feature, CAST(len(list_filter(e, lambda q: q <= {f})) AS DOUBLE) AS value,
  target FROM labelled, (SELECT quantile_cont({f}, {_FIFTHS}) AS e FROM labelled)""")
        else:
            parts.append(f"SELECT id_aplikasi, '{f}' AS feature, {f} AS value, target FROM labelled")
    return "cells AS (" + " UNION ALL ".join(parts) + ")"


_CELLS = _cells(_G6_FEATURES, ["ratio_pendatapan_to_angsuran"])


@query("g6_woe_of_features", Q.with_view("model_input", """
SELECT feature, value, event_count, non_event_count, round(woe, 6) AS woe, round(gap * woe, 6) AS iv FROM weights""",
                                         LABELLED, _CELLS, _limited("feature, value", "cells", "target")))
def g6(spark, sf):
    return rounded(W.woe_table(_labelled(spark, sf, *_G6_FEATURES), _G6_FEATURES, "target"), "woe", "iv")


@query("g6_information_values", Q.with_view("model_input", """
SELECT feature, round(sum(gap * woe), 6) AS iv FROM weights GROUP BY feature""",
                                            LABELLED, _CELLS, _limited("feature, value", "cells", "target")))
def g6_iv(spark, sf):
    return rounded(W.information_values(W.woe_table(_labelled(spark, sf, *_G6_FEATURES), _G6_FEATURES, "target")), "iv")


@query("g7_woe_replace", Q.with_view("model_input", f"""
SELECT id_aplikasi, {", ".join(f"round(max(woe) FILTER (cells.feature = '{f}'), 6) AS {f}" for f in _G6_FEATURES)}
FROM cells JOIN weights ON cells.feature = weights.feature AND cells.value = weights.value GROUP BY id_aplikasi""",
                                     LABELLED, _CELLS, _limited("feature, value", "cells", "target")))
def g7(spark, sf):
    # Continuous features are cut as in the table, so that their values are found there.
    rows = write_stage(B.discretise(_labelled(spark, sf, *_G6_FEATURES), _G6_FEATURES), "labelled")
    table = write_stage(W.woe_table(rows, _G6_FEATURES, "target"), "woe")
    return rounded(W.woe_replace(rows, _G6_FEATURES, table).drop("target"), *_G6_FEATURES)


@query("g8_combined_iv", f"""
WITH {_DOCS}, {_limited("lang || source AS value", "source", "quality")}
SELECT value, event_count, non_event_count, round(woe, 6) AS woe, round(gap * woe, 6) AS iv FROM weights""")
def g8(spark, sf):
    return rounded(W.combined_iv(_documents(spark, sf), ["lang", "source"], "quality"), "woe", "iv")


@query("g9_event_counts", """
SELECT count(*) FILTER (toxic = 1) AS event_count, count(*) FILTER (toxic <> 1) AS non_event_count,
  count(DISTINCT toxic) AS n_labels FROM labels""")
def g9(spark, sf):
    labels = V.table(spark, sf, "labels")
    W.check_binary(labels, "toxic")
    return W.event_counts(labels, "toxic")


@query("g10_woe_own_limits", f"""
WITH {_DOCS}, {_limited("lang || source || CAST(quality AS VARCHAR) AS value", "source", "toxic", -5, 5)}
SELECT value, event_count, non_event_count, round(woe, 6) AS woe, round(gap * woe, 6) AS iv FROM weights""")
def g10(spark, sf):
    table = W.combined_iv(_documents(spark, sf), ["lang", "source", "quality"], "toxic", low=-5, high=5)
    return rounded(table, "woe", "iv")


# Curves --------------------------------------------------------------------------------------

_P_VALUE = """greatest(0.0, least(1.0, list_sum(list_transform(range(1, 101),
  lambda k: CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * x * x)))))"""


def _ks_two(source: str, value: str, second: str) -> str:
    """Statistic and p-value over ``source``; ``second`` marks the second sample."""
    return f"""
SELECT round(d, 6) AS statistic, n1, n2, round(CASE WHEN x < 0.2 THEN 1.0 ELSE {_P_VALUE} END, 6) AS p_value
FROM (SELECT d, n1, n2, (sqrt(n1 * n2 / (n1 + n2)) + 0.12 + 0.11 / sqrt(n1 * n2 / (n1 + n2))) * d AS x FROM (
  SELECT max(abs(ca / n1 - cb / n2)) AS d, any_value(n1) AS n1, any_value(n2) AS n2 FROM (
    SELECT CAST(sum(a) OVER (ORDER BY v) AS DOUBLE) AS ca, CAST(sum(b) OVER (ORDER BY v) AS DOUBLE) AS cb,
      CAST(sum(a) OVER () AS BIGINT) AS n1, CAST(sum(b) OVER () AS BIGINT) AS n2 FROM (
      SELECT {value} AS v, count(*) FILTER (NOT ({second})) AS a, count(*) FILTER ({second}) AS b
      FROM {source} GROUP BY 1))))"""


@query("g11_ks_two_sample", Q.with_view("scored", _ks_two("train", "pd", "label = 1"),
                                        "train AS (SELECT * FROM scored WHERE split = 'train')"))
def g11(spark, sf):
    train = _scored(spark, sf).where("split = 'train'")
    return rounded(C.ks_two_sample(train, "pd", F.col("label") == 1), "statistic", "p_value")


def _ks_by(source: str, value: str, second: str, by: str) -> str:
    """``_ks_two`` of each value of ``by``."""
    return f"""
SELECT {by}, round(d, 6) AS statistic, n1, n2, round(CASE WHEN x < 0.2 THEN 1.0 ELSE {_P_VALUE} END, 6) AS p_value
FROM (SELECT {by}, d, n1, n2, (sqrt(n1 * n2 / (n1 + n2)) + 0.12 + 0.11 / sqrt(n1 * n2 / (n1 + n2))) * d AS x FROM (
  SELECT {by}, max(abs(ca / n1 - cb / n2)) AS d, any_value(n1) AS n1, any_value(n2) AS n2 FROM (
    SELECT {by}, CAST(sum(a) OVER (PARTITION BY {by} ORDER BY v) AS DOUBLE) AS ca,
      CAST(sum(b) OVER (PARTITION BY {by} ORDER BY v) AS DOUBLE) AS cb,
      CAST(sum(a) OVER (PARTITION BY {by}) AS BIGINT) AS n1, CAST(sum(b) OVER (PARTITION BY {by}) AS BIGINT) AS n2 FROM (
      SELECT {by}, {value} AS v, count(*) FILTER (NOT ({second})) AS a, count(*) FILTER ({second}) AS b
      FROM {source} GROUP BY ALL)) GROUP BY {by}))"""


@query("g11_ks_by_split", Q.with_view("scored", _ks_by("scored", "pd", "label = 1", "split")))
def g11_by_split(spark, sf):
    return rounded(C.ks_two_sample(_scored(spark, sf), "pd", F.col("label") == 1, by=["split"]), "statistic", "p_value")


@query("g12_ks_of_histograms", Q.with_view("scored", _ks_two("hist", "n", "label = 1"), """
limits AS (SELECT label, min(pd) AS lo, max(pd) AS hi, CAST(ceil(sqrt(ceil(count(*) / 1000.0) * 1000)) AS BIGINT) AS n
  FROM scored GROUP BY label),
edges AS (SELECT label, range AS bin, n, lo + range * ((hi - lo) / n) AS a, lo + (range + 1) * ((hi - lo) / n) AS b
  FROM limits, range(0, 100000) WHERE range < n),
hist AS (SELECT edges.label, bin, count(pd) AS n FROM edges LEFT JOIN scored ON scored.label = edges.label AND pd >= a
  AND (pd < b OR edges.bin + 1 = edges.n) GROUP BY ALL)"""))
def g12(spark, sf):
    return rounded(C.ks_of_histograms(_scored(spark, sf), "pd", "label"), "statistic", "p_value")


_CONFUSION = """SELECT t.range AS true_label, p.range AS pred_label, count(label) AS n
  FROM range(0, 2) t CROSS JOIN range(0, 2) p
  LEFT JOIN scored ON label = t.range AND CAST(pd > 0.12 AS INTEGER) = p.range GROUP BY ALL"""


@query("g13_confusion_counts", Q.with_view("scored", f"""
SELECT CAST(true_label AS INTEGER) AS true_label, CAST(pred_label AS INTEGER) AS pred_label, n FROM ({_CONFUSION})"""))
def g13(spark, sf):
    return C.confusion_counts(V.scored(spark, sf), "pd", "label", 0.12)


_ROC = """roc AS (SELECT pd, CAST(sum(neg) OVER w / sum(neg) OVER () AS DOUBLE) AS fpr,
  CAST(sum(pos) OVER w / sum(pos) OVER () AS DOUBLE) AS tpr
  FROM (SELECT pd, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY pd) WINDOW w AS (ORDER BY pd DESC))"""


@query("g14_roc_points", Q.with_view("scored", """
SELECT pd AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM roc""", _ROC))
def g14(spark, sf):
    return rounded(C.roc_points(_scored(spark, sf), "pd", "label"), "fpr", "tpr")


@query("g15_auc", Q.with_view("scored", """
SELECT round(a, 6) AS auc, round(2 * a - 1, 6) AS gini FROM (
  SELECT sum((fpr - pf) * (tpr + pt) / 2) AS a FROM (
    SELECT fpr, tpr, coalesce(lag(fpr) OVER (ORDER BY pd DESC), 0) AS pf, coalesce(lag(tpr) OVER (ORDER BY pd DESC), 0) AS pt
    FROM roc))""", _ROC))
def g15(spark, sf):
    return rounded(C.auc(_scored(spark, sf), "pd", "label"), "auc", "gini")


# The same on train and test side by side.
_ROC_BY = _ROC.replace("sum(neg) OVER ()", "sum(neg) OVER (PARTITION BY split)").replace(
    "sum(pos) OVER ()", "sum(pos) OVER (PARTITION BY split)").replace("SELECT pd,", "SELECT split, pd,").replace(
    "GROUP BY pd", "GROUP BY split, pd").replace("(ORDER BY pd DESC)", "(PARTITION BY split ORDER BY pd DESC)")
_AUC_BY = f"""{_ROC_BY}, areas AS (SELECT split, sum((fpr - pf) * (tpr + pt) / 2) AS a FROM (
  SELECT split, fpr, tpr, coalesce(lag(fpr) OVER w, 0) AS pf, coalesce(lag(tpr) OVER w, 0) AS pt FROM roc
  WINDOW w AS (PARTITION BY split ORDER BY pd DESC)) GROUP BY split)"""


@query("g13_confusion_by_split", Q.with_view("scored", """
SELECT s.split, CAST(t.range AS INTEGER) AS true_label, CAST(p.range AS INTEGER) AS pred_label, count(label) AS n
FROM (SELECT DISTINCT split FROM scored) s CROSS JOIN range(0, 2) t CROSS JOIN range(0, 2) p
LEFT JOIN scored ON scored.split = s.split AND label = t.range AND CAST(pd > 0.12 AS INTEGER) = p.range GROUP BY ALL"""))
def g13_by_split(spark, sf):
    return C.confusion_counts(V.scored(spark, sf), "pd", "label", 0.12, by=["split"])


@query("g14_roc_points_by_split", Q.with_view("scored", """
SELECT split, pd AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM roc""", _ROC_BY))
def g14_by_split(spark, sf):
    return rounded(C.roc_points(_scored(spark, sf), "pd", "label", by=["split"]), "fpr", "tpr")


@query("g15_auc_by_split", Q.with_view("scored", """
SELECT split, round(a, 6) AS auc, round(2 * a - 1, 6) AS gini FROM areas""", _AUC_BY))
def g15_by_split(spark, sf):
    return rounded(C.auc(_scored(spark, sf), "pd", "label", by=["split"]), "auc", "gini")


@query("g11_g15_evaluation", Q.with_view("scored", """
SELECT split, n, bad, statistic AS ks, p_value, round(a, 6) AS auc, round(2 * a - 1, 6) AS gini, round(right_labels / n, 6) AS accuracy,
  round(tp / predicted, 6) AS precision, round(tp / bad, 6) AS recall
FROM (SELECT split, count(*) AS n, CAST(sum(label) AS BIGINT) AS bad, count(*) FILTER (CAST(pd > 0.12 AS INTEGER) = label) AS right_labels,
    count(*) FILTER (pd > 0.12) AS predicted, count(*) FILTER (pd > 0.12 AND label = 1) AS tp FROM scored GROUP BY split)
JOIN areas USING (split) JOIN ks USING (split)""", _AUC_BY, "ks AS (" + _ks_by("scored", "pd", "label = 1", "split") + ")"))
def evaluation(spark, sf):
    table = C.evaluation(_scored(spark, sf), "pd", "label", ["split"], 0.12)
    return rounded(table, "ks", "p_value", "auc", "gini", "accuracy", "precision", "recall")


@query("g16_accuracy", Q.with_view("scored", """
SELECT split, round(avg(CAST(CAST(pd > 0.12 AS INTEGER) = label AS INTEGER)), 6) AS accuracy, count(*) AS n
FROM scored GROUP BY split"""))
def g16(spark, sf):
    return rounded(C.accuracy(V.scored(spark, sf), "pd", "label", "split", 0.12), "accuracy")


@query("g17_classification_report", Q.with_view("scored", f"""
SELECT CAST(l.range AS INTEGER) AS label, round(tp / pred, 6) AS precision, round(tp / sup, 6) AS recall,
  round(2 * (tp / pred) * (tp / sup) / (tp / pred + tp / sup), 6) AS f1, CAST(sup AS BIGINT) AS support
FROM range(0, 2) l, LATERAL (SELECT sum(n) FILTER (true_label = l.range AND pred_label = l.range) AS tp,
  sum(n) FILTER (pred_label = l.range) AS pred, sum(n) FILTER (true_label = l.range) AS sup FROM ({_CONFUSION}))"""))
def g17(spark, sf):
    return rounded(C.classification_report(V.scored(spark, sf), "pd", "label", 0.12), "precision", "recall", "f1")


# Grades --------------------------------------------------------------------------------------


@query("s4_grade_lookup", Q.with_view("graded", "SELECT row_id, pd, round(score, 6) AS score, rating FROM graded"))
def s4(spark, sf):
    graded = G.add_grades(V.scored(spark, sf), G.default_grades(spark))
    return rounded(graded, "score").select("row_id", "pd", "score", "rating")


@query("s4_default_rate_by_rating", Q.with_view("graded", """
SELECT rating, count(*) AS n, round(avg(label), 6) AS default_rate, round(min(score), 6) AS low_score,
  round(max(score), 6) AS high_score FROM graded GROUP BY rating"""))
def s4_rates(spark, sf):
    graded = G.add_grades(V.scored(spark, sf), G.default_grades(spark))
    return graded.groupBy("rating").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("label"), 6).alias("default_rate"),
        F.round(F.min("score"), 6).alias("low_score"), F.round(F.max("score"), 6).alias("high_score"),
    )


@query("h16_grade_table", Q.with_view("graded", """
SELECT CAST(row_number() OVER o AS INTEGER) AS "Rating", round(lo, 6) AS "Proba_MIN", round(hi, 6) AS "Proba_MAX",
  CASE WHEN row_number() OVER o = count(*) OVER () THEN 0 ELSE round_even((1 - hi * 2) * 1000, 0) END AS "Score_MIN",
  CASE WHEN row_number() OVER o = 1 THEN 1000 ELSE round_even((1 - lo * 2) * 1000, 0) END AS "Score_MAX",
  n AS "Total", round(p, 6) AS "PD(%)"
FROM (SELECT rating, min(pd) AS lo, max(pd) AS hi, count(*) AS n, sum(label) * 100 / count(*) AS p
  FROM graded WHERE split = 'train' GROUP BY rating) WINDOW o AS (ORDER BY p, lo)"""))
def h16(spark, sf):
    train = V.scored(spark, sf).where("split = 'train'")
    bands = G.add_grades(train, G.default_grades(spark)).withColumnRenamed("rating", "cluster")
    return rounded(G.build_grades(bands, "pd", "label"), "Proba_MIN", "Proba_MAX", "PD(%)")
