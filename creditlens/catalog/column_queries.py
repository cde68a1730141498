"""Scalar transforms and imputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditlens import schemas as S
from creditlens.catalog import sql as Q
from creditlens.catalog.registry import query
from creditlens.functions import bands as N
from creditlens.functions import labels as L
from creditlens.functions import numbers as M
from creditlens.operators import impute as I
from creditlens.operators.grading import add_grades, default_grades
from creditlens.plans import preparation as P
from creditlens.plans.scoring import RESULT_SCHEMA, result_text, with_constants
from creditlens.sources import records as R
from creditlens.sources import views as V


def _raw(name: str, sql: str, column):
    """Register one derived column over the raw applications: (id_aplikasi, value)."""

    @query(name, Q.with_view("loan_raw", f"SELECT id_aplikasi, {sql} AS value FROM loan_raw"))
    def run(spark, sf) -> DataFrame:
        return V.loan_raw(spark, sf).select("id_aplikasi", column().alias("value"))


def _cleaned(spark, sf) -> DataFrame:
    return P.clean(V.loan_raw(spark, sf), "id_aplikasi")


c = F.col


def _years(column: str, end: str = "tgl_mulai") -> str:
    return f"CAST(round_even(date_diff('day', CAST(strptime({column}, '%d-%m-%Y') AS DATE), {end}) / 364.0::DOUBLE, 0) AS DOUBLE)"


_raw("c1_inverted_flag", "CASE WHEN debitur_baru THEN 0 WHEN NOT debitur_baru THEN 1 END",
     lambda: L.inverted_flag(c("debitur_baru")))
_raw("c2_marital_status", Q.case("status_nikah", L.MARITAL_STATUS), lambda: L.marital_status(c("status_nikah")))
_raw("c3_home_ownership", Q.case("kepemilikan_tempat_tinggal", L.HOME_OWNERSHIP),
     lambda: L.home_ownership(c("kepemilikan_tempat_tinggal")))
_raw("c4_loan_purpose", Q.case("tujuan_penggunaan", L.LOAN_PURPOSE), lambda: L.loan_purpose(c("tujuan_penggunaan")))
_raw("c5_gender", Q.case("jenis_kelamin", L.GENDER), lambda: L.gender(c("jenis_kelamin")))
_raw("c6_collateral", Q.phrases("status_bukti_kepemilikan_agunan", L.COLLATERAL_PHRASES),
     lambda: L.collateral(c("status_bukti_kepemilikan_agunan")))
_raw("c7_education", Q.education("pendidikan"), lambda: L.education(c("pendidikan")))
_raw("c8_parse_date", "CAST(CAST(strptime(tanggal_lahir, '%d-%m-%Y') AS DATE) AS VARCHAR)",
     lambda: M.parse_day_first(c("tanggal_lahir")).cast("string"))
_raw("c9_whole_years", _years("tanggal_lahir"),
     lambda: M.whole_years(M.parse_day_first(c("tanggal_lahir")), c("tgl_mulai")))
_raw("c10_not_below_zero", f"CASE WHEN {_years('tanggal_mulai_bekerja')} < 0 THEN 0 ELSE {_years('tanggal_mulai_bekerja')} END",
     lambda: M.not_below(M.whole_years(M.parse_day_first(c("tanggal_mulai_bekerja")), c("tgl_mulai")), 0))
_raw("c11_children_cap", "CASE WHEN jumlah_anak_dlm_tanggungan > 10 THEN 10 ELSE jumlah_anak_dlm_tanggungan END",
     lambda: M.not_above(c("jumlah_anak_dlm_tanggungan"), S.MAX_CHILDREN))
_raw("c12_right_trim", "rtrim(jenis_pekerjaan)", lambda: L.strip_right(c("jenis_pekerjaan")))
_raw("c13_default_flag", "CASE WHEN kolektibilitas > 2 THEN 1 WHEN kolektibilitas <= 2 THEN 0 END",
     lambda: M.default_flag(c("kolektibilitas")))
_raw("c14_side_business", """CASE WHEN usaha_sampingan > 0 THEN usaha_sampingan
  WHEN pendapatan_netto_sampingan > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END""",
     lambda: M.side_business(c("usaha_sampingan"), c("pendapatan_netto_sampingan")))


@query("c9_whole_years_of_times", """
SELECT event_id, CAST(round_even(floor((epoch(ts) - epoch(TIMESTAMP '2020-06-15 12:00:00')) / 86400.0::DOUBLE)
  / 364.0::DOUBLE, 0) AS DOUBLE) AS years
FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)
""")
def c9_times(spark, sf):
    start = F.lit("2020-06-15 12:00:00").cast("timestamp")
    events = V.table(spark, sf, "events")
    return events.select("event_id", M.whole_years_between_times(start, c("ts").cast("timestamp")).alias("years"))


def _v0(name: str, sql: str, column):
    """Register one derived column over the imputed applications, infinities shown as text."""

    @query(name, Q.with_view("v0", f"""
SELECT id_aplikasi, CASE WHEN isinf(value) THEN NULL ELSE round(value, 6) END AS value,
  CASE WHEN value IS NULL THEN 'null' WHEN value = 'inf'::DOUBLE THEN 'inf' WHEN value = '-inf'::DOUBLE THEN '-inf'
    ELSE 'finite' END AS kind
FROM (SELECT id_aplikasi, CAST({sql} AS DOUBLE) AS value FROM v0)"""))
    def run(spark, sf) -> DataFrame:
        v0 = P.stage_clean(V.loan_raw(spark, sf), "id_aplikasi")
        value = column().cast("double")
        infinite = F.abs(value) == float("inf")
        kind = F.when(value.isNull(), "null").when(infinite & (value > 0), "inf").when(infinite, "-inf").otherwise("finite")
        return v0.select("id_aplikasi", F.when(~infinite, F.round(value, 6)).alias("value"), kind.alias("kind"))


_INCOME = "pendapatan_netto_utama + pendapatan_netto_sampingan"


def _income() -> Column:
    return c("pendapatan_netto_utama") + c("pendapatan_netto_sampingan")


_v0("c15_income_ratio", f"CASE WHEN {Q.ratio(_INCOME, 'angsuran')} > 10 THEN 10 ELSE {Q.ratio(_INCOME, 'angsuran')} END",
    lambda: M.capped_ratio(_income(), c("angsuran")))
_v0("c16_is_positive", "CASE WHEN pendapatan_netto_sampingan > 0 THEN 1 ELSE 0 END",
    lambda: M.is_positive(c("pendapatan_netto_sampingan")))
_v0("c17_row_maximum", "greatest(CASE WHEN pendapatan_netto_sampingan > 0 THEN 1 ELSE 0 END, usaha_sampingan)",
    lambda: F.greatest(M.is_positive(c("pendapatan_netto_sampingan")).cast("double"), c("usaha_sampingan")))
_v0("c18_collateral_ratio", Q.ratio("nilai_likuidasi", "plafond"), lambda: M.ratio(c("nilai_likuidasi"), c("plafond")))


def band_sql(column: str, bands: list[tuple]) -> str:
    whens = []
    for low, high, ends, label in bands:
        tests = []
        if low is not None:
            tests.append(f"{column} {'>=' if ends[0] == '[' else '>'} {low}")
        if high is not None:
            tests.append(f"{column} {'<=' if ends[1] == ']' else '<'} {high}")
        whens.append(f"WHEN {' AND '.join(tests)} THEN '{label}'")
    return "CASE " + " ".join(whens) + " END"


_BANDED = {
    "usia": N.AGE_BANDS, "jumlah_anak_dlm_tanggungan": N.CHILDREN_BANDS, "lama_bekerja": N.TENURE_FINE_BANDS,
    "jangka_waktu": N.TERM_BANDS,
}


@query("c19_bands", Q.with_view("v0", f"""
SELECT id_aplikasi, {", ".join(f"{band_sql(k, b)} AS {k}" for k, b in _BANDED.items())},
  {band_sql("lama_bekerja", N.TENURE_BANDS)} AS tenure
FROM v0"""))
def c19(spark, sf):
    v0 = P.stage_clean(V.loan_raw(spark, sf), "id_aplikasi")
    return v0.select(
        "id_aplikasi", *[N.band(c(k), b).alias(k) for k, b in _BANDED.items()],
        N.band(c("lama_bekerja"), N.TENURE_BANDS).alias("tenure"),
    )


_ORDERED = {
    "status_nikah": N.MARITAL_ORDER, "tujuan_penggunaan": N.PURPOSE_ORDER, "jenis_kelamin": N.GENDER_ORDER,
    "status_bukti_kepemilikan_agunan": N.COLLATERAL_ORDER,
}


@query("c20_ordinals", Q.with_view("v0", f"""
SELECT id_aplikasi, {", ".join(f"{Q.case(k, o)} AS {k}" for k, o in _ORDERED.items())},
  {Q.case(band_sql("usia", N.AGE_BANDS), N.AGE_ORDER)} AS usia,
  {Q.case(band_sql("jangka_waktu", N.TERM_BANDS), N.TERM_ORDER)} AS jangka_waktu,
  {Q.case(band_sql("jumlah_anak_dlm_tanggungan", N.CHILDREN_BANDS), N.CHILDREN_ORDER)} AS jumlah_anak_dlm_tanggungan,
  {Q.case(band_sql("lama_bekerja", N.TENURE_FINE_BANDS), N.TENURE_ORDER)} AS lama_bekerja,
  CASE pendidikan WHEN 'S1/S2/S3' THEN 3 WHEN 'SD/SMP/SMU/SMK' THEN 4 END AS pendidikan,
  CASE kepemilikan_tempat_tinggal WHEN 'MilikSendiri' THEN 1 WHEN 'RumahDinas' THEN 2 WHEN 'SewaKontrak' THEN 4 END
    AS kepemilikan_tempat_tinggal
FROM v0"""))
def c20(spark, sf):
    v0 = P.stage_clean(V.loan_raw(spark, sf), "id_aplikasi")
    return v0.select(
        "id_aplikasi", *[N.ordinal(c(k), o).alias(k) for k, o in _ORDERED.items()],
        N.ordinal(N.band(c("usia"), N.AGE_BANDS), N.AGE_ORDER).alias("usia"),
        N.ordinal(N.band(c("jangka_waktu"), N.TERM_BANDS), N.TERM_ORDER).alias("jangka_waktu"),
        N.ordinal(N.band(c("jumlah_anak_dlm_tanggungan"), N.CHILDREN_BANDS), N.CHILDREN_ORDER).alias("jumlah_anak_dlm_tanggungan"),
        N.ordinal(N.band(c("lama_bekerja"), N.TENURE_FINE_BANDS), N.TENURE_ORDER).alias("lama_bekerja"),
        # The education and home orders name raw levels; the cleaned labels are mapped to these first.
        N.ordinal(N.map_values(c("pendidikan"), {"S1/S2/S3": "S1", "SD/SMP/SMU/SMK": "SD-SMA"}), N.EDUCATION_ORDER).alias("pendidikan"),
        N.ordinal(
            N.map_values(c("kepemilikan_tempat_tinggal"), {"MilikSendiri": "status0", "RumahDinas": "status1", "SewaKontrak": "status3"}),
            N.HOME_ORDER,
        ).alias("kepemilikan_tempat_tinggal"),
    )


_NATION_GROUPS = [["INDONESIA", "VIETNAM"], ["CHINA", "JAPAN", "INDIA"]]


@query("c21_merged_groups", """
SELECT c_custkey, CASE WHEN trim(n_name) IN ('INDONESIA', 'VIETNAM') THEN 'INDONESIA|VIETNAM'
  WHEN trim(n_name) IN ('CHINA', 'JAPAN', 'INDIA') THEN 'CHINA|JAPAN|INDIA'
  WHEN trim(n_name) > '' THEN 'LainLain' END AS nation_group,
  CASE WHEN trim(c_mktsegment) IN ('BUILDING') THEN trim(c_mktsegment) WHEN trim(c_mktsegment) > '' THEN 'LainLain' END
    AS segment
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
""")
def c21(spark, sf):
    customers = V.table(spark, sf, "customer").join(
        V.table(spark, sf, "nation"), c("c_nationkey") == c("n_nationkey"), "left"
    )
    return customers.select(
        "c_custkey", N.merge_groups(c("n_name"), _NATION_GROUPS).alias("nation_group"),
        N.keep_values(c("c_mktsegment"), ["BUILDING"]).alias("segment"),
    )


@query("c22_constants", Q.with_view("v2", f"""
SELECT id_aplikasi, plafond, '1999-01-01' AS tgl_mulai, 'XXX' AS status_bukti_kepemilikan_agunan,
  0.0::DOUBLE AS pemasaran, 0.0::DOUBLE AS ratio_likuidasi_agunan_to_plafond, 0 AS target
FROM v2"""))
def c22(spark, sf):
    v2 = P.prepare(V.loan_raw(spark, sf), "id_aplikasi").select("id_aplikasi", "plafond")
    return with_constants(v2)


@query("c23_hard_labels", Q.with_view("scored", """
SELECT row_id, CAST(pd >= 0.15 AS INTEGER) AS at_cutoff, CAST(pd > 0.12 AS INTEGER) AS above_threshold FROM scored
"""))
def c23(spark, sf):
    return V.scored(spark, sf).select(
        "row_id", M.at_least(c("pd"), S.REPORT_CUTOFF).alias("at_cutoff"), M.above(c("pd"), 0.12).alias("above_threshold")
    )


@query("c24_result_text", Q.with_view("graded", """
SELECT row_id, 'OK' AS status, CAST(rating AS VARCHAR) AS rating, round(CAST(pd AS DOUBLE), 6) AS pd_number,
  round(score, 6) AS score_number
FROM graded"""))
def c24(spark, sf):
    out = result_text(add_grades(V.scored(spark, sf), default_grades(spark)))
    texts = out.select("row_id", F.to_json(F.struct("status", "pd", "score", "rating")).alias("record"))
    return R.parse_json(texts, "record", RESULT_SCHEMA).select(
        "row_id", "status", "rating", F.round(c("pd").cast("double"), 6).alias("pd_number"),
        F.round(c("score").cast("double"), 6).alias("score_number"),
    )


# Imputation ----------------------------------------------------------------------------------


@query("d1_mean_fill", Q.with_view("clean", """
SELECT id_aplikasi, round(coalesce(pemasaran, (SELECT avg(pemasaran) FROM complete)), 6) AS pemasaran FROM complete"""))
def d1(spark, sf):
    rows = I.mean_fill(_cleaned(spark, sf).select("id_aplikasi", "pemasaran"), ["pemasaran"])
    return rows.withColumn("pemasaran", F.round("pemasaran", 6))


@query("d2_constant_fill", Q.with_view("clean", """
SELECT id_aplikasi, coalesce(simpanan, 0) AS simpanan, coalesce(nilai_likuidasi, 0) AS nilai_likuidasi,
  coalesce(status_bukti_kepemilikan_agunan, 'Lainlain') AS status_bukti_kepemilikan_agunan FROM complete"""))
def d2(spark, sf):
    rows = _cleaned(spark, sf).select("id_aplikasi", *P.CONSTANT_FILLED)
    return I.constant_fill(rows, P.CONSTANT_FILLED)


@query("d3_mode_fill", Q.with_view("clean", f"""
SELECT id_aplikasi, coalesce(tujuan_penggunaan, {Q.mode_of("tujuan_penggunaan")}) AS tujuan_penggunaan,
  coalesce(jenis_pekerjaan, {Q.mode_of("jenis_pekerjaan")}) AS jenis_pekerjaan,
  coalesce(jabatan, {Q.mode_of("jabatan")}) AS jabatan FROM complete"""))
def d3(spark, sf):
    columns = ["tujuan_penggunaan", "jenis_pekerjaan", "jabatan"]
    return I.mode_fill(_cleaned(spark, sf).select("id_aplikasi", *columns), columns)


_MEDIANS = ["debitur_lama", "lama_bekerja", "jumlah_anak_dlm_tanggungan", "pendapatan_netto_sampingan", "pendapatan_netto_utama"]


@query("d4_median_fill", Q.with_view("clean", f"""
SELECT id_aplikasi, {", ".join(f"coalesce(CAST({m} AS DOUBLE), {Q.median_of(m)}) AS {m}" for m in _MEDIANS)} FROM complete"""))
def d4(spark, sf):
    return I.median_fill(_cleaned(spark, sf).select("id_aplikasi", *_MEDIANS), _MEDIANS)
