"""Common table expressions of the check SQL (DuckDB dialect)."""

from __future__ import annotations

from creditlens import schemas as S
from creditlens.functions import labels as L
from creditlens.functions.hashing import FIRST_FACTOR, MODULUS, SECOND_FACTOR
from creditlens.sources import views as V


def row_hash(row_id: str, seed: int = 0) -> str:
    h = f"((({row_id}) % {MODULUS}) * {FIRST_FACTOR} + {seed}) % {MODULUS}"
    return f"((({h}) * ({h}) + ({h}) * {SECOND_FACTOR} + {seed}) % {MODULUS})"


def unit_hash(row_id: str, seed: int = 0) -> str:
    return f"({row_hash(row_id, seed)} / {float(MODULUS)})"


def text_list(values: list) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def pick(values: list, index: str) -> str:
    return f"({text_list(values)})[({index}) % {len(values)} + 1]"


def case(column: str, table: dict) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else str(v)

    return "CASE " + " ".join(f"WHEN {column} = {lit(k)} THEN {lit(v)}" for k, v in table.items()) + " END"


def phrases(column: str, table: dict[str, list[str]]) -> str:
    whens = []
    for label, parts in table.items():
        test = " OR ".join(f"contains({column}, '{p}')" for p in parts)
        whens.append(f"WHEN {test} THEN '{label}'")
    return "CASE " + " ".join(whens) + " END"


def education(column: str) -> str:
    parts = " OR ".join(f"contains(upper(trim({column})), '{p}')" for p in L.DIPLOMA_PARTS)
    names = ", ".join(f"'{n}'" for n in L.DIPLOMA_NAMES)
    return f"""CASE WHEN {column} IS NULL OR upper(trim({column})) = '{L.NO_SCHOOL_TEXT}' THEN '{L.NO_SCHOOL}'
        WHEN upper(trim({column})) IN ({", ".join(f"'{n}'" for n in L.SCHOOL_NAMES)}) THEN '{L.SCHOOL}'
        WHEN upper(trim({column})) IN ({names}) OR {parts} THEN '{L.DIPLOMA}'
        WHEN trim({column}) IN ({", ".join(f"'{n}'" for n in L.DEGREE_NAMES)}) THEN '{L.DEGREE}'
        ELSE '{L.NO_SCHOOL_TEXT}' END"""


LINES = """
lines AS (
  SELECT l_orderkey, count(*) AS n_lines, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned
  FROM lineitem GROUP BY l_orderkey)"""

LOAN_RAW_SQL = f"""
loan_base AS (
  SELECT o_orderkey AS o, o_custkey AS k, CAST(o_orderdate AS DATE) AS d, o_orderpriority, c_acctbal,
         round(o_totalprice * 100.0) AS amount, CAST(6 + 6 * (o_orderkey % 7) AS INTEGER) AS months,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_returned, 0) AS returned
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN lines ON o_orderkey = l_orderkey),
loan_raw AS (
  SELECT 'ACC' || o AS no_rekening, k AS cif, o AS id_aplikasi, o + 1 AS id_kredit, k + 1 AS fid_cif_las,
    o_orderpriority AS tp_produk,
    CASE WHEN o % 11 <> 0 THEN o % 2 = 0 END AS debitur_baru,
    CAST(CASE WHEN k % 19 = 0 THEN 9 ELSE 1 + k % 3 END AS INTEGER) AS status_nikah,
    d AS tgl_mulai,
    CASE WHEN k % 97 <> 0 THEN strftime(d - CAST(5000 + (k * 37) % 18000 AS INTEGER), '%d-%m-%Y') END AS tanggal_lahir,
    CASE WHEN o % 23 <> 0 THEN strftime(d - CAST((o * 13) % 9000 - 300 AS INTEGER), '%d-%m-%Y') END
      AS tanggal_mulai_bekerja,
    CASE WHEN k % 12 <> 0 THEN {pick(V.COLLATERAL_TEXTS, "o")} END AS status_bukti_kepemilikan_agunan,
    CASE WHEN k % 29 = 0 THEN 'X' ELSE {pick(V.GENDER_CODES, "k")} END AS jenis_kelamin,
    CAST(CASE WHEN k % 31 = 0 THEN 2 ELSE {pick(V.HOME_CODES, "k")} END AS INTEGER) AS kepemilikan_tempat_tinggal,
    CAST(o % 4 AS INTEGER) AS tujuan_penggunaan,
    CASE WHEN o % 17 <> 0 THEN {pick(V.EDUCATION_TEXTS, "k")} END AS pendidikan,
    CASE WHEN o % 211 = 0 THEN 0.0::DOUBLE WHEN o % 103 <> 0 THEN amount / months END AS angsuran,
    CASE WHEN o % 101 <> 0 THEN amount END AS plafond,
    'KOTA' || (k % 7) AS domisili,
    CASE WHEN o % 37 <> 0 THEN CAST(n_lines + o % 3 AS INTEGER) END AS jumlah_anak_dlm_tanggungan,
    CASE WHEN k % 5 <> 0 THEN {pick(V.JOB_TEXTS, "k")} END AS jenis_pekerjaan,
    CASE WHEN o % 499 <> 0 THEN CAST(1 + least(4, greatest(0, returned - 2)) AS INTEGER) END AS kolektibilitas,
    CAST(o % 30 AS DOUBLE) AS lama_usaha,
    CASE WHEN o % 3 <> 0 THEN CASE WHEN k % 5 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS usaha_sampingan,
    CASE WHEN o % 4 = 1 THEN 0.0::DOUBLE WHEN o % 7 <> 0 THEN CAST((o % 900) * 1000 AS DOUBLE) END
      AS pendapatan_netto_sampingan,
    CASE WHEN k % 41 <> 0 THEN CAST(((k * 7919) % 5000 - 100) * 1000 AS DOUBLE) END AS pendapatan_netto_utama,
    CASE WHEN o % 6 <> 0 THEN CAST(o % 100 AS DOUBLE) END AS pemasaran,
    CASE WHEN o % 13 <> 0 THEN round(c_acctbal * 1000.0) END AS simpanan,
    CASE WHEN o % 8 <> 0 THEN CAST((o % 50) * 1000000 AS DOUBLE) END AS nilai_likuidasi,
    months AS jangka_waktu,
    CAST(month(d) AS INTEGER) AS bln_mulai,
    CAST(10 + o % 8 AS DOUBLE) AS suku_bunga,
    'B' || (k % 9) AS bidang_pekerjaan,
    CASE WHEN o % 19 <> 0 THEN 'J' || (k % 4) END AS jabatan,
    'R' || (k % 5) AS region,
    CAST(o % 2 AS INTEGER) AS baru_perpanjangan,
    'F' || (o % 3) AS jenis_fasilitas
  FROM loan_base)"""

SCORED_SQL = f"""
scored AS (
  SELECT o_orderkey AS row_id,
    round(1.0::DOUBLE / (1.0 + exp(-(CAST(coalesce(n_lines, 0) AS DOUBLE) * 0.35::DOUBLE
      + o_totalprice / 500000.0::DOUBLE - 4.6::DOUBLE))), 6) AS pd,
    CASE WHEN coalesce(n_returned, 0) - 2 >= 2 THEN 1 ELSE 0 END AS label,
    CASE WHEN {unit_hash("o_orderkey", V.SPLIT_SEED)} < {V.TEST_SHARE} THEN 'test' ELSE 'train' END AS split
  FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey
  WHERE o_orderkey % 499 <> 0)"""

_years = "CAST(round_even(date_diff('day', CAST(strptime({0}, '%d-%m-%Y') AS DATE), tgl_mulai) / 364.0::DOUBLE, 0) AS DOUBLE)"

CLEAN_SQL = f"""
clean AS (
  SELECT id_aplikasi, tgl_mulai,
    CASE WHEN debitur_baru THEN 0 WHEN NOT debitur_baru THEN 1 END AS debitur_lama,
    {case("status_nikah", L.MARITAL_STATUS)} AS status_nikah,
    {_years.format("tanggal_lahir")} AS usia,
    greatest({_years.format("tanggal_mulai_bekerja")}, CASE WHEN tanggal_mulai_bekerja IS NOT NULL THEN 0 END)
      AS lama_bekerja,
    {phrases("status_bukti_kepemilikan_agunan", L.COLLATERAL_PHRASES)} AS status_bukti_kepemilikan_agunan,
    {case("jenis_kelamin", L.GENDER)} AS jenis_kelamin,
    {case("kepemilikan_tempat_tinggal", L.HOME_OWNERSHIP)} AS kepemilikan_tempat_tinggal,
    {case("tujuan_penggunaan", L.LOAN_PURPOSE)} AS tujuan_penggunaan,
    {education("pendidikan")} AS pendidikan,
    angsuran, plafond,
    CASE WHEN jumlah_anak_dlm_tanggungan > 10 THEN 10 ELSE jumlah_anak_dlm_tanggungan END
      AS jumlah_anak_dlm_tanggungan,
    rtrim(jenis_pekerjaan) AS jenis_pekerjaan,
    usaha_sampingan, pendapatan_netto_sampingan, pendapatan_netto_utama, pemasaran, simpanan, nilai_likuidasi,
    jangka_waktu, bln_mulai, suku_bunga, bidang_pekerjaan, jabatan, region, baru_perpanjangan, jenis_fasilitas,
    CASE WHEN kolektibilitas > 2 THEN 1 WHEN kolektibilitas <= 2 THEN 0 END AS target
  FROM loan_raw),
complete AS (
  SELECT * FROM clean
  WHERE status_nikah IS NOT NULL AND pendidikan IS NOT NULL AND jenis_kelamin IS NOT NULL AND usia IS NOT NULL
    AND angsuran IS NOT NULL AND plafond IS NOT NULL AND kepemilikan_tempat_tinggal IS NOT NULL)"""


def mode_of(column: str, source: str = "complete") -> str:
    """Most frequent value, the smallest one on a tie."""
    return (
        f"(SELECT {column} FROM {source} WHERE {column} IS NOT NULL GROUP BY {column} "
        f"ORDER BY count(*) DESC, {column} LIMIT 1)"
    )


def median_of(column: str, source: str = "complete") -> str:
    return f"(SELECT quantile_cont(CAST({column} AS DOUBLE), 0.5) FROM {source})"


def _median(column: str, source: str = "complete") -> str:
    return f"coalesce(CAST({column} AS DOUBLE), {median_of(column, source)}) AS {column}"


V0_SQL = f"""
fixed AS (
  SELECT * REPLACE (CASE WHEN usaha_sampingan > 0 THEN usaha_sampingan
    WHEN pendapatan_netto_sampingan > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS usaha_sampingan) FROM complete),
v0 AS (
  SELECT id_aplikasi, tgl_mulai, {_median("debitur_lama")}, status_nikah, usia, {_median("lama_bekerja")},
    coalesce(status_bukti_kepemilikan_agunan, '{L.OTHER_COLLATERAL}') AS status_bukti_kepemilikan_agunan,
    jenis_kelamin, kepemilikan_tempat_tinggal,
    coalesce(tujuan_penggunaan, {mode_of("tujuan_penggunaan")}) AS tujuan_penggunaan,
    pendidikan, angsuran, plafond, {_median("jumlah_anak_dlm_tanggungan")},
    coalesce(jenis_pekerjaan, {mode_of("jenis_pekerjaan")}) AS jenis_pekerjaan,
    usaha_sampingan, {_median("pendapatan_netto_sampingan")}, {_median("pendapatan_netto_utama")},
    coalesce(pemasaran, (SELECT avg(pemasaran) FROM complete)) AS pemasaran,
    coalesce(simpanan, 0) AS simpanan, coalesce(nilai_likuidasi, 0) AS nilai_likuidasi,
    jangka_waktu, bln_mulai, suku_bunga, bidang_pekerjaan, coalesce(jabatan, {mode_of("jabatan")}) AS jabatan,
    region, baru_perpanjangan, jenis_fasilitas, target
  FROM fixed)"""


def ratio(n: str, d: str) -> str:
    return f"""CASE WHEN {d} <> 0 THEN ({n}) / {d} WHEN ({n}) > 0 THEN 'inf'::DOUBLE
      WHEN ({n}) < 0 THEN '-inf'::DOUBLE END"""


V1_SQL = f"""
v1 AS (
  SELECT id_aplikasi, tgl_mulai, debitur_lama, status_nikah, usia, lama_bekerja, status_bukti_kepemilikan_agunan,
    jenis_kelamin, kepemilikan_tempat_tinggal, tujuan_penggunaan, pendidikan, plafond, jumlah_anak_dlm_tanggungan,
    jenis_pekerjaan, pemasaran, simpanan, jangka_waktu, bln_mulai, suku_bunga, bidang_pekerjaan, jabatan, region,
    baru_perpanjangan, jenis_fasilitas,
    least({ratio("pendapatan_netto_utama + pendapatan_netto_sampingan", "angsuran")},
      CASE WHEN angsuran <> 0 OR pendapatan_netto_utama + pendapatan_netto_sampingan <> 0 THEN 10 END)
      AS ratio_pendatapan_to_angsuran,
    greatest(CASE WHEN pendapatan_netto_sampingan > 0 THEN 1 ELSE 0 END, usaha_sampingan) AS punya_usaha_sampingan,
    {ratio("nilai_likuidasi", "plafond")} AS ratio_likuidasi_agunan_to_plafond,
    target
  FROM v0)"""

V2_SQL = f"""
v2 AS (
  SELECT id_aplikasi, {", ".join(S.MODEL_TABLE_COLUMNS)}
  FROM (SELECT * REPLACE (CASE WHEN pendidikan = '{L.NO_SCHOOL_TEXT}' THEN '{L.NO_SCHOOL}' ELSE pendidikan END
    AS pendidikan) FROM v1)
  WHERE usia >= {S.MIN_AGE} AND ratio_pendatapan_to_angsuran >= 0)"""

MODEL_INPUT_SQL = f"""
model_input AS (
  SELECT id_aplikasi,
    {", ".join(f"CAST({f} AS DOUBLE) AS {f}" if f in S.NUMERIC_FEATURES else f for f in S.FEATURES)}, target
  FROM v2 WHERE plafond <= {S.MAX_PLAFOND})"""

GRADES_SQL = """
grades AS (
  SELECT * FROM (VALUES {}) AS t("Rating", "Proba_MIN", "Proba_MAX", "Score_MIN", "Score_MAX", "Total"))""".format(
    ", ".join(
        f"({r}, {lo}::DOUBLE, {hi}::DOUBLE, {s0}::DOUBLE, {s1}::DOUBLE, {n}::BIGINT)" for r, lo, hi, s0, s1, n in S.GRADES
    )
)

# Disjoint probability ranges of the grades; the upper end of the last but one belongs to the last.
BANDS_SQL = """
bands AS (
  SELECT "Rating" AS rating, "Score_MIN" AS s0, "Score_MAX" AS s1,
    CASE WHEN "Rating" = 1 THEN "Proba_MIN" ELSE lag("Proba_MAX") OVER (ORDER BY "Rating") END AS lo,
    CASE WHEN "Rating" = max("Rating") OVER () THEN 1.0 ELSE "Proba_MAX" END AS hi,
    max("Rating") OVER () AS n
  FROM grades),
graded AS (
  SELECT row_id, pd, label, split, rating, (pd - lo) * (s0 - s1) / (hi - lo) + s1 AS score
  FROM scored LEFT JOIN bands ON
    CASE WHEN rating = 1 THEN pd >= 0 AND pd <= hi
         WHEN rating = n THEN pd >= lo AND pd <= 1
         WHEN rating = n - 1 THEN pd > lo AND pd < hi
         ELSE pd > lo AND pd <= hi END)"""

_PARTS = {
    "loan_raw": [LINES, LOAN_RAW_SQL],
    "clean": [LINES, LOAN_RAW_SQL, CLEAN_SQL],
    "v0": [LINES, LOAN_RAW_SQL, CLEAN_SQL, V0_SQL],
    "v1": [LINES, LOAN_RAW_SQL, CLEAN_SQL, V0_SQL, V1_SQL],
    "v2": [LINES, LOAN_RAW_SQL, CLEAN_SQL, V0_SQL, V1_SQL, V2_SQL],
    "model_input": [LINES, LOAN_RAW_SQL, CLEAN_SQL, V0_SQL, V1_SQL, V2_SQL, MODEL_INPUT_SQL],
    "scored": [LINES, SCORED_SQL],
    "graded": [LINES, SCORED_SQL, GRADES_SQL, BANDS_SQL],
}


def with_view(view: str, body: str, *more: str) -> str:
    """``body`` behind the expressions that define ``view``, and further named expressions."""
    return "WITH " + ",".join([*_PARTS[view], *(f"\n{m}" for m in more)]) + "\n" + body
