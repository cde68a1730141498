"""Schemas and fixed values of the loan data model."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: column names -------------------------------------------------------------

ID_COLUMNS = ["no_rekening", "cif", "id_aplikasi", "id_kredit", "fid_cif_las", "tp_produk"]
DATE_COLUMN = "tgl_mulai"
TARGET = "target"
LABEL_SOURCE = "kolektibilitas"

# A missing value in any of these removes the application.
REQUIRED_COLUMNS = [
    "status_nikah", "pendidikan", "jenis_kelamin", "usia",
    "angsuran", "plafond", "kepemilikan_tempat_tinggal",
]

# Columns that the modelling table leaves out.
UNUSED_COLUMNS = [
    "bln_mulai", "suku_bunga", "bidang_pekerjaan", "jenis_pekerjaan", "jabatan", "region",
    "baru_perpanjangan", "jenis_fasilitas",
]

# Columns that the model itself does not use.
IGNORED_FEATURES = ["status_bukti_kepemilikan_agunan", "ratio_likuidasi_agunan_to_plafond", "pemasaran"]

# --- fixed values: business limits ----------------------------------------------------------

MIN_AGE = 16
MAX_PLAFOND = 25_000_000
MAX_CHILDREN = 10
MAX_INCOME_RATIO = 10
DAYS_PER_YEAR = 364

# --- fixed values: layout of the modelling table --------------------------------------------

MODEL_TABLE_SCHEMA = T.StructType([
    T.StructField("tgl_mulai", T.StringType()),
    T.StructField("jangka_waktu", T.IntegerType()),
    T.StructField("plafond", T.DoubleType()),
    T.StructField("jenis_kelamin", T.StringType()),
    T.StructField("pendidikan", T.StringType()),
    T.StructField("status_nikah", T.StringType()),
    T.StructField("jumlah_anak_dlm_tanggungan", T.IntegerType()),
    T.StructField("kepemilikan_tempat_tinggal", T.StringType()),
    T.StructField("debitur_lama", T.DoubleType()),
    T.StructField("tujuan_penggunaan", T.StringType()),
    T.StructField("status_bukti_kepemilikan_agunan", T.StringType()),
    T.StructField("lama_bekerja", T.IntegerType()),
    T.StructField("pemasaran", T.DoubleType()),
    T.StructField("simpanan", T.DoubleType()),
    T.StructField("usia", T.DoubleType()),
    T.StructField("ratio_pendatapan_to_angsuran", T.DoubleType()),
    T.StructField("punya_usaha_sampingan", T.DoubleType()),
    T.StructField("ratio_likuidasi_agunan_to_plafond", T.DoubleType()),
    T.StructField("target", T.IntegerType()),
])
MODEL_TABLE_COLUMNS = MODEL_TABLE_SCHEMA.fieldNames()

# Constants put into the columns that a scoring request does not carry.
REQUEST_CONSTANTS = {
    "tgl_mulai": "1999-01-01",
    "status_bukti_kepemilikan_agunan": "XXX",
    "pemasaran": 0.0,
    "ratio_likuidasi_agunan_to_plafond": 0.0,
    "target": 0,
}

FEATURES = [c for c in MODEL_TABLE_COLUMNS if c not in (DATE_COLUMN, TARGET, *IGNORED_FEATURES)]
CATEGORICAL_FEATURES = [f for f in FEATURES if MODEL_TABLE_SCHEMA[f].dataType == T.StringType()]
NUMERIC_FEATURES = [f for f in FEATURES if f not in CATEGORICAL_FEATURES]

REQUEST_SCHEMA = T.StructType([MODEL_TABLE_SCHEMA[f] for f in FEATURES])

# --- fixed values: rating table -------------------------------------------------------------

GRADE_SCHEMA = T.StructType([
    T.StructField("Rating", T.IntegerType()),
    T.StructField("Proba_MIN", T.DoubleType()),
    T.StructField("Proba_MAX", T.DoubleType()),
    T.StructField("Score_MIN", T.DoubleType()),
    T.StructField("Score_MAX", T.DoubleType()),
    T.StructField("Total", T.LongType()),
])
GRADES = [
    (1, 0.010989232920110226, 0.03996504843235016, 920.0, 1000.0, 9443),
    (2, 0.03999679535627365, 0.07041777670383453, 859.0, 920.0, 3845),
    (3, 0.07042985409498215, 0.09688137471675873, 806.0, 859.0, 4679),
    (4, 0.09689781814813614, 0.12239924818277359, 755.0, 806.0, 5260),
    (5, 0.12240796536207199, 0.14599540829658508, 708.0, 755.0, 6511),
    (6, 0.14601776003837585, 0.17510880529880524, 650.0, 708.0, 4273),
    (7, 0.17514187097549438, 0.2242763340473175, 551.0, 650.0, 1535),
    (8, 0.22502173483371735, 0.40973323583602905, 0.0, 550.0, 235),
]

# --- fixed values: report edges -------------------------------------------------------------

PD_EDGES = [0.01098923, 0.05086363, 0.09073803, 0.13061243, 0.17048683, 1.0]
WOE_EDGES = {
    "jangka_waktu": [0, 12, 18, 24],
    "usia": [16, 22, 27, 35, 45, 55, 65, 90],
    "plafond": [4_500_000, 10_000_000, 15_000_000, 20_000_000, 25_000_000],
    "simpanan": [-0.1, 100_000, 250_000, 500_000, 1_000_000, 5_000_000, 10_000_000, 50_000_000],
    "lama_bekerja": [-1, 0, 2, 6, 10, 20, 50],
    "ratio_pendatapan_to_angsuran": [0.95, 1.33, 2.00, 3.00, 10.00],
}
REPORT_CUTOFF = 0.15
