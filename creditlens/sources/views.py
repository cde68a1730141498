"""Loan data as views over the supplied order, customer and line tables.

The tables hold no loans, so every loan column is a fixed rule over order columns. The rules leave
gaps and undefined codes on purpose. ``LOAN_RAW_SQL`` in the catalog states the same rules in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlens.functions.hashing import unit_hash
from creditlens.functions.numbers import default_flag
from creditlens.operators.joins import join_summary

# --- fixed values: texts that the rules choose from ------------------------------------------

COLLATERAL_TEXTS = [
    "Kwitansi Pembelian", "Bukti Kepemilikan Kendaraan Bermotor", "BPKB Motor", "Sertifikat Hak Milik", "SHM 17",
    "Sertifikat Hak Guna Bangunan", "SHGB", "Petok D", "Letter C", "Surat Tanah di luar Sertifikat", "lain",
]
EDUCATION_TEXTS = [
    "SD", "SMP ", "SMA", "SMU/SMK", "D3", " diploma", "Akademi", "Sarjana", "Master", "Doktoral", "Tidak Sekolah",
    "sarjana", "D1",
]
JOB_TEXTS = ["Petani ", "Pedagang  ", "Nelayan", "Guru"]
GENDER_CODES = ["M", "L", "F", "W"]
HOME_CODES = [0, 1, 3]

# The columns of the raw application table.
LOAN_COLUMNS = (
    "no_rekening cif id_aplikasi id_kredit fid_cif_las tp_produk debitur_baru status_nikah tgl_mulai tanggal_lahir "
    "tanggal_mulai_bekerja status_bukti_kepemilikan_agunan jenis_kelamin kepemilikan_tempat_tinggal tujuan_penggunaan "
    "pendidikan angsuran plafond domisili jumlah_anak_dlm_tanggungan jenis_pekerjaan kolektibilitas lama_usaha "
    "usaha_sampingan pendapatan_netto_sampingan pendapatan_netto_utama pemasaran simpanan nilai_likuidasi jangka_waktu "
    "bln_mulai suku_bunga bidang_pekerjaan jabatan region baru_perpanjangan jenis_fasilitas"
).split()

SPLIT_SEED = 100
TEST_SHARE = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int") + 1)


def _unless(k: Column, every: int, value: Column) -> Column:
    """Null on every ``every``-th row."""
    return F.when(k % every != 0, value)


def returned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and returned lines per order.

    The result grows with the orders it is joined to, so the join is a merge join at any size.
    """
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned")
    ).hint("merge")


def loan_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw application table.

    All joins are outer joins to unique keys, so Catalyst drops the ones a query does not need. A customer with a large share of the
    orders is dealt to several tasks.
    """
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")
    lines = returned_lines(spark, sf_dir)
    df = join_summary(orders, customers, "o_custkey", "c_custkey", F.col("o_orderkey"), c_acctbal=F.max("c_acctbal"))
    df = df.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    o, k = F.col("o_orderkey"), F.col("o_custkey")
    day = F.col("o_orderdate").cast("date")
    born = F.date_sub(day, (5000 + (k * 37) % 18000).cast("int"))
    hired = F.date_sub(day, ((o * 13) % 9000 - 300).cast("int"))
    amount = F.round(F.col("o_totalprice") * 100.0, 0)
    months = (6 + 6 * (o % 7)).cast("int")
    n_lines, returned = F.coalesce("n_lines", F.lit(0)), F.coalesce("n_returned", F.lit(0))
    return df.select(
        F.concat(F.lit("ACC"), o).alias("no_rekening"),
        k.alias("cif"),
        o.alias("id_aplikasi"),
        (o + 1).alias("id_kredit"),
        (k + 1).alias("fid_cif_las"),
        F.col("o_orderpriority").alias("tp_produk"),
        _unless(o, 11, o % 2 == 0).alias("debitur_baru"),
        F.when(k % 19 == 0, F.lit(9)).otherwise((1 + k % 3).cast("int")).alias("status_nikah"),
        day.alias("tgl_mulai"),
        _unless(k, 97, F.date_format(born, "dd-MM-yyyy")).alias("tanggal_lahir"),
        _unless(o, 23, F.date_format(hired, "dd-MM-yyyy")).alias("tanggal_mulai_bekerja"),
        _unless(k, 12, _pick(COLLATERAL_TEXTS, o)).alias("status_bukti_kepemilikan_agunan"),
        F.when(k % 29 == 0, F.lit("X")).otherwise(_pick(GENDER_CODES, k)).alias("jenis_kelamin"),
        F.when(k % 31 == 0, F.lit(2)).otherwise(_pick(HOME_CODES, k)).alias("kepemilikan_tempat_tinggal"),
        (o % 4).cast("int").alias("tujuan_penggunaan"),
        _unless(o, 17, _pick(EDUCATION_TEXTS, k)).alias("pendidikan"),
        F.when(o % 211 == 0, F.lit(0.0)).when(o % 103 != 0, amount / months).alias("angsuran"),
        _unless(o, 101, amount).alias("plafond"),
        F.concat(F.lit("KOTA"), k % 7).alias("domisili"),
        _unless(o, 37, (n_lines + o % 3).cast("int")).alias("jumlah_anak_dlm_tanggungan"),
        _unless(k, 5, _pick(JOB_TEXTS, k)).alias("jenis_pekerjaan"),
        _unless(o, 499, (1 + F.least(F.lit(4), F.greatest(F.lit(0), returned - 2))).cast("int")).alias("kolektibilitas"),
        (o % 30).cast("double").alias("lama_usaha"),
        _unless(o, 3, F.when(k % 5 == 0, 1.0).otherwise(0.0)).alias("usaha_sampingan"),
        F.when(o % 4 == 1, F.lit(0.0)).when(o % 7 != 0, ((o % 900) * 1000).cast("double"))
        .alias("pendapatan_netto_sampingan"),
        _unless(k, 41, (((k * 7919) % 5000 - 100) * 1000).cast("double")).alias("pendapatan_netto_utama"),
        _unless(o, 6, (o % 100).cast("double")).alias("pemasaran"),
        _unless(o, 13, F.round(F.col("c_acctbal") * 1000.0, 0)).alias("simpanan"),
        _unless(o, 8, ((o % 50) * 1000000).cast("double")).alias("nilai_likuidasi"),
        months.alias("jangka_waktu"),
        F.month(day).alias("bln_mulai"),
        (10 + o % 8).cast("double").alias("suku_bunga"),
        F.concat(F.lit("B"), k % 9).alias("bidang_pekerjaan"),
        _unless(o, 19, F.concat(F.lit("J"), k % 4)).alias("jabatan"),
        F.concat(F.lit("R"), k % 5).alias("region"),
        (o % 2).cast("int").alias("baru_perpanjangan"),
        F.concat(F.lit("F"), o % 3).alias("jenis_fasilitas"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications with a closed-form default probability, the label and the train/test split."""
    orders = table(spark, sf_dir, "orders").join(
        returned_lines(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"), "left"
    )
    lines = F.coalesce("n_lines", F.lit(0)).cast("double")
    logit = lines * 0.35 + F.col("o_totalprice") / 500000.0 - 4.6
    returned = F.coalesce("n_returned", F.lit(0))
    collectibility = F.when(F.col("o_orderkey") % 499 != 0, 1 + F.least(F.lit(4), F.greatest(F.lit(0), returned - 2)))
    return orders.select(
        F.col("o_orderkey").alias("row_id"),
        F.round(1.0 / (1.0 + F.exp(-logit)), 6).alias("pd"),
        default_flag(collectibility).alias("label"),
        F.when(unit_hash(F.col("o_orderkey"), SPLIT_SEED) < TEST_SHARE, "test").otherwise("train").alias("split"),
    ).where("label is not null")
