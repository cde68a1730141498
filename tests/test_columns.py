"""Column expressions on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from creditlens.functions import bands as B
from creditlens.functions import labels as L
from creditlens.functions import numbers as N


def column(spark, values, expression, schema="x string"):
    rows = [(i, v) if not isinstance(v, tuple) else (i, *v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, " + schema)
    return [r["v"] for r in df.withColumn("v", expression).orderBy("i").collect()]


x, y = F.col("x"), F.col("y")


def test_codes(spark):
    codes = [0, 1, 2, 3, 9, None]
    assert column(spark, codes, L.marital_status(x), "x int") == [None, "Menikah", "BelumMenikah", "JandaDuda", None, None]
    assert column(spark, codes, L.home_ownership(x), "x int") == ["MilikSendiri", "RumahDinas", None, "SewaKontrak", None, None]
    assert column(spark, codes, L.loan_purpose(x), "x int") == ["KMK", "PMK", "KI", None, None, None]
    assert column(spark, ["M", "L", "F", "W", "m", None], L.gender(x)) == ["M", "M", "F", "F", None, None]
    assert column(spark, [True, False, None], L.inverted_flag(x), "x boolean") == [0, 1, None]


def test_collateral_takes_the_first_label_and_minds_case(spark):
    texts = ["BPKB dan Kwitansi", "SHM / BPKB", "SHM", "SHGB", "Petok D", "Surat Tanah di luar Sertifikat", "bpkb", "", None]
    assert column(spark, texts, L.collateral(x)) == [
        "Kwitansi", "BPKB", "SHM", "SHGB", "SuratTanahDiLuarSertifikat", "SuratTanahDiLuarSertifikat", None, None, None,
    ]


def test_education(spark):
    texts = [None, " tidak sekolah ", "smp", "SMU/SMK\t", "D3 Teknik", "pendidikan", "Sarjana ", "sarjana", "D4", "", "diploma"]
    assert column(spark, texts, L.education(x)) == [
        "TidakSekolah", "TidakSekolah", "SD/SMP/SMU/SMK", "SD/SMP/SMU/SMK", "Akademi/Diploma", "Akademi/Diploma",
        "S1/S2/S3", "TIDAK SEKOLAH", "TIDAK SEKOLAH", "TIDAK SEKOLAH", "Akademi/Diploma",
    ]
    assert column(spark, ["TIDAK SEKOLAH", "S1/S2/S3", None], L.education_label(x)) == ["TidakSekolah", "S1/S2/S3", None]


def test_years_round_half_to_even(spark):
    days = [182, 546, 910, 183, -182, -546, None]
    start = F.lit("2000-01-01").cast("date")
    got = column(spark, days, N.whole_years(start, F.date_add(start, x)), "x int")
    assert got == [round(d / 364) if d is not None else None for d in days]


def test_times_floor_to_days(spark):
    start = F.lit("2000-01-01 12:00:00").cast("timestamp")
    seconds = [182 * 86400 - 1, 182 * 86400, 183 * 86400, -1]
    got = column(spark, seconds, N.whole_years_between_times(start, F.timestamp_seconds(F.unix_timestamp(start) + x)), "x long")
    assert got == [round((s // 86400) / 364) for s in seconds]


def test_limits_keep_null(spark):
    assert column(spark, [-2.0, 0.0, 3.0, None], N.not_below(x, 0), "x double") == [0, 0, 3, None]
    assert column(spark, [9, 10, 14, None], N.not_above(x, 10), "x int") == [9, 10, 10, None]
    assert column(spark, [1, 2, 3, 5, None], N.default_flag(x), "x int") == [0, 0, 1, 1, None]
    assert column(spark, [float("nan"), 1.0, None], N.missing_to_null(x), "x double") == [None, 1.0, None]


def test_side_business(spark):
    rows = [(2.0, None), (0.0, 5.0), (None, 5.0), (None, 0.0), (None, None), (-1.0, 1.0)]
    assert column(spark, rows, N.side_business(x, y), "x double, y double") == [2.0, 1.0, 1.0, 0.0, 0.0, 1.0]


def test_ratio_of_zero_divisor(spark):
    rows = [(6.0, 2.0), (60.0, 2.0), (1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 1.0), (1.0, None), (-9.0, 2.0)]
    assert column(spark, rows, N.capped_ratio(x, y), "x double, y double") == [3.0, 10.0, 10.0, -math.inf, None, None, None, -4.5]
    assert column(spark, rows, N.ratio(x, y), "x double, y double") == [3.0, 30.0, math.inf, -math.inf, None, None, None, -4.5]


def test_hard_labels(spark):
    assert column(spark, [0.14, 0.15, 0.16], N.at_least(x, 0.15), "x double") == [0, 1, 1]
    assert column(spark, [0.14, 0.15, 0.16], N.above(x, 0.15), "x double") == [0, 0, 1]


@pytest.mark.parametrize("bands,values,expected", [
    (B.AGE_BANDS, [19.9, 20, 25.5, 31, 66, 70, 70.5, None], ["<20", "20-25", None, "26-31", "42-66", "67-70", ">70", None]),
    (B.CHILDREN_BANDS, [0, 2, 5, 8, 9, -1], ["0", "1-2", "3-5", "6-8", ">8", None]),
    (B.TENURE_BANDS, [-1, 2, 6.5, 7, 11], ["<2", "2-6", "2-6", "7-10", ">=11"]),
    (B.TENURE_FINE_BANDS, [0, 8, 9, 9.5, 50, 51], ["0-1", "7-9", "7-9", ">50", "45-50", ">50"]),
    (B.TERM_BANDS, [5, 10, 12, 12.5, 18, 60, 61], ["<6", None, "12", "18", "18", "60", None]),
])
def test_bands(spark, bands, values, expected):
    values = [None if v is None else float(v) for v in values]
    assert column(spark, values, B.band(x, bands), "x double") == expected


def test_groups(spark):
    got = column(spark, [" BALI ", "PAPUA", "ACEH", "", None], B.merge_groups(x, B.PROVINCE_GROUPS))
    assert got == ["BALI", "NANGGROE ACEH DARUSSALAM|PAPUA|NUSA TENGGARA BARAT", "LainLain", None, None]
    assert column(spark, ["SMA", "S2 ", "x"], B.relabel(x, B.EDUCATION_NAMES)) == ["SD-SMA", "S2", None]
    assert column(spark, ["SMA", "S2"], B.ordinal(B.relabel(x, B.EDUCATION_NAMES), B.EDUCATION_ORDER)) == [4, 2]
    assert column(spark, ["Kwitansi", "SHM"], B.collateral_as_other(x)) == ["Lainlain", "SHM"]
