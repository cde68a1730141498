"""Optional recoding of features into bands, ordinals and merged groups."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from creditlens.functions.labels import choose, map_values, strip

# --- fixed values: bands (low, high, ends, label); None is open; ends as in interval notation --

AGE_BANDS = [
    (None, 20, "[)", "<20"), (20, 25, "[]", "20-25"), (26, 31, "[]", "26-31"), (32, 41, "[]", "32-41"),
    (42, 66, "[]", "42-66"), (67, 70, "[]", "67-70"), (70, None, "()", ">70"),
]
CHILDREN_BANDS = [
    (0, 0, "[]", "0"), (1, 2, "[]", "1-2"), (3, 5, "[]", "3-5"), (6, 8, "[]", "6-8"), (8, None, "()", ">8"),
]
TENURE_BANDS = [(None, 2, "[)", "<2"), (2, 7, "[)", "2-6"), (7, 11, "[)", "7-10"), (11, None, "[)", ">=11")]
TENURE_FINE_BANDS = [
    (0, 1, "[]", "0-1"), (2, 4, "[]", "2-4"), (5, 6, "[]", "5-6"), (7, 9, "[]", "7-9"), (10, 17, "[]", "10-17"),
    (18, 23, "[]", "18-23"), (24, 32, "[]", "24-32"), (33, 38, "[]", "33-38"), (39, 44, "[]", "39-44"),
    (45, 50, "[]", "45-50"), (8, None, "()", ">50"),
]
TERM_BANDS = [
    (None, 6, "[)", "<6"), (6, 9, "[]", "6-9"), (11, 12, "[]", "12"), (12, 18, "(]", "18"), (18, 24, "(]", "24"),
    (24, 36, "(]", "36"), (36, 48, "(]", "48"), (48, 60, "(]", "60"),
]

# --- fixed values: label to ordinal ---------------------------------------------------------

AGE_ORDER = {"<20": 1, "20-25": 2, "26-31": 3, "32-41": 4, "42-66": 5, "67-70": 6, ">70": 7}
CHILDREN_ORDER = {"0": 1, "1-2": 2, "3-5": 3, "6-8": 4, ">8": 5}
TENURE_ORDER = {
    "0-1": 1, "2-4": 2, "5-6": 3, "7-9": 4, "10-17": 5, "18-23": 6, "24-32": 7, "33-38": 8,
    "39-44": 9, "45-50": 10, ">50": 11,
}
TERM_ORDER = {"<6": 0, "6-9": 1, "12": 2, "18": 3, "24": 4, "36": 5, "48": 6, "60": 7}
EDUCATION_ORDER = {"S3": 1, "S2": 2, "S1": 3, "SD-SMA": 4}
COLLATERAL_ORDER = {"SHM": 1, "SHGB": 2, "BPKB": 3, "SuratTanahDiLuarSertifikat": 4, "Lainlain": 5}
MARITAL_ORDER = {"JandaDuda": 1, "BelumMenikah": 2, "Menikah": 3}
HOME_ORDER = {"status0": 1, "status1": 2, "status2": 3, "status3": 4}
PURPOSE_ORDER = {"KI": 1, "PMK": 2, "KMK": 3}
GENDER_ORDER = {"M": 0, "F": 1}

# --- fixed values: merged groups ------------------------------------------------------------

PROVINCE_GROUPS = [
    ["GORONTALO", "SULAWESI TENGAH", "SULAWESI UTARA"],
    ["LAMPUNG", "KEP BANGKA BLT"],
    ["NANGGROE ACEH DARUSSALAM", "PAPUA", "NUSA TENGGARA BARAT"],
    ["JAWA BARAT", "SUMATERA SELATAN", "BANTEN", "MALUKU"],
    ["RIAU", "JAMBI", "JAWA TENGAH", "BENGKULU"],
    ["BALI"],
]
KEPT_BUSINESSES = [
    "Riset & Pengembangan", "Penganggur/Belum Bekerja/Pencari Kerja",
    "Komputer-Analis/Progrmr/Internt/MIS/Engi",
]
REST = "LainLain"
EDUCATION_NAMES = {"S3": ["S3"], "S2": ["S2"], "S1": ["S1"], "SD-SMA": ["SD", "SMP", "SMA"]}
COLLATERAL_AS_OTHER = ["Kwitansi"]

# --- expressions ----------------------------------------------------------------------------


def band(c: Column, bands: list[tuple]) -> Column:
    """Label of the first band that holds the value, null if none does."""
    conditions = []
    for low, high, ends, label in bands:
        tests = []
        if low is not None:
            tests.append(c >= low if ends[0] == "[" else c > low)
        if high is not None:
            tests.append(c <= high if ends[1] == "]" else c < high)
        conditions.append((reduce(and_, tests), F.lit(label)))
    return choose(conditions)


def ordinal(c: Column, order: dict[str, int]) -> Column:
    return map_values(c, order)


def merge_groups(c: Column, groups: list[list[str]], rest: str = REST) -> Column:
    """Values listed together share one label, their names joined by a bar; other text is ``rest``."""
    text = strip(c)
    listed = [(text.isin(names), F.lit("|".join(names))) for names in groups]
    return choose([*listed, (text > "", F.lit(rest))])


def keep_values(c: Column, values: list[str], rest: str = REST) -> Column:
    """Listed values stay, other text is ``rest``."""
    text = strip(c)
    return choose([(text.isin(values), text), (text > "", F.lit(rest))])


def relabel(c: Column, names: dict[str, list[str]]) -> Column:
    """Label whose list holds the value, null if none does."""
    text = strip(c)
    return choose([(text.isin(values), F.lit(label)) for label, values in names.items()])


def collateral_as_other(c: Column) -> Column:
    return F.when(c.isin(COLLATERAL_AS_OTHER), F.lit("Lainlain")).otherwise(c)
