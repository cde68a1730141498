"""Code-to-label and label-to-label column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------------------

MARITAL_STATUS = {1: "Menikah", 2: "BelumMenikah", 3: "JandaDuda"}
HOME_OWNERSHIP = {0: "MilikSendiri", 1: "RumahDinas", 3: "SewaKontrak"}
LOAN_PURPOSE = {0: "KMK", 1: "PMK", 2: "KI"}
GENDER = {"M": "M", "L": "M", "F": "F", "W": "F"}

# Ordered: the first label with a matching phrase wins.
COLLATERAL_PHRASES = {
    "Kwitansi": ["Kwitansi"],
    "BPKB": ["Bukti Kepemilikan Kendaraan Bermotor", "BPKB"],
    "SHM": ["Sertifikat Hak Milik", "SHM"],
    "SHGB": ["Sertifikat Hak Guna Bangunan", "SHGB"],
    "SuratTanahDiLuarSertifikat": ["Petok", "Letter", "Surat Tanah di luar "],
}
OTHER_COLLATERAL = "Lainlain"

NO_SCHOOL = "TidakSekolah"
NO_SCHOOL_TEXT = "TIDAK SEKOLAH"
SCHOOL = "SD/SMP/SMU/SMK"
SCHOOL_NAMES = ["SD", "SMP", "SMA", "SMU/SMK"]
DIPLOMA = "Akademi/Diploma"
DIPLOMA_NAMES = ["D3", "D2", "DIPLOMA", "AKADEMI"]
DIPLOMA_PARTS = ["D3", "DIII", "D2", "DII", "D1", "DI", "DIPLOMA"]
DEGREE = "S1/S2/S3"
DEGREE_NAMES = ["Sarjana", "Master", "Doktoral"]

# Whitespace removed at either end of a text: all that Unicode has, and the four separators of ASCII.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))

# --- expressions ----------------------------------------------------------------------------


def choose(pairs: list[tuple[Column, object]], default: Column | None = None) -> Column:
    """First matching condition decides; no match gives ``default`` (null if not given)."""
    out = None
    for condition, value in pairs:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out if default is None else out.otherwise(default)


def map_values(c: Column, table: dict) -> Column:
    """Look a value up in a small fixed table; unknown values become null."""
    return choose([(c == key, F.lit(label)) for key, label in table.items()])


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def strip_right(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANKS))


def first_phrase(c: Column, phrases: dict[str, list[str]]) -> Column:
    """Case-sensitive substring classifier; labels are tried in order."""
    return choose([
        (reduce(or_, [c.contains(p) for p in parts]), F.lit(label)) for label, parts in phrases.items()
    ])


def inverted_flag(c: Column) -> Column:
    """true -> 0, false -> 1, null -> null."""
    return F.when(c, 0).when(~c, 1)


def marital_status(c: Column) -> Column:
    return map_values(c, MARITAL_STATUS)


def home_ownership(c: Column) -> Column:
    return map_values(c, HOME_OWNERSHIP)


def loan_purpose(c: Column) -> Column:
    return map_values(c, LOAN_PURPOSE)


def gender(c: Column) -> Column:
    return map_values(c, GENDER)


def collateral(c: Column) -> Column:
    return first_phrase(c, COLLATERAL_PHRASES)


def education(c: Column) -> Column:
    """Education level; text that fits no rule keeps the spelled-out form of 'no school'."""
    return education_of_stripped(strip(c))


def education_of_stripped(exact: Column) -> Column:
    """``education`` of a text without blanks at its ends, which is used several times over."""
    upper = F.upper(exact)
    # A text that holds DIII also holds DI: the shortest parts decide.
    parts = [p for p in DIPLOMA_PARTS if not any(q in p for q in DIPLOMA_PARTS if q != p)]
    diploma = reduce(or_, [upper.contains(p) for p in parts], upper.isin(DIPLOMA_NAMES))
    return choose(
        [
            (exact.isNull() | (upper == NO_SCHOOL_TEXT), F.lit(NO_SCHOOL)),
            (upper.isin(SCHOOL_NAMES), F.lit(SCHOOL)),
            (diploma, F.lit(DIPLOMA)),
            (exact.isin(DEGREE_NAMES), F.lit(DEGREE)),
        ],
        default=F.lit(NO_SCHOOL_TEXT),
    )


def education_label(c: Column) -> Column:
    """One spelling for 'no school'."""
    return F.when(c == NO_SCHOOL_TEXT, NO_SCHOOL).otherwise(c)
