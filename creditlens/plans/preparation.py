"""From the raw application table to the modelling table, in three stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditlens import schemas as S
from creditlens.functions import labels as L
from creditlens.functions import numbers as N
from creditlens.operators.impute import FillValues, fit_fill_values
from creditlens.operators.shaping import append_rows, drop_columns, drop_incomplete, in_range, keep_rows, reorder
from creditlens.session import compiled_methods, write_stage

# --- fixed values ---------------------------------------------------------------------------

MEAN_FILLED = ["pemasaran"]
CONSTANT_FILLED = {
    "simpanan": 0.0,
    "nilai_likuidasi": 0.0,
    "status_bukti_kepemilikan_agunan": L.OTHER_COLLATERAL,
}


def clean(raw: DataFrame, keep_id: str | None = None) -> DataFrame:
    """Normalised columns and derived ages, incomplete applications removed; a single narrow pass."""
    c = F.col
    df = drop_columns(raw, [i for i in S.ID_COLUMNS if i != keep_id])
    start = c("tgl_mulai").cast("date")
    df = df.withColumns({
        "debitur_baru": L.inverted_flag(c("debitur_baru")),
        "status_nikah": L.marital_status(c("status_nikah")),
        "tgl_mulai": start,
        "usia": N.whole_years(N.parse_day_first(c("tanggal_lahir")), start),
        "lama_bekerja": N.whole_years(N.parse_day_first(c("tanggal_mulai_bekerja")), start),
        "status_bukti_kepemilikan_agunan": L.collateral(c("status_bukti_kepemilikan_agunan")),
        "jenis_kelamin": L.gender(c("jenis_kelamin")),
        "kepemilikan_tempat_tinggal": L.home_ownership(c("kepemilikan_tempat_tinggal")),
        "tujuan_penggunaan": L.loan_purpose(c("tujuan_penggunaan")),
        "pendidikan": L.strip(c("pendidikan")),
        "jumlah_anak_dlm_tanggungan": N.not_above(c("jumlah_anak_dlm_tanggungan"), S.MAX_CHILDREN),
        "jenis_pekerjaan": L.strip_right(c("jenis_pekerjaan")),
        "target": N.default_flag(c(S.LABEL_SOURCE)),
    }).withColumnRenamed("debitur_baru", "debitur_lama")
    # A step of its own, so that the date is parsed and the text stripped once, not at each mention.
    df = df.withColumns({
        "lama_bekerja": N.not_below(c("lama_bekerja"), 0),
        "pendidikan": L.education_of_stripped(c("pendidikan")),
    })
    df = drop_columns(df, ["tanggal_lahir", "tanggal_mulai_bekerja", "domisili", S.LABEL_SOURCE])
    df = drop_incomplete(df, S.REQUIRED_COLUMNS)
    return reorder(df, first=[S.DATE_COLUMN], last=[S.TARGET])


def _with_side_business(cleaned: DataFrame) -> DataFrame:
    fixed = N.side_business(F.col("usaha_sampingan"), F.col("pendapatan_netto_sampingan"))
    return drop_columns(cleaned, ["lama_usaha"]).withColumn("usaha_sampingan", fixed)


def fit_imputation(cleaned: DataFrame, keep_id: str | None = None) -> FillValues:
    """Fill values from the cleaned rows, before any of the later row filters."""
    return fit_fill_values(
        _with_side_business(cleaned),
        mean_columns=MEAN_FILLED,
        constants=CONSTANT_FILLED,
        exclude=[S.DATE_COLUMN, S.TARGET, *([keep_id] if keep_id else [])],
    )


def stage_clean(raw: DataFrame, keep_id: str | None = None, fill: FillValues | None = None) -> DataFrame:
    """Stage v0: cleaned and imputed.

    ``fill`` re-uses the values of an earlier run in one narrow pass. Without it the cleaned rows
    are read several times over, so they are written once.
    """
    cleaned = clean(raw, keep_id)
    if fill is None:
        with compiled_methods(raw.sparkSession):
            cleaned = write_stage(cleaned, "clean")
            fill = fit_imputation(cleaned, keep_id)
    return fill.apply(_with_side_business(cleaned))


def stage_ratios(v0: DataFrame) -> DataFrame:
    """Stage v1: income and collateral ratios in place of the amounts."""
    c = F.col
    income = c("pendapatan_netto_utama") + c("pendapatan_netto_sampingan")
    df = v0.withColumns({
        "ratio_pendatapan_to_angsuran": N.capped_ratio(income, c("angsuran")),
        "punya_usaha_sampingan": F.greatest(
            N.is_positive(c("pendapatan_netto_sampingan")).cast("double"), c("usaha_sampingan")
        ),
        "ratio_likuidasi_agunan_to_plafond": N.ratio(c("nilai_likuidasi"), c("plafond")),
    })
    df = drop_columns(df, [
        "pendapatan_netto_utama", "angsuran", "pendapatan_netto_sampingan", "usaha_sampingan", "nilai_likuidasi",
    ])
    return reorder(df, last=[S.TARGET])


def stage_model_table(v1: DataFrame, extra: DataFrame | None = None, keep_id: str | None = None) -> DataFrame:
    """Stage v2: the modelling table. ``extra`` appends further applications in the layout of v1."""
    if extra is not None:
        v1 = append_rows(v1, extra)
    df = drop_columns(v1, S.UNUSED_COLUMNS)
    df = keep_rows(
        df,
        in_range(F.col("usia"), low=S.MIN_AGE),
        in_range(F.col("ratio_pendatapan_to_angsuran"), low=0),
    )
    df = df.withColumn("pendidikan", L.education_label(F.col("pendidikan")))
    return df.select(*([keep_id] if keep_id else []), *S.MODEL_TABLE_COLUMNS)


def model_input(v2: DataFrame, keep_id: str | None = None) -> DataFrame:
    """Applications of the trained segment with the features, the target and, if asked, the id."""
    df = keep_rows(v2, in_range(F.col("plafond"), high=S.MAX_PLAFOND))
    numbers = [F.col(f).cast("double").alias(f) if f in S.NUMERIC_FEATURES else f for f in S.FEATURES]
    return df.select(*([keep_id] if keep_id else []), *numbers, S.TARGET)


def fit_prepare(raw: DataFrame, keep_id: str | None = None) -> tuple[DataFrame, FillValues]:
    """The modelling table, and the fill values that later applications are prepared with."""
    with compiled_methods(raw.sparkSession):
        cleaned = write_stage(clean(raw, keep_id), "clean")
        fill = fit_imputation(cleaned, keep_id)
    filled = fill.apply(_with_side_business(cleaned))
    return stage_model_table(stage_ratios(filled), keep_id=keep_id), fill


def prepare(raw: DataFrame, keep_id: str | None = None, fill: FillValues | None = None) -> DataFrame:
    """Raw applications to the modelling table."""
    return stage_model_table(stage_ratios(stage_clean(raw, keep_id, fill)), keep_id=keep_id)
