"""From the modelling table to a trained scorer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlens import schemas as S
from creditlens.functions.hashing import row_hash
from creditlens.operators import balance, encode, ensemble, split
from creditlens.operators.grading import learn_grades
from creditlens.operators.impute import FillValues
from creditlens.plans import preparation
from creditlens.session import write_stage


_ABOUT = "models int, method string, graded boolean, filled boolean"


@dataclass
class Scorer:
    """Fitted encoder, the models of the folds, and, if there are any, the grade table learned from their probabilities and the fill
    values that raw applications need."""

    encoder: PipelineModel
    models: list
    method: str = "max"
    grades: DataFrame | None = None
    fill: FillValues | None = None

    @property
    def feature_names(self) -> list[str]:
        return encode.feature_names(self.encoder)

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.encoder.write().overwrite().save(f"{path}/encoder")
        for i, model in enumerate(self.models):
            model.write().overwrite().save(f"{path}/model-{i}")
        if self.grades is not None:
            self.grades.coalesce(1).write.mode("overwrite").parquet(f"{path}/grades")
        if self.fill is not None:
            self.fill.to_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/fill")
        about = spark.createDataFrame(
            [(len(self.models), self.method, self.grades is not None, self.fill is not None)], _ABOUT)
        about.write.mode("overwrite").json(f"{path}/about")

    @staticmethod
    def load(path: str) -> Scorer:
        spark = SparkSession.active()
        about = spark.read.schema(_ABOUT).json(f"{path}/about").first()
        models = [GBTClassificationModel.load(f"{path}/model-{i}") for i in range(about["models"])]
        grades = spark.read.parquet(f"{path}/grades") if about["graded"] else None
        fill = FillValues.from_table(spark.read.parquet(f"{path}/fill")) if about["filled"] else None
        return Scorer(PipelineModel.load(f"{path}/encoder"), models, about["method"], grades, fill)


def training_rows(
    encoded: DataFrame, names: list[str], row_id: str, folds: int = split.FOLDS, oversample_before_folds: bool = False
) -> DataFrame:
    """Rows to learn from: real ones with their fold, and synthetic minority rows.

    By default the folds come first. A synthetic row is in no held-out fold, and a model does not
    learn from it if one of its parents is in the fold held out from that model. With
    ``oversample_before_folds`` synthetic rows are spread over the folds like real ones.
    """
    columns = [f"x{i}" for i in range(len(names))]
    rows = write_stage(encode.wide(split.add_fold(encoded, row_id, folds), columns), "train")
    real = rows.select(*columns, S.TARGET, "fold", F.array("fold").alias("blocked"))
    new = balance.synthetic_minority(rows, row_id, columns, S.TARGET)
    draw = row_hash(F.col("parent"), 48) + F.col("copy")
    if oversample_before_folds:
        new = split.add_fold(new.withColumn("_draw", draw), "_draw", folds)
        new = new.select(*columns, S.TARGET, "fold", F.array("fold").alias("blocked"))
    else:
        new = split.add_fold(split.add_fold(new, "parent", folds, out="_a"), "neighbour", folds, out="_b")
        new = new.select(*columns, S.TARGET, F.lit(None).cast("int").alias("fold"), F.array("_a", "_b").alias("blocked"))
    together = real.unionByName(new)
    assembled = VectorAssembler(inputCols=columns, outputCol="features").transform(together)
    return write_stage(assembled.select("features", S.TARGET, "fold", "blocked"), "learn")


def train(
    rows: DataFrame,
    row_id: str,
    folds: int = split.FOLDS,
    rounds: int = ensemble.ROUNDS,
    method: str = "max",
    encoder_on_all_rows: bool = False,
    oversample_before_folds: bool = False,
    class_weights: bool = False,
    seed: int = 1,
) -> Scorer:
    """Train on the 'train' part of ``rows``, the model input with an id; rows without a target are left out."""
    known = split.add_split(rows.where(F.col(S.TARGET).isNotNull()), row_id)
    learn = known.where("split = 'train'")
    encoder = encode.fit_encoder(known if encoder_on_all_rows else learn)
    names = encode.feature_names(encoder)
    encoded = encode.encode(encoder, learn).select(row_id, S.TARGET, "features")
    data = training_rows(encoded, names, row_id, folds, oversample_before_folds)
    if class_weights:
        data = balance.class_weights(data, S.TARGET)
    models = ensemble.fit_folds(data, folds, rounds=rounds, weight="weight" if class_weights else None, seed=seed)
    return Scorer(encoder, models, method)


def train_graded(rows: DataFrame, row_id: str, **options) -> Scorer:
    """``train``, and the grades of the probabilities of the rows it learned from."""
    scorer = train(rows, row_id, **options)
    learn = split.add_split(rows.where(F.col(S.TARGET).isNotNull()), row_id).where("split = 'train'")
    scored = ensemble.ensemble_probability(encode.encode(scorer.encoder, learn), scorer.models, scorer.method)
    scorer.grades = learn_grades(write_stage(scored.select(row_id, "pd", S.TARGET), "graded"), "pd", S.TARGET)
    return scorer


def train_on_raw(raw: DataFrame, row_id: str, **options) -> Scorer:
    """From raw applications to a scorer with grades and fill values, which ``scoring.score_raw`` can use in another session."""
    table, fill = preparation.fit_prepare(raw, row_id)
    rows = write_stage(preparation.model_input(table, row_id), "model-input")
    scorer = train_graded(rows, row_id, **options)
    scorer.fill = fill
    return scorer
