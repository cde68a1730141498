"""Label codes, one-hot vectors with names, scaling, feature choice."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditlens import schemas as S


def fit_label_encoder(df: DataFrame, columns: list[str]) -> PipelineModel:
    """Sorted classes per column; an unseen value is an error when the model is applied."""
    indexer = StringIndexer(
        inputCols=columns, outputCols=[f"{c}_code" for c in columns], stringOrderType="alphabetAsc", handleInvalid="error"
    )
    return Pipeline(stages=[indexer]).fit(df)


def label_encode(model: PipelineModel, df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace each column by its whole-number code."""
    coded = model.transform(df)
    return coded.withColumns({c: F.col(f"{c}_code").cast("int") for c in columns}).drop(*[f"{c}_code" for c in columns])


def fit_encoder(
    df: DataFrame,
    categorical: list[str] | None = None,
    numeric: list[str] | None = None,
    out: str = "features",
) -> PipelineModel:
    """Vector of the one-hot blocks, no level dropped, followed by the numbers."""
    categorical = S.CATEGORICAL_FEATURES if categorical is None else categorical
    numeric = S.NUMERIC_FEATURES if numeric is None else numeric
    codes = [f"{c}_code" for c in categorical]
    # Output columns take the feature's name, so the vector names come out as feature_value.
    stages = [
        StringIndexer(inputCols=categorical, outputCols=codes, stringOrderType="alphabetAsc", handleInvalid="error"),
        OneHotEncoder(inputCols=codes, outputCols=[f"{c}_onehot" for c in categorical], dropLast=False),
        VectorAssembler(inputCols=[f"{c}_onehot" for c in categorical] + numeric, outputCol=out),
    ]
    return Pipeline(stages=stages).fit(df)


def encode(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add the vector; the helper columns go."""
    return model.transform(df).select(*df.columns, model.stages[-1].getOutputCol())


def feature_names(model: PipelineModel) -> list[str]:
    """Names of the vector entries: ``column_value`` for the one-hot part, then the numeric names."""
    indexer, _, assembler = model.stages
    names = [f"{c}_{v}" for c, values in zip(indexer.getInputCols(), indexer.labelsArray) for v in values]
    return names + [c for c in assembler.getInputCols() if not c.endswith("_onehot")]


def wide(df: DataFrame, names: list[str], vector: str = "features") -> DataFrame:
    """The vector as one double column per entry."""
    entries = vector_to_array(vector)
    rest = [c for c in df.columns if c != vector]
    return df.select(*rest, entries.alias("_v")).select(*rest, *[F.col("_v")[i].alias(n) for i, n in enumerate(names)])


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population standard deviation; a constant column becomes 0."""
    stats = df.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd")).alias(c) for c in columns]).first()
    return df.withColumns({c: (F.col(c) - F.lit(stats[c]["mean"])) / F.lit(stats[c]["sd"] or 1.0) for c in columns})


def anova_f(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """One-way ANOVA F of each numeric column against the class; one grouped pass for all columns.

    Sums are taken around the overall mean, which keeps them well-conditioned.
    """
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    centred = df.select(F.col(label).alias("_class"), *[(F.col(c) - F.lit(means[c])).alias(c) for c in columns])
    groups = centred.unpivot("_class", columns, "feature", "x").groupBy("feature", "_class").agg(
        F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss")
    )
    # One row per feature and class from here on.
    return groups.groupBy("feature").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("ss").alias("ss"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"), F.sum("s").alias("s"),
    ).select(
        "feature",
        (
            ((F.col("between") - F.col("s") * F.col("s") / F.col("n")) / (F.col("k") - 1))
            / F.nullif((F.col("ss") - F.col("between")) / (F.col("n") - F.col("k")), F.lit(0.0))
        ).alias("f_score"),
    )


def best_features(df: DataFrame, columns: list[str], label: str, k: int = 42) -> DataFrame:
    """The ``k`` features with the largest F, ties by name; undefined scores come last."""
    scores = anova_f(df, columns, label)
    return scores.orderBy(F.desc_nulls_last("f_score"), "feature").limit(k)
