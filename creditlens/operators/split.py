"""Train/test split and folds by a hash of the row id: the same rows go the same way on every run,
however the data is partitioned, and no shuffle is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditlens.functions.hashing import row_hash, unit_hash

# --- fixed values ---------------------------------------------------------------------------

TEST_SHARE = 0.3
SPLIT_SEED = 100
FOLDS = 5
FOLD_SEED = 3228


def add_split(df: DataFrame, row_id: str, test_share: float = TEST_SHARE, seed: int = SPLIT_SEED, out: str = "split") -> DataFrame:
    """Column ``out`` holding 'test' for about ``test_share`` of the rows and 'train' for the others."""
    test = unit_hash(F.col(row_id), seed) < test_share
    return df.withColumn(out, F.when(test, F.lit("test")).otherwise(F.lit("train")))


def add_fold(df: DataFrame, row_id: str, k: int = FOLDS, seed: int = FOLD_SEED, out: str = "fold") -> DataFrame:
    """Column ``out`` holding a fold number 0..k-1."""
    return df.withColumn(out, (row_hash(F.col(row_id), seed) % k).cast("int"))
