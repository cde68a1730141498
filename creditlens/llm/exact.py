"""Exact deduplication by a stream with disk-backed keyed state.

Fingerprints of the rows arrive as a file stream. Its state has one entry per distinct text and no expiry: the SHA-256 digest, the
number of rows, the largest id and the locator (file and row) of the row with that id. The state lives in RocksDB on
the executors' disks and in the checkpoint in the shared folder, so a lost executor resumes from there; when the stream
has read all files, the state is read as a table. Rows are partially aggregated before the shuffle, so a text with a third
of all rows sends one entry per task. Rows that hit the same
digest are compared by the bytes of their whole texts; a difference fails the job. All of this is DataFrame work.

Edge cases: a null text counts as empty; a null id is lower than any other; of equal texts with equal ids the row with
the largest locator stays; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlens.llm.text import lower_ascii, unused, with_row_key
from creditlens.session import new_path, write_stage

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _normal(text: str) -> Column:
    return lower_ascii(F.coalesce(F.col(text), F.lit("")))


def _placed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with the locator (file, row) of each row in one more column, and that column's name."""
    file, row, name = (unused(x, docs.columns) for x in ("row_file", "row_no", "row_locator"))
    keyed = with_row_key(docs, file, row)
    return keyed.select(*docs.columns, F.struct(F.col(file).alias("file"), F.col(row).alias("row")).alias(name)), name


def keyed_state(spark: SparkSession, path: str, bytes_per_batch: str | None = None) -> DataFrame:
    """Run the stream over the fingerprints (id, locator, text_sha256) at ``path``; returns its state: text_sha256, group_size, keeper.

    ``bytes_per_batch`` (a number as text) makes the stream commit in several steps; without it one step reads what is there.
    """
    checkpoint = new_path(spark, "exact-state")
    settings = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
        "spark.sql.streaming.minBatchesToRetain": "2",
        # A store leaves the executor's disk when its task has committed it to the checkpoint.
        "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        reader = spark.readStream.schema(spark.read.parquet(path).schema)
        if bytes_per_batch:
            reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
        seen = (
            reader.parquet(path).groupBy("text_sha256")
            .agg(F.count("*").alias("group_size"), F.max(F.struct("id", "locator")).alias("keeper"))
        )
        stream = (
            seen.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
        stream.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.format("statestore").load(checkpoint).select(
        "key.text_sha256", F.col("value.count").alias("group_size"), F.col("value.max").alias("keeper"),
    )


def verdicts(docs: DataFrame, text: str = "text", row_id: str = "doc_id", **options) -> DataFrame:
    """(id, locator, keep_id, group_size, kept, text_sha256) for every row of ``docs``."""
    return _verdicts(*_placed(docs), text, row_id, **options)


def _verdicts(docs: DataFrame, locator: str, text: str, row_id: str, **options) -> DataFrame:
    spark = docs.sparkSession
    _check_bytes(docs, text)
    path = new_path(spark, "exact-rows")
    digest = F.sha2(_normal(text).cast("binary"), 256)
    docs.select(F.col(row_id).alias("id"), F.col(locator).alias("locator"), digest.alias("text_sha256")).write.parquet(path)
    # Written, so that rows of a frequent digest meet a plain table and adaptive execution can split them.
    state = write_stage(keyed_state(spark, path, **options), "exact-keys")
    return spark.read.parquet(path).join(state, "text_sha256").select(
        "id", "locator", F.col("keeper.id").alias("keep_id"), "group_size",
        F.col("locator").eqNullSafe(F.col("keeper.locator")).alias("kept"), "text_sha256",
    )


def _check_bytes(docs: DataFrame, text: str) -> None:
    """Fail if rows with one digest differ in any byte. Equal texts meet before the shuffle already, so a hot one is small."""
    normal = docs.select(_normal(text).alias("normal"))
    different = normal.groupBy("normal").agg(F.count("*").alias("n")).groupBy(F.sha2(F.col("normal").cast("binary"), 256).alias("digest")).count()
    if not different.filter("count > 1").isEmpty():
        raise ValueError("different texts have the same SHA-256 digest")


def deduplicate(docs: DataFrame, text: str = "text", row_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of equal texts the one with the largest id."""
    placed, locator = _placed(docs)
    kept = _verdicts(placed, locator, text, row_id, **options).filter("kept").select(F.col("locator").alias(locator))
    return placed.join(kept, locator, "left_semi").select(*docs.columns)
