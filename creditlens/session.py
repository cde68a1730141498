"""Session set-up and the shared work area."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Largest row count of a table that is turned into literals or hinted as a broadcast side.
MAX_SMALL_ROWS = 100_000

# The JVM does not compile methods above 8000 bytes of bytecode; the wide label and date
# expressions of the preparation would run interpreted if fused into one method.
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
COMPILED_BYTES = 8000


def build_session(app_name: str = "creditlens", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every job here relies on; extra settings win."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        METHOD_LIMIT: str(COMPILED_BYTES),
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """What runs inside generates no methods that the JVM does not compile, also in a session that ``build_session`` did not make."""
    before = spark.conf.get(METHOD_LIMIT)
    spark.conf.set(METHOD_LIMIT, str(min(int(before), COMPILED_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(METHOD_LIMIT, before)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the session names it.

    A temporary folder is only made up for a local master with nothing configured.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by driver and executors")
    folder = tempfile.mkdtemp(prefix="creditlens-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """Unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/creditlens/{name}-{uuid.uuid4().hex}"


def write_stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage and survives the loss of executors, unlike a cached frame.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_compiled(df: DataFrame, name: str) -> DataFrame:
    """``write_stage`` for wide expressions: the session that later reads the rows may have no limit on generated methods."""
    with compiled_methods(df.sparkSession):
        return write_stage(df, name)


def empty_stage(df: DataFrame) -> None:
    """Free the space of a stage that nothing reads any more: its folder (``df`` is what ``write_stage`` returned) then holds no rows."""
    folders = {path.rsplit("/", 1)[0] for path in df.inputFiles()}
    for folder in folders:
        df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(folder)


def small_rows(df: DataFrame, what: str, limit: int = 1000) -> list:
    """Rows of a table that must be small; reads at most ``limit`` + 1 rows and fails beyond."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows")
    return rows
