"""Session construction and lineage cut-off through the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
# A join on a key that a later aggregation also uses is split at a hot key only when this is forced.
# Shuffle files go as soon as the job that wrote them ends, not whenever the driver next collects garbage.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
_local_dirs: dict[str, str] = {}
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def build_session(master: str | None = None, app_name: str = "tariffspark", **conf: str) -> SparkSession:
    """Session with the settings the operators are tuned for; ``conf`` overrides them."""
    settings = {
        **ADAPTIVE,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Adaptive settings for a session that somebody else built."""
    for key, value in ADAPTIVE.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def divided_code(spark: SparkSession) -> Iterator[None]:
    """For passes over tables of some forty columns or more: their generated code is divided into methods that the virtual machine compiles.

    It never compiles a method of more than 8000 bytes, which by default is written whole and then interpreted row by row.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "8000")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own; on a cluster a
    machine-local folder would lose intermediate tables with its machine.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder on shared storage")
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="tariffspark-")
    return _local_dirs[app]


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later passes prune columns on the Parquet table, the lineage is cut, and a
    lost executor costs only the re-read of its splits.
    """
    spark = df.sparkSession
    return _written(df, f"{_scratch.get() or shared_folder(spark)}/{label}-{uuid.uuid4().hex}")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _emptied(spark: SparkSession, folder: str) -> None:
    """Overwriting the folder lets Spark delete its contents on any store; an empty table of a few bytes stays."""
    spark.createDataFrame([], "nothing int").write.mode("overwrite").parquet(folder)


@contextmanager
def for_now(df: DataFrame, label: str = "stage") -> Iterator[DataFrame]:
    """``materialize`` for a table that nothing reads after the block: it is deleted at the end, also after an error."""
    spark = df.sparkSession
    path = f"{_scratch.get() or shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    try:
        yield _written(df, path)
    finally:
        _emptied(spark, path)


@contextmanager
def scratch(spark: SparkSession, label: str = "scratch") -> Iterator[str]:
    """Tables materialized inside share one folder, whose contents are deleted at the end, also after an error.

    Nothing that still reads them may leave the block.
    """
    folder = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    token = _scratch.set(folder)
    try:
        yield folder
    finally:
        _scratch.reset(token)
        _emptied(spark, folder)
