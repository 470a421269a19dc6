"""Session settings and the shared checkpoint folder."""
from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on. A cluster keeps its own memory, core and shuffle-partition sizing.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.files.maxPartitionBytes": "16m",
}
STATE_STORE_SETTING = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_steps: ContextVar[list | None] = ContextVar("_steps", default=None)


def local_session(name: str = "paperloom", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session that is already there."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PAPERLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config(STATE_STORE_SETTING, ROCKSDB_PROVIDER)
    )
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the folder that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. A local session without that setting (tests, a laptop) gets a
    temporary folder; any other session without it is an error, since executors could not see one another's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="paperloom-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """The session with other values of some settings for a while."""
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@contextmanager
def passing_tables() -> Iterator[None]:
    """Tables that ``cut_lineage`` makes inside are dropped at the end: nothing that outlives the block may read them."""
    token = _steps.set([])
    try:
        yield
    finally:
        made = _steps.get()
        _steps.reset(token)
        for table in made:
            drop_table(table)


def cut_lineage(
    df: DataFrame, purpose: str = "stage", compression: str | None = None, options: dict[str, str] | None = None, batch_bytes: int | None = None
) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: survives lost executors, unlike a cache.

    The write's own shuffle files go as soon as the table stands, so a chain of such steps needs the disk of its
    largest step only. ``drop_table`` removes the table when nothing reads it any more. ``options``: of the writer.
    ``batch_bytes``: how much of a partition goes to a Python worker at once, for steps over few, very large rows.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    with settings(spark, **{SHUFFLE_CLEANUP: "true"}, **({ARROW_BYTES: str(batch_bytes)} if batch_bytes else {})):
        df.write.mode("errorifexists").options(**options or {}).parquet(path, compression=compression)
    table = spark.read.schema(df.schema).parquet(path)
    if (steps := _steps.get()) is not None:
        steps.append(table)
    return table


def drop_table(table: DataFrame) -> None:
    """Delete the files of a table that ``cut_lineage`` made."""
    context = table.sparkSession.sparkContext
    folders = {name.rpartition("/")[0] for name in table.inputFiles()}
    for folder in folders:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def spread(scan: DataFrame, waves: int = 1) -> DataFrame:
    """A scan with at least one partition per core, for work that costs far more than moving the rows.

    A few files with one row group each give few tasks, however large the cluster. A scan that already has enough
    partitions, as every large table has, is returned unchanged. Call it on a scan, before anything is joined.
    ``waves``: up to so many partitions per core and per partition of the scan, so that a larger table has more tasks
    and not longer ones where few bytes a row make much work.
    """
    cores, parts = scan.sparkSession.sparkContext.defaultParallelism, scan.rdd.getNumPartitions()
    wanted = max(cores, min(parts, cores) * waves)
    return scan if parts >= wanted else scan.repartition(wanted)
