"""What every module needs of a session: reading tables, scratch tables, workers that can import this package."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only if it was counted and takes at most so many bytes, by the widths of its columns.
BROADCAST_BYTES = 24_000_000
#: Bytes of one batch of rows on its way to a Python worker. Spark's own bound of 64 MB, in buffers of up to twice as
#: much, is held by the executor and by the worker, for each task at once.
BATCH_BYTES = 4 << 20
_BATCH, _DEFAULT_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: Spark removes the shuffle files of a scratch table as soon as it is written, if this is set meanwhile.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_shipped: set[str] = set()


def _local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.split("[")[0] == "local"


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package: by its path, and on a cluster by a zip file that Spark ships. Batches of
    rows for them are bounded by BATCH_BYTES, unless the session sets a bound of its own."""
    if spark.conf.get(_BATCH) == _DEFAULT_BATCH:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    package = Path(__file__).resolve().parent
    root, known = str(package.parent), spark.sparkContext.environment
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known.get("PYTHONPATH", "")]))
    app = spark.sparkContext.applicationId
    if _local(spark) or app in _shipped:
        return
    _shipped.add(app)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent).as_posix())
    path = f"{scratch(spark)}/{package.name}.zip"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    try:
        stream.write(bytearray(data.getvalue()))
    finally:
        stream.close()
    spark.sparkContext.addPyFile(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own, and a cluster an error: its
    executors share no local folder."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not _local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
        base = context.getCheckpointDir()
    return base.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when the driver ends."""
    path = f"{shared_folder(spark)}/textloom/{spark.sparkContext.applicationId}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        files.mkdirs(at)
        files.deleteOnExit(at)
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: lineage ends here, so a lost executor costs no
    recomputation of what stands before. Its shuffle files go as soon as it is written."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    try:
        spark.conf.set(_CLEAN, "true")
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing reads any more."""
    for df in tables:
        files = df.inputFiles()
        if not files:
            continue
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out for work that is long for its bytes: a few small files would else be a few tasks, however many
    cores there are."""
    spark = df.sparkSession
    return df.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def fits(df: DataFrame, limit: int | None = None) -> bool:
    """Whether a settled table is small enough for a broadcast; it is counted. ``limit`` replaces the bound in rows."""
    if limit is None:
        width = 16 + sum({"long": 8, "bigint": 8, "int": 8, "double": 8, "boolean": 8}.get(kind, 48) for _, kind in df.dtypes)
        limit = BROADCAST_BYTES // width
    return df.count() <= limit


def small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Marks a settled table for broadcast if it is counted to be small enough."""
    return F.broadcast(df) if fits(df, limit) else df
