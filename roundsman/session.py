"""Session settings, lineage cuts and scratch space shared by the iterative operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings every job of this package is written for. AQE re-plans joins from
#: measured sizes, coalesces small partitions and splits skewed ones.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join even if the next step then needs a shuffle of its own
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # only matters for small inputs: lets a compute-heavy join on little data use every
    # core; at scale the advisory partition size decides
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "32k",
    # rows of road regions hold whole arrays, so bytes bound an Arrow batch, not rows
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


#: Settings of the Spark context, which only a new session can take: the files of a
#: checkpoint go once nothing refers to it, so a long loop keeps about two states on disk.
CONTEXT_SETTINGS = {"spark.cleaner.referenceTracking.cleanCheckpoints": "true"}


def build_session(app: str = "roundsman", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **CONTEXT_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: For queries whose tasks take rows of a few numbers or short lists only: with a bound on bytes Spark sizes the
#: batch anew for every row, which costs more than the row itself; 10,000 such rows are a batch.
FLAT_ROWS = {"spark.sql.execution.arrow.maxBytesPerBatch": str((1 << 31) - 1)}


def prepare(spark: SparkSession, flat_rows: bool = False) -> None:
    """Apply ``SETTINGS`` to a session somebody else has built."""
    for key, value in {**SETTINGS, **(FLAT_ROWS if flat_rows else {})}.items():
        spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder; a cluster
    session without it is refused, since a machine-local folder would be lost
    with its executor.
    """
    sc = spark.sparkContext
    # the JVM setting is read directly: PySpark's own getter wraps a missing value
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="roundsman-")
    sc.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Materialise ``df`` by column and compressed in the shared folder, for long tables that are read again."""
    path = scratch_path(df.sparkSession, "rows")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: State rows one task of a loop is meant to hold.
_ROWS_PER_TASK = 100_000


@contextlib.contextmanager
def round_settings(spark: SparkSession, rows: int):
    """Settings for loops of many small dependent jobs; yields the partition count.

    ``rows`` bounds the carried state. The count is the session's shuffle setting, or
    less for a state too small to fill that many tasks.

    Hash partitionings must stay exactly as declared from one round to the next
    so that the carried state is never shuffled again; AQE would merge
    partitions and lose that property. Constraint inference on self-unions of a
    checkpointed frame is switched off as well (it fails to resolve attributes).
    """
    wanted = {
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.constraintPropagation.enabled": "false",
    }
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(most, max(spark.sparkContext.defaultParallelism, rows // _ROWS_PER_TASK))
    wanted["spark.sql.shuffle.partitions"] = str(parts)
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield parts
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
