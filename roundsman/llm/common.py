"""Reading, Arrow settings and small column helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import gc
import string
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roundsman.session import cut_lineage, prepare

#: Rows and bytes of one Arrow batch: with whole texts as rows, the bytes are what counts.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def session_ready(spark: SparkSession) -> None:
    """Apply the package's settings and small Arrow batches to the session."""
    prepare(spark)
    for key, value in BATCH.items():
        spark.conf.set(key, value)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    session_ready(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


_worker: dict[str, object] = {}


def release_memory() -> None:
    """Give freed memory back to the system, which allocators otherwise keep for the worker's next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only the GNU C library has it
        pass


def kept_state(owner: str, key: object, build: Callable[[], object]) -> object:
    """What a Python worker has built for ``key``; another owner's or key's state is let go first.

    Workers live through many stages, so only the stage at work holds a model or automaton.
    """
    if _worker.get("owner") != owner or _worker.get("key") is not key:
        _worker.clear()
        release_memory()
        _worker.update(owner=owner, key=key, state=build())
        release_memory()
    return _worker["state"]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores added what no column of ``df`` is called, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; a null key gives -1."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(n)), F.lit(-1)).cast("int")


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a, b)``: (id, component) for every id that occurs.

    Alternates large-star and small-star steps, which end as stars around each smallest id.
    Every step is a minimum per id (combined before the shuffle) and one join; its result is
    checkpointed in the shared folder. Nothing of the graph reaches the driver but one sum.
    """
    edges = cut_lineage(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = cut_lineage(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
