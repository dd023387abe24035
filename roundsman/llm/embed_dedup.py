"""Near-duplicate embeddings: p-stable hashing of normalised vectors, then exact cosines.

Each table projects a vector on Gaussian directions and quantises the projections; the cell is
the vector's bucket. How many directions a table has follows the number of vectors (a bucket
then holds few strangers), how many tables there are follows the recall wanted at the
threshold. Equal vectors are one class from the start. A bucket of many classes is cut into
blocks, and each pair of blocks is compared on its own as a matrix product, so no task holds
more than two blocks of a bucket. A pair that meets in several tables counts in the first.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundsman.llm.common import components
from roundsman.llm.hashing import mix
from roundsman.session import cut_lineage

#: Chance that a pair exactly at the threshold is found.
RECALL = 0.9995
#: Cell width; close to the best for thresholds above 0.9.
WIDTH = 2.0
#: Strangers a bucket may hold on average.
STRANGERS = 0.05
#: Vectors of one block.
BLOCK = 512
_SEED = 1871


def _same_cell(distance: float, width: float) -> float:
    """Chance that two vectors at a distance share a cell of one projection."""
    t = width / distance
    tail = 0.5 * math.erfc(t / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def shape(vectors: int, threshold: float, recall: float = RECALL, width: float = WIDTH) -> tuple[int, int]:
    """Directions per table and tables for so many vectors, strangers taken as orthogonal."""
    near = _same_cell(math.sqrt(max(1e-12, 2 - 2 * threshold)), width)
    far = _same_cell(math.sqrt(2), width)
    directions = max(1, math.ceil(math.log(max(2.0, vectors / STRANGERS)) / -math.log(far)))
    return directions, max(1, math.ceil(math.log(1 - recall) / math.log1p(-(near**directions))))


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    # scaled first, so that no component's square overflows or vanishes
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


@functools.lru_cache(maxsize=8)
def _planes(dim: int, directions: int, width: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Directions and offsets of table after table; grows as tables are asked for."""
    return []


def _cells(unit: np.ndarray, directions: int, tables: int, width: float) -> np.ndarray:
    """Bucket (64 bits) of each vector in each table."""
    dim = unit.shape[1]
    planes = _planes(dim, directions, width)
    for t in range(len(planes), tables):
        rng = np.random.default_rng([_SEED, dim, t])
        planes.append((rng.standard_normal((dim, directions)), rng.uniform(0, width, directions)))
    turn = np.concatenate([p[0] for p in planes[:tables]], axis=1)
    shift = np.concatenate([p[1] for p in planes[:tables]])
    cell = np.floor((unit @ turn + shift) / width).astype(np.int64).view(np.uint64).reshape(len(unit), tables, directions)
    code = np.broadcast_to(np.arange(tables, dtype=np.uint64), (len(unit), tables))
    for k in range(directions):
        code = mix(code * np.uint64(31) + cell[:, :, k])
    return code.view(np.int64)


def _by_dim(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = np.array(batch.column(column).value_lengths().to_pylist(), np.int64)
    for dim in np.unique(sizes).tolist():
        yield dim, batch.take(pa.array(np.flatnonzero(sizes == dim)))


def _roots(link: np.ndarray) -> np.ndarray:
    """Smallest row of each row's component of a symmetric link matrix."""
    root = np.arange(len(link))
    while True:
        least = np.minimum(np.where(link, root[None, :], len(link)).min(axis=1), root)
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _compare(rows: pa.Table, threshold: float, directions: int, tables: int, width: float) -> Iterator[pa.RecordBatch]:
    """Links of one pair of blocks: (id, copies of linked vectors, smallest linked class)."""
    dim = len(rows.column("vector")[0])
    ids, copies, own, bucket_at = [rows.column(c).to_numpy() for c in ("rep", "copies", "block", "table")]
    unit = _unit(rows.column("vector").combine_chunks(), dim)
    cosine = unit @ unit.T
    link = cosine >= threshold
    np.fill_diagonal(link, False)
    a, b = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
    if a != b:
        link &= own[:, None] != own[None, :]
    i, j = np.nonzero(np.triu(link))
    if not len(i):
        return
    root = ids[_roots(link)] if a == b else ids[_roots(link | link.T)]
    counted = np.ones(len(i), bool)
    t = int(bucket_at[0])
    if t:
        cells = _cells(unit, directions, t, width)
        for part in range(0, len(i), 65536):
            x, y = i[part : part + 65536], j[part : part + 65536]
            counted[part : part + 65536] = ~(cells[x] == cells[y]).any(axis=1)
    n = np.bincount(i[counted], copies[j[counted]], len(ids)) + np.bincount(j[counted], copies[i[counted]], len(ids))
    found = np.flatnonzero(link.any(axis=1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(ids[found]), pa.array(n[found].astype(np.int64)), pa.array(root[found])], names=["id", "n", "root"]
    )


def links(
    vectors: DataFrame, threshold: float = 0.93, recall: float = RECALL, width: float = WIDTH,
    vec_id: str = "vec_id", vector: str = "embedding", group: str = "label",
) -> DataFrame:
    """(id, n_links, component) of every row of ``vectors``.

    Vectors of one group (equal and not null) and one length link when their cosine, in double
    precision, is at least ``threshold``. ``n_links`` counts the other rows linked directly,
    ``component`` is the smallest id reachable. A vector that is null, empty, zero, or holds a
    null or non-finite component links with nothing; so does one without a group. Every pair
    reported is exact; a pair at the threshold is found with probability ``recall``, a closer
    one with more.
    """
    source = vectors.select(
        F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector"), F.col(group).alias("label")
    )
    infinite = F.lit(float("inf")).cast("double")
    usable = (
        F.col("label").isNotNull() & F.col("vector").isNotNull() & F.col("id").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < infinite))
        & F.exists("vector", lambda x: x != 0)
    )
    usable = F.coalesce(usable, F.lit(False))
    good = source.where(usable)
    classes = cut_lineage(
        good.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
        .withColumn("dim", F.size("vector"))
    )
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    directions, tables = shape(largest, threshold, recall, width)

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for dim, batch in _by_dim(whole, "vector"):
                cells = _cells(_unit(batch.column("vector"), dim), directions, tables, width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rep"), pa.array(list(cells), pa.list_(pa.int64()))], names=["rep", "cells"]
                )

    placed = (
        classes.select("rep", "vector").mapInArrow(hash_all, "rep long, cells array<long>")
        .join(classes.select("rep", "label", "dim"), "rep")
        .select("rep", F.xxhash64("label", "dim").alias("kind"), F.posexplode("cells").alias("table", "cell"))
        .select("rep", "table", F.xxhash64("kind", "cell").alias("bucket"))
    )
    shared = placed.groupBy("table", "bucket").agg(F.count("*").alias("members")).where("members > 1")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    inside = (
        placed.join(shared, ["table", "bucket"])
        .withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
        .select("rep", "table", "bucket", "block", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        .select("rep", "table", "bucket", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of equal (table, bucket, low, high) of sorted rows; a run may span batches."""
        held: list[pa.Table] = []
        last = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            keys = np.stack([part.column(c).to_numpy().astype(np.int64) for c in ("table", "bucket", "low", "high")], axis=1)
            cut = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
            for start, stop in zip(cut.tolist(), [*cut[1:].tolist(), len(keys)], strict=True):
                key = tuple(keys[start].tolist())
                if key != last and held:
                    yield from flush(held)
                    held = []
                last = key
                held.append(part.slice(start, stop - start))
        if held:
            yield from flush(held)

    def flush(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        rows = pa.concat_tables(held)
        if rows.num_rows > 1:
            yield from _compare(rows, threshold, directions, tables, width)

    order = ["table", "bucket", "low", "high"]
    met = (
        inside.join(classes.select("rep", "vector", "copies"), "rep")
        .repartition(*order).sortWithinPartitions(*order)
        .mapInArrow(compare, "id long, n long, root long")
    )
    found = cut_lineage(met.groupBy("id", "root").agg(F.sum("n").alias("n")))
    component = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    of_class = (
        classes.join(counts, F.col("rep") == counts["id"], "left").drop("id")
        .join(component, F.col("rep") == component["id"], "left")
        .select(
            F.col("label").alias("l"), F.col("vector").alias("v"),
            (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component"),
        )
    )
    linked = good.join(of_class, (F.col("label") == F.col("l")) & (F.col("vector") == F.col("v"))).select("id", "n_links", "component")
    return linked.unionByName(
        source.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    )
