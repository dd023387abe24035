"""Super-k-mers: runs of consecutive windows that share a minimiser, dealt to buckets by it.

Two equal windows have the same minimiser, so both are in the bucket of its value. First only
the minimisers travel, to find those that occur more than once; then the runs of these travel,
one packed string for all their windows, equal strings of a batch once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundsman.llm.hashing import _LETTERS, chunks, grams, mix, word_hashes
from roundsman.session import cut_lineage

#: Most windows of one run; longer runs are cut, which changes no window.
MAX_RUN = 512
_BLANK = bytes(32 if c == 32 or 9 <= c <= 13 else c for c in range(256))
_PACKED = "key long, a binary, b binary, c binary, d binary"


def encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def plain_words(text: str | None) -> bytes:
    """The words of a text, one space between them."""
    return b" ".join(encode(text).translate(_BLANK).split())


def byte_grams(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` bytes (a power of two) from each position on."""
    h = _LETTERS[data]
    m = 1
    while m < n:
        right = h[m:]
        h = h[:-m] * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
        m *= 2
    return mix(h)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    out, m = x, 1
    while 2 * m <= w:
        out = np.minimum(out[:-m], out[m:])
        m *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - m : w - m + len(x) - w + 1])


class Units:
    """What windows are made of: bytes, or words of texts with one space between words."""

    def __init__(self, words: bool, window: int, gram: int):
        self.words, self.window, self.gram = words, window, gram
        self.prepare: Callable[[str | None], bytes] = plain_words if words else encode

    def runs(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Row, minimiser, first unit, units, byte range within the row's text, of each run.

        The last array tells whether the minimiser stands more than once in the run, so that
        windows of the run itself may be equal.
        """
        sizes = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(np.concatenate(([0], sizes + 1)))[:-1]
        if self.words:
            hashes, starts, ends, counts = word_hashes(texts)
            value = grams(hashes, self.gram)
        else:
            joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
            value = byte_grams(joined, self.gram) if len(joined) > self.gram else np.zeros(0, np.uint64)
            counts, starts, ends = sizes, None, None
        first = np.cumsum(counts) - counts if self.words else begin
        width = self.window - self.gram + 1
        none = np.zeros(0, np.int64)
        if len(value) < width:
            return (none,) * 7
        least = _sliding_min(value, width)
        n = np.maximum(counts - self.window + 1, 0)
        row = np.repeat(np.arange(len(texts)), n)
        if not len(row):
            return (none,) * 7
        inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = inside + np.repeat(first, n)
        low = least[at]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (low[1:] != low[:-1])
        head = np.flatnonzero(new)
        length = np.diff(np.concatenate((head, [len(row)])))
        if length.max() > MAX_RUN:
            pieces = -(-length // MAX_RUN)
            offset = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head, length = np.repeat(head, pieces) + offset * MAX_RUN, np.repeat(length, pieces) - offset * MAX_RUN
            length = np.minimum(length, MAX_RUN)
        units = length + self.window - 1
        a, b = at[head], at[head] + units - 1
        rows = row[head]
        left = (starts[a] if self.words else a) - begin[rows]
        right = (ends[b] if self.words else b + 1) - begin[rows]
        span = length + width - 1
        place = np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span) + np.repeat(a, span)
        same = value[place] == np.repeat(low[head], span)
        again = np.add.reduceat(same, np.cumsum(span) - span, dtype=np.int64) > 1
        return rows, low[head].view(np.int64), inside[head], units, left, right, again


def _frames(batch: pa.RecordBatch, units: Units) -> Iterator[tuple[int, list[bytes], tuple]]:
    texts = [units.prepare(t.as_py()) for t in batch.column("body")]
    for start, stop in chunks([len(t) for t in texts]):
        yield start, texts[start:stop], units.runs(texts[start:stop])


def _batch(rows: list[tuple]) -> list[pa.RecordBatch]:
    if not rows:
        return []
    kinds = [pa.int64()] + [pa.binary()] * 4
    return pa.table(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "a", "b", "c", "d"]
    ).to_batches()


def _bucket(value: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(value.view(np.uint64) + np.uint64(5)) % np.uint64(buckets)).astype(np.int64)


def shared_minimisers(docs: DataFrame, units: Units, buckets: int) -> DataFrame:
    """(key, values): the minimisers of each row of ``docs(key, body)`` that occur in another run as well."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            parts = []
            for start, _, (rows, value, *_, again) in _frames(batch, units):
                parts.append((keys[rows + start], value))
                parts.append((keys[rows[again] + start], value[again]))
            if not parts:
                continue
            key, value = (np.concatenate(x) for x in zip(*parts, strict=True))
            place = _bucket(value, buckets)
            order = np.argsort(place, kind="stable")
            cut = np.searchsorted(place[order], np.arange(buckets + 1))
            out = []
            for b in range(buckets):
                x = order[cut[b] : cut[b + 1]]
                if len(x):
                    name, per = np.unique(key[x], return_counts=True)
                    by = np.argsort(key[x], kind="stable")
                    out.append((b, name.tobytes(), per.astype("<u4").tobytes(), value[x][by].tobytes(), b""))
            yield from _batch(out)

    def meet(rows: pa.Table) -> pa.Table:
        name, per, value = (
            np.frombuffer(b"".join(rows.column(c).to_pylist()), k) for c, k in (("a", np.int64), ("b", "<u4"), ("c", np.int64))
        )
        _, which, count = np.unique(value, return_inverse=True, return_counts=True)
        common = count[which] > 1
        return pa.table({"key": np.repeat(name, per)[common], "value": value[common]})

    packed = docs.select("key", "body").mapInArrow(send, _PACKED)
    return (
        packed.groupBy("key").applyInArrow(meet, "key long, value long")
        .groupBy("key").agg(F.collect_set("value").alias("values"))
    )


def repeated(
    docs: DataFrame, units: Units, judge: Callable[[list[bytes], np.ndarray, np.ndarray], tuple[np.ndarray, ...]],
) -> DataFrame:
    """(key, spans: array of (low, high) unit ranges covered by windows that occur elsewhere too).

    ``judge(strings, minimiser, copies)`` gets the distinct strings of a bucket and how often
    each occurs, and returns (string, first unit, end unit) ranges relative to the string.
    """
    spark = docs.sparkSession
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    flags = cut_lineage(shared_minimisers(docs, units, buckets))
    marked = docs.join(flags.select(F.col("key").alias("of"), "values").hint("shuffle_hash"), F.col("key") == F.col("of"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            wanted = np.unique(batch.column("values").flatten().to_numpy())
            sent: list[dict[bytes, list]] = [{} for _ in range(buckets)]
            for start, texts, (rows, value, unit, _, left, right, _) in _frames(batch, units):
                at = np.minimum(np.searchsorted(wanted, value), len(wanted) - 1)
                pick = np.flatnonzero(wanted[at] == value)
                place = _bucket(value[pick], buckets)
                for i, b, r, v, u, x, y in zip(
                    pick.tolist(), place.tolist(), rows[pick].tolist(), value[pick].tolist(), unit[pick].tolist(),
                    left[pick].tolist(), right[pick].tolist(), strict=True,
                ):
                    found = sent[b].setdefault(texts[r][x:y], [v])
                    found.append((keys[r + start], u))
            out = []
            for b, strings in enumerate(sent):
                if strings:
                    head = np.array([(v[0], len(s), len(v) - 1) for s, v in strings.items()], np.int64)
                    where = np.array([o for v in strings.values() for o in v[1:]], np.int64)
                    blob = b"".join(strings)
                    out.append((b, head.tobytes(), where.tobytes(), pa.compress(blob, "zstd", asbytes=True), len(blob).to_bytes(8, "little")))
            yield from _batch(out)

    def meet(rows: pa.Table) -> pa.Table:
        index: dict[bytes, int] = {}
        strings, values, which, wheres = [], [], [], []
        for row in rows.to_pylist():
            head = np.frombuffer(row["a"], np.int64).reshape(-1, 3)
            wheres.append(np.frombuffer(row["b"], np.int64).reshape(-1, 2))
            blob = pa.decompress(row["c"], int.from_bytes(row["d"], "little"), "zstd", asbytes=True)
            ends = np.cumsum(head[:, 1])
            ids = np.empty(len(head), np.int64)
            for k, (v, size, end) in enumerate(zip(head[:, 0].tolist(), head[:, 1].tolist(), ends.tolist(), strict=True)):
                s = blob[end - size : end]
                if (i := index.setdefault(s, len(strings))) == len(strings):
                    strings.append(s)
                    values.append(v)
                ids[k] = i
            which.append(np.repeat(ids, head[:, 2]))
        owner, where = np.concatenate(which), np.concatenate(wheres)
        copies = np.bincount(owner, minlength=len(strings))
        string, low, high = judge(strings, np.array(values, np.int64), copies)
        # every place of a string takes the string's ranges
        order = np.argsort(owner, kind="stable")
        first = np.searchsorted(owner[order], np.arange(len(strings) + 1))
        times = first[string + 1] - first[string]
        at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[string], times)
        place = where[order[at]]
        ranges = pa.table({
            "key": place[:, 0], "low": place[:, 1] + np.repeat(low, times), "high": place[:, 1] + np.repeat(high, times),
        })
        # rows equal in id and text share a key, and each of them has brought its ranges
        return ranges.group_by(["key", "low", "high"], use_threads=False).aggregate([])

    ranges = marked.select("key", "body", "values").mapInArrow(send, _PACKED).groupBy("key").applyInArrow(
        meet, "key long, low long, high long"
    )
    return ranges.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("spans"))


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(key, id, body): ``key`` tells rows of one id apart by their text; equal rows are one."""
    key = F.xxhash64(F.col(doc_id).cast("string"), F.col(text))
    return docs.select(key.alias("key"), F.col(doc_id).cast("long").alias("id"), F.col(text).alias("body"))


def joined_ranges(found: list[tuple[int, int, int]]) -> tuple[np.ndarray, ...]:
    """(string, low, high) ranges, those of one string that touch made one."""
    rows = np.array(sorted(set(found)), np.int64).reshape(-1, 3)
    if not len(rows):
        return rows[:, 0], rows[:, 1], rows[:, 2]
    far = rows[:, 0] << 32  # strings apart, so that one running maximum serves all
    reach = np.maximum.accumulate(far + rows[:, 2])
    head = np.flatnonzero(np.concatenate(([True], (far + rows[:, 1])[1:] > reach[:-1])))
    return rows[head, 0], rows[head, 1], np.maximum.reduceat(rows[:, 2], head)


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Sorted ranges joined where they touch."""
    out: list[list[int]] = []
    for s in spans or []:
        if out and s["low"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["high"])
        else:
            out.append([s["low"], s["high"]])
    return [(a, b) for a, b in out]
