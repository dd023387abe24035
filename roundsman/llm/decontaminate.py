"""Benchmark decontamination: one Aho-Corasick automaton over all test items, each text read once.

Items and texts are normalised alike: A-Z lower-cased, every ASCII character that is neither
letter nor digit a separator, words joined by one space. Normalising keeps the byte positions
of the original until the words are joined, so a match leads back to the original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roundsman.llm.common import kept_state

#: Words of a window.
WINDOW = 10
#: Most bytes of all items together: a benchmark is a fixed test set. The automaton takes
#: about 100 bytes of a worker's memory for each byte of distinct windows.
MAX_ITEM_BYTES = 4 << 20

_SEPARATE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def normalise(text: str | None) -> bytes:
    """Bytes as long as the text's UTF-8, words in lower case, all else spaces."""
    return (text or "").encode("utf-8", "replace").lower().translate(_SEPARATE)


def windows(words: list[bytes], size: int) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def _automaton(items: list[tuple[str, str]], size: int):
    import ahocorasick

    owners: dict[bytes, set[str]] = {}
    for item, text in items:
        for window in windows(normalise(text).split(), size):
            owners.setdefault(window, set()).add(item)
    found = ahocorasick.Automaton()
    for window, ids in owners.items():
        # a byte is one character here, and the spaces around make whole words match only
        found.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, tuple(sorted(ids))))
    if owners:
        found.make_automaton()
    return found


def _scan(text: str | None, automaton) -> tuple[int, np.ndarray, list[str], list[tuple[int, int]]]:
    """Words, hit words, items, and the hit runs as (start, end) offsets in the original's characters."""
    plain = normalise(text)
    words = plain.split()
    if not words or not len(automaton):
        return len(words), np.zeros(0, np.int64), [], []
    joined = b" " + b" ".join(words) + b" "
    ends, sizes, items = [], [], set()
    for end, (size, ids) in automaton.iter(joined.decode("latin-1")):
        ends.append(end)
        sizes.append(size)
        items.update(ids)
    if not ends:
        return len(words), np.zeros(0, np.int64), [], []
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    last = np.searchsorted(spaces, np.array(ends))  # the space at the end of word k is number k + 1
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, last - np.array(sizes), 1)
    np.add.at(change, last, -1)
    hit = np.flatnonzero(np.cumsum(change)[:-1])
    raw = np.frombuffer(plain, np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], raw.view(np.int8), [0]))))
    first, stop = edge[0::2], edge[1::2]
    # byte offsets to character offsets: count the bytes that begin a character
    begins = np.concatenate(([0], np.cumsum((np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8) & 0xC0) != 0x80)))
    cut = np.flatnonzero(np.diff(hit) > 1)
    left, right = hit[np.concatenate(([0], cut + 1))], hit[np.concatenate((cut, [len(hit) - 1]))]
    return len(words), hit, sorted(items), list(zip(begins[first[left]].tolist(), begins[stop[right]].tolist(), strict=True))


def scan(
    docs: DataFrame, items: DataFrame, size: int = WINDOW, text: str = "text",
    item_id: str = "item_id", item_text: str = "text", max_item_bytes: int = MAX_ITEM_BYTES,
) -> DataFrame:
    """``docs`` with n_words, n_hit, item_ids, starts, ends: hit words, their items, the hit runs of the original.

    A window is ``size`` consecutive words of an item, or the whole of a shorter one. Offsets
    count characters, end exclusive. Null texts and texts without words have no words and no
    hits; items without words or id match nothing; columns of the new names are replaced. The
    items go to every worker, so their bytes are counted first and more than
    ``max_item_bytes`` is refused. No shuffle: texts are scanned where they are read.
    """
    spark = docs.sparkSession
    weight = items.agg(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0))).first()[0]
    if weight > max_item_bytes:
        raise ValueError(f"{weight} bytes of items; the automaton is built for {max_item_bytes}: scan in parts")
    rows = [(r[0], r[1]) for r in items.select(F.col(item_id).cast("string"), item_text).collect() if r[0] is not None]
    shared = spark.sparkContext.broadcast(rows)
    made = {
        "n_words": T.LongType(), "n_hit": T.LongType(), "item_ids": T.ArrayType(T.StringType()),
        "starts": T.ArrayType(T.IntegerType()), "ends": T.ArrayType(T.IntegerType()),
    }
    docs = docs.drop(*made)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = shared.value  # one list per worker and broadcast
        automaton = kept_state(f"decontaminate {size}", key, lambda: _automaton(key, size))
        ints = pa.list_(pa.int32())
        for batch in batches:
            done = [_scan(t.as_py(), automaton) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([
                *batch.columns,
                pa.array([d[0] for d in done], pa.int64()),
                pa.array([len(d[1]) for d in done], pa.int64()),
                pa.array([d[2] for d in done], pa.list_(pa.string())),
                pa.array([[s for s, _ in d[3]] for d in done], ints),
                pa.array([[e for _, e in d[3]] for d in done], ints),
            ], names=[*batch.schema.names, *made])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(k, v) for k, v in made.items())]))
