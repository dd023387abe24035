"""Most similar streets of blocks of query streets and pool streets, as arrays.

Lengths and shared trigrams bound a similarity from above: an edit moves a text's length by one
at most and changes at most three of its distinct trigrams. Edit distances are worked out for
the best bounds first and then only for bounds that reach the k-th similarity found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_PAD = 0x110000
#: Pairs worked on at once.
_PAIRS = 1 << 16
#: Pairs whose edit distances advance together, few enough for a core's cache.
_CHUNK = 4096


def spelled(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts as rows of one matrix, padded, and their lengths."""
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.full((len(texts), max(int(length.max(initial=0)), 1)), _PAD, np.int32)
    points[np.arange(points.shape[1]) < length[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le"), np.int32)
    return points, length


def trigram_bits(points: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of each text, padded by two blanks before and one after, as bits; their number."""
    n, width = points.shape
    padded = np.full((n, width + 3), 32, np.int64)
    padded[:, 2 : width + 2] = np.where(points == _PAD, 32, points)
    grams = (padded[:, :-2] << 42) | (padded[:, 1:-1] << 21) | padded[:, 2:]
    there = np.arange(grams.shape[1]) <= length[:, None]
    known, at = np.unique(grams[there], return_inverse=True)
    has = np.zeros((n, -(-len(known) // 64) * 64), bool)
    has[np.nonzero(there)[0], at] = True
    bits = np.packbits(has, axis=1).view(np.uint64)
    return bits, has.sum(axis=1)


def edit_distances(a: np.ndarray, len_a: np.ndarray, b: np.ndarray, len_b: np.ndarray) -> np.ndarray:
    """Edit distance of each row of ``a`` to the same row of ``b``: a text position at a time, all pairs at once."""
    kind = np.int16 if max(a.shape[1], b.shape[1]) < 1 << 14 else np.int32
    result = np.empty(len(a), np.int64)
    for low in range(0, len(a), _CHUNK):
        part = slice(low, low + _CHUNK)
        m, n = len_a[part], len_b[part]
        x, y = a[part, : int(m.max())].T.copy(), b[part, : int(n.max())].T.copy()
        steps = np.arange(len(y) + 1, dtype=kind)[:, None]
        line = np.repeat(steps, len(m), axis=1)
        every = np.arange(len(m))
        found = line[n, every].astype(np.int64)
        after = np.empty_like(line)
        for i in range(len(x)):
            after[0] = i + 1
            np.minimum(line[1:] + kind(1), line[:-1] + (y != x[i]), out=after[1:])
            # an insertion costs one for each place it moves on
            line = np.minimum.accumulate(after - steps, axis=0) + steps
            ends = m == i + 1
            if ends.any():
                found[ends] = line[n[ends], every[ends]]
        result[part] = found
    return result


def _kth(values: np.ndarray, start: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each run of values; below all values where there are fewer."""
    run = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((-values, run))
    at = np.minimum(start + k - 1, len(values) - 1)
    return np.where(size >= k, values[order[at]], -1.0)


def compare(groups: list[tuple[list[str], list[str]]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Groups of queries and streets to (query, street, similarity) of what can be among a query's ``k`` best.

    Queries and streets are numbered through all groups. The last figure is the number of edit
    distances it took.
    """
    queries = [q for asked, _ in groups for q in asked]
    streets = [s for _, offered in groups for s in offered]
    n_streets = np.array([len(offered) for _, offered in groups])
    size = np.repeat(n_streets, [len(asked) for asked, _ in groups])
    first_street = np.repeat(np.cumsum(n_streets) - n_streets, [len(asked) for asked, _ in groups])
    start = np.cumsum(size) - size
    query = np.repeat(np.arange(len(queries)), size)
    street = np.arange(len(query)) - np.repeat(start - first_street, size)
    points, length = spelled(queries + streets)
    bits, grams = trigram_bits(points, length)
    right = street + len(queries)
    shared = np.empty(len(query), np.int64)
    for low in range(0, len(query), _CHUNK):
        part = slice(low, low + _CHUNK)
        shared[part] = np.bitwise_count(bits[query[part]] & bits[right[part]]).sum(axis=1)
    len_a, len_b, n_a, n_b = length[query], length[right], grams[query], grams[right]
    longer = np.maximum(np.maximum(len_a, len_b), 1)
    overlap = shared / (n_a + n_b - shared) * 0.5
    empty = (len_a == 0) | (len_b == 0)

    def mixed(distance, at=slice(None)):
        return np.where(empty[at], 0.0, (1.0 - distance / longer[at]) * 0.5 + overlap[at])

    bound = mixed(np.maximum(np.abs(len_a - len_b), -(-(np.maximum(n_a, n_b) - shared) // 3)))
    similarity = np.full(len(query), -1.0)
    edits = 0
    reach = _kth(bound, start, size, k)
    for _ in range(2):
        todo = np.flatnonzero((bound >= np.repeat(reach, size)) & (similarity < 0))
        if len(todo):
            a, b = query[todo], right[todo]
            similarity[todo] = mixed(edit_distances(points[a], length[a], points[b], length[b]), todo)
            edits += len(todo)
        reach = _kth(similarity, start, size, k)
    kept = (similarity >= 0) & (similarity >= np.repeat(reach, size))
    return query[kept], street[kept], similarity[kept], edits


def best_rows(k: int, names: list[str]):
    """Rows of (pool, facet, queries, streets, first_ids) to those that can be among the ``k`` best."""

    def found(batch, low, high):
        rows = range(low, high)
        lists = [[batch.column(c)[i].values for i in rows] for c in (2, 3, 4)]
        query, street, similarity, edits = compare([(q.to_pylist(), s.to_pylist()) for q, s in zip(*lists[:2])], k)
        group = np.repeat(np.arange(low, high), [len(q) for q in lists[0]])[query]
        asked, offered, ids = (pa.concat_arrays(x) for x in lists)
        counted = np.zeros(len(query), np.int64)
        counted[:1] = edits
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(group)), batch.column(1).take(pa.array(group)), asked.take(pa.array(query)),
                offered.take(pa.array(street)), ids.take(pa.array(street)), pa.array(similarity), pa.array(counted),
            ],
            names,
        )

    def work(batches):
        for batch in batches:
            pairs = [len(batch.column(2)[i].values) * len(batch.column(3)[i].values) for i in range(batch.num_rows)]
            low = total = 0
            for i, n in enumerate(pairs):
                total += n
                if total >= _PAIRS:
                    yield found(batch, low, i + 1)
                    low, total = i + 1, 0
            if low < len(pairs):
                yield found(batch, low, len(pairs))

    return work
