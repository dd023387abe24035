"""Suffix-array dedup on bytes, with the linear grouping construction.

Suffixes are first grouped by their Lyndon prefixes: groups are taken in descending order, and
each member hands its group's prefix to the nearest suffix before it that is in a smaller
group. Then one pass over the array, from the smallest suffix on, puts each suffix into its
group's next place, following the same previous-smaller pointers. No step renames the text or
recurses. In the finished array, equal windows are neighbours.

Only text that can repeat is sorted: runs of windows meet in the bucket of their minimiser,
equal runs count as copies, and windows with a part that occurs once drop out before. The
letters of the array are blocks of eight bytes. Equal windows hold their minimiser at the same
offset, so blocks counted from it lie alike in both; the array finds the equal whole blocks,
and the bytes left and right of them, seven and one up to none and eight, decide the window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundsman.llm.superkmers import Units, byte_grams, encode, joined_ranges, keyed, merged, repeated

#: Bytes minimisers are chosen from, and bytes of the parts that must repeat; powers of two.
GRAM, PART = 64, 32
#: Bytes of a block.
BLOCK = 8
#: Bytes sorted at once; a minimiser's strings stay together.
SORTED_BYTES = 1 << 20


def suffix_array(letters: np.ndarray) -> list[int]:
    """Starts of the suffixes of a sequence of integers, in order."""
    n = len(letters)
    _, data, sizes = np.unique(letters, return_inverse=True, return_counts=True)
    member = np.argsort(data, kind="stable")
    starts = np.cumsum(sizes) - sizes
    group = starts[data].tolist() if n else []  # a group is named by its first place, so names are in order
    order = member.tolist()
    place = np.empty(n, np.int64)
    place[member] = np.arange(n)
    place = place.tolist()
    size = [0] * n
    for s, k in zip(starts.tolist(), sizes.tolist()):
        size[s] = k
    prev = [-1] * n
    high = n
    while high:
        low = group[order[high - 1]]
        given: dict[int, int] = {}
        members = order[low:high]
        if high - low > 1:
            members.sort()
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= low:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                given[p] = given.get(p, 0) + 1
        high = low
        if not given:
            continue
        times = set(given.values())
        for t in sorted(times, reverse=True):
            taken = given if len(times) == 1 else [p for p, k in given.items() if k == t]
            for p in taken:  # to the end of its group
                g = group[p]
                k = size[g] - 1
                size[g] = k
                last = g + k
                at = place[p]
                other = order[last]
                order[at], order[last] = other, p
                place[other], place[p] = at, last
            fresh: dict[int, int] = {}
            for p in taken:  # a group of their own, right behind
                g = group[p]
                new = fresh.get(g)
                if new is None:
                    new = fresh[g] = g + size[g]
                    if new != g:
                        size[new] = 0
                group[p] = new
                size[new] += 1
    out = [-1] * n
    free = list(range(n))
    done = bytearray(n)
    at, i = n, 0
    while True:
        j = at - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = 1
            j = prev[j]
        if i == n:
            return out
        at = out[i]
        i += 1


def _equal_windows(pieces: list[bytes], value: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, start) of the windows that are equal to another one at the same minimiser."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(pieces) + bytes(2 * BLOCK), np.uint8)
    owner = np.repeat(np.arange(len(pieces)), sizes)
    gram = byte_grams(data[: len(owner)], GRAM)
    at = np.flatnonzero(gram == value.view(np.uint64)[owner[: len(gram)]])
    at = at[owner[at] == owner[at + GRAM - 1]]
    # a sequence of blocks for each piece and each offset its minimisers have to a block's edge
    lane = np.unique(owner[at] * BLOCK + (at - begin[owner[at]]) % BLOCK)
    piece, phase = lane // BLOCK, lane % BLOCK
    blocks = (sizes[piece] - phase) // BLOCK
    end = np.cumsum(blocks + 1)  # one letter more stands between sequences
    of = np.repeat(np.arange(len(lane)), blocks + 1)
    k = np.arange(len(of)) - np.repeat(end - blocks - 1, blocks + 1)
    start = (begin[piece] + phase)[of] + k * BLOCK
    last = k == blocks[of]
    raw = np.lib.stride_tricks.sliding_window_view(data, BLOCK)[np.where(last, 0, start)]
    _, letters = np.unique(np.ascontiguousarray(raw).view(np.uint64).ravel(), return_inverse=True)
    letters[last] = len(letters) + of[last]
    whole = (window - BLOCK + 1) // BLOCK  # blocks in every window, wherever it starts
    inside = whole * BLOCK
    order = np.array(suffix_array(letters), np.int64)
    order = order[k[order] + whole <= blocks[of[order]]]
    same = np.ones(max(0, len(order) - 1), bool)
    for i in range(whole):
        same &= letters[order[1:] + i] == letters[order[:-1] + i]
    kind = np.concatenate(([0], np.cumsum(~same)))[: len(order)]
    found = []
    rest = window - inside  # bytes of a window besides its whole blocks, left and right
    for left in range(min(BLOCK, rest + 1)):
        first = start[order] - left
        ok = (first >= begin[piece[of[order]]]) & (first + window <= (begin + sizes)[piece[of[order]]])
        first, group = first[ok], kind[ok]
        edge = np.concatenate((np.arange(left), np.arange(left + inside, window)))
        key = np.zeros((len(first), 2 * BLOCK), np.uint8)
        key[:, : len(edge)] = data[first[:, None] + edge]
        key = key.view(np.uint64)
        by = np.lexsort((key[:, 1], key[:, 0], group))
        equal = (group[by][1:] == group[by][:-1]) & (key[by][1:] == key[by][:-1]).all(axis=1)
        twin = np.concatenate((equal, [False])) | np.concatenate(([False], equal))
        found.append(first[by][twin[: len(by)]])
    found = np.unique(np.concatenate(found))
    return owner[found], found - begin[owner[found]]


def _candidates(strings: list[bytes], value: np.ndarray, copies: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(string, first, last + 1) runs of window starts whose every part occurs again at the same minimiser."""
    sizes = np.array([len(s) for s in strings], np.int64)
    data = np.frombuffer(b"".join(strings), np.uint8)
    owner = np.repeat(np.arange(len(strings)), sizes)
    part = byte_grams(data, PART) + value.view(np.uint64)[owner[: len(data) - PART + 1]] * np.uint64(0x9E3779B97F4A7C15)
    own = owner[: len(part)] == owner[PART - 1 :]
    _, which = np.unique(part, return_inverse=True)
    often = np.bincount(which, np.where(own, copies[owner[: len(part)]], 0))
    lone = np.concatenate(([0], np.cumsum(own & (often[which] < 2))))
    begin = np.cumsum(sizes) - sizes
    n = np.maximum(sizes - window + 1, 0)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
    good = lone[at + window - PART + 1] == lone[at]
    string, start = owner[at][good], (at - np.repeat(begin, n))[good]
    if not len(string):
        return []
    head = np.flatnonzero(np.concatenate(([True], (np.diff(start) != 1) | (np.diff(string) != 0))))
    last = np.concatenate((head[1:], [len(string)])) - 1
    return list(zip(string[head].tolist(), start[head].tolist(), (start[last] + 1).tolist(), strict=True))


def _judge(window: int):
    def judge(strings: list[bytes], value: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, ...]:
        found: list[tuple[int, int, int]] = [(i, 0, len(strings[i])) for i in np.flatnonzero(copies > 1).tolist()]
        order = np.argsort(value, kind="stable")
        bounds = np.flatnonzero(np.concatenate(([True], np.diff(value[order]) != 0, [True])))
        held: list[int] = []
        weight = 0
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            group = order[a:b].tolist()
            if b - a > 1 or len(strings[group[0]]) > window:
                held += group
                weight += sum(len(strings[i]) for i in group)
            if held and (weight >= SORTED_BYTES or b == len(order)):
                found += _sort([strings[i] for i in held], value[held], copies[held], np.array(held), window)
                held, weight = [], 0
        return joined_ranges(found)

    return judge


def _sort(strings: list[bytes], value: np.ndarray, copies: np.ndarray, names: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    pieces: dict[bytes, list[tuple[int, int]]] = {}
    for i, a, b in _candidates(strings, value, copies, window):
        pieces.setdefault(strings[i][a : b + window - 1], []).append((i, a))
    # a piece of several strings repeats as a whole, and still is one of the sorted ones
    found = [
        (int(names[i]), a, a + len(piece)) for piece, places in pieces.items() if len(places) > 1 for i, a in places
    ]
    texts = list(pieces)
    if texts:
        of = value[[pieces[t][0][0] for t in texts]]
        for k, start in zip(*(x.tolist() for x in _equal_windows(texts, of, window)), strict=True):
            found += [(int(names[i]), a + start, a + start + window) for i, a in pieces[texts[k]]]
    return found


def removed(docs: DataFrame, window: int = 200, doc_id: str = "doc_id", text: str = "text", kept_bytes: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row, texts as UTF-8 bytes.

    A byte goes if a ``window``-byte string that covers it starts anywhere else too, in the
    same document or another; strings are judged on the input and never cross documents.
    ``n_spans`` counts the maximal removed runs. Null, empty and shorter texts lose nothing; a
    repeated row counts as another document. ``window`` is 64 or more.
    """
    if window < GRAM:
        raise ValueError(f"a window has {GRAM} bytes at least")
    rows = keyed(docs, doc_id, text)
    spans = repeated(rows, Units(False, window, GRAM), _judge(window))
    joined = rows.join(spans.select(F.col("key").alias("of"), "spans").hint("shuffle_hash"), F.col("key") == F.col("of"), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, spans in zip(batch.column("body").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = encode(body)
                gone = merged(spans)
                kept = b"".join(data[a:b] for a, b in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(data)], strict=True))
                out.append((len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.binary()] * kept_bytes
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds))],
                names=["id", *names[: len(kinds)]],
            )

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept_bytes
    return joined.select("id", "body", "spans").mapInArrow(cut, schema)
