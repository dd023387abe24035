"""Substring dedup on words: windows counted exactly within super-k-mer buckets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundsman.llm.superkmers import Units, joined_ranges, keyed, merged, plain_words, repeated

#: Words of the n-grams minimisers are chosen from.
GRAM = 5


def _judge(window: int):
    def judge(strings: list[bytes], value: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, ...]:
        """Sort the windows of all strings of a minimiser; equal neighbours repeat."""
        found: list[tuple[int, int, int]] = []
        order = np.argsort(value, kind="stable")
        cut = np.flatnonzero(np.concatenate(([True], np.diff(value[order]) != 0, [True])))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            group = order[a:b].tolist()
            if b - a == 1 and copies[group[0]] == 1 and strings[group[0]].count(b" ") < window:
                continue
            rows = []
            for i in group:
                s = strings[i]
                spaces = np.flatnonzero(np.frombuffer(s, np.uint8) == 32)
                starts, ends = [0, *(spaces + 1).tolist()], [*spaces.tolist(), len(s)]
                if copies[i] > 1:
                    found.append((i, 0, len(starts)))
                rows += [(s[starts[k] : ends[k + window - 1]], i, k) for k in range(len(starts) - window + 1)]
            rows.sort()
            for x, y in zip(rows, rows[1:]):
                if x[0] == y[0]:
                    found += [(x[1], x[2], x[2] + window), (y[1], y[2], y[2] + window)]
        return joined_ranges(found)

    return judge


def removed(docs: DataFrame, window: int = 35, doc_id: str = "doc_id", text: str = "text", kept_text: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept]) of every row.

    A word goes if a window of ``window`` consecutive words that covers it starts anywhere else
    too, in the same document or another; windows are judged on the input. Kept words are
    joined by one space. Null, empty and shorter texts lose nothing; a repeated row counts as
    another document.
    """
    rows = keyed(docs, doc_id, text)
    spans = repeated(rows, Units(True, window, min(GRAM, window)), _judge(window))
    joined = rows.join(spans.select(F.col("key").alias("of"), "spans").hint("shuffle_hash"), F.col("key") == F.col("of"), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, spans in zip(batch.column("body").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = plain_words(body).split()
                kept, at = [], 0
                for a, b in merged(spans):
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                joined = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode()))
            columns = [batch.column("id"), *(pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string())))]
            names = ["id", "n_words", "n_removed", "kept_sha256"]
            if kept_text:
                columns.append(pa.array([o[3] for o in out], pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * kept_text
    return joined.select("id", "body", "spans").mapInArrow(cut, schema)
