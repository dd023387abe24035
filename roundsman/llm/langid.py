"""Language identification, words first.

A known word counts by its log frequency in each language. An unseen word falls back to the
character n-grams of length 4, and where none of those is known to 3, 2 and 1.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roundsman.llm.common import kept_state
from roundsman.session import cut_lineage

#: Labelled texts the tables are fitted on, about (a hash of the text picks them; equal texts are one).
SAMPLE_ROWS = 4_000
LENGTHS = (4, 3, 2, 1)
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
_SMOOTH = 0.5


def _grams(word: str, n: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def words_of(text: str | None) -> Counter:
    """Letter runs in lower case with their counts."""
    return Counter(_WORD.findall((text or "").lower()))


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (size 0) and of n-grams by language, one row per batch, language and unit."""
    for batch in batches:
        by: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, Counter()).update(words_of(text))
        for lang, words in by.items():
            units: Counter = Counter()
            for word, n in words.items():
                units[(0, word)] += n
                for size in LENGTHS:
                    for gram in _grams(word, size):
                        units[(size, gram)] += n
            keys = list(units)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(keys)), pa.array([k[0] for k in keys], pa.int32()),
                pa.array([k[1] for k in keys]), pa.array([units[k] for k in keys], pa.int64()),
            ], names=["lang", "size", "unit", "n"])


def fit(
    labelled: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS
) -> tuple[list[str], dict]:
    """Languages (sorted) and {size: (units, log frequencies)}, learnt from rows with text and language.

    The tables hold every unit of the sample, which bounds them. Ids have no part in the choice,
    and a text that is there many times with a language counts once.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("body"), F.xxhash64(text).alias("mark")
    )
    total = rows.select("lang", "mark").distinct().count()
    steps = 1 << 30
    share = steps if total <= sample_rows else int(sample_rows / total * steps)
    picked = rows.where(F.pmod(F.xxhash64("mark", F.lit("sample")), F.lit(steps)) < share)
    units = cut_lineage(
        picked.groupBy("lang", "mark").agg(F.first("body").alias("body")).select("lang", "body")
        .mapInArrow(_tally, "lang string, size int, unit string, n long")
        .groupBy("lang", "size", "unit").agg(F.sum("n").alias("n"))
    )
    langs = sorted(r.lang for r in units.select("lang").distinct().collect())
    model = {}
    for size in (0, *LENGTHS):
        found = units.where(F.col("size") == size).select("lang", "unit", "n").toArrow()
        known = pc.unique(found["unit"]).sort()
        counts = np.zeros((len(known), len(langs)))
        at = pc.index_in(found["unit"], known).to_numpy(), pc.index_in(found["lang"], pa.array(langs, pa.string())).to_numpy()
        counts[at] = found["n"].to_numpy()
        logs = np.log((counts + _SMOOTH) / (counts.sum(axis=0) + _SMOOTH * (len(known) + 1)))
        model[size] = (known.to_pylist(), logs.astype(np.float32))
    return langs, model


class Scorer:
    """The tables of a worker, over the words of a whole batch at once.

    Words lead to rows of a matrix by a dictionary. n-grams are whole numbers in sorted order,
    16 bits a character as numbered by the model's own characters.
    """

    def __init__(self, langs: list[str], model: dict):
        self.langs = langs
        self.places = {word: i for i, word in enumerate(model[0][0])}
        self.logs = {size: logs for size, (_, logs) in model.items()}
        self.letters = np.array(sorted({ord(c) for unit in model[1][0] for c in unit}), np.int32)
        if len(self.letters) >= 1 << 16:
            raise ValueError("more than 65,535 characters in the labelled sample")
        self.grams = {}
        for size in LENGTHS:
            codes = self._codes(model[size][0])[0]
            packed = self._pack(codes, size)[:, 0] if len(codes) else np.zeros(0, np.uint64)
            order = np.argsort(packed)
            self.grams[size] = packed[order]
            self.logs[size] = self.logs[size][order]

    def _codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' characters by the model's numbers, 0 for others and past the end; lengths."""
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.zeros((len(texts), max(int(length.max(initial=0)), max(LENGTHS))), np.uint64)
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.int32)
        at = np.minimum(np.searchsorted(self.letters, points), max(len(self.letters) - 1, 0))
        numbers = np.where(self.letters[at] == points, at + 1, 0) if len(self.letters) else np.zeros(len(points), np.int64)
        codes[np.arange(codes.shape[1]) < length[:, None]] = numbers
        return codes, length

    @staticmethod
    def _pack(codes: np.ndarray, size: int) -> np.ndarray:
        """All n-grams of each row; 0 where a character is none of the model's."""
        width = codes.shape[1] - size + 1
        packed, whole = np.zeros((len(codes), width), np.uint64), np.ones((len(codes), width), bool)
        for k in range(size):
            part = codes[:, k : k + width]
            packed = (packed << np.uint64(16)) | part
            whole &= part > 0
        return np.where(whole, packed, np.uint64(0))

    def back_off(self, words: list[str]) -> np.ndarray:
        """Log frequencies by language of unseen words, each from its longest known n-grams."""
        out = np.zeros((len(words), len(self.langs)))
        by_length = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
        # words of like length together, so that a long one does not widen all rows
        for low in range(0, len(words), 4096):
            part = by_length[low : low + 4096]
            codes, _ = self._codes([f"<{words[i]}>" for i in part])
            open_rows = np.arange(len(part))
            for size in LENGTHS:
                known = self.grams[size]
                if not len(known) or not len(open_rows):
                    continue
                packed = self._pack(codes[open_rows], size)
                at = np.minimum(np.searchsorted(known, packed), len(known) - 1)
                row, column = np.nonzero((known[at] == packed) & (packed > 0))
                hits = np.bincount(row, minlength=len(open_rows))
                logs = self.logs[size][at[row, column]]
                for k in range(len(self.langs)):
                    sums = np.bincount(row, weights=logs[:, k], minlength=len(open_rows))
                    out[part[open_rows], k] = sums / np.maximum(hits, 1)
                open_rows = open_rows[hits == 0]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, has letters) of every text."""
        numbers: dict[str, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        found = [list(map(numbers.__getitem__, _WORD.findall((t or "").lower()))) for t in texts]
        length = np.fromiter(map(len, found), np.int64, len(found))
        tokens = np.fromiter(itertools.chain.from_iterable(found), np.int64, int(length.sum()))
        words = list(numbers)
        # a run of \w that is no digit may still hold no letter
        letter = np.fromiter((any(map(str.isalpha, w)) for w in words), bool, len(words))
        doc = np.repeat(np.arange(len(texts)), length)
        letters = np.bincount(doc, weights=letter[tokens], minlength=len(texts)) > 0
        if not self.langs or not len(words):
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), letters
        place = np.fromiter((self.places.get(w, -1) for w in words), np.int64, len(words))
        logs = self.logs[0][place].astype(np.float64)
        unseen = np.flatnonzero(place < 0)
        logs[unseen] = self.back_off([words[i] for i in unseen])
        sums = np.stack([np.bincount(doc, weights=logs[tokens, k], minlength=len(texts)) for k in range(len(self.langs))], axis=1)
        best = sums.argmax(axis=1)  # ties go to the first name
        share = np.exp(sums - sums.max(axis=1, keepdims=True))
        score = np.where(letters, np.minimum(1.0, share.max(axis=1) / share.sum(axis=1)), 0.0)
        return [self.langs[b] if there else UNKNOWN for b, there in zip(best, letters)], score, letters


def predict(docs: DataFrame, model: tuple[list[str], dict], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and has_letters of every whole text; columns of these names are replaced.

    A null text, one without letters, or a model without languages gives ``und`` and 0; of
    these only the last has letters. No shuffle: the languages are found where the texts are
    read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score", "has_letters")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = shared.value
        scorer = kept_state("langid", value, lambda: Scorer(*value))
        for batch in batches:
            langs, score, letters = scorer.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(score), pa.array(letters)],
                names=[*batch.schema.names, "lang_pred", "score", "has_letters"],
            )

    schema = T.StructType([
        *docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("has_letters", T.BooleanType()),
    ])
    return docs.mapInArrow(run, schema)
