"""BPE encoding by speculation: greedy longest match proposes, a vectorised check accepts.

A proposal is right when every two neighbouring tokens are compatible, that is when merging
their joined text would leave the border between them. The merge of the tokens' edge parts
across the border decides that, and numpy tests it for all pairs of a batch at once. Only
words with an incompatible pair are merged rule by rule.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from roundsman.llm.common import kept_state
from roundsman.llm.hashing import chunks

#: Distinct words a worker remembers.
CACHE_WORDS = 200_000
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SPACE = regex.compile(r"\s+")


def _byte_letters() -> list[str]:
    """The visible character that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Tokenizer:
    """The vocabulary file's normaliser, splitter and merges, for lower-case models with word ends."""

    def __init__(self, spec: dict, cache_words: int = CACHE_WORDS):
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.texts = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: r for r, pair in enumerate(merges)}
        self.letters = dict(enumerate(_byte_letters()))
        n = max(self.texts) + 1
        #: rank at which a token arises (-1: a single symbol) and the two parts it arises from
        self.born = np.full(n, -1, np.int64)
        self.left = np.full(n, -1, np.int64)
        self.right = np.full(n, -1, np.int64)
        codes = np.empty(len(merges), np.int64)
        for r, (a, b) in enumerate(merges):
            t, i, j = self.ids[a + b], self.ids[a], self.ids[b]
            codes[r] = i * n + j
            if self.born[t] < 0:
                self.born[t], self.left[t], self.right[t] = r, i, j
        order = np.argsort(codes, kind="stable")
        self.codes, self.code_ranks, self.n = codes[order], order, n
        # a token that its own text would not merge into can't be proposed
        made = np.flatnonzero(self.born >= 0)
        sound = self.compatible(self.left[made], self.right[made], self.born[made])
        own = set(made[~sound].tolist())
        for t in made[np.argsort(self.born[made])].tolist():
            if self.left[t] in own or self.right[t] in own:
                own.add(t)
        self.inner = {t: i for t, i in self.ids.items() if i not in own and not t.endswith(self.end)}
        self.final = {t.removesuffix(self.end): i for t, i in self.ids.items() if i not in own and t.endswith(self.end)}
        self.longest = max(map(len, self.ids))
        self.known: dict[str, bytes] = {}
        self.cache_words = cache_words
        self.exact_words = 0

    def compatible(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """Whether the border between each ``a`` and ``b`` outlives all merges (those before ``below``)."""
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), len(self.codes), np.int64) if below is None else below.copy()
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            code = x * self.n + y
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            rank = np.where(self.codes[at] == code, self.code_ranks[at], len(self.codes))
            bad = rank < limit[live]
            good[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            # look at the state before the later of the two arose: its part at the border
            bx, by = self.born[x], self.born[y]
            go_left = bx > by
            more = np.maximum(bx, by) >= 0
            # at equal ranks the pair further left merges first, so the right one is undone first
            limit[live] = np.minimum(limit[live], np.where(go_left, bx, by + 1))
            a[live] = np.where(go_left & more, self.right[x], x)
            b[live] = np.where(~go_left & more, self.left[y], y)
            live = live[more]
        return good

    def propose(self, word: str) -> list[int]:
        out, at, size = [], 0, len(word)
        inner, final = self.inner, self.final
        while at < size:
            if size - at <= self.longest and (t := final.get(word[at:])) is not None:
                out.append(t)
                break
            for stop in range(min(size - 1, at + self.longest), at, -1):
                if (t := inner.get(word[at:stop])) is not None:
                    out.append(t)
                    at = stop
                    break
            else:
                return []
        return out

    def merge(self, word: str) -> list[int]:
        """The merges themselves, lowest rank first and leftmost among equals."""
        import heapq

        parts = [*word[:-1], word[-1] + self.end]
        after = list(range(1, len(parts))) + [-1]
        before = list(range(-1, len(parts) - 1))
        heap = [(r, i, p, q) for i, (p, q) in enumerate(zip(parts, parts[1:])) if (r := self.ranks.get((p, q))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, p, q = heapq.heappop(heap)
            j = after[i]
            if parts[i] != p or j < 0 or parts[j] != q:
                continue
            parts[i], parts[j] = p + q, ""
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (r := self.ranks.get((parts[k], parts[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k, parts[k], parts[after[k]]))
        return [self.ids[p] for p in parts if p]

    def learn(self, words: set[str]) -> None:
        """Encode words not yet remembered: propose all, check all pairs at once, merge the failures."""
        new = list(words)
        shown = ["".join(map(self.letters.__getitem__, w.encode("utf-8", "replace"))) for w in new]
        proposals = [self.propose(w) for w in shown]
        sizes = np.array([len(p) for p in proposals], np.int64)
        flat = np.array([t for p in proposals for t in p], np.int64)
        owner = np.repeat(np.arange(len(new)), sizes)
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        failed = sizes == 0
        failed[owner[pair[~self.compatible(flat[pair], flat[pair + 1])]]] = True
        for i in np.flatnonzero(failed).tolist():
            proposals[i] = self.merge(shown[i])
        self.exact_words += int(failed.sum())
        for word, ids in zip(new, proposals, strict=True):
            self.known[word] = np.array(ids, "<u4").tobytes()

    def split(self, text: str) -> list[str]:
        """Normalised words of a stretch without special tokens."""
        text = _SPACE.sub(" ", unicodedata.normalize("NFC", text))
        # character by character, so no final sigma
        return _SPLIT.findall(text.replace("Σ", "σ").lower())

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        pieces: list[list] = []
        for text in texts:
            parts = self.cut.split(text or "") if self.cut else [text or ""]
            words: list = []
            for k, part in enumerate(parts):
                if k % 2:
                    words.append(self.special[part])
                elif part:
                    words += self.split(part)
            pieces.append(words)
        if len(self.known) > self.cache_words:
            self.known.clear()
        new = {w for words in pieces for w in words if w not in self.known and not isinstance(w, int)}
        if new:
            self.learn(new)
        for t in self.special.values():
            self.known[t] = np.array([t], "<u4").tobytes()
        return [b"".join(map(self.known.__getitem__, words)) for words in pieces]

    def decode(self, ids: bytes) -> str:
        """Without a decoder in the file, the tokens' strings joined by spaces."""
        return " ".join(map(self.texts.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(
    docs: DataFrame, vocabulary: str, text: str = "text", ids: bool = True, decoded: bool = False, digests: bool = False,
) -> DataFrame:
    """``docs`` with n_tokens and, as asked for, ids, decoded, ids_sha256 and decoded_sha256 of every whole text.

    ``ids`` are little-endian unsigned 32-bit integers. ``vocabulary`` is the path of a
    tokenizer file on the driver; its content is broadcast (a vocabulary is a fixed size).
    A null text is the empty one: no ids, an empty string. Columns of these names are replaced.
    """
    with open(vocabulary, encoding="utf-8") as file:
        content = file.read()
    shared = docs.sparkSession.sparkContext.broadcast(content)
    made: dict[str, T.DataType] = {"n_tokens": T.LongType()}
    if ids:
        made["ids"] = T.BinaryType()
    if decoded:
        made["decoded"] = T.StringType()
    if digests:
        made |= {"ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    docs = docs.drop(*made)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = shared.value
        tokenizer = kept_state("bpe", value, lambda: Tokenizer(json.loads(value)))
        for whole in batches:
            # the words of a text take many times its bytes, so few texts are at work at once
            sizes = pc.fill_null(pc.binary_length(whole.column(at)), 0).to_pylist()
            for start, stop in chunks(sizes):
                batch = whole.slice(start, stop - start)
                found = tokenizer.encode_batch(batch.column(at).to_pylist())
                new = {"n_tokens": pa.array([len(i) // 4 for i in found], pa.int64())}
                if ids:
                    new["ids"] = pa.array(found, pa.binary())
                if decoded or digests:
                    texts = [tokenizer.decode(i) for i in found]
                if decoded:
                    new["decoded"] = pa.array(texts, pa.string())
                if digests:
                    new["ids_sha256"] = pa.array([hashlib.sha256(i).hexdigest() for i in found], pa.string())
                    new["decoded_sha256"] = pa.array([hashlib.sha256(d.encode()).hexdigest() for d in texts], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, *new.values()], names=[*batch.schema.names, *new])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(k, v) for k, v in made.items())]))
