"""Phrase collocations from a weighted de Bruijn graph over words.

An edge is a run of ``longest`` words with the number of times it occurs; it leads from the
node of its first ``longest - 1`` words to the node of its last ones. Where a piece ends too
early for an edge, the words left over are kept as a piece end. The number of times a node
(or any shorter run) occurs is then the weight that flows out of it plus its piece ends, so
shorter runs are never counted in the text.

Tasks count edges per chunk of text and send one row per node with its outgoing edges. Rows
meet by the node's first word, so that flows of a word are complete in one partition; words
and nodes that hold a large share of the rows, known from a sample, are dealt by more of the
phrase and their partial flows are added up afterwards. The sample decides the plan only.
Sorted partitions are merged as they stream by, so no partition is ever held whole.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundsman.llm.common import session_ready
from roundsman.session import cut_lineage

# Piece separators and blanks.
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b"\t"

#: Bytes of text counted at once in a task.
CHUNK = 4 << 20
#: A word or node is dealt by more of its phrase from this share of all rows on.
HOT_SHARE = 1 / 512
#: One document in so many is read to find hot words.
SAMPLE = 64
#: Parts that the edges of a hot node are dealt to.
SPREAD = 64

# capitals never occur after lower-casing, so one of them can stand for the end of a piece
_END = b"A"
_FOLD = bytes.maketrans(
    bytes(range(65, 91)) + SEPARATORS + BLANKS, bytes(range(97, 123)) + _END * len(SEPARATORS) + b" " * len(BLANKS)
)
#: Stands for "no next word" in a row's edges; words hold neither blank.
_NONE = "\t"
_ROW = "lang string, node string, part long, hot tinyint, n long, edges string"


def _chunks(texts: list[bytes]) -> Iterator[bytes]:
    """The texts' pieces, folded, in chunks that end where a piece does."""
    held, size = [], 0
    for text in texts:
        text = text.translate(_FOLD)
        start = 0
        while start < len(text):
            end = len(text)
            if end - start > CHUNK:
                cut = text.find(_END, start + CHUNK)
                end = cut if cut >= 0 else end
            held.append(text[start:end])
            size += end - start
            start = end + 1
            if size >= CHUNK:
                yield _END.join(held)
                held, size = [], 0
    if held:
        yield _END.join(held)


def _count(chunk: bytes, longest: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Vocabulary, word numbers of the distinct runs (0: past the piece's end) and their counts."""
    tokens = chunk.replace(_END, b" " + _END + b" ").split()
    numbers: dict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    numbers[_END]
    first = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
    words = [first]
    for _ in range(longest - 1):
        after = np.append(words[-1][1:], 0)
        # the shifted row may already have lost its own start
        after[words[-1] == 0] = 0
        words.append(after)
    there = first != 0
    runs = np.stack([w[there] for w in words])
    width = len(numbers)
    if width**longest < 1 << 62:
        code = runs[0]
        for row in runs[1:]:
            code = code * width + row
        code, n = np.unique(code, return_counts=True)
        rows = []
        for _ in range(longest):
            code, row = np.divmod(code, width)
            rows.append(row)
        runs = np.stack(rows[::-1])
    elif runs.size:
        runs, n = np.unique(runs, axis=1, return_counts=True)
    else:
        n = np.zeros(0, np.int64)
    return list(numbers), runs, n


def _joined(vocabulary: pa.Array, rows: np.ndarray) -> pa.Array:
    """Words of each column of ``rows`` joined by a blank, 0 left out."""
    parts = [vocabulary.take(pa.array(row, mask=row == 0)) for row in rows]
    return parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, " ", null_handling="skip")


def _languages(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    langs = batch.column(0).dictionary_encode()
    texts = batch.column(1).cast(pa.binary())
    numbers = langs.indices.to_numpy()
    for number, lang in enumerate(langs.dictionary.to_pylist()):
        yield lang, texts.filter(pa.array(numbers == number)).to_pylist()


def _node_starts(runs: np.ndarray) -> np.ndarray:
    """First run of every node; runs are sorted."""
    if not runs.shape[1]:
        return np.zeros(0, np.int64)
    fresh = (runs[:-1, 1:] != runs[:-1, :-1]).any(axis=0)
    return np.append(0, np.flatnonzero(fresh) + 1)


def _shares(longest: int):
    """Rows (lang, phrase, n): the first words and nodes that hold many of a chunk's distinct edges."""

    def work(batches):
        for batch in batches:
            for lang, texts in _languages(batch):
                for chunk in _chunks(texts):
                    words, runs, n = _count(chunk, longest)
                    if not len(n):
                        continue
                    vocabulary = pa.array(words, pa.binary()).cast(pa.string())
                    phrases, sums = [""], [len(n)]
                    for rows in (runs[:1], runs[:-1])[: longest - 1]:
                        starts = _node_starts(np.vstack([rows, np.zeros((1, rows.shape[1]), rows.dtype)]))
                        size = np.diff(np.append(starts, len(n)))
                        large = size >= len(n) * HOT_SHARE / 2
                        phrases += _joined(vocabulary, rows[:, starts[large]]).to_pylist()
                        sums += size[large].tolist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(sums)), pa.array(phrases), pa.array(sums, pa.int64())], ["lang", "phrase", "n"]
                    )

    return work


def _edges(longest: int, hot: frozenset[tuple[str, str]]):
    """One row per node (and part of a hot node) of every chunk, with its outgoing edges."""

    def work(batches):
        for batch in batches:
            for lang, texts in _languages(batch):
                hot_here = {phrase for at, phrase in hot if at == lang}
                seed = zlib.crc32(lang.encode())
                for chunk in _chunks(texts):
                    words, runs, n = _count(chunk, longest)
                    if not len(n):
                        continue
                    sums = np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words))
                    hot_word = np.zeros(len(words), bool)
                    vocabulary = pa.array(words, pa.binary()).cast(pa.string())
                    spread = np.zeros(len(n), np.int64)
                    starts = _node_starts(runs)
                    lasting = np.diff(np.append(starts, len(n)))
                    names = _joined(vocabulary, runs[:-1, starts])
                    if hot_here:
                        known = pa.array(sorted(hot_here), pa.string())
                        hot_word = pc.is_in(vocabulary, known).to_numpy(zero_copy_only=False)
                        # a node shorter than the others is a piece end
                        hot_node = pc.is_in(names, known).to_numpy(zero_copy_only=False) & (runs[-2, starts] != 0)
                        spread = np.where(np.repeat(hot_node, lasting), 1 + sums[runs[-1]] % SPREAD, 0)
                        order = np.lexsort((spread, np.repeat(np.arange(len(starts)), lasting)))
                        runs, n, spread = runs[:, order], n[order], spread[order]
                        starts = _node_starts(np.vstack([runs[:-1], spread, runs[-1:]]))
                        names = _joined(vocabulary, runs[:-1, starts])
                    first = runs[0, starts]
                    part = seed + sums[first]
                    wider = hot_word[first]
                    for row in runs[1:-1]:
                        part = np.where(wider, part * 31 + sums[row[starts]], part)
                    part = part * 67 + spread[starts]
                    figures, which = np.unique(n, return_inverse=True)
                    pool = pa.concat_arrays([vocabulary, pa.array([str(f) for f in figures] + [_NONE])])
                    ends = len(words) + len(figures)
                    pairs = np.empty(2 * len(n), np.int64)
                    pairs[::2] = np.where(runs[-1] == 0, ends, runs[-1])
                    pairs[1::2] = len(words) + which
                    edges = pc.binary_join(
                        pa.ListArray.from_arrays(pa.array(np.append(2 * starts, 2 * len(n)), pa.int32()), pool.take(pa.array(pairs))), " "
                    )
                    table = pa.table(
                        [
                            pa.repeat(lang, len(starts)), names, pa.array(part),
                            # 1: flows of the prefixes are partial, 2: the node's flow too
                            pa.array(np.where(spread[starts] > 0, 2, wider), pa.int8()),
                            pa.array(np.add.reduceat(n, starts)), edges,
                        ],
                        ["lang", "node", "part", "hot", "n", "edges"],
                    )
                    yield from table.to_batches(65_536)

    return work


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["lang", "phrase", "n"]
    )


class _Flow:
    """Adds up consecutive rows of one phrase of ``words`` words; holds the one the next batch may go on with."""

    def __init__(self, words: int, least: int, partial: int, edges: bool):
        self.words, self.least, self.partial, self.with_edges = words, least, partial, edges
        self.key, self.n, self.hot = None, 0, 0
        self.rows: list[str] = []
        self.counts: Counter[str] = Counter()

    def _fold(self, rows: list[str]) -> None:
        for row in rows:
            items = row.split(" ")
            for word, n in zip(items[::2], items[1::2]):
                self.counts[word] += int(n)

    def _done(self) -> list[tuple]:
        out = []
        if self.key is not None and self.key[1].count(" ") == self.words - 1:
            if self.n >= self.least or self.hot >= self.partial:
                out.append((*self.key, self.n))
                self._fold(self.rows)
                # an edge is whole in its partition, however hot its node
                out += [
                    (self.key[0], f"{self.key[1]} {word}", n) for word, n in self.counts.items() if n >= self.least and word != _NONE
                ]
        self.key, self.n, self.hot, self.rows, self.counts = None, 0, 0, [], Counter()
        return out

    def add(self, langs: pa.Array, phrases: pa.Array, n: np.ndarray, hot: np.ndarray, edges: pa.Array) -> list[tuple]:
        fresh = pc.or_(
            pc.not_equal(phrases.slice(1), phrases.slice(0, len(phrases) - 1)), pc.not_equal(langs.slice(1), langs.slice(0, len(langs) - 1))
        ).to_numpy(zero_copy_only=False)
        starts = np.append(0, np.flatnonzero(fresh) + 1)
        ends = np.append(starts[1:], len(phrases))
        sums, hots = np.add.reduceat(n, starts), np.maximum.reduceat(hot, starts)
        # runs inside the batch count only if they reach the threshold; the outer two may go on
        inner = (sums >= self.least) | (hots >= self.partial)
        inner[[0, -1]] = True
        chosen = np.flatnonzero(inner)
        at = pa.array(starts[chosen])
        out: list[tuple] = []
        for run, lang, phrase in zip(chosen.tolist(), langs.take(at).to_pylist(), phrases.take(at).to_pylist()):
            if (lang, phrase) != self.key:
                out += self._done()
                self.key = (lang, phrase)
            self.n += int(sums[run])
            self.hot = max(self.hot, int(hots[run]))
            if self.with_edges:
                self.rows += edges.slice(starts[run], ends[run] - starts[run]).to_pylist()
        if len(self.rows) > 256:
            self._fold(self.rows)
            self.rows = []
        return out

    def finish(self) -> list[tuple]:
        return self._done()


def _flows(longest: int, least: int):
    """Sorted node rows to phrases with their counts: flows of nodes and of their prefixes, edges, words."""

    def work(batches):
        flows = [_Flow(k, least, 2 if k == longest - 1 else 1, k == longest - 1) for k in range(1, longest)]
        total: Counter[str] = Counter()
        for batch in batches:
            if not batch.num_rows:
                continue
            langs, n, hot = batch.column("lang"), batch.column("n").to_numpy(), batch.column("hot").to_numpy()
            coded = langs.dictionary_encode()
            for lang, words in zip(coded.dictionary.to_pylist(), np.bincount(coded.indices.to_numpy(), n).tolist()):
                total[lang] += round(words)
            out = []
            for flow in flows:
                name = "node" if flow.with_edges else f"p{flow.words}"
                out += flow.add(langs, batch.column(name), n, hot, batch.column("edges"))
            yield _batch(out)
        out = [row for flow in flows for row in flow.finish()]
        yield _batch(out + [(lang, "", words) for lang, words in total.items()])

    return work


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, phrase, words, n): runs of up to ``longest`` words that occur ``least`` times or more.

    A row of 0 words holds the number of words of its language. Only ``text`` and ``lang``
    are read, so other columns cannot clash. A null text has no words, a null language is
    ``und``; repeated rows count as often as they are there. The result is checkpointed.
    """
    session_ready(docs.sparkSession)
    pieces = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")
    ).where(F.col("text").isNotNull())
    sample = pieces.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    shares = sample.mapInArrow(_shares(longest), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    shares = cut_lineage(shares)
    total = shares.where("phrase = ''").agg(F.sum("n")).first()[0] or 0
    # at most 1 / HOT_SHARE words and as many nodes
    hot = frozenset((r.lang, r.phrase) for r in shares.where((F.col("phrase") != "") & (F.col("n") >= total * HOT_SHARE)).collect())
    rows = pieces.mapInArrow(_edges(longest, hot), _ROW)
    prefixes = [F.substring_index("node", " ", k).alias(f"p{k}") for k in range(1, longest - 1)]
    # by whole words, as a blank is not the least character of a word
    order = ["p1", "lang", *[f"p{k}" for k in range(2, longest - 1)], "node"] if prefixes else ["lang", "node"]
    flows = (
        rows.repartition("part").select("lang", *prefixes, "node", "hot", "n", "edges").sortWithinPartitions(*order)
        .mapInArrow(_flows(longest, least), "lang string, phrase string, n long")
    )
    words = F.when(F.col("phrase") == "", 0).otherwise(F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1)
    whole = flows.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("phrase") == ""))
    return cut_lineage(whole.select("lang", "phrase", words.alias("words"), "n"))


def _head(phrase: Column, words: int) -> Column:
    return F.substring_index(phrase, " ", words)


def _tail(phrase: Column, words: int) -> Column:
    return F.substring_index(phrase, " ", -words)


def unary_paths(counts: DataFrame, longest: int = 3) -> DataFrame:
    """The graph's edges with the unary path they lie on: (lang, phrase, n, path, pos, inner).

    ``path`` is the path's first edge, ``pos`` the edge's place on it from 0, ``inner`` whether
    the edge's left node is inside the path. A node with one way in and one way out, both as
    heavy as itself, neither starts nor ends a piece, so all edges of a path weigh the same
    and the counts above the threshold are enough to see it. Pointers double each round, so a
    path of p edges takes log2(p) rounds.
    """
    node = counts.where(F.col("words") == longest - 1).select("lang", F.col("phrase").alias("node"), F.col("n").alias("flow"))
    edge = counts.where(F.col("words") == longest).select(
        "lang", "phrase", "n", _head(F.col("phrase"), longest - 1).alias("left"), _tail(F.col("phrase"), longest - 1).alias("right")
    )
    into = edge.select("lang", F.col("right").alias("node"), F.col("n").alias("flow"), F.col("phrase").alias("before"))
    links = into.join(node, ["lang", "node", "flow"]).join(
        edge.select("lang", F.col("left").alias("node"), F.col("n").alias("flow"), "phrase"), ["lang", "node", "flow"]
    ).select("lang", "phrase", "before")
    state = cut_lineage(
        edge.join(links, ["lang", "phrase"], "left").select(
            "lang", "phrase", "n", F.col("before").isNotNull().alias("inner"),
            F.coalesce("before", "phrase").alias("path"), F.col("before").isNotNull().cast("long").alias("pos"),
        )
    )
    while True:
        ahead = state.where("inner").select("lang", F.col("phrase").alias("path"), F.col("path").alias("far"), F.col("pos").alias("step"))
        state = cut_lineage(
            state.join(ahead, ["lang", "path"], "left").select(
                "lang", "phrase", "n", "inner", F.coalesce("far", "path").alias("path"),
                (F.col("pos") + F.coalesce("step", F.lit(0))).alias("pos"), F.col("far").isNotNull().alias("moved"),
            )
        )
        if state.where("moved").isEmpty():
            return state.drop("moved")


def collocations(
    docs: DataFrame, longest: int = 3, least: int = 10, cover: int = 50, top: int = 2000, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, path_words): each language's best phrases.

    A phrase's score is ``floor(1000000 a² / (l r))`` at its weakest cut; phrases inside a
    longer one with ``cover`` per cent of their count are dropped. ``path_words`` is the
    length of the repeated passage (unary path) around a longest phrase, else the phrase's
    own. Scores are decimals of 38 digits, so counts up to 10^16 stay exact. Without
    documents, words or candidates the result is empty.
    """
    counts = phrase_counts(docs, longest, least, text, lang)
    paths = unary_paths(counts, longest)
    length = paths.groupBy("lang", "path").agg((F.max("pos") + longest).alias("path_words"))
    passage = paths.join(length, ["lang", "path"]).select("lang", "phrase", "path_words")
    found = counts.where("words >= 2").withColumnRenamed("n", "a")
    # nodes inside a path are in an edge as frequent as themselves: covered without a look at counts
    if cover <= 100:
        inside = paths.where("inner").select("lang", _head(F.col("phrase"), longest - 1).alias("phrase"))
        found = found.join(inside, ["lang", "phrase"], "left_anti")
    longer = found if longest == 2 else counts.where("words >= 3").select(
        "lang", F.explode(F.array(
            F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)")
        )).alias("phrase"), "n",
    ).groupBy("lang", "phrase").agg(F.max("n").alias("around"))
    if longest > 2:
        found = found.join(longer, ["lang", "phrase"], "left").where(
            F.col("around").isNull() | (100 * F.col("around") < cover * F.col("a"))
        )
    cuts = found.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "*", F.expr("substring_index(phrase, ' ', k)").alias("lp"), F.expr("substring_index(phrase, ' ', k - words)").alias("rp")
    )
    for side, count in (("lp", "l"), ("rp", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(count)), ["lang", side])
    whole = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r")}
    times = (F.lit(1_000_000).cast("decimal(7,0)") * (whole["a"] * whole["a"])).alias("num")
    scored = cuts.select("*", times, (whole["l"] * whole["r"]).alias("den")).withColumn("score", F.expr("num div den"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select(
        "lang", "phrase", "a", "b.l", "b.r", "b.score"
    )
    # two steps, so that no task meets more than a few lists of `top` rows
    ranked = _first(best, ["lang", "deal"], top, F.pmod(F.xxhash64("phrase"), F.lit(32)))
    ranked = _first(ranked.drop("rank"), ["lang"], top)
    total = counts.where("words = 0").select("lang", "n")
    return ranked.join(total, "lang").join(passage, ["lang", "phrase"], "left").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score",
        F.coalesce("path_words", F.size(F.split("phrase", " ")).cast("long")).alias("path_words"),
    )


def _first(rows: DataFrame, keys: list[str], top: int, deal: Column | None = None) -> DataFrame:
    from pyspark.sql import Window

    if deal is not None:
        rows = rows.withColumn("deal", deal)
    by = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).drop("deal")
