"""Ranked lexical search: a hybrid of term-at-a-time and document-at-a-time.

Documents are cut into segments where they are read. A segment is one row: its documents in id
order, their lengths and the posting lists of the terms asked for. Statistics are sums over all
segments. A query then visits every segment: its short lists are added up term by term into
accumulators, which from there on are one more list with a bound of its own; that list and the
long ones are followed document by document, a window of documents at a time, and whatever
cannot reach the best scores so far is skipped. Only a task's best rows per query are shuffled.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roundsman.llm.common import session_ready
from roundsman.session import scratch_path

#: Bytes of text in one segment; a longer document is a segment of its own.
SEGMENT = 16 << 20
#: Bytes of query text worked on at once; queries beyond it follow in further blocks.
QUERY_BLOCK = 4 << 20
#: Lists of up to this share of a segment's documents are added up first.
SHORT = 1 / 16
#: Documents in one step of the document-at-a-time part.
WINDOW = 2048

_UPPER, _LOWER = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B))
# everything in ASCII but digits and letters parts terms
_FOLD = bytes(
    _LOWER[c - 0x41] if c in _UPPER else c if c >= 0x80 or 0x30 <= c <= 0x39 or c in _LOWER else 0x20 for c in range(256)
)
_INT = np.dtype("<i4")


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a text; bytes beyond ASCII belong to terms and are left as they are."""
    return (text or b"").translate(_FOLD).split()


def _place(key) -> tuple:
    """Sorts ids upwards, null first."""
    return (0, 0) if key is None else (1, key)


def _segments(vocabulary: dict[bytes, int]):
    """Rows of documents to rows of segments: ids in order, lengths, posting lists by term."""

    def segment(ids: list, lengths: list[int], terms: list[int], owners: list[int], tfs: list[int], id_type) -> pa.RecordBatch:
        order = sorted(range(len(ids)), key=lambda i: _place(ids[i]))
        place = np.empty(len(ids), _INT)
        place[order] = np.arange(len(ids))
        term, owner, tf = (np.array(x, _INT) for x in (terms, owners, tfs))
        owner = place[owner]
        by_term = np.lexsort((owner, term))
        term, owner, tf = term[by_term], owner[by_term], tf[by_term]
        held, starts = np.unique(term, return_index=True)
        df = np.diff(np.append(starts, len(term)))
        length = np.array(lengths, np.int64)[order]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([int(np.count_nonzero(length))], pa.int64()), pa.array([int(length.sum())], pa.int64()),
                pa.array([[ids[i] for i in order]], pa.list_(id_type)), pa.array([length.tobytes()], pa.binary()),
                pa.array([held.tolist()], pa.list_(pa.int32())), pa.array([df.tolist()], pa.list_(pa.int32())),
                pa.array([owner.tobytes()], pa.binary()), pa.array([tf.tobytes()], pa.binary()),
            ],
            ["n_docs", "n_terms", "ids", "lengths", "terms", "df", "owners", "tfs"],
        )

    def work(batches):
        size, columns, id_type = 0, ([], [], [], [], []), None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if columns[0] and size + len(text or b"") > SEGMENT:
                    yield segment(*columns, id_type)
                    size, columns = 0, ([], [], [], [], [])
                ids, lengths, terms, owners, tfs = columns
                found = terms_of(text)
                for term, n in Counter(found).items():
                    number = vocabulary.get(term)
                    if number is not None:
                        terms.append(number)
                        owners.append(len(ids))
                        tfs.append(n)
                ids.append(key)
                lengths.append(len(found))
                size += len(text or b"")
        if columns[0]:
            yield segment(*columns, id_type)

    return work


class Lists:
    """A segment's posting lists with the score each posting adds, and each list's largest."""

    def __init__(self, row: dict, weights: np.ndarray, n_docs: int, n_terms: int):
        length = np.frombuffer(row["lengths"], np.int64)
        owners, tf = np.frombuffer(row["owners"], _INT), np.frombuffer(row["tfs"], _INT).astype(np.int64)
        terms, df = np.array(row["terms"], np.int64), np.array(row["df"], np.int64)
        m = 100 - 75 + (75 * length * n_docs) // max(n_terms, 1)
        score = np.repeat(weights[terms], df) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[owners]))
        ends = np.cumsum(df)
        self.size = len(length)
        self.lists = {t: (owners[e - d : e], score[e - d : e]) for t, e, d in zip(terms.tolist(), ends.tolist(), df.tolist())}
        self.most = {t: int(s.max()) for t, (_, s) in self.lists.items()}


def _sum_by_document(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One list of several: each document once, in order, with its scores added up."""
    if len(lists) == 1:
        return lists[0]
    docs, scores = np.concatenate([d for d, _ in lists]), np.concatenate([s for _, s in lists])
    order = np.argsort(docs, kind="stable")
    docs, scores = docs[order], scores[order]
    starts = np.flatnonzero(np.append(True, docs[1:] != docs[:-1])) if len(docs) else np.zeros(0, np.int64)
    return docs[starts], (np.add.reduceat(scores, starts) if len(docs) else scores)


def _slice(docs: np.ndarray, scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.searchsorted(docs, (low, high))
    return docs[a:b], scores[a:b]


def search(held: Lists, query: list[tuple[int, int]], top: int, floor: int = 1) -> list[tuple[int, int]]:
    """(score, document) of the ``top`` best documents for (term, repeats); equal scores by document.

    No document below ``floor`` is returned. A document is skipped only where the bounds of
    all lists it can be in stay below the ``top``-th score found, so equal scores are kept.
    """
    short, long = [], []
    for term, repeats in query:
        if term in held.lists and held.most[term] > 0:
            docs, scores = held.lists[term]
            (short if len(docs) <= held.size * SHORT else long).append((docs, scores * repeats))
    if not short and not long:
        return []
    least = max(floor, 1)
    lists = [(*x, int(x[1].max())) for x in long]
    if short:
        docs, sums = _sum_by_document(short)
        lists.append((docs, sums, int(sums.max())))
        if len(sums) >= top:
            # long lists only add, so this many documents reach the accumulators' top-th sum
            least = max(least, int(np.partition(sums, len(sums) - top)[len(sums) - top]))
    # by bound: lists that together stay below the least score make no candidates
    lists.sort(key=lambda x: x[2])
    bounds = np.cumsum([0] + [x[2] for x in lists])
    best: list[tuple[int, int]] = []
    for low in range(0, held.size, WINDOW):
        high = low + WINDOW
        first = int(np.searchsorted(bounds[1:], least))  # bounds[1:][first] is the first that reaches it
        if first == len(lists):
            break
        here = [_slice(docs, scores, low, high) for docs, scores, _ in lists]
        # what the lists hold in this window bounds it closer than the whole lists do
        if sum(int(s.max()) for _, s in here if len(s)) < least:
            continue
        docs, scores = _sum_by_document(here[first:])
        for number in range(first - 1, -1, -1):
            alive = scores + bounds[number + 1] >= least
            docs, scores = docs[alive], scores[alive]
            if not len(docs):
                break
            more, added = here[number]
            if len(more):
                at = np.minimum(np.searchsorted(more, docs), len(more) - 1)
                scores = scores + np.where(more[at] == docs, added[at], 0)
        alive = scores >= least
        if not alive.any():
            continue
        best = sorted(best + [(-s, d) for s, d in zip(scores[alive].tolist(), docs[alive].tolist())])[:top]
        if len(best) == top:
            least = max(least, -best[-1][0])
    return [(-s, d) for s, d in best]


def _best(queries: list[tuple[int, list[tuple[int, int]]]], weights: np.ndarray, n_docs: int, n_terms: int, top: int, names: list[str]):
    """Segments to rows (query, id, score): the task's best documents of every query."""

    def work(batches):
        best: dict[int, list] = {}
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type.value_type
            for row in batch.to_pylist():
                held = Lists(row, weights, n_docs, n_terms)
                ids = row["ids"]
                for number, query in queries:
                    known = best.get(number, [])
                    floor = known[-1][0] if len(known) == top else 1
                    found = [(score, ids[doc]) for score, doc in search(held, query, top, floor)]
                    if found:
                        best[number] = sorted(known + found, key=lambda x: (-x[0], _place(x[1])))[:top]
        if id_type is not None:
            rows = [(number, key, score) for number, found in best.items() for score, key in found]
            columns = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), id_type, pa.int64()))], names
            )

    return work


def _query_block(rows: list) -> tuple[dict[bytes, int], list[tuple[int, list[tuple[int, int]]]]]:
    """Numbers of all terms of a block and every query as (number, [(term, repeats)])."""
    vocabulary: dict[bytes, int] = {}
    queries = []
    for number, row in enumerate(rows):
        counts = Counter(terms_of(row["text"].encode()))
        queries.append((number, [(vocabulary.setdefault(t, len(vocabulary)), n) for t, n in counts.items()]))
    return vocabulary, queries


def rank(
    docs: DataFrame, items: DataFrame, top: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text"
) -> DataFrame:
    """(item_id, rank, doc_id, score): every item's ``top`` best documents with a score above 0.

    Equal scores go by ascending document id, a null id first. Null and empty texts have no
    terms; rows that repeat an id or text are documents, or items, of their own. Equal item
    texts are searched once. Items are worked on in blocks of ``QUERY_BLOCK`` bytes, each of
    which reads the documents once and sends its terms and weights, no larger than the block,
    to the executors. Without items, documents or terms the result is empty.
    """
    spark = docs.sparkSession
    session_ready(spark)
    asked = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    asked = asked.withColumn("key", F.sha2("text", 256))
    distinct = asked.groupBy("key").agg(F.first("text").alias("text"))
    size = distinct.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // QUERY_BLOCK)
    dealt = distinct.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(max(blocks, 1))))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    id_type = rows.schema["id"].dataType
    found = spark.createDataFrame([], rows.select("id").schema.add("key", "string").add("score", "long"))
    for block in range(blocks):
        chosen = dealt.where(F.col("block") == block).select("key", "text").collect()
        found = found.unionByName(_search_block(rows, chosen, top, id_type))
    # within the ids of a part, then among the parts' best: no task meets more than its share
    part = Window.partitionBy("key", "part").orderBy(F.desc("score"), F.asc_nulls_first("id"))
    whole = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_first("id"))
    first = found.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(32))).withColumn("rank", F.row_number().over(part))
    ranked = first.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= top)
    return asked.select("item_id", "key").join(ranked, "key").select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def _search_block(rows: DataFrame, chosen: list, top: int, id_type) -> DataFrame:
    spark = rows.sparkSession
    vocabulary, queries = _query_block(chosen)
    shape = f"n_docs long, n_terms long, ids array<{id_type.simpleString()}>, lengths binary, terms array<int>, df array<int>, owners binary, tfs binary"
    path = scratch_path(spark, "segments")
    rows.mapInArrow(_segments(vocabulary), shape).write.parquet(path)
    segments = spark.read.parquet(path)
    n_docs, n_terms = (int(x or 0) for x in segments.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    pairs = segments.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("x.terms").agg(F.sum("x.df").alias("df"))
    # one row per term of the block
    df = dict(tuple(r) for r in pairs.collect())
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
    keys = spark.createDataFrame([(n, r["key"]) for n, r in enumerate(chosen)], "number int, key string")
    best = segments.select("ids", "lengths", "terms", "df", "owners", "tfs").mapInArrow(
        _best(queries, weights, n_docs, n_terms, top, ["number", "id", "score"]), f"number int, id {id_type.simpleString()}, score long"
    )
    return best.join(keys, "number").select("id", "key", "score")
