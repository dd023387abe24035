"""N-gram Jaccard join with vertical partitioning.

The n-grams of all documents have one global order, which is cut into fragments. Each
fragment holds its piece of every document's set and counts on its own: how common each
n-gram is, and, for a candidate pair, how many n-grams both pieces share. What belongs
together is summed: the counts of a document to its prefix, the overlaps of a pair to its
similarity.

Only n-grams of more than one set can count. A set links only if enough of its n-grams are
shared at all, and two linked sets share one of the rarest (their prefixes). Sets that meet
there are candidates, unless their spread over the order already rules a link out. They are compared with a growing number of pivots of each meeting
place, and sets already in one component are not compared again, so a large group of near
copies costs a few comparisons per member instead of one per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundsman.llm.common import components, kept_state
from roundsman.llm.hashing import chunks, mix, shingle_sets
from roundsman.session import cut_lineage, scratch_path

#: N-grams of one fragment, all documents together.
FRAGMENT_GRAMS = 2_000_000
#: Neighbouring fragments that travel to one task, which counts them one after another: a set is named once for all.
FRAGMENTS_PER_TASK = 4
#: Most buckets of a table (Spark's own limit); beyond it a bucket holds several fragments.
MAX_BUCKETS = 100_000
#: Pairs sent to the fragments as one packed row.
PAIRS_PER_CHUNK = 32_768
#: Bins that bound the overlap of two sets from above.
BINS = 64
#: Growth of the number of pivots from round to round.
PIVOT_GROWTH = 16
#: of a cell: n-grams of the set, those from the cell on in the global order, prefix n-grams in it
_CELL = np.dtype([("n", "<u4"), ("rest", "<u4"), ("take", "<u4")])
#: of a prefix n-gram: n-grams of its set, those from it on in the global order
_PLACE = np.dtype([("n", "<u4"), ("rest", "<u4")])
_PARTS = "kind int, key long, a binary, b binary, c binary, d binary"


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple]:
    """(row numbers, n-grams, n-grams per row, 64-bit set identity) of parts of a batch."""
    texts = [(t or "").encode("utf-8", "replace").lower() for t in batch.column("body").to_pylist()]
    for start, stop in chunks([len(t) for t in texts]):
        found, counts = shingle_sets(texts[start:stop], size)
        ends = np.cumsum(counts)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(found + np.uint64(1)))))
        same = mix((total[ends] - total[ends - counts]) ^ mix(counts.astype(np.uint64)))
        yield np.arange(start, stop), found, counts, same.view(np.int64)


def shingled(docs: DataFrame, size: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, mark: hash of the text, same: identity of the n-gram set, n: its size) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_state("jaccard_join", None, lambda: None)  # lets go what an earlier operator has left
        for batch in batches:
            for rows, _, counts, same in _sets(batch, size):
                own = [batch.column(c).take(pa.array(rows)) for c in ("id", "mark")]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(same), pa.array(counts.astype(np.int64))], names=["id", "mark", "same", "n"]
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("body"))
    return rows.mapInArrow(run, "id long, mark long, same long, n long")


def _pack(*arrays: np.ndarray) -> list[bytes]:
    return [a.tobytes() for a in arrays]


def _rows(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 4
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "key", "a", "b", "c", "d"])


def _read(table: pa.Table, **kinds) -> list[np.ndarray]:
    """The packed columns of all rows, joined."""
    return [
        np.frombuffer(b"".join(table.column(name).to_pylist()), kind) for name, kind in kinds.items()
    ]


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Small numbers as 32-bit integers, compressed."""
    raw = b"".join(a.astype("<u4").tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unsqueezed(packed: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True), "<u4")


def _loosen(column: pa.ChunkedArray, parts: int) -> list[np.ndarray]:
    """The arrays of all rows of a squeezed column, joined."""
    rows = [_unsqueezed(x) for x in column.to_pylist()]
    return [np.concatenate([r.reshape(parts, -1)[k] for r in rows]) for k in range(parts)]


def _fragment_of(found: np.ndarray, fragments: int) -> np.ndarray:
    return ((found >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)


def _pieces(docs: DataFrame, size: int, fragments: int, doc_id: str, text: str) -> DataFrame:
    """Packed pieces by group of fragments: sets, 40 bits of each n-gram, sizes, and n-grams per fragment and set.

    Equal sets of a batch are sent once.
    """
    groups = -(-fragments // FRAGMENTS_PER_TASK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            sent: list[list] = [[] for _ in range(groups)]
            for _, found, counts, same in _sets(batch, size):
                new = np.array([not (s in seen or seen.add(s)) for s in same.tolist()], bool) & (counts > 0)
                owner = np.repeat(np.arange(len(counts)), counts)
                pick = new[owner]
                owner, found = owner[pick], found[pick]
                place = _fragment_of(found, fragments)
                order = np.argsort(place, kind="stable")
                owner, found, place = owner[order], found[order], place[order]
                cut = np.searchsorted(place, np.arange(groups + 1) * FRAGMENTS_PER_TASK)
                for g in range(groups):
                    a, b = cut[g], cut[g + 1]
                    if a < b:
                        rows, at = np.unique(owner[a:b], return_inverse=True)
                        cell = (place[a:b] - g * FRAGMENTS_PER_TASK) * len(rows) + at
                        per = np.bincount(cell, minlength=len(rows) * FRAGMENTS_PER_TASK)
                        low = found[a:b]
                        sent[g].append((
                            same[rows], low.astype(np.uint32), (low >> np.uint64(32)).astype(np.uint8), counts[rows],
                            per.reshape(FRAGMENTS_PER_TASK, -1),
                        ))
            yield from _rows([
                (0, g, *_pack(names, low, high), _squeeze(n, per))
                for g, parts in enumerate(sent) for names, low, high, n, per in parts
            ]).to_batches()

    rows = docs.select(F.col(text).alias("body"))
    return rows.mapInArrow(run, _PARTS)


def _sorted_pairs(gram: np.ndarray, owner: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (n-gram, set) pairs in order."""
    if owners < 1 << 24:  # both in one word: 40 bits and 24
        code = gram << np.uint64(24)
        code |= owner.view(np.uint64)
        code.sort()  # np.unique would fill a hash table, several times the size of the pairs
        new = np.ones(len(code), bool)
        new[1:] = code[1:] != code[:-1]
        code = code[new]
        owner = (code & np.uint64((1 << 24) - 1)).view(np.int64)
        code >>= np.uint64(24)
        return code, owner
    order = np.lexsort((owner, gram))
    gram, owner = gram[order], owner[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    return gram[new], owner[new]


def _count(fragments: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Of each fragment of a group: its shared n-grams (kind 0), and how many of each rarity a set has (kind 1, by set).

    A fragment's rows leave the task before the next one is counted, so neither side ever holds those of a whole group.
    """
    first = table.column("key")[0].as_py() * FRAGMENTS_PER_TASK
    same, low, high = (
        [np.frombuffer(x.as_buffer(), kind) for x in table.column(name)]
        for name, kind in (("a", np.int64), ("b", np.uint32), ("c", np.uint8))
    )
    heads = [_unsqueezed(x).reshape(1 + FRAGMENTS_PER_TASK, -1) for x in table.column("d").to_pylist()]
    names, which = np.unique(np.concatenate(same), return_inverse=True)
    sizes = np.zeros(len(names), np.uint32)
    sizes[which] = np.concatenate([h[0] for h in heads])
    ends = [np.cumsum(np.append(0, h[1:].sum(axis=1, dtype=np.int64))) for h in heads]  # a row holds one fragment after the other
    for k in range(min(FRAGMENTS_PER_TASK, fragments - first)):
        gram = np.concatenate([x[e[k] : e[k + 1]] for x, e in zip(low, ends, strict=True)]).astype(np.uint64)
        gram |= np.concatenate([x[e[k] : e[k + 1]] for x, e in zip(high, ends, strict=True)]).astype(np.uint64) << np.uint64(32)
        owner = np.repeat(which, np.concatenate([h[1 + k] for h in heads]))
        yield from _rows(_count_fragment(fragments, first + k, names, sizes, gram, owner)).to_batches()


def _count_fragment(
    buckets: int, fragment: int, names: np.ndarray, sizes: np.ndarray, gram: np.ndarray, owner: np.ndarray
) -> list[tuple]:
    """The rows of one fragment: (n-gram, position of its set in ``names``), equal sets and repeats included."""
    if not len(gram):
        return []
    gram, owner = _sorted_pairs(gram, owner, len(names))
    start = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
    common = np.diff(np.concatenate((start, [len(gram)])))
    shared = np.repeat(common > 1, common)
    rarity = np.repeat(np.minimum(np.ceil(np.log2(common)), 255).astype(np.uint8), common)[shared]
    gram, owner = gram[shared], owner[shared]
    order = np.lexsort((gram, rarity, owner))
    gram, owner, rarity = gram[order], owner[order], rarity[order]
    if not len(gram):
        return []
    cell = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (rarity[1:] != rarity[:-1]))))
    per = np.diff(np.concatenate((cell, [len(gram)]))).astype(np.uint32)
    name, kind = names[owner[cell]], rarity[cell]
    out = [(0, fragment, *_pack(name, kind, per, gram))]
    bucket = mix(name.view(np.uint64)) % np.uint64(buckets)
    for b in np.unique(bucket).tolist():
        x = bucket == b
        own, cells_of = np.unique(owner[cell[x]], return_counts=True)
        out.append((
            1, b, names[own].tobytes(), _squeeze(sizes[own], cells_of), _squeeze(kind[x], per[x]),
            np.array([fragment, x.sum()], np.int64).tobytes(),
        ))
    return out


def _cut(percent: int, key: tuple, table: pa.Table) -> pa.Table:
    """The cells (fragment, rarity) of each set that can link, and how far its prefix reaches; by fragment."""
    same, at = _read(table, a=np.int64, d=np.dtype([("f", "<i8"), ("n", "<i8")]))
    (n, cells), (kind, per) = _loosen(table.column("b"), 2), _loosen(table.column("c"), 2)
    name, size = np.repeat(same, cells), np.repeat(n, cells)
    kind, per = kind.astype(np.uint8), per.astype(np.int64)
    fragment = np.repeat(at["f"], at["n"])
    order = np.lexsort((fragment, kind, name))
    name, size, kind, per, fragment = name[order], size[order].astype(np.int64), kind[order], per[order], fragment[order]
    start = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
    cells = np.diff(np.concatenate((start, [len(name)])))
    shared = np.repeat(np.add.reduceat(per, start), cells)
    before = np.cumsum(per) - per
    before -= np.repeat(before[start], cells)
    least = -(-percent * size // 100)  # a partner shares at least so many
    need = size - least + 1 - (size - shared)  # of the prefix, what the unshared ones leave
    keep = shared >= least
    cells = np.zeros(len(name), _CELL)
    cells["n"], cells["rest"], cells["take"] = size, shared - before, np.clip(need - before, 0, per)
    name, cells, kind, fragment = name[keep], cells[keep], kind[keep], fragment[keep]
    out = []
    for f in np.unique(fragment).tolist():
        x = fragment == f
        out.append((0, f, *_pack(name[x], cells[x], kind[x], np.zeros(0))))
    return _rows(out)


def _prefix(fragments: int, key: tuple, pieces: pa.Table, cells: pa.Table) -> pa.Table:
    """Of a fragment: the pieces of the sets that can link (0), their prefix n-grams (1), their spread (2)."""
    if not pieces.num_rows or not cells.num_rows:
        return _rows([])
    fragment = pieces.column("key")[0].as_py()
    name, kind, per, gram = _read(pieces, a=np.int64, b=np.uint8, c=np.uint32, d=np.uint64)
    wanted, cell, wanted_kind = _read(cells, a=np.int64, b=_CELL, c=np.uint8)
    mine, theirs = _code(name, kind), _code(wanted, wanted_kind)
    order = np.argsort(theirs)
    match = order[np.minimum(np.searchsorted(theirs, mine, sorter=order), len(theirs) - 1)]
    ok = theirs[match] == mine
    match = match[ok]
    each = np.repeat(ok, per)
    name, kind, per, gram = name[ok], kind[ok], per[ok], gram[each]
    cell = cell[match]
    out = [(0, fragment, *_pack(name, cell["n"], per, gram))]
    inside = np.arange(len(gram)) - np.repeat(np.cumsum(per) - per, per)  # cells hold their n-grams in order
    first = inside < np.repeat(cell["take"], per)
    if first.any():
        place = np.zeros(first.sum(), _PLACE)
        place["n"] = np.repeat(cell["n"], per)[first]
        place["rest"] = np.repeat(cell["rest"], per)[first] - inside[first]
        out.append((1, fragment, *_pack(
            np.repeat(name, per)[first], place, gram[first] | np.uint64(fragment) << np.uint64(40), np.zeros(0)
        )))
    # how the set's shared n-grams spread over fixed bins
    low, bits = np.repeat(name, per), max(1, BINS // fragments)
    spot = (np.uint64(fragment * bits) + gram % np.uint64(bits)) % np.uint64(BINS)
    code, count = np.unique(np.rec.fromarrays([low, spot.astype(np.uint8)], names="name,bin"), return_counts=True)
    bucket = mix(code["name"].view(np.uint64)) % np.uint64(fragments)
    for b in np.unique(bucket).tolist():
        x = bucket == b
        out.append((2, b, *_pack(code["name"][x], code["bin"][x], count[x].astype(np.uint32), np.zeros(0))))
    return _rows(out)


def _spread(key: tuple, table: pa.Table) -> pa.Table:
    """The summed bins of each set."""
    name, spot, count = _read(table, a=np.int64, b=np.uint8, c=np.uint32)
    names, which = np.unique(name, return_inverse=True)
    bins = np.bincount(which * BINS + spot, count, len(names) * BINS).astype(np.int32)
    return pa.table({
        "of": names, "bins": pa.ListArray.from_arrays(np.arange(0, len(bins) + 1, BINS, dtype=np.int32), pa.array(bins))
    })


def _code(name: np.ndarray, kind: np.ndarray) -> np.ndarray:
    return mix(name.view(np.uint64) + mix(kind.astype(np.uint64) + np.uint64(11)))


def _overlap(key: tuple, pieces: pa.Table, pairs: pa.Table) -> pa.Table:
    """N-grams a fragment finds in both pieces of each pair, packed per chunk of pairs."""
    if not pairs.num_rows:
        return _rows([])
    out = []
    if pieces.num_rows:
        name, _, per, gram = _read(pieces, a=np.int64, b=np.uint32, c=np.uint32, d=np.uint64)
        names, which = np.unique(name, return_inverse=True)
        _, rank = np.unique(gram, return_inverse=True)
        code = np.sort(np.repeat(which.astype(np.int64), per) << 32 | rank)
        edge = np.searchsorted(code >> 32, np.arange(len(names) + 1))
    for row in pairs.to_pylist():
        ab = [np.frombuffer(row[c], np.int64) for c in ("a", "b")]
        counts = np.zeros(len(ab[0]), np.uint32)
        if pieces.num_rows:
            i, j = [np.minimum(np.searchsorted(names, x), len(names) - 1) for x in ab]
            both = np.flatnonzero((names[i] == ab[0]) & (names[j] == ab[1]))
            i, j = i[both], j[both]
            size = edge[i + 1] - edge[i]
            owner = np.repeat(np.arange(len(both)), size)
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(edge[i], size)
            sought = code[at] & 0xFFFFFFFF | j[owner] << 32
            hit = code[np.minimum(np.searchsorted(code, sought), len(code) - 1)] == sought
            counts[both] = np.bincount(owner[hit], minlength=len(both))
        out.append((0, row["kind_id"], counts.tobytes(), b"", b"", b""))
    return _rows(out)


def _sum(percent: int, key: tuple, chunk: pa.Table, counts: pa.Table) -> pa.Table:
    """The pairs of a chunk whose summed overlap reaches the threshold."""
    a, b, n = _read(chunk, a=np.int64, b=np.int64, c=np.dtype([("a", "<i8"), ("b", "<i8")]))
    total = np.zeros(len(a), np.int64)
    for part in counts.column("a").to_pylist():
        total += np.frombuffer(part, np.uint32)
    link = 100 * total >= percent * (n["a"] + n["b"] - total)
    return pa.table({"a": a[link], "b": b[link]})


def _chunked(pairs: DataFrame) -> DataFrame:
    """``pairs(a, b, na, nb)`` packed, many to a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAIRS_PER_CHUNK):
                a, b, na, nb = [c.to_numpy(zero_copy_only=False) for c in batch.slice(at, PAIRS_PER_CHUNK).columns]
                yield from _rows([(0, 0, *_pack(a, b, np.rec.fromarrays([na, nb])), b"")]).to_batches()

    return pairs.select("a", "b", "na", "nb").mapInArrow(run, _PARTS).withColumn("key", F.monotonically_increasing_id())


def _kept(parts: DataFrame, fragments: int) -> DataFrame:
    """Write packed rows as a table with a bucket per fragment, which later steps read without a shuffle."""
    spark = parts.sparkSession
    at = scratch_path(spark, "fragments")
    name = at.rsplit("/", 1)[1].replace("-", "_")
    (
        parts.write.partitionBy("kind").bucketBy(min(fragments, MAX_BUCKETS), "key")
        .option("path", at).format("parquet").saveAsTable(name)
    )
    return spark.table(name)


def link_sets(docs: DataFrame, sets: DataFrame, size: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """(id, component) of the sets (by identity) that link with another one."""
    spark = docs.sparkSession
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    fragments = max(1, -(-total // FRAGMENT_GRAMS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _count(fragments, pa.Table.from_batches(batches))

    counted = _kept(
        _pieces(docs, size, fragments, doc_id, text).groupBy("key").applyInArrow(count, _PARTS), fragments
    )
    cells = (
        counted.where("kind = 1").groupBy("key").applyInArrow(lambda key, t: _cut(percent, key, t), _PARTS)
    )
    kept = _kept(
        counted.where("kind = 0").groupBy("key").cogroup(cells.groupBy("key"))
        .applyInArrow(lambda key, p, c: _prefix(fragments, key, p, c), _PARTS), fragments
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, size, gram = _read(pa.Table.from_batches([batch]), a=np.int64, b=_PLACE, c=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array(name), *(pa.array(size[c].astype(np.int64)) for c in ("n", "rest"))],
                names=["gram", "same", "n", "rest"],
            )

    met = cut_lineage(kept.where("kind = 1").select("a", "b", "c").mapInArrow(meet, "gram long, same long, n long, rest long"))
    met = met.join(met.groupBy("gram").count().where("count > 1").select("gram"), "gram")
    spread = cut_lineage(kept.where("kind = 2").groupBy("key").applyInArrow(_spread, "of long, bins array<int>"))
    links = spark.createDataFrame([], "a long, b long")
    found = spark.createDataFrame([], "id long, component long")
    pivots = 1
    while True:
        here = met.join(found, met["same"] == found["id"], "left").select(
            "gram", "same", "n", "rest", F.coalesce("component", "same").alias("component")
        )
        places = here.groupBy("gram").agg(
            F.count("*").alias("members"), F.min("same").alias("first"),
            F.min("component").alias("least"), F.max("component").alias("most"),
        ).where((F.col("least") != F.col("most")) & (F.col("members") > pivots))
        here = cut_lineage(here.join(places, "gram"))
        # meeting places of the same sets choose the same pivots; of few members, everyone is one
        lot = F.pmod(F.xxhash64("same"), F.lit(1 << 30)) * F.col("members")
        chosen = (lot < pivots << 30) | (F.col("members") <= pivots * PIVOT_GROWTH)
        if pivots == 1:
            chosen |= F.col("same") == F.col("first")
        else:  # earlier pivots have met everyone
            chosen &= (lot >= pivots // PIVOT_GROWTH << 30) & (F.col("same") != F.col("first"))
        here = here.withColumn("pivot", chosen)
        pivot = here.where("pivot").select(
            "gram", F.col("same").alias("p"), F.col("n").alias("pn"), F.col("rest").alias("pr"), F.col("component").alias("pc")
        )
        # sets that first meet here share nothing before; if they met before, they were seen there
        most = F.least("rest", "pr")
        alike = (100 * most >= percent * (F.col("n") + F.col("pn") - most)) & (F.col("component") != F.col("pc"))
        small = F.col("same") < F.col("p")
        # two pivots meet from both sides; once is enough
        pairs = (
            here.join(pivot, "gram").where(alike & (small | ~F.col("pivot")))
            .select(
                F.least("same", "p").alias("a"), F.greatest("same", "p").alias("b"),
                F.when(small, F.col("n")).otherwise(F.col("pn")).alias("na"),
                F.when(small, F.col("pn")).otherwise(F.col("n")).alias("nb"),
            ).distinct()
        )
        # no bin can share more than the smaller count
        bound = F.aggregate(F.zip_with("x", "y", lambda x, y: F.least(x, y)), F.lit(0), lambda total, x: total + x)
        pairs = cut_lineage(
            pairs.join(spread.select(F.col("of").alias("a"), F.col("bins").alias("x")), "a")
            .join(spread.select(F.col("of").alias("b"), F.col("bins").alias("y")), "b")
            .withColumn("most", bound)
            .where(100 * F.col("most") >= percent * (F.col("na") + F.col("nb") - F.col("most")))
            .select("a", "b", "na", "nb")
        )
        if not pairs.isEmpty():
            packed = cut_lineage(_chunked(pairs))
            asked = packed.select(
                F.explode(F.sequence(F.lit(0).cast("long"), F.lit(fragments - 1).cast("long"))).alias("key"),
                F.col("key").alias("kind_id"), "a", "b",
            )
            partial = (
                kept.where("kind = 0").groupBy("key").cogroup(asked.groupBy("key")).applyInArrow(_overlap, _PARTS)
            )
            more = packed.groupBy("key").cogroup(partial.groupBy("key")).applyInArrow(
                lambda key, c, t: _sum(percent, key, c, t), "a long, b long"
            )
            links = cut_lineage(links.unionByName(more))
            found = cut_lineage(components(links))
        largest = here.agg(F.max("members")).first()[0]
        if largest is None or largest <= pivots * PIVOT_GROWTH:
            return found
        pivots *= PIVOT_GROWTH


def _classes(docs: DataFrame, size: int, percent: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(id, mark, n, class) of the rows with a set, and (id, mark, n) of those without."""
    sets = cut_lineage(shingled(docs, size, doc_id, text))
    found = link_sets(docs, sets, size, percent, doc_id, text)
    full = sets.where("n > 0").join(found.withColumnRenamed("id", "same"), "same", "left").select(
        "id", "mark", "n", F.coalesce("component", "same").alias("class")
    )
    return full, sets.where("n = 0").select("id", "mark", "n")


def kept(docs: DataFrame, size: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, mark) of the documents that stay: of each class the one with the smallest id, and all without a set.

    The mark is the xxhash64 of the text. A null id comes after all others; of several texts
    with the smallest id the smallest mark stays.
    """
    full, alone = _classes(docs, size, percent, doc_id, text)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("first")
    return full.groupBy("class").agg(first).select("first.id", "first.mark").unionByName(alone.select("id", "mark").distinct())


def join(
    docs: DataFrame, size: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(id, n, component) of every row: its set's size, and the smallest id reachable by links.

    Two documents link when 100 * intersection >= ``percent`` * union of their sets of word
    ``size``-grams (A-Z lower-cased; fewer words: the whole sequence as one). Without words or
    text a document has no set and stays alone. Rows of equal sets are one class throughout.
    N-grams are told apart by 64 bits, inside a fragment by 40 and the fragment itself.
    """
    full, alone = _classes(docs, size, percent, doc_id, text)
    least = full.groupBy("class").agg(F.min("id").alias("component"))
    return full.join(least, "class").select("id", "n", "component").unionByName(
        alone.select("id", "n", F.col("id").alias("component"))
    )
