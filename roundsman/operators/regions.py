"""Travel-time search over regions of a road graph.

The graph is cut into regions of a bounded number of edges. A task holds one region and a few
dozen sources at a time and relaxes all of the region's turns until nothing improves; what
leaves the region travels as offers, which the next round's tasks take up. Rounds therefore
follow the number of regions a trip crosses, not its hops, and a round reads and writes only
the (region, source) rows that offers have reached. Earlier rows are never rewritten: the row
of the last round counts.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from roundsman.session import cut_lineage

# the code travels with the task, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Nodes of one region; neighbouring node numbers are taken to be neighbours on the map.
REGION_NODES = 1024
#: Edges of one region at most; a node range with more is cut by edge number.
REGION_EDGES = 8192
#: Sources whose searches share one task's copy of a region.
SOURCES_PER_PART = 32
#: Sources relaxed together.
_BLOCK = 32
#: Rounds after which superseded rows are dropped from the carried state.
_COMPACT = 16

#: Relaxations between two looks at the farthest target.
_BOUND_STEPS = 16
#: Stretch of time whose edges pass on together, in lengths of a middling edge.
_STRETCH = 1.0
#: Turns into one edge that are compared in step.
_IN_STEP = 8

_INF = float("inf")
#: Predecessor of a source's first edges.
SEED = -1

_GRAPH = "g_e array<long>, g_v array<long>, g_w array<double>, t_e array<long>, t_f array<long>, t_w array<double>, t_region array<long>"
_STATE = "d array<double>, prev array<long>, x_at array<int>, x_d array<double>, x_prev array<long>"
_OFFER = "o_e array<long>, o_d array<double>, o_prev array<long>"
_KEY = "region long, part int, source long"


def region_of(node, edge, splits: int):
    """Region of an edge by the node it leads to."""
    spot = F.floor(node / REGION_NODES).cast("long")
    return spot * splits + F.pmod(F.hash(edge), F.lit(splits)) if splits > 1 else spot


def build_graph(edges: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(graph, located edges, splits): one row per region with its edges and the turns out of them.

    ``located`` is (e, u, v, w, region). ``splits`` is above 1 where a node range has more
    than ``REGION_EDGES`` edges, as around a hub; its edges then make several regions.
    """
    plain = edges.select(
        F.col("e").cast("long").alias("e"), F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"),
        F.col("w").cast("double").alias("w"),
    )
    plain = cut_lineage(plain)
    largest = plain.groupBy(F.floor(F.col("v") / REGION_NODES)).count().agg(F.max("count")).first()[0] or 0
    splits = max(1, -(-largest // REGION_EDGES))
    located = plain.withColumn("region", region_of(F.col("v"), F.col("e"), splits))
    own = located.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("e", "v", "w"))).alias("g")).select(
        "region", *[F.col(f"g.{c}").alias(f"g_{c}") for c in ("e", "v", "w")]
    )
    ways = (
        turns.select(F.col("e").cast("long").alias("e"), F.col("f").cast("long").alias("f"))
        .join(located.select("e", "region"), "e")
        .join(located.select(F.col("e").alias("f"), "w", F.col("region").alias("to")), "f")
        .groupBy("region")
        .agg(F.collect_list(F.struct("e", "f", "w", F.col("to").alias("region"))).alias("t"))
        .select("region", *[F.col(f"t.{c}").alias(f"t_{c}") for c in ("e", "f", "w", "region")])
    )
    return cut_lineage(own.join(ways, "region", "left")), located, splits


def _least(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Least of each stretch of rows; stretches are mostly short, and then faster gone through in step."""
    sizes = np.diff(np.append(starts, len(rows)))
    if sizes.max() > _IN_STEP:
        return np.minimum.reduceat(rows, starts, axis=0)
    least = rows.take(starts, axis=0)
    for k in range(1, sizes.max()):
        more = np.flatnonzero(sizes > k)
        least[more] = np.minimum(least[more], rows[starts[more] + k])
    return least


class Region:
    """One region's edges (in order of their numbers) and turns as arrays."""

    def __init__(self, batch: pa.RecordBatch, at: int):
        def array(name: str, kind) -> np.ndarray:
            value = batch.column(name)[at]
            return value.values.to_numpy(zero_copy_only=False) if value.is_valid else np.zeros(0, kind)

        self.id = batch.column("region")[at].as_py()
        self.e, self.v, self.w = array("g_e", np.int64), array("g_v", np.int64), array("g_w", float)
        e, f, w, to = array("t_e", np.int64), array("t_f", np.int64), array("t_w", float), array("t_region", np.int64)
        inside = to == self.id
        # turns inside the region by the edge they lead to, lowest first edge first
        order = np.lexsort((e[inside], f[inside]))
        self.turn_from = np.searchsorted(self.e, e[inside][order])
        self.turn_to = np.searchsorted(self.e, f[inside][order])
        self.turn_w = w[inside][order]
        order = np.argsort(to[~inside], kind="stable")
        self.out_from = np.searchsorted(self.e, e[~inside][order])
        self.out_e, self.out_w, self.out_region = f[~inside][order], w[~inside][order], to[~inside][order]
        self.by_node = np.lexsort((self.e, self.v))
        nodes = self.v[self.by_node]
        self.node_start = np.flatnonzero(np.append(True, nodes[1:] != nodes[:-1])) if len(nodes) else np.zeros(0, np.int64)
        self.node = nodes[self.node_start]

    def arrivals(self, d: np.ndarray) -> np.ndarray:
        """Least time per node of the region (rows) and source (columns)."""
        return np.minimum.reduceat(d[self.by_node], self.node_start, axis=0)

    @cached_property
    def leaving(self) -> tuple[np.ndarray, np.ndarray]:
        """Turns by the edge they start from, and where an edge's turns begin among them."""
        order = np.argsort(self.turn_from, kind="stable")
        return order, np.searchsorted(self.turn_from[order], np.arange(len(self.e) + 1))

    def relax(self, d: np.ndarray, limit: np.ndarray, bound: Callable[[np.ndarray], np.ndarray] | None) -> None:
        """Improve ``d`` (edges x sources) in place until no turn inside the region does.

        Edges pass on what they got nearest first, those of a stretch of time together: an edge far off
        waits until the ways to it are nearly settled, instead of passing on every improvement.
        """
        if not len(self.turn_to):
            return
        order, begin = self.leaving
        stretch = _STRETCH * float(np.fmax(np.median(self.turn_w), 0.0))
        due = np.fmin.reduce(d, axis=1)
        due[np.isnan(due)] = _INF
        steps = 0
        while np.isfinite(first := due.min()) and first <= limit.max():
            steps += 1
            if bound is not None and steps % _BOUND_STEPS == 0:
                limit = np.minimum(limit, bound(d))
            now = np.flatnonzero(due <= first + stretch)
            due[now] = _INF
            counts = begin[now + 1] - begin[now]
            ends = np.cumsum(counts)
            # turns are numbered by the edge they lead to
            some = np.sort(order[np.arange(ends[-1]) + np.repeat(begin[now] - (ends - counts), counts)])
            if not len(some):
                continue
            reached = d.take(self.turn_from[some], axis=0)
            reached += self.turn_w[some, None]
            to = self.turn_to[some]
            starts = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            to, least = to[starts], _least(reached, starts)
            known = d.take(to, axis=0)
            better = (least < known) & (least <= limit)
            hit = np.flatnonzero(better.any(axis=1))
            to, better, least = to[hit], better[hit], least[hit]
            d[to] = np.where(better, least, known[hit])
            due[to] = np.minimum(due[to], np.where(better, least, _INF).min(axis=1, initial=_INF))

    def previous(self, d: np.ndarray, x_d: np.ndarray, x_prev: np.ndarray) -> np.ndarray:
        """The edge before each edge on a fastest way, the lowest of several; ``SEED`` for first edges.

        Edges without length tie with the one before them, so those are settled in order from
        the edges that have a shorter one before.
        """
        none = np.iinfo(np.int64).max
        prev = np.where(x_d == d, x_prev, none)
        prev[~np.isfinite(d)] = none
        if len(self.turn_to):
            tight = (d[self.turn_from] + self.turn_w[:, None] == d[self.turn_to]) & np.isfinite(d[self.turn_to])
            starts = np.flatnonzero(np.append(True, self.turn_to[1:] != self.turn_to[:-1]))
            to = self.turn_to[starts]
            from_e = self.e[self.turn_from][:, None]
            first = np.minimum.reduceat(np.where(tight & (self.turn_w > 0)[:, None], from_e, none), starts, axis=0)
            prev[to] = np.where(prev[to] == SEED, SEED, np.minimum(prev[to], first))
            idle = tight & (self.turn_w <= 0)[:, None]
            while idle.any():
                known = prev < none
                first = np.minimum.reduceat(np.where(idle & known[self.turn_from], from_e, none), starts, axis=0)
                fresh = ~known[to] & (first < none)
                if not fresh.any():
                    break
                prev[to] = np.where(fresh, first, prev[to])
        return prev


def _lists(rows: list, kind) -> pa.Array:
    return pa.array(rows, pa.list_(kind))


def regional(graph: DataFrame, work: DataFrame, step: Callable[[Region, list[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run ``step(region, rows)`` over ``work(region, part, source, ...)``, a block of sources at a time.

    A region's row is copied once per part that has work in it and sorted ahead of the work, so
    a task holds one region and one block of rows, however many of them a partition has.
    """
    copies = graph.join(work.select("region", "part").distinct(), "region").withColumn("source", F.lit(None).cast("long"))
    rows = work.unionByName(copies, allowMissingColumns=True).repartition("region", "part")
    rows = rows.sortWithinPartitions("region", "part", F.asc_nulls_first("source"))

    def run(batches):
        region, held, size = None, [], 0
        for batch in batches:
            at = 0
            sources = batch.column("source")
            heads = [i for i in range(batch.num_rows) if not sources[i].is_valid] if sources.null_count else []
            for end in [*heads, batch.num_rows]:
                while at < end:
                    take = min(end - at, _BLOCK - size)
                    held.append(batch.slice(at, take))
                    at, size = at + take, size + take
                    if size == _BLOCK:
                        yield from step(region, held)
                        held, size = [], 0
                if end < batch.num_rows:
                    if held:
                        yield from step(region, held)
                        held, size = [], 0
                    region, at = Region(batch, end), end + 1
        if held:
            yield from step(region, held)

    return rows.mapInArrow(run, schema)


class _Rows:
    """Cells of a block of work rows."""

    def __init__(self, batches: list[pa.RecordBatch]):
        self.batches = batches
        self.at = [(batch, i) for batch in batches for i in range(batch.num_rows)]

    def __len__(self) -> int:
        return len(self.at)

    def array(self, name: str, row: int) -> np.ndarray | None:
        batch, i = self.at[row]
        value = batch.column(name)[i]
        return value.values.to_numpy(zero_copy_only=False) if value.is_valid else None

    def cells(self, name: str) -> list:
        return [batch.column(name)[i].as_py() for batch, i in self.at]


def _relax_step(max_s: float):
    def step(region: Region, batches: list[pa.RecordBatch]):
        rows = _Rows(batches)
        shape = (len(region.e), len(rows))
        d, x_d = np.full(shape, _INF), np.full(shape, _INF)
        x_prev = np.zeros(shape, np.int64)
        was = d.copy()
        targets = []
        for s in range(len(rows)):
            if (known := rows.array("d", s)) is not None:
                d[:, s] = was[:, s] = known
                at = rows.array("x_at", s)
                x_d[at, s], x_prev[at, s] = rows.array("x_d", s), rows.array("x_prev", s)
            e, offered, prev = rows.array("o_e", s), rows.array("o_d", s), rows.array("o_prev", s)
            order = np.lexsort((prev, offered, e))
            e, offered, prev = e[order], offered[order], prev[order]
            first = np.append(True, e[1:] != e[:-1])
            at, offered, prev = np.searchsorted(region.e, e[first]), offered[first], prev[first]
            better = (offered < x_d[at, s]) | ((offered == x_d[at, s]) & (prev < x_prev[at, s]))
            at, offered, prev = at[better], offered[better], prev[better]
            x_d[at, s], x_prev[at, s] = offered, prev
            d[at, s] = np.minimum(d[at, s], offered)
            wanted = rows.array("targets", s)
            targets.append(None if wanted is None else np.searchsorted(region.node, wanted))
        limit = np.array(rows.cells("bound"), float)
        limit = np.minimum(limit, max_s)
        alone = np.array([t is not None and only for t, only in zip(targets, rows.cells("only"))])
        bound = None
        if alone.any():
            # all targets of the source are in this region: nothing beyond the farthest is needed
            def bound(d):
                far = np.full(len(rows), _INF)
                arrived = region.arrivals(d)
                for s in np.flatnonzero(alone):
                    far[s] = arrived[targets[s], s].max()
                return far  # infinite while one of them is not reached

        region.relax(d, limit, bound)
        if bound is not None:
            limit = np.minimum(limit, bound(d))
        prev = region.previous(d, x_d, x_prev)
        arrived = region.arrivals(d)
        fars = [None if t is None else float(arrived[t, s].max()) for s, t in enumerate(targets)]
        state: dict[str, list] = {name: [] for name in ("d", "prev", "x_at", "x_d", "x_prev")}
        offers: dict[str, list] = {name: [] for name in ("region", "row", "e", "d", "prev")}
        reached = d[region.out_from] + region.out_w[:, None]
        changed = (d < was)[region.out_from] & (reached <= limit)
        bounds = np.flatnonzero(np.append(True, region.out_region[1:] != region.out_region[:-1])) if len(region.out_region) else []
        ends = np.append(bounds[1:], len(region.out_region)) if len(bounds) else []
        for s in range(len(rows)):
            at = np.flatnonzero(np.isfinite(x_d[:, s]))
            state["d"].append(d[:, s])
            state["prev"].append(prev[:, s])
            state["x_at"].append(at.astype(np.int32))
            state["x_d"].append(x_d[at, s])
            state["x_prev"].append(x_prev[at, s])
            for start, end in zip(bounds, ends):
                some = start + np.flatnonzero(changed[start:end, s])
                if len(some):
                    offers["region"].append(int(region.out_region[start]))
                    offers["row"].append(s)
                    offers["e"].append(region.out_e[some])
                    offers["d"].append(reached[some, s])
                    offers["prev"].append(region.e[region.out_from[some]])
        parts, sources = rows.cells("part"), rows.cells("source")
        n, m = len(rows), len(offers["row"])
        columns = [
            pa.array([region.id] * n + offers["region"], pa.int64()), pa.array(parts + [parts[s] for s in offers["row"]], pa.int32()),
            pa.array(sources + [sources[s] for s in offers["row"]], pa.int64()),
            _lists(state["d"] + [None] * m, pa.float64()), _lists(state["prev"] + [None] * m, pa.int64()),
            _lists(state["x_at"] + [None] * m, pa.int32()), _lists(state["x_d"] + [None] * m, pa.float64()),
            _lists(state["x_prev"] + [None] * m, pa.int64()), _lists([None] * n + offers["e"], pa.int64()),
            _lists([None] * n + offers["d"], pa.float64()), _lists([None] * n + offers["prev"], pa.int64()),
            pa.array(fars + [None] * m, pa.float64()),
        ]
        names = [x.split(" ")[0] for x in f"{_KEY}, {_STATE}, {_OFFER}, far double".split(", ")]
        yield pa.RecordBatch.from_arrays(columns, names)

    return step


def _latest(rows: list[DataFrame]) -> DataFrame:
    """The newest row per (region, part, source) of the rounds' outputs."""
    if len(rows) == 1:
        return rows[0].drop("age")
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    kept = [c for c in every.columns if c not in ("region", "part", "source", "age")]
    return every.groupBy("region", "part", "source").agg(F.max_by(F.struct(*kept), "age").alias("s")).select(
        "region", "part", "source", *[F.col(f"s.{c}") for c in kept]
    )


class Search:
    """All sources' searches: ``state`` holds a row per (region, source) with times by edge.

    With ``targets(source, target)`` a source stops at its farthest target: rows beyond the
    bound known so far are not searched any further, so times above it are not final.
    """

    def __init__(
        self, sources: DataFrame, edges: DataFrame, turns: DataFrame, max_s: float, cap_seeds: bool = True,
        targets: DataFrame | None = None, built: tuple[DataFrame, DataFrame, int] | None = None,
    ):
        self.graph, self.located, self.splits = built or build_graph(edges, turns)
        ids = sources.select(F.col("source").cast("long").alias("source")).where("source IS NOT NULL").distinct()
        self.parts = max(1, -(-ids.count() // SOURCES_PER_PART))
        self.rounds = 0
        self.targets = self._by_region(targets) if targets is not None else None
        seeds = ids.join(self.located.select(F.col("u").alias("source"), "e", "w", "region"), "source")
        if cap_seeds:
            seeds = seeds.where(F.col("w") <= max_s)
        packed = seeds.groupBy("region", self.part(), "source").agg(F.collect_list(F.struct("e", "w")).alias("o")).select(
            "region", "part", "source", F.col("o.e").alias("o_e"), F.col("o.w").alias("o_d"),
            F.transform("o", lambda x: F.lit(SEED).cast("long")).alias("o_prev"),
        )
        self.state = self._run(packed, max_s)

    def part(self):
        return F.pmod(F.hash("source"), F.lit(self.parts)).alias("part")

    def _by_region(self, targets: DataFrame) -> DataFrame:
        """Targets a source has in each region (bounded by the region's nodes), and whether that is its only one."""
        pairs = targets.select(F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target")).distinct()
        home = self.located.select(F.col("v").alias("target"), "region").distinct()
        found = pairs.join(home, "target", "left")
        # a target no edge leads to is never reached, so its source has no bound
        rows = found.groupBy("source", "region").agg(F.sort_array(F.collect_list("target")).alias("targets"))
        n = rows.groupBy("source").agg(F.count("*").alias("homes"))
        return cut_lineage(rows.where("region IS NOT NULL").join(n, "source").select(
            "region", self.part(), "source", "targets", "homes"
        ))

    def _work(self, offers: DataFrame, rounds: list[DataFrame], bounds: DataFrame | None) -> DataFrame:
        keys = ["region", "part", "source"]
        work = offers
        if rounds:
            touched = offers.select(*keys)
            work = work.join(_latest([r.join(touched, keys, "left_semi") for r in rounds]).drop("far"), keys, "left")
        else:
            for column in _STATE.split(", "):
                name, kind = column.split(" ")
                work = work.withColumn(name, F.lit(None).cast(kind))
        if self.targets is None:
            return work.withColumns({
                "targets": F.lit(None).cast("array<long>"), "only": F.lit(False), "bound": F.lit(_INF),
            })
        work = work.join(self.targets, keys, "left").withColumn("only", F.coalesce(F.col("homes") == 1, F.lit(False))).drop("homes")
        if bounds is None:
            return work.withColumn("bound", F.lit(_INF))
        return work.join(bounds, "source", "left").withColumn("bound", F.coalesce("bound", F.lit(_INF)))

    def _bounds(self, rounds: list[DataFrame]) -> DataFrame:
        """Time of the farthest target of every source that has reached all of them."""
        seen = _latest([r.where("far IS NOT NULL").select("region", "part", "source", "far", "age") for r in rounds])
        homes = self.targets.select("source", "homes").distinct()
        return seen.groupBy("source").agg(F.count("*").alias("n"), F.max("far").alias("bound")).join(homes, "source").where(
            "n = homes"
        ).select("source", "bound")

    def _run(self, offers: DataFrame, max_s: float) -> DataFrame:
        rounds: list[DataFrame] = []
        bounds = None
        while True:
            sent = Observation()
            out = cut_lineage(
                regional(self.graph, self._work(offers, rounds, bounds), _relax_step(max_s), f"{_KEY}, {_STATE}, {_OFFER}, far double")
                .observe(sent, F.count_if(F.col("o_e").isNotNull()).alias("n"))
            )
            self.rounds += 1
            state = out.where("d IS NOT NULL").drop("o_e", "o_d", "o_prev").withColumn("age", F.lit(self.rounds))
            rounds.append(state)
            if not sent.get["n"]:
                break
            if len(rounds) == _COMPACT:
                rounds = [cut_lineage(_latest(rounds)).withColumn("age", F.lit(self.rounds))]
            offers = out.where("o_e IS NOT NULL").groupBy("region", "part", "source").agg(
                *[F.flatten(F.collect_list(c)).alias(c) for c in ("o_e", "o_d", "o_prev")]
            )
            if self.targets is not None:
                bounds = cut_lineage(self._bounds(rounds))
                offers = offers.join(bounds, "source", "left").where(
                    F.col("bound").isNull() | (F.array_min("o_d") <= F.col("bound"))
                ).drop("bound")
        return cut_lineage(_latest(rounds)) if len(rounds) > 1 else _latest(rounds)

    def arrivals(self) -> DataFrame:
        """(source, node, seconds) of all reached nodes, or of the targets if there are any."""
        if self.targets is None:
            work = self.state.select("region", "part", "source", "d", F.lit(None).cast("array<long>").alias("targets"))
        else:
            work = self.state.select("region", "part", "source", "d").join(
                self.targets.select("region", "part", "source", "targets"), ["region", "part", "source"]
            )
        found = regional(self.graph, work, _arrival_step, "source long, node long, seconds double, edge long")
        if self.splits > 1:
            # a node's edges may be in several regions
            found = found.groupBy("source", "node").agg(F.min(F.struct("seconds", "edge")).alias("s")).select(
                "source", "node", "s.seconds", "s.edge"
            )
        return found

    def walks(self, ends: DataFrame) -> DataFrame:
        """(source, target, piece, nodes): the way to ``ends(source, target, edge)`` in pieces, last piece first.

        A round follows every way back through one region; ``nodes`` are the ends of its edges in
        driving order, so the source itself is not among them.
        """
        homes = self.located.select(F.col("e").alias("edge"), "region")
        at = ends.select("source", "target", "edge")
        pieces = []
        while True:
            here = at.join(homes, "edge").groupBy("region", self.part(), "source").agg(
                F.collect_list(F.struct("target", "edge")).alias("w")
            ).select(
                "region", "part", "source", F.col("w.target").alias("targets"), F.col("w.edge").alias("edges")
            )
            work = here.join(self.state.select("region", "part", "source", "prev"), ["region", "part", "source"])
            left = Observation()
            out = cut_lineage(
                regional(self.graph, work, _walk_step, "source long, target long, edge long, nodes array<long>")
                .observe(left, F.count_if(F.col("edge") != SEED).alias("n"))
            )
            pieces.append(out.select("source", "target", F.lit(len(pieces)).alias("piece"), "nodes"))
            if not left.get["n"]:
                break
            at = out.where(F.col("edge") != SEED).select("source", "target", "edge")
        every = pieces[0]
        for more in pieces[1:]:
            every = every.unionByName(more)
        return every


def _arrival_step(region: Region, batches: list[pa.RecordBatch]):
    rows = _Rows(batches)
    d = np.stack([rows.array("d", s) for s in range(len(rows))], axis=1)
    arrived = region.arrivals(d)
    by_node = region.by_node
    spans = np.diff(np.append(region.node_start, len(by_node)))
    for s, source in enumerate(rows.cells("source")):
        wanted = rows.array("targets", s)
        at = np.arange(len(region.node)) if wanted is None else np.searchsorted(region.node, wanted)
        seconds = arrived[:, s]
        # lowest edge that arrives at the node's time; edges of a node are in order
        ties = d[by_node, s] == np.repeat(seconds, spans)
        first = np.minimum.reduceat(np.where(ties, region.e[by_node], np.iinfo(np.int64).max), region.node_start)
        at = at[np.isfinite(seconds[at])]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(at), source)), pa.array(region.node[at]), pa.array(seconds[at]), pa.array(first[at]),
            ],
            ["source", "node", "seconds", "edge"],
        )


def _walk_step(region: Region, batches: list[pa.RecordBatch]):
    rows = _Rows(batches)
    for s, source in enumerate(rows.cells("source")):
        prev = rows.array("prev", s)
        targets, edges = rows.array("targets", s), rows.array("edges", s)
        back = np.searchsorted(region.e, prev)
        back[back == len(region.e)] = 0
        inside = region.e[back] == prev
        ways, last = [], []
        for edge in edges.tolist():
            at = int(np.searchsorted(region.e, edge))
            way = [at]
            while inside[at]:
                at = int(back[at])
                way.append(at)
            ways.append(region.v[np.array(way[::-1])])
            last.append(int(prev[at]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(edges), source)), pa.array(targets), pa.array(last, pa.int64()), _lists(ways, pa.int64())],
            ["source", "target", "edge", "nodes"],
        )
