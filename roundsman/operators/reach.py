"""Times and paths of neighbouring sources, searched in one task over the map within their reach.

Sources are grouped by the region of their node. One search per group over region crossings
(``regions.Search``, all sources of the group at once) tells which regions any of them gets to
within the time limit. A task then holds the edges of those regions and searches its sources a
block at a time, so nothing of a source's search is ever written but what was asked for. A group
whose map is too large for a task goes through the rounds of ``regions.Search`` instead.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from roundsman.operators import regions as G
from roundsman.session import cut_lineage

# the code travels with the task, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Edges of a map one task holds at most.
MAP_EDGES = 1 << 20
#: Cells (edges x sources) relaxed together at most.
_CELLS = 1 << 20
#: Sources of one task at most.
_SOURCES = 256
#: Paths walked back together.
_WALKS = 1024
#: Matrix rows looked up by one task; the sources of a depot, which all tours ask for, are searched once for each such lot.
_ASKED = 500_000

_TIMES = "source long, node long, seconds double"
_WAYS = "source long, target long, seconds double, nodes array<long>, lat array<double>, lon array<double>"


class Map(G.Region):
    """Edges (in order of their numbers) of several regions and the turns between them."""

    def __init__(self, rows: G._Rows):
        def joined(name: str, kind) -> tuple[np.ndarray, np.ndarray]:
            cells = [rows.array(name, i) for i in range(len(rows))]
            cells = [np.zeros(0, kind) if c is None else c for c in cells]
            return np.concatenate(cells).astype(kind, copy=False), np.array([len(c) for c in cells])

        regions = np.array(rows.cells("region"), np.int64)
        e, sizes = joined("g_e", np.int64)
        home = np.repeat(np.arange(len(regions)), sizes)
        order = np.argsort(e, kind="stable")
        self.e, self.home = e[order], home[order]
        self.v, self.w = joined("g_v", np.int64)[0][order], joined("g_w", float)[0][order]
        # an edge by its region and number: both in order within the regions
        by_region = np.argsort(self.home, kind="stable")
        starts = np.append(0, np.cumsum(sizes))

        def spot(region: np.ndarray, edge: np.ndarray) -> np.ndarray:
            found = np.zeros(len(edge), np.int64)
            sort = np.argsort(region, kind="stable")
            cuts = np.searchsorted(region[sort], np.arange(len(regions) + 1))
            for r in np.flatnonzero(cuts[1:] > cuts[:-1]):
                own, some = by_region[starts[r] : starts[r + 1]], sort[cuts[r] : cuts[r + 1]]
                found[some] = own[np.searchsorted(self.e[own], edge[some])]
            return found

        t_e, t_sizes = joined("t_e", np.int64)
        t_f, t_w, t_region = (joined(n, k)[0] for n, k in (("t_f", np.int64), ("t_w", float), ("t_region", np.int64)))
        rank = np.argsort(regions)
        to = np.searchsorted(regions[rank], t_region)
        to[to == len(regions)] = 0
        to = rank[to]
        # no source gets through a turn that leaves the map
        kept = np.flatnonzero(regions[to] == t_region)
        at, to = spot(np.repeat(np.arange(len(regions)), t_sizes)[kept], t_e[kept]), spot(to[kept], t_f[kept])
        order = np.lexsort((at, to))
        self.turn_from, self.turn_to, self.turn_w = at[order], to[order], t_w[kept][order]
        self.by_node = np.lexsort((self.e, self.v))
        nodes = self.v[self.by_node]
        self.node_start = np.flatnonzero(np.append(True, nodes[1:] != nodes[:-1])) if len(nodes) else np.zeros(0, np.int64)
        self.node = nodes[self.node_start]
        self.node_end = np.append(self.node_start[1:], len(nodes))
        self.first = np.searchsorted(self.e, self.e)
        self.copies = (np.searchsorted(self.e, self.e, side="right") - self.first)
        if "p_node" in rows.batches[0].schema.names:
            place, _ = joined("p_node", np.int64)
            order = np.argsort(place, kind="stable")
            self.place = place[order]
            cells = [[b.column(c)[i].values for b, i in rows.at if b.column(c)[i].is_valid] for c in ("p_lat", "p_lon")]
            self.lat, self.lon = (
                pa.concat_arrays(c).take(pa.array(order)) if c else pa.array([], pa.float64()) for c in cells
            )
        else:
            self.place = None

    def node_at(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``nodes`` an edge of the map leads to, their places in ``node``)."""
        at = np.searchsorted(self.node, nodes)
        at[at == len(self.node)] = 0
        some = np.flatnonzero(self.node[at] == nodes) if len(self.node) else np.zeros(0, np.int64)
        return some, at[some]

    def search(self, seeds: list, targets: list, max_s: float) -> np.ndarray:
        """Least times by edge and source; with targets final up to a source's farthest one only."""
        d = np.full((len(self.e), len(seeds)), np.inf)
        for s, (e, w) in enumerate(seeds):
            np.minimum.at(d, (np.searchsorted(self.e, e), s), w)
        known = [None if t is None else self.node_at(t) for t in targets]
        # a node no edge of the map leads to is out of reach, so nothing is searched for its sake
        limit = np.array([0.0 if k is not None and not len(k[0]) else max_s for k in known])
        ended = [s for s, k in enumerate(known) if k is not None and len(k[0])]
        bound = None
        if ended:
            wanted, which = np.unique(np.concatenate([known[s][1] for s in ended]), return_inverse=True)
            cuts = np.append(0, np.cumsum([len(known[s][0]) for s in ended]))
            which = [which[a:b] for a, b in zip(cuts, cuts[1:])]
            spans = self.node_end[wanted] - self.node_start[wanted]
            starts = np.append(0, np.cumsum(spans)[:-1])
            edges = self.by_node[np.repeat(self.node_start[wanted] - starts, spans) + np.arange(spans.sum())]

            def bound(d):
                far = np.full(len(seeds), np.inf)
                arrived = np.minimum.reduceat(d[edges], starts, axis=0)
                for s, at in zip(ended, which):
                    far[s] = arrived[at, s].max()
                return far  # infinite while one of them is not reached

        self.relax(d, limit, bound)
        return d


def _seeded(rows: G._Rows) -> list:
    return [(rows.array("o_e", s), rows.array("o_d", s)) for s in range(len(rows))]


def _times_step(max_s: float):
    def step(here: Map, rows: G._Rows) -> Iterator[pa.RecordBatch]:
        targets = [rows.array("targets", s) for s in range(len(rows))]
        arrived = here.arrivals(here.search(_seeded(rows), targets, max_s))
        source, node, seconds = [], [], []
        for s, number in enumerate(rows.cells("source")):
            at = np.arange(len(here.node)) if targets[s] is None else here.node_at(targets[s])[1]
            at = at[np.isfinite(arrived[at, s])]
            source.append(np.full(len(at), number, np.int64))
            node.append(here.node[at])
            seconds.append(arrived[at, s])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(c)) for c in (source, node, seconds)], ["source", "node", "seconds"]
        )

    return step


def _repeated(here: Map, way: np.ndarray) -> np.ndarray:
    """A way (last edge first) in driving order; an edge that is listed several times brings its piece as often."""
    cuts = np.flatnonzero(np.append(True, here.home[way[1:]] != here.home[way[:-1]]))
    pieces, times = [], 1
    for start, end in zip(cuts, np.append(cuts[1:], len(way))):
        times *= here.copies[way[start]]
        pieces.append(np.tile(way[start:end][::-1], times))
    return np.concatenate(pieces[::-1])


def _walk(here: Map, back: np.ndarray, at: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges in driving order, length of every way) of the ways that end at edges ``at``."""
    hops = []
    while (at >= 0).any():
        hops.append(at)
        at = np.where(at >= 0, back[at, source], -1)
    ways = np.stack(hops[::-1], axis=1)
    if (here.copies > 1).any():
        ways = [_repeated(here, way[way >= 0][::-1]) for way in ways]
        return np.concatenate(ways), np.array([len(way) for way in ways])
    return ways[ways >= 0], (ways >= 0).sum(axis=1)


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values)


def _ways_step(max_s: float):
    def step(here: Map, rows: G._Rows) -> Iterator[pa.RecordBatch]:
        targets = [rows.array("targets", s) for s in range(len(rows))]
        seeds = _seeded(rows)
        d = here.search(seeds, targets, max_s)
        x_d, x_prev = np.full(d.shape, np.inf), np.full(d.shape, G.SEED)
        for s, (e, w) in enumerate(seeds):
            np.minimum.at(x_d, (np.searchsorted(here.e, e), s), w)
        prev = here.previous(d, x_d, x_prev)
        back = np.searchsorted(here.e, prev)
        back[back == len(here.e)] = 0
        back[here.e[back] != prev] = G.SEED
        arrived = here.arrivals(d)
        # lowest edge that arrives at the node's time; edges are in order
        spans = here.node_end - here.node_start
        ties = d[here.by_node] == np.repeat(arrived, spans, axis=0)
        first = np.minimum.reduceat(np.where(ties, here.first[here.by_node][:, None], len(here.e)), here.node_start, axis=0)
        spots = [here.node_at(t)[1] for t in targets]
        spots = [at[np.isfinite(arrived[at, s])] for s, at in enumerate(spots)]
        column = np.repeat(np.arange(len(rows)), [len(at) for at in spots])
        spots = np.concatenate(spots)
        number = np.array(rows.cells("source"), np.int64)
        for start in range(0, len(spots), _WALKS):
            at, s = spots[start : start + _WALKS], column[start : start + _WALKS]
            edges, sizes = _walk(here, back, first[at, s], s)
            # the source goes ahead of the nodes its edges lead to
            heads = np.append(0, np.cumsum(sizes)[:-1])
            nodes = np.insert(here.v[edges], heads, number[s])
            sizes = sizes + 1
            if here.place is None:
                drawn = [_lists(pa.array(nodes), sizes), *[pa.nulls(len(at), pa.list_(pa.float64()))] * 2]
            else:
                low, high = np.searchsorted(here.place, nodes), np.searchsorted(here.place, nodes, side="right")
                spans, ends = high - low, np.cumsum(high - low)
                spread = pa.array(np.repeat(low - (ends - spans), spans) + np.arange(ends[-1]))
                sizes = np.diff(np.append(0, ends[np.cumsum(sizes) - 1]))
                drawn = [pa.nulls(len(at), pa.list_(pa.int64())), *[_lists(c.take(spread), sizes) for c in (here.lat, here.lon)]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(number[s]), pa.array(here.node[at]), pa.array(arrived[at, s]), *drawn],
                ["source", "target", "seconds", "nodes", "lat", "lon"],
            )

    return step


def _mapped(step: Callable[[Map, G._Rows], Iterator[pa.RecordBatch]], block: int, cells: int):
    """Rows without a source are the regions of a map, those with one its work."""

    def run(batches):
        here, key, regions, held = None, None, [], []
        for batch in batches:
            keys = list(zip(batch.column("home").to_pylist(), batch.column("part").to_pylist()))
            sources = batch.column("source").is_valid().to_pylist()
            for i in range(batch.num_rows):
                if keys[i] != key or not sources[i]:
                    if held:
                        yield from step(here, _rows(held))
                        held = []
                    if keys[i] != key:
                        key, here, regions = keys[i], None, []
                if not sources[i]:
                    regions.append((batch, i))
                    continue
                if here is None:
                    here, regions = Map(_rows(regions)), []
                held.append((batch, i))
                if len(held) == max(1, min(block, cells // max(1, len(here.e)))):
                    yield from step(here, _rows(held))
                    held = []
        if held:
            yield from step(here, _rows(held))

    return run


def _rows(at: list) -> G._Rows:
    rows = G._Rows([])
    rows.batches, rows.at = [at[0][0]], at
    return rows


class _Times:
    """Seconds by source and node, as found by ``_times_step``."""

    def __init__(self, found: list[pa.RecordBatch]):
        def joined(name: str, kind) -> np.ndarray:
            return np.concatenate([np.zeros(0, kind), *[b.column(name).to_numpy() for b in found]])

        self.source, by_source = np.unique(joined("source", np.int64), return_inverse=True)
        self.node, by_node = np.unique(joined("node", np.int64), return_inverse=True)
        keys = by_source * len(self.node) + by_node
        order = np.argsort(keys)
        self.key, self.seconds = keys[order], joined("seconds", float)[order]

    def of(self, source: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Seconds of pairs; infinite where none were found, 0 from a node to itself."""
        seconds = np.full(len(node), np.inf)
        if len(self.key):
            s = np.minimum(np.searchsorted(self.source, source), len(self.source) - 1)
            n = np.minimum(np.searchsorted(self.node, node), len(self.node) - 1)
            at = np.minimum(np.searchsorted(self.key, s * len(self.node) + n), len(self.key) - 1)
            some = (self.key[at] == s * len(self.node) + n) & (self.source[s] == source) & (self.node[n] == node)
            seconds[some] = self.seconds[at[some]]
        seconds[source == node] = 0.0
        return seconds


def _looked_up(times: _Times, rows: pa.RecordBatch) -> pa.RecordBatch:
    """Matrix rows (tour_id, i, j, seconds) of points that ask for the nodes ``b`` of all points ``j`` of their tour."""
    nodes = rows.column("b").flatten()
    sizes = rows.column("b").value_lengths().to_numpy()
    known = nodes.is_valid().to_numpy(zero_copy_only=False)
    seconds = np.full(len(nodes), np.inf)
    source = np.repeat(rows.column("source").to_numpy(), sizes)
    seconds[known] = times.of(source[known], nodes.drop_null().to_numpy())
    return pa.RecordBatch.from_arrays(
        [rows.column("tour_id"), rows.column("i"), rows.column("j"), _lists(pa.array(seconds), sizes)], ["tour_id", "i", "j", "seconds"]
    )


def _matrix_step(max_s: float, block: int, cells: int):
    """Rows of kind 0 are the regions of a map, those of kind 1 the sources to search, those of kind 2 look the times up."""
    search = _times_step(max_s)

    def run(batches):
        key, regions, here, held, found, times = None, [], None, [], [], None

        def searched():
            if held:
                found.extend(search(here, _rows(held)))
                held.clear()

        for batch in batches:
            names = ("home", "part", "share", "kind")
            keys = np.stack([batch.column(n).to_numpy().astype(np.int64) for n in names], axis=1)
            cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
            for start, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)]):
                *group, kind = keys[start].tolist()
                if group != key:
                    key, regions, here, times = group, [], None, None
                    held.clear()
                    found.clear()
                if kind == 0:
                    regions.extend((batch, i) for i in range(start, end))
                elif kind == 1:
                    if here is None:
                        here, regions = Map(_rows(regions)), []
                    for i in range(start, end):
                        held.append((batch, i))
                        if len(held) == max(1, min(block, cells // max(1, len(here.e)))):
                            searched()
                else:
                    if times is None:
                        searched()
                        times, here, regions = _Times(found), None, []
                    yield _looked_up(times, batch.slice(start, end - start))

    return run


class Reach:
    """Searches of ``sources`` in the maps of their groups; ``wide`` are those of groups with too large a map.

    With ``targets(source, target)`` a source stops at its farthest target; ``targets(source, targets)`` are the
    same in lists. ``places(node, lat, lon)`` let ways be drawn.
    """

    def __init__(
        self, sources: DataFrame, edges: DataFrame, turns: DataFrame, max_s: float, cap_seeds: bool = True,
        targets: DataFrame | None = None, places: DataFrame | None = None,
    ):
        self.max_s, self.drawn = max_s, places is not None
        graph, located, splits = G.build_graph(edges, turns)
        nodes = G.REGION_NODES

        def group(node: str):
            return F.floor(F.col(node) / nodes).cast("long")

        ids = sources.select(F.col("source").cast("long").alias("source")).where("source IS NOT NULL")
        if targets is None:
            ids = ids.distinct().withColumn("targets", F.lit(None).cast("array<long>"))
        else:
            # by source alone, so that telling pairs apart and listing them share one shuffle
            if "targets" in targets.columns:
                pairs = targets.where("source IS NOT NULL").select(F.col("source").cast("long").alias("source"), "targets")
                pairs = pairs.repartition("source").select("source", F.explode(F.col("targets").cast("array<long>")).alias("target"))
                pairs = pairs.where("source <> target").distinct()
            else:
                pairs = targets.select(F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"))
                pairs = pairs.where("source IS NOT NULL").repartition("source").distinct()
            ids = pairs.groupBy("source").agg(F.sort_array(F.collect_list("target")).alias("targets"))
        ids = cut_lineage(ids)
        together = located.withColumn("u", group("u"))
        homes = ids.select(group("source").alias("source")).distinct()
        coarse = G.Search(homes, edges, turns, max_s, cap_seeds, built=(graph, together, splits))
        around = coarse.state.select(F.col("source").alias("home"), "region").distinct()
        sizes = around.join(graph.select("region", F.size("g_e").alias("n")), "region").groupBy("home").agg(F.sum("n").alias("n"))
        sizes = cut_lineage(sizes)
        ids = ids.withColumn("home", group("source"))
        self.wide = None
        wide = sizes.where(F.col("n") > MAP_EDGES).select("home")
        if not wide.isEmpty():
            wide = cut_lineage(wide)
            self.wide, self.wide_homes = ids.join(wide, "home", "left_semi").select("source", "targets"), wide
            ids = ids.join(wide, "home", "left_anti")
            around = around.join(wide, "home", "left_anti")
        n = ids.count()
        cores = edges.sparkSession.sparkContext.defaultParallelism
        size = max(8, min(_SOURCES, n // (3 * cores)))
        self.home, self.part = group("source"), F.floor(F.pmod(F.col("source"), F.lit(nodes)) / size).cast("int")
        seeds = located.select(F.col("u").alias("source"), "e", "w")
        if cap_seeds:
            seeds = seeds.where(F.col("w") <= max_s)
        seeds = seeds.join(ids.select("source"), "source", "left_semi")
        seeds = seeds.groupBy("source").agg(F.collect_list(F.struct("e", "w")).alias("o"))
        self.work = ids.join(seeds, "source").select(
            "home", self.part.alias("part"), "source", "targets", F.col("o.e").alias("o_e"), F.col("o.w").alias("o_d")
        )
        if places is not None:
            spot = F.floor(F.col("node") / nodes).cast("long") * splits
            seen = places.select(
                spot.alias("region"), F.struct(F.col("node").cast("long").alias("node"), F.col("lat"), F.col("lon")).alias("p")
            ).groupBy("region").agg(F.array_sort(F.collect_list("p")).alias("p")).select(
                "region", *[F.col(f"p.{c}").alias(f"p_{c}") for c in ("node", "lat", "lon")]
            )
            # a source no edge leads to may have its place in a region nobody gets to
            spots = around.select("home", (F.col("region") - F.pmod(F.col("region"), F.lit(splits))).alias("region"))
            spots = spots.unionByName(ids.select("home", (F.col("home") * splits).alias("region"))).distinct()
            around = around.unionByName(spots).distinct()
            graph = graph.join(seen, "region", "full")
        copies = around.join(graph, "region").join(self.work.select("home", "part").distinct(), "home")
        self.copies = copies.withColumn("source", F.lit(None).cast("long"))
        self.tasks = max(cores, min(1024, 2 * n // size))

    def _run(self, step, schema: str) -> DataFrame:
        rows = self.copies.unionByName(self.work, allowMissingColumns=True).repartition(self.tasks, "home", "part")
        rows = rows.sortWithinPartitions("home", "part", F.asc_nulls_first("source"))
        return rows.mapInArrow(_mapped(step, G._BLOCK, _CELLS), schema)

    def times(self) -> DataFrame:
        """(source, node, seconds) of all reached nodes, or of the targets if there are any."""
        return self._run(_times_step(self.max_s), _TIMES)

    def matrix(self, points: DataFrame, lists: DataFrame) -> DataFrame:
        """(tour_id, i, j, seconds) of ``lists(tour_id, i, source, j, b)``, times to all nodes in ``b``; without those of wide groups.

        ``points(source)`` are the lists' sources. Times are looked up in the task that has searched their
        source, so neither they nor the pairs that ask for them are ever joined row by row.
        """
        loads = points.where("source IS NOT NULL").groupBy(self.home.alias("home"), self.part.alias("part")).agg(F.count("*").alias("n"))
        loads = F.broadcast(cut_lineage(loads.where(F.col("n") > _ASKED).select("home", "part", F.ceil(F.col("n") / _ASKED).alias("lots"))))
        asked = lists.where("source IS NOT NULL").select("*", self.home.alias("home"), self.part.alias("part"))
        if self.wide is not None:
            asked = asked.join(self.wide_homes, "home", "left_anti")
        lots = F.coalesce("lots", F.lit(1))
        asked = asked.join(loads, ["home", "part"], "left").withColumn("share", F.pmod(F.xxhash64("tour_id", "i"), lots)).drop("lots")
        copies = self.copies.withColumn("kind", F.lit(0)).unionByName(self.work.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        copies = copies.join(loads, ["home", "part"], "left").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), lots - 1))).drop("lots")
        rows = copies.unionByName(asked.withColumn("kind", F.lit(2)), allowMissingColumns=True)
        rows = rows.repartition(self.tasks, "home", "part", "share").sortWithinPartitions("home", "part", "share", "kind", "source")
        schema = StructType([*[lists.schema[n] for n in ("tour_id", "i", "j")], StructField("seconds", ArrayType(DoubleType()))])
        return rows.mapInArrow(_matrix_step(self.max_s, G._BLOCK, _CELLS), schema)

    def ways(self) -> DataFrame:
        """(source, target, seconds, nodes, lat, lon): the ways to all reached targets; with places
        their coordinates, else their nodes, the source ahead."""
        return self._run(_ways_step(self.max_s), _WAYS)
