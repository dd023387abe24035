"""Queries over the road graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from roundsman.operators import roads as R
from roundsman.plans.places import _NEAREST
from roundsman.plans.registry import query

col, lit = F.col, F.lit

_REACH = f"""step AS (SELECT t.e, t.f, CAST(b.w AS DOUBLE) AS w FROM {{turn}} t JOIN {{edge}} b ON b.e = t.f),
  reach(source, edge, d) USING KEY (source, edge) AS (SELECT u, e, CAST(w AS DOUBLE) FROM {{edge}} WHERE w <= {R.MAX_SECONDS}
    UNION SELECT n.source, s.f, MIN(n.d + s.w) FROM reach n JOIN step s ON s.e = n.edge
      LEFT JOIN recurring.reach o ON o.source = n.source AND o.edge = s.f
      WHERE n.d + s.w <= {R.MAX_SECONDS} AND (o.d IS NULL OR n.d + s.w < o.d) GROUP BY n.source, s.f),
  times AS (SELECT source, node, MIN(d) AS seconds FROM (SELECT source, v AS node, d FROM reach JOIN {{edge}} x ON x.e = reach.edge
    UNION ALL SELECT node, node, 0 FROM {{node}}) z GROUP BY source, node)"""


def _times(body: str, *more: str) -> str:
    return "WITH RECURSIVE " + ", ".join([_REACH, *more]) + " " + body


@query("gr01_shortest_times", _times("SELECT source, node, seconds FROM times"))
def _(v):
    return R.shortest_times(v.node.select(col("node").alias("source")), v.edge, v.turn)


@query(
    "gr02_time_matrix",
    _times("""SELECT a.l_orderkey AS tour_id, a.ordre AS i, b.ordre AS j, coalesce(seconds, CAST('Infinity' AS DOUBLE)) AS seconds
        FROM {lines} a JOIN {lines} b ON a.l_orderkey = b.l_orderkey LEFT JOIN times ON source = a.l_suppkey AND node = b.l_suppkey"""),
)
def _(v):
    points = v.lines.select(col("l_orderkey").alias("tour_id"), col("ordre").cast("bigint").alias("i"), col("l_suppkey").alias("node"))
    return R.time_matrix(points, v.edge, v.turn)


_PAIRS = """SELECT DISTINCT a.l_suppkey AS source, b.l_suppkey AS target FROM {lines} a JOIN {lines} b
    ON a.l_orderkey = b.l_orderkey AND b.ordre = a.ordre + 1"""


# ways back from each target by the lowest edge before, then node lists in driving order
_BACK = """prior AS (SELECT r.source, r.edge, MIN(n.edge) AS p FROM reach r JOIN step s ON s.f = r.edge
      JOIN reach n ON n.source = r.source AND n.edge = s.e AND n.d + s.w = r.d GROUP BY r.source, r.edge),
  ends AS (SELECT p.source, p.target, arg_min(r.edge, (r.d, r.edge)) AS edge FROM pairs p
      JOIN {edge} x ON x.v = p.target JOIN reach r ON r.source = p.source AND r.edge = x.e WHERE p.source <> p.target GROUP BY p.source, p.target),
  behind(source, target, edge, k) AS (SELECT source, target, edge, 0 FROM ends
    UNION ALL SELECT b.source, b.target, q.p, b.k + 1 FROM behind b JOIN prior q ON q.source = b.source AND q.edge = b.edge),
  way AS (SELECT source, target, k, v AS node FROM behind JOIN {edge} x ON x.e = edge
    UNION ALL SELECT source, target, MAX(k) + 1, source FROM behind GROUP BY source, target)"""


@query(
    "gr03_shortest_paths",
    _times(
        """SELECT p.source, p.target, seconds, CASE WHEN p.source = p.target THEN CAST(p.source AS VARCHAR) ELSE path END AS path
        FROM pairs p LEFT JOIN times t ON t.source = p.source AND t.node = p.target LEFT JOIN (
          SELECT source, target, string_agg(CAST(node AS VARCHAR), '>' ORDER BY k DESC) AS path FROM way GROUP BY source, target) w
        ON w.source = p.source AND w.target = p.target""",
        f"pairs AS ({_PAIRS})", _BACK,
    ),
)
def _(v):
    """The whole node list and the driving time of every pair."""
    return R.shortest_paths(v.sql(_PAIRS), v.edge, v.turn).select(
        "source", "target", "seconds", F.array_join(F.transform("nodes", lambda n: n.cast("string")), ">").alias("path")
    )


_PLACED = "SELECT s.*, lat, lon FROM {stop} s JOIN (SELECT id, lat, lon FROM {parcel}) p ON id = s.colis_id"
_WAY = f"""located AS (SELECT * FROM ({_PLACED}) x WHERE lat IS NOT NULL),
  placed AS (SELECT tour_id, row_number() OVER (PARTITION BY tour_id ORDER BY ordre) AS pos, lat, lon, statut <> 'a_livrer' AS done FROM located),
  back AS (SELECT tour_id, coalesce(MAX(pos), 0) + 1 AS pos, MIN(return_lat) AS lat, MIN(return_lon) AS lon, coalesce(bool_and(done), false) AS done
    FROM {{tour}} LEFT JOIN placed USING (tour_id) WHERE return_to_depot GROUP BY tour_id),
  place AS (SELECT tour_id, 0 AS pos, depot_lat AS lat, depot_lon AS lon, false AS done FROM {{tour}} UNION ALL SELECT * FROM placed UNION ALL SELECT * FROM back)"""


_LEGS = (
    _WAY,
    _NEAREST.replace("{place}", "place"),
    """spot AS (SELECT p.*, node FROM place p LEFT JOIN snapped s ON s.lat = p.lat AND s.lon = p.lon),
      legs AS (SELECT x.tour_id, CAST(x.pos AS BIGINT) AS leg, y.done, x.lat, x.lon, y.lat AS lat2, y.lon AS lon2, x.node AS a, y.node AS b
        FROM spot x JOIN spot y ON y.tour_id = x.tour_id AND y.pos = x.pos + 1)""",
)


def _segments(v):
    points = R.route_points(v.tour, v.sql(_PLACED))
    return R.route_segments(points, v.node, v.edge, v.turn)


def _micro_sql(x: str) -> str:
    return f"CAST(CAST(floor({x} * 1000000 + 0.5) AS BIGINT) AS VARCHAR)"


def _micro(x):
    return F.floor(x * 1000000 + 0.5).cast("long").cast("string")


_POINT = _micro_sql("lat") + " || ',' || " + _micro_sql("lon")
_LINES = (
    *_LEGS, "pairs AS (SELECT DISTINCT a AS source, b AS target FROM legs WHERE a IS NOT NULL AND b IS NOT NULL)", _BACK,
    f"""road AS (SELECT source, target, string_agg({_POINT.replace("lat", "nlat").replace("lon", "nlon")}, ' ' ORDER BY k DESC) AS line
      FROM way JOIN nodes n ON n.node = way.node GROUP BY source, target)""",
    f"""drawn AS (SELECT tour_id, leg, done, coalesce(line, {_POINT} || ' ' || {_POINT.replace("lat", "lat2").replace("lon", "lon2")}) AS line
      FROM legs LEFT JOIN road ON source = a AND target = b)""",
)


@query("gr04_route_segments", _times("SELECT tour_id, leg, done, line FROM drawn", *_LINES))
def _(v):
    """Every leg's whole line in millionths of a degree."""
    return _segments(v).select(
        "tour_id", col("leg").cast("bigint").alias("leg"), "done",
        F.array_join(F.transform("line", lambda p: F.concat(_micro(p["lat"]), lit(","), _micro(p["lon"]))), " ").alias("line"),
    )


@query(
    "io07_route_features",
    _times("SELECT tour_id, leg, CAST(done AS VARCHAR) AS done, 'LineString' AS kind, line FROM drawn", *_LINES),
)
def _(v):
    """Every leg's GeoJSON text read again: all coordinates, in millionths of a degree."""
    from roundsman.sources.geojson import route_features

    kind = "struct<properties: struct<done: string>, geometry: struct<type: string, coordinates: array<array<double>>>>"
    feature = route_features(_segments(v)).select("tour_id", "leg", F.from_json("json", kind).alias("f"))
    return feature.select(
        "tour_id", col("leg").cast("bigint").alias("leg"), col("f.properties.done").alias("done"), col("f.geometry.type").alias("kind"),
        F.array_join(F.transform("f.geometry.coordinates", lambda p: F.concat(_micro(p[1]), lit(","), _micro(p[0]))), " ").alias("line"),
    )


@query(
    "gr05_graph_stats",
    """SELECT COUNT(*) AS nodes, MAX(coalesce(o, 0)) AS max_out, MAX(coalesce(i, 0)) AS max_in,
          COUNT(*) FILTER (WHERE o IS NULL) AS no_way_out, COUNT(*) FILTER (WHERE i IS NULL) AS no_way_in,
          (SELECT COUNT(*) FROM {edge}) AS edges, (SELECT COUNT(*) FROM {turn}) AS turns
        FROM {node} LEFT JOIN (SELECT u, COUNT(*) AS o FROM {edge} GROUP BY u) a ON u = node
          LEFT JOIN (SELECT v, COUNT(*) AS i FROM {edge} GROUP BY v) b ON v = node""",
)
def _(v):
    return R.graph_stats(v.node, v.edge, v.turn)


_MEMBERS = """SELECT c_custkey AS id, CASE WHEN c_nationkey % 3 = 0 THEN '' WHEN c_nationkey % 3 = 1 THEN c_mktsegment END AS community_name,
    c_nationkey AS community FROM {customer}"""


@query(
    "gr06_community_rollup",
    f"""SELECT coalesce(nullif(community_name, ''), 'Communauté ' || community) AS community, COUNT(*) AS members FROM ({_MEMBERS}) x GROUP BY 1""",
)
def _(v):
    return R.community_rollup(v.sql(_MEMBERS))


_LINKS = """SELECT l_partkey AS source, l_suppkey * 23 AS target, l_returnflag AS relation,
    CASE WHEN l_linestatus = 'O' THEN 'INFERRED' END AS confidence FROM {lineitem}"""


@query(
    "jn13_node_link_report",
    f"""WITH links AS ({_LINKS}), names AS (SELECT p_partkey AS id, p_name AS label FROM {{part}})
      SELECT a.id AS node, 'out' AS direction, relation, b.id AS other, b.label AS other_label, coalesce(confidence = 'INFERRED', false) AS inferred
        FROM links JOIN names a ON a.id = source JOIN names b ON b.id = target
      UNION ALL SELECT b.id, 'in', relation, a.id, a.label, coalesce(confidence = 'INFERRED', false)
        FROM links JOIN names a ON a.id = source JOIN names b ON b.id = target
      UNION ALL SELECT id, 'isolated', NULL, NULL, NULL, false FROM names
        WHERE id NOT IN (SELECT source FROM links) AND id NOT IN (SELECT target FROM links)""",
)
def _(v):
    nodes = v.part.select(col("p_partkey").alias("id"), col("p_name").alias("label"))
    return R.node_link_report(nodes, v.sql(_LINKS))
