"""Queries over whole plans, on times of the derived roads."""

from __future__ import annotations

from pyspark.sql import functions as F

from roundsman.operators import journeys as J
from roundsman.plans.places import _NEAREST
from roundsman.plans.registry import query
from roundsman.plans.roads import _times
from roundsman.plans.touring import _FIRST, _LOCATED, _WALK, PENALTY, _improved

col = F.col

_POINTS = """taken AS (SELECT p.tour_id, id, p.lat, p.lon, avant12h,
      row_number() OVER (PARTITION BY p.tour_id ORDER BY p.statut <> 'pret', id) AS i
      FROM {parcel} p JOIN {tour} t ON t.tour_id = p.tour_id WHERE p.statut IN ('pret', 'en_tournee')),
  sizes AS (SELECT tour_id, COUNT(*) AS n FROM taken GROUP BY tour_id),
  pts AS (SELECT tour_id, CAST(0 AS BIGINT) AS i, NULL AS colis_id, depot_lat AS lat, depot_lon AS lon, false AS avant12h, false AS fixed_end FROM {tour}
    UNION ALL SELECT tour_id, i, id, lat, lon, avant12h, false FROM taken
    UNION ALL SELECT t.tour_id, coalesce(n, 0) + 1, NULL, return_lat, return_lon, false, true FROM {tour} t
      LEFT JOIN sizes s ON s.tour_id = t.tour_id WHERE return_to_depot)"""


def _matrix_of(points: str) -> str:
    """Road times between the snapped points of each tour."""
    return f"""spot AS (SELECT p.tour_id, p.i, coalesce(s.node, 0) AS node FROM {points} p LEFT JOIN snapped s ON s.lat = p.lat AND s.lon = p.lon),
  mtx AS (SELECT a.tour_id, a.i, b.i AS j, coalesce(t.seconds, CAST('Infinity' AS DOUBLE)) AS seconds FROM spot a JOIN spot b ON b.tour_id = a.tour_id
    LEFT JOIN times t ON t.source = a.node AND t.node = b.node)"""


def _looked_up(i: str, j: str) -> str:
    return f"mat[CAST({i} * np + {j} + 1 AS BIGINT)]"


def _named(sql: str) -> str:
    return sql.replace("{tpoint}", "pts").replace("{matrix}", "mtx")


@query(
    "pl01_compute_tours",
    _times(
        """SELECT o.tour_id, p.colis_id, o.pos + 1 AS ordre, m.seconds AS leg_s
        FROM (SELECT *, coalesce(lag(i) OVER (PARTITION BY tour_id ORDER BY pos), 0) AS prev FROM placed) o
          JOIN pts p ON p.tour_id = o.tour_id AND p.i = o.i JOIN mtx m ON m.tour_id = o.tour_id AND m.i = o.prev AND m.j = o.i WHERE NOT p.fixed_end""",
        _POINTS, _NEAREST.replace("{place}", "pts"), _matrix_of("pts"), _named(_WALK), _named(_FIRST),
        "mats AS (SELECT tour_id, list(seconds ORDER BY i, j) AS mat, CAST(round(sqrt(COUNT(*))) AS BIGINT) AS np FROM mtx GROUP BY tour_id)",
        "ready AS (SELECT g.*, mat, np FROM given g JOIN mats USING (tour_id))",
        _improved("ready", _looked_up).replace("noon, lim", "noon, mat, np, lim"),
    ),
)
def _(v):
    """From parcels to numbered stops: snapped, timed on the roads, ordered."""
    tours = v.tour.select("tour_id", col("depot_lat").alias("start_lat"), col("depot_lon").alias("start_lon"), "return_to_depot",
                          col("return_lat").alias("depot_lat"), col("return_lon").alias("depot_lon"))
    _, stops, _ = J.compute_tours(tours, v.parcel, v.node, v.edge, v.turn, PENALTY)
    return stops.select("tour_id", "colis_id", "ordre", "leg_s")


_NEW = """SELECT tour_id, 'new' || CAST(tour_id AS STRING) AS colis_id, 48 + CAST(tour_id % 83 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lat,
    5 + CAST(tour_id % 37 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lon FROM {tour} WHERE statut = 'en_cours'"""


@query(
    "pl02_insert_parcel",
    _times(
        """SELECT tour_id, colis_id, ordre, statut, false AS unplaced, CAST(NULL AS DOUBLE) AS extra_s FROM st WHERE statut <> 'a_livrer' OR tour_id NOT IN (SELECT tour_id FROM gap)
      UNION ALL SELECT tour_id, colis_id, CASE WHEN NOT located THEN base + n + 1 + k WHEN k > gap THEN base + k + 1 ELSE base + k END, statut, NOT located, NULL FROM rk
      UNION ALL SELECT g.tour_id, colis_id, coalesce(base, 0) + least(gap, coalesce(n, 0)) + 1, 'a_livrer', false, extra FROM gap g LEFT JOIN b ON b.tour_id = g.tour_id""",
        f"fresh AS ({_NEW.replace('STRING', 'VARCHAR')}), st AS ({_LOCATED})",
        """last AS (SELECT tour_id, arg_max(colis_id, ordre) AS colis_id FROM {stop} WHERE statut <> 'a_livrer' GROUP BY tour_id),
        ahead AS (SELECT s.tour_id, row_number() OVER (PARTITION BY s.tour_id ORDER BY ordre) AS k, p.lat, p.lon FROM {stop} s
          JOIN {parcel} p ON p.id = s.colis_id WHERE s.statut = 'a_livrer' AND p.lat IS NOT NULL),
        open_n AS (SELECT tour_id, COUNT(*) AS n FROM ahead GROUP BY tour_id),
        route AS (SELECT t.tour_id, CAST(0 AS BIGINT) AS i, coalesce(p.lat, depot_lat) AS lat, coalesce(p.lon, depot_lon) AS lon FROM {tour} t
            LEFT JOIN last l ON l.tour_id = t.tour_id LEFT JOIN {parcel} p ON p.id = l.colis_id
          UNION ALL SELECT tour_id, k, lat, lon FROM ahead
          UNION ALL SELECT t.tour_id, coalesce(n, 0) + 1, return_lat, return_lon FROM {tour} t LEFT JOIN open_n o ON o.tour_id = t.tour_id WHERE return_to_depot),
        pts AS (SELECT r.* FROM route r JOIN fresh f ON f.tour_id = r.tour_id
          UNION ALL SELECT f.tour_id, coalesce(n, 0) + 2, lat, lon FROM fresh f LEFT JOIN open_n o ON o.tour_id = f.tour_id)""",
        _NEAREST.replace("{place}", "pts"), _matrix_of("pts"),
        """priced AS (SELECT a.tour_id, a.i AS k, x.seconds + y.seconds - d.seconds AS extra FROM route a JOIN fresh f ON f.tour_id = a.tour_id
          JOIN route b ON b.tour_id = a.tour_id AND b.i = a.i + 1 LEFT JOIN open_n o ON o.tour_id = a.tour_id
          JOIN mtx x ON x.tour_id = a.tour_id AND x.i = a.i AND x.j = coalesce(n, 0) + 2
          JOIN mtx y ON y.tour_id = a.tour_id AND y.i = coalesce(n, 0) + 2 AND y.j = b.i
          JOIN mtx d ON d.tour_id = a.tour_id AND d.i = a.i AND d.j = b.i),
        best AS (SELECT * FROM priced WHERE NOT isnan(extra) AND extra < CAST('Infinity' AS DOUBLE)
          QUALIFY row_number() OVER (PARTITION BY tour_id ORDER BY extra, k) = 1),
        gap AS (SELECT f.tour_id, f.colis_id, coalesce(k, 0) AS gap, extra FROM fresh f LEFT JOIN best b ON b.tour_id = f.tour_id),
        b AS (SELECT tour_id, coalesce(MAX(ordre) FILTER (WHERE statut <> 'a_livrer'), 0) AS base,
          COUNT(*) FILTER (WHERE statut = 'a_livrer' AND located) AS n FROM st GROUP BY tour_id),
        rk AS (SELECT st.*, base, n, least(gap, n) AS gap, row_number() OVER (PARTITION BY st.tour_id, located ORDER BY ordre) AS k
          FROM st JOIN gap ON gap.tour_id = st.tour_id JOIN b ON b.tour_id = st.tour_id WHERE statut = 'a_livrer')""",
    ),
)
def _(v):
    """A late parcel into every running tour, where the road times make it cheapest."""
    v.keep("lines")  # stops and parcels are made from them
    stops, gaps = J.insert_parcels(v.sql(_NEW), v.tour, v.stop, v.parcel, v.node, v.edge, v.turn)
    return stops.join(gaps.select("tour_id", "colis_id", "extra_s"), ["tour_id", "colis_id"], "left").select(
        "tour_id", "colis_id", "ordre", "statut", "unplaced", "extra_s"
    )
