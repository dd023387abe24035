"""Queries over tour building, ordering, status and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from roundsman.operators import ordering as O
from roundsman.operators import status as S
from roundsman.operators import tours as T
from roundsman.plans.registry import query

col, lit = F.col, F.lit

#: Noon penalty per position in seconds, and the stay at a stop.
PENALTY, DWELL = 1200.0, 180.0

_LEG = """(CASE WHEN {{i}} = {{j}} THEN CAST(0 AS DOUBLE) WHEN ({{i}} * 7 + {{j}} * 3 + tour_id) % 23 = 0 THEN CAST('Infinity' AS DOUBLE)
    ELSE CAST(30 + ({{i}} * 37 + {{j}} * 91 + tour_id * 13) % 600 AS DOUBLE) END)"""


def _leg(i: str, j: str) -> str:
    """Closed form of the derived matrix."""
    return _LEG.replace("{{i}}", i).replace("{{j}}", j)


def _seconds(column):
    return F.unix_seconds(column.cast("timestamp"))


@query("tr01_eligible", "SELECT id, CAST(CASE statut WHEN 'pret' THEN 0 ELSE 1 END AS BIGINT) AS rank FROM {parcel} WHERE statut IN ('pret', 'en_tournee')")
def _(v):
    return T.eligible(v.parcel).select("id", col("rank").cast("bigint").alias("rank"))


@query(
    "tr02_tour_points",
    """WITH taken AS (SELECT p.tour_id, id, p.lat, p.lon, avant12h,
        row_number() OVER (PARTITION BY p.tour_id ORDER BY p.statut <> 'pret', id) AS i
        FROM {parcel} p JOIN {tour} t ON t.tour_id = p.tour_id WHERE p.statut IN ('pret', 'en_tournee')),
      sizes AS (SELECT tour_id, COUNT(*) AS n FROM taken GROUP BY tour_id)
      SELECT tour_id, CAST(0 AS BIGINT) AS i, NULL AS colis_id, depot_lat AS lat, depot_lon AS lon, 'start' AS kind, false AS avant12h, false AS fixed_end FROM {tour}
      UNION ALL SELECT tour_id, i, id, lat, lon, 'parcel', avant12h, false FROM taken
      UNION ALL SELECT t.tour_id, coalesce(n, 0) + 1, NULL, return_lat, return_lon, 'return', false, true FROM {tour} t
        LEFT JOIN sizes s ON s.tour_id = t.tour_id WHERE return_to_depot""",
)
def _(v):
    tours = v.tour.select("tour_id", col("depot_lat").alias("start_lat"), col("depot_lon").alias("start_lon"), "return_to_depot",
                          col("return_lat").alias("depot_lat"), col("return_lon").alias("depot_lon"))
    return T.tour_points(tours, v.parcel)


@query(
    "tr03_tour_cost",
    f"""SELECT tour_id, SUM({_leg('prev', 'i')} + CASE WHEN avant12h THEN pos * {PENALTY} ELSE 0 END) AS cost
        FROM (SELECT *, coalesce(lag(i) OVER (PARTITION BY tour_id ORDER BY pos), 0) AS prev FROM {{torder}}) o GROUP BY tour_id""",
)
def _(v):
    return O.tour_cost(v.torder, v.matrix, PENALTY)


_WALK = f"""hop AS (SELECT m.tour_id, m.i, m.j, m.seconds FROM {{matrix}} m JOIN {{tpoint}} p ON p.tour_id = m.tour_id AND p.i = m.j
      WHERE m.i <> m.j AND m.j > 0 AND NOT fixed_end AND NOT isinf(seconds)),
  walk(tour_id, pos, i, seen) AS (SELECT DISTINCT tour_id, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), [CAST(0 AS BIGINT)] FROM {{tpoint}}
    UNION ALL SELECT tour_id, pos + 1, j, list_append(seen, j) FROM (SELECT w.tour_id, pos, h.j, seen,
        row_number() OVER (PARTITION BY w.tour_id ORDER BY seconds, h.j) AS k
      FROM walk w JOIN hop h ON h.tour_id = w.tour_id AND h.i = w.i WHERE NOT list_contains(seen, h.j)) n WHERE k = 1),
  done AS (SELECT tour_id, arg_max(seen, pos) AS seen, MAX(pos) AS last FROM walk GROUP BY tour_id),
  left_over AS (SELECT p.tour_id, last + row_number() OVER (PARTITION BY p.tour_id ORDER BY p.i) AS pos, p.i FROM {{tpoint}} p JOIN done d ON d.tour_id = p.tour_id
    WHERE p.i > 0 AND NOT fixed_end AND NOT list_contains(seen, p.i)),
  nn AS (SELECT tour_id, pos, i FROM walk WHERE pos >= 0 UNION ALL SELECT * FROM left_over
    UNION ALL SELECT p.tour_id, (SELECT COUNT(*) FROM {{tpoint}} q WHERE q.tour_id = p.tour_id AND q.i > 0 AND NOT q.fixed_end), p.i
      FROM {{tpoint}} p WHERE fixed_end)"""


@query("tr04_nearest_neighbor", f"WITH RECURSIVE {_WALK} SELECT tour_id, pos, i FROM nn", flat_rows=True)
def _(v):
    return O.nearest_neighbor(v.tpoint, v.matrix)


def _improved(start: str, leg=_leg) -> str:
    """Scan-order 2-opt by full re-pricing of every reversal, over ``start(tour_id, ord, flags, lim)``."""
    price = f"""list_sum(list_transform(range(1, len(o) + 1), lambda p: {leg('(CASE WHEN p = 1 THEN 0 ELSE o[p - 1] END)', 'o[p]')}
        + CASE WHEN list_contains(noon, o[p]) THEN (p - 1) * {PENALTY} ELSE 0 END))"""
    return f"""begin AS (SELECT tour_id, ord AS o, noon, lim FROM {start}),
  scan(tour_id, o, noon, lim, cost, ca, cb, k) AS (SELECT tour_id, o, noon, lim, {price}, CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), 0 FROM begin WHERE lim >= 4
    UNION ALL SELECT tour_id, o, noon, lim, price, a, b, k + 1 FROM (
      SELECT *, row_number() OVER (PARTITION BY tour_id ORDER BY (a < ca OR (a = ca AND b <= cb)), a, b) AS r FROM (
        SELECT *, {price} AS price FROM (
          SELECT s.tour_id, list_concat(s.o[:a], list_reverse(s.o[a + 1:b + 1]), s.o[b + 2:]) AS o, noon, lim, cost, ca, cb, k, a, b
          FROM scan s, (SELECT x AS a, y AS b FROM range(0, 20) t(x), range(0, 20) u(y) WHERE x < y) ab WHERE b < lim) c) d
      WHERE price < cost - 1e-9) e WHERE r = 1),
  final AS (SELECT tour_id, arg_max(o, k) AS o FROM scan GROUP BY tour_id UNION ALL SELECT tour_id, o FROM begin WHERE lim < 4),
  placed AS (SELECT tour_id, CAST(p - 1 AS BIGINT) AS pos, o[p] AS i FROM (SELECT tour_id, o, unnest(range(1, len(o) + 1)) AS p FROM final) z)"""


_GIVEN = """given AS (SELECT tour_id, list(i ORDER BY i) AS ord, list(i) FILTER (WHERE avant12h) AS noon,
    COUNT(*) FILTER (WHERE NOT fixed_end) AS lim FROM {tpoint} WHERE i > 0 GROUP BY tour_id)"""


@query("tr05_two_opt", f"WITH RECURSIVE {_GIVEN}, {_improved('given')} SELECT tour_id, pos, i FROM placed", flat_rows=True)
def _(v):
    orders = v.tpoint.where(col("i") > 0).select("tour_id", (col("i") - 1).alias("pos"), "i", "avant12h", col("fixed_end").alias("locked"))
    return O.two_opt(orders, v.matrix, PENALTY).select("tour_id", "pos", "i")


_FIRST = """given AS (SELECT n.tour_id, list(n.i ORDER BY n.pos) AS ord, list(n.i) FILTER (WHERE avant12h) AS noon,
    COUNT(*) FILTER (WHERE NOT fixed_end) AS lim FROM nn n JOIN {tpoint} p ON p.tour_id = n.tour_id AND p.i = n.i GROUP BY n.tour_id)"""


@query(
    "tr06_optimize",
    f"""WITH RECURSIVE {_WALK}, {_FIRST}, {_improved('given')} SELECT tour_id, pos, i, {_leg('prev', 'i')} AS seconds
      FROM (SELECT *, coalesce(lag(i) OVER (PARTITION BY tour_id ORDER BY pos), 0) AS prev FROM placed) q""",
    flat_rows=True,
)
def _(v):
    return O.optimize(v.tpoint, v.matrix, PENALTY)


@query("tr04_nearest_neighbor_long", "WITH RECURSIVE " + _WALK.replace("{tpoint}", "{long_tpoint}").replace("{matrix}", "{long_matrix}") + " SELECT tour_id, pos, i FROM nn", flat_rows=True)
def _(v):
    """Tours by order beside tours of some 290 points."""
    return O.nearest_neighbor(v.long_tpoint, v.long_matrix)


@query("tr06_optimize_long", None, flat_rows=True)
def _(v):
    """As above, improved; re-pricing every reversal of a long tour is too slow in SQL, so tests compare with a plain scan."""
    return O.optimize(v.long_tpoint, v.long_matrix, 60.0)


_TIMED = f"""timed AS (SELECT o.tour_id, o.pos, o.i, {_leg('prev', 'o.i').replace('tour_id', 'o.tour_id')} AS seconds, p.colis_id, fixed_end
    FROM (SELECT *, coalesce(lag(i) OVER (PARTITION BY tour_id ORDER BY pos), 0) AS prev FROM {{torder}}) o JOIN {{tpoint}} p ON p.tour_id = o.tour_id AND p.i = o.i)"""


@query(
    "tr07_build_tours",
    f"""WITH {_TIMED} SELECT tour_id, SUM(seconds) AS total_s, COUNT(*) FILTER (WHERE NOT fixed_end) AS stops, bool_or(fixed_end) AS return_to_depot,
      'en_cours' AS statut FROM timed GROUP BY tour_id""",
)
def _(v):
    return T.build_tours(v.torder, v.matrix, v.tpoint)[0]


@query(
    "tr07_tour_stops",
    f"WITH {_TIMED} SELECT tour_id, colis_id, pos + 1 AS ordre, 'a_livrer' AS statut, seconds AS leg_s FROM timed WHERE NOT fixed_end",
)
def _(v):
    return T.build_tours(v.torder, v.matrix, v.tpoint)[1].drop("delivered_at")


@query(
    "tr07_stop_numbers",
    """SELECT o.tour_id, colis_id, CAST(pos + 1 AS BIGINT) AS ordre FROM {torder} o JOIN {tpoint} p ON p.tour_id = o.tour_id AND p.i = o.i
        WHERE NOT fixed_end""",
)
def _(v):
    stops = T.build_tours(v.torder, v.matrix, v.tpoint)[1]
    return stops.select("tour_id", "colis_id", col("ordre").cast("bigint").alias("ordre"))


@query(
    "tr07_start_parcels",
    """SELECT id, CASE WHEN id IN (SELECT colis_id FROM {stop}) THEN 'en_tournee' ELSE statut END AS statut FROM {parcel}""",
)
def _(v):
    return T.start_parcels(v.parcel, v.stop).select("id", "statut")


@query(
    "tr08_cheapest_gap",
    f"""WITH ways AS (SELECT p.tour_id, i AS k, n + 1 AS x FROM {{tpoint}} p JOIN {{tour_size}} s ON s.tour_id = p.tour_id WHERE i <= n),
      gaps AS (SELECT tour_id, k, x, {_leg('k', 'x')} + {_leg('x', '(k + 1)')} - {_leg('k', '(k + 1)')} AS extra FROM ways WHERE k < x - 1),
      best AS (SELECT * FROM gaps WHERE NOT isnan(extra) AND extra < CAST('Infinity' AS DOUBLE) QUALIFY row_number() OVER (PARTITION BY tour_id ORDER BY extra, k) = 1)
      SELECT t.tour_id, coalesce(k, 0) AS gap, extra AS extra_s FROM {{tour_size}} t LEFT JOIN best b ON b.tour_id = t.tour_id""",
)
def _(v):
    sizes = v.tour_size
    route = v.tpoint.join(sizes, "tour_id").where(col("i") <= col("n")).select("tour_id", col("i").alias("k"), "i")
    return T.cheapest_gap(route, sizes.select("tour_id", (col("n") + 1).alias("i")), v.matrix)


_GAPS = "SELECT tour_id, tour_id % 4 AS gap, 'new' || CAST(tour_id AS STRING) AS colis_id FROM {tour} WHERE statut = 'en_cours'"
_LOCATED = "SELECT s.*, coalesce(lat IS NOT NULL, false) AS located FROM {stop} s LEFT JOIN (SELECT id, lat FROM {parcel}) p ON id = s.colis_id"


@query(
    "tr09_apply_insertion",
    f"""WITH gaps AS ({_GAPS}), st AS ({_LOCATED}), b AS (SELECT tour_id, coalesce(MAX(ordre) FILTER (WHERE statut <> 'a_livrer'), 0) AS base,
        COUNT(*) FILTER (WHERE statut = 'a_livrer' AND located) AS n FROM st GROUP BY tour_id),
      rk AS (SELECT st.*, base, n, least(gap, n) AS gap, row_number() OVER (PARTITION BY st.tour_id, located ORDER BY ordre) AS k
        FROM st JOIN gaps ON gaps.tour_id = st.tour_id JOIN b ON b.tour_id = st.tour_id WHERE statut = 'a_livrer')
      SELECT tour_id, colis_id, ordre, statut, false AS unplaced FROM st WHERE statut <> 'a_livrer' OR tour_id NOT IN (SELECT tour_id FROM gaps)
      UNION ALL SELECT tour_id, colis_id, CASE WHEN NOT located THEN base + n + 1 + k WHEN k > gap THEN base + k + 1 ELSE base + k END, statut, NOT located FROM rk
      UNION ALL SELECT g.tour_id, colis_id, coalesce(base, 0) + least(gap, coalesce(n, 0)) + 1, 'a_livrer', false FROM gaps g LEFT JOIN b ON b.tour_id = g.tour_id""",
)
def _(v):
    return T.apply_insertion(v.sql(_LOCATED), v.sql(_GAPS)).select("tour_id", "colis_id", "ordre", "statut", "unplaced")


@query(
    "tr10_reference_point",
    """WITH last AS (SELECT tour_id, arg_max(colis_id, ordre) AS colis_id FROM {stop} WHERE statut <> 'a_livrer' GROUP BY tour_id)
      SELECT t.tour_id, coalesce(p.lat, depot_lat) AS lat, coalesce(p.lon, depot_lon) AS lon FROM {tour} t
        LEFT JOIN last l ON l.tour_id = t.tour_id LEFT JOIN {parcel} p ON p.id = l.colis_id""",
)
def _(v):
    return T.reference_point(v.tour, v.stop, v.parcel)


_MOVES = "SELECT tour_id, tour_id % 4 + 1 AS ordre, CASE WHEN tour_id % 3 = 0 THEN -1 ELSE 1 END AS direction FROM {tour}"


@query(
    "tr11_move_stops",
    f"""WITH m AS ({_MOVES}), s AS (SELECT s.*, m.ordre AS here_at, direction, bool_or(s.ordre = m.ordre) OVER w AS here, MAX(s.ordre) OVER w AS n
        FROM {{stop}} s LEFT JOIN m ON m.tour_id = s.tour_id WINDOW w AS (PARTITION BY s.tour_id))
      SELECT tour_id, colis_id, CASE WHEN NOT coalesce(here, false) OR here_at + direction < 1 OR here_at + direction > n THEN ordre
        WHEN ordre = here_at THEN here_at + direction WHEN ordre = here_at + direction THEN here_at ELSE ordre END AS ordre FROM s""",
)
def _(v):
    return T.move_stops(v.stop, v.sql(_MOVES)).select("tour_id", "colis_id", "ordre")


@query(
    "tr12_insert_or_defer",
    """SELECT id, coalesce(t.statut = 'en_cours' AND p.statut = 'pret' AND geocode_status = 'ok', false) AS inserted
        FROM {parcel} p LEFT JOIN {tour} t ON t.tour_id = p.tour_id""",
)
def _(v):
    now, later = T.insert_or_defer(v.parcel, v.tour)
    return now.select("id", lit(True).alias("inserted")).unionByName(later.select("id", lit(False).alias("inserted")))


@query(
    "ag01_parcel_states",
    """SELECT colis_id, arg_max(CASE kind WHEN 'failed' THEN 'echec' WHEN 'report' THEN 'pret' ELSE 'livre' END, (ts, seq)) AS statut
        FROM {event} WHERE kind <> 'archive' GROUP BY colis_id""",
)
def _(v):
    return S.fold_events(v.event)[0]


@query(
    "ag01_stop_states",
    """WITH closed AS (SELECT tour_id, MIN((ts, seq)) AS c FROM {event} WHERE kind = 'archive' GROUP BY tour_id),
      touch AS (SELECT e.* FROM {event} e LEFT JOIN closed USING (tour_id) WHERE kind IN ('delivered', 'failed') OR (kind = 'direct' AND (c IS NULL OR (ts, seq) < c))),
      lagged AS (SELECT *, lag(kind) OVER (PARTITION BY tour_id, ordre ORDER BY ts, seq) AS p FROM touch),
      eff AS (SELECT * FROM lagged WHERE kind <> 'direct' OR p IS NULL OR p = 'failed')
      SELECT tour_id, ordre, arg_max(CASE WHEN kind = 'failed' THEN 'echec' ELSE 'livre' END, (ts, seq)) AS statut,
        CAST(floor(epoch(MAX(ts) FILTER (WHERE kind <> 'failed'))) AS BIGINT) AS delivered_s, CAST(floor(epoch(MAX(ts) FILTER (WHERE kind = 'failed'))) AS BIGINT) AS failed_s,
        arg_max(raison, (ts, seq)) FILTER (WHERE kind = 'failed') AS raison FROM eff GROUP BY tour_id, ordre""",
)
def _(v):
    stops = S.fold_events(v.event)[1]
    return stops.select("tour_id", "ordre", "statut", _seconds(col("delivered_at")).alias("delivered_s"),
                        _seconds(col("failed_at")).alias("failed_s"), col("raison_echec").alias("raison"))


@query("ag01_tour_states", "SELECT tour_id, CASE WHEN bool_or(kind = 'archive') THEN 'archivee' ELSE 'en_cours' END AS statut FROM {event} GROUP BY tour_id")
def _(v):
    return S.fold_events(v.event)[2]


@query(
    "ag02_daily_stats",
    """WITH ev AS (SELECT CAST(delivered_at AS DATE) AS day, 1 AS l, 0 AS e FROM {stop} WHERE statut = 'livre' AND delivered_at IS NOT NULL
        UNION ALL SELECT CAST(failed_at AS DATE), 0, 1 FROM {stop} WHERE statut = 'echec' AND failed_at IS NOT NULL),
      d AS (SELECT day, CAST(SUM(l) AS BIGINT) AS livres, CAST(SUM(e) AS BIGINT) AS echecs FROM ev GROUP BY day),
      t AS (SELECT CAST(date_creation AS DATE) AS day, SUM(total_s) AS duree_s, COUNT(*) AS tours FROM {tour} GROUP BY 1)
      SELECT strftime(day, '%Y-%m-%d') AS day, coalesce(livres, 0) AS livres, coalesce(echecs, 0) AS echecs, coalesce(duree_s, 0) AS duree_s,
        coalesce(tours, 0) AS tours FROM d FULL JOIN t USING (day)""",
)
def _(v):
    return S.daily_stats(v.tour, v.stop).withColumn("day", col("day").cast("string"))


_ANCHOR = """anchor AS (SELECT t.tour_id, arg_max(ordre, ordre) AS o, coalesce(arg_max(coalesce(delivered_at, failed_at), ordre), MIN(date_creation)) AS a
      FROM {tour} t LEFT JOIN (SELECT * FROM {stop} WHERE statut <> 'a_livrer' AND coalesce(delivered_at, failed_at) IS NOT NULL) s ON s.tour_id = t.tour_id GROUP BY t.tour_id),
  ahead AS (SELECT s.*, a FROM {stop} s JOIN anchor ON anchor.tour_id = s.tour_id WHERE o IS NULL OR ordre > o)"""


@query(
    "ag03_etas",
    f"""WITH {_ANCHOR} SELECT tour_id, ordre, CAST(epoch(a) + SUM(coalesce(leg_s, 0)) OVER w + (row_number() OVER w - 1) * {DWELL} AS BIGINT) AS eta
      FROM ahead WINDOW w AS (PARTITION BY tour_id ORDER BY ordre ROWS UNBOUNDED PRECEDING)""",
)
def _(v):
    return S.etas(v.tour, v.stop, DWELL).select("tour_id", "ordre", _seconds(col("eta")).alias("eta"))


@query(
    "ag04_depot_etas",
    f"""WITH {_ANCHOR}, sums AS (SELECT tour_id, SUM(coalesce(leg_s, 0)) AS l, COUNT(*) AS n FROM ahead GROUP BY tour_id),
      alls AS (SELECT tour_id, SUM(coalesce(leg_s, 0)) AS t FROM {{stop}} GROUP BY tour_id)
      SELECT t.tour_id, CAST(epoch(a) + coalesce(l, 0) + coalesce(n, 0) * {DWELL} + greatest(0, total_s - coalesce(alls.t, 0)) AS BIGINT) AS eta
      FROM {{tour}} t JOIN anchor ON anchor.tour_id = t.tour_id LEFT JOIN sums ON sums.tour_id = t.tour_id LEFT JOIN alls ON alls.tour_id = t.tour_id
      WHERE return_to_depot""",
)
def _(v):
    return S.depot_etas(v.tour, v.stop, DWELL).select("tour_id", _seconds(col("depot_eta")).alias("eta"))


@query(
    "ag05_preparation_summary",
    """SELECT tour_id, CAST(SUM(CASE WHEN statut NOT IN ('livre', 'echec') THEN coalesce(nullif(quantite, 0), 1) ELSE 0 END) AS BIGINT) AS total_qty,
        COUNT(*) FILTER (WHERE statut = 'a_verifier') AS to_check, COUNT(*) FILTER (WHERE statut = 'echec') AS failed FROM {parcel} GROUP BY tour_id""",
)
def _(v):
    return S.preparation_summary(v.parcel, ["tour_id"])


@query(
    "ag06_progress",
    """SELECT *, CAST(floor(CAST(delivered + failed AS DOUBLE) / total * 100 + 0.5) AS BIGINT) AS percent FROM (SELECT tour_id,
        COUNT(*) FILTER (WHERE statut = 'livre') AS delivered, COUNT(*) FILTER (WHERE statut = 'echec') AS failed, COUNT(*) AS total FROM {stop} GROUP BY tour_id) x""",
)
def _(v):
    return S.progress(v.stop)


@query(
    "ag07_current_stop",
    """WITH first AS (SELECT tour_id, MIN(ordre) AS ordre, arg_min(colis_id, ordre) AS colis_id FROM {stop}
        WHERE statut = 'a_livrer' AND colis_id IN (SELECT id FROM {parcel}) GROUP BY tour_id)
      SELECT tour_id, ordre, colis_id, ordre IS NULL AS all_treated FROM (SELECT DISTINCT tour_id FROM {stop}) t LEFT JOIN first USING (tour_id)""",
)
def _(v):
    return S.current_stop(v.stop, v.parcel)


@query(
    "ag08_movable",
    """SELECT tour_id, ordre, coalesce(statut = 'a_livrer' AND ordre > lo, false) AS can_move_up, coalesce(statut = 'a_livrer' AND ordre < hi, false) AS can_move_down
        FROM {stop} LEFT JOIN (SELECT tour_id, MIN(ordre) AS lo, MAX(ordre) AS hi FROM {stop} WHERE statut = 'a_livrer' GROUP BY tour_id) s USING (tour_id)""",
)
def _(v):
    return S.movable(v.stop).select("tour_id", "ordre", "can_move_up", "can_move_down")


@query(
    "ag09_filter_stops",
    """SELECT s.tour_id, ordre FROM {stop} s LEFT JOIN {parcel} p ON p.id = s.colis_id
        WHERE p.id IS NULL OR contains(lower(nom || ' ' || rue || ' ' || cp || ' ' || ville), 'rue d''azé 1')""",
)
def _(v):
    return S.filter_stops(S.stops_with_parcels(v.stop, v.scan), lit(" RUE D'AZÉ 1 ")).select("tour_id", "ordre")


@query(
    "ag10_extent",
    """SELECT tour_id, MIN(lat) AS min_lat, MAX(lat) AS max_lat, MIN(lon) AS min_lon, MAX(lon) AS max_lon, COUNT(*) AS n FROM (
        SELECT tour_id, depot_lat AS lat, depot_lon AS lon FROM {tour} UNION ALL SELECT tour_id, lat, lon FROM {parcel}
        UNION ALL SELECT tour_id, return_lat, return_lon FROM {tour}) x WHERE lat IS NOT NULL GROUP BY tour_id""",
)
def _(v):
    depots = v.tour.select("tour_id", col("depot_lat").alias("lat"), col("depot_lon").alias("lon"))
    returns = v.tour.select("tour_id", col("return_lat").alias("lat"), col("return_lon").alias("lon"))
    return S.extent(depots, v.parcel, returns, by=["tour_id"])


@query(
    "ag12_map_features",
    """SELECT s.tour_id, ordre, id AS colis_id, p.statut, lat, lon, CASE p.statut WHEN 'livre' THEN '#22c55e' WHEN 'echec' THEN '#dc2626'
          WHEN 'a_verifier' THEN '#94a3b8' ELSE '#3b82f6' END AS colour, coalesce(s.statut IN ('livre', 'echec'), false) AS done
        FROM {parcel} p LEFT JOIN {stop} s ON s.colis_id = id WHERE lat IS NOT NULL""",
)
def _(v):
    return S.map_features(v.stop, v.parcel)
