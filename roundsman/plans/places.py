"""Queries over geocoding, search and nearness."""

from __future__ import annotations

from pyspark.sql import functions as F

from roundsman.functions.text import join_number_street
from roundsman.operators import geocode as G
from roundsman.operators import spatial as P
from roundsman.operators.status import stops_with_parcels
from roundsman.operators.tours import parcels_from_favourites
from roundsman.plans import oracle as D
from roundsman.plans.registry import query

col, lit = F.col, F.lit

_POOL = """pools AS (SELECT q.*, CASE WHEN p.n IS NOT NULL THEN 'p:' || q.cp WHEN q_city <> '' AND t.n IS NOT NULL THEN 'c:' || q_city END AS pool,
    coalesce(p.n, CASE WHEN q_city <> '' THEN t.n END, 0) AS pool_size FROM {asked} q
    LEFT JOIN (SELECT cp, COUNT(*) AS n FROM {address} GROUP BY cp) p ON p.cp = q.cp
    LEFT JOIN (SELECT cn, COUNT(*) AS n FROM {address} GROUP BY cn) t ON t.cn = q_city)"""

# brute force: every query against every address of its pool
_RANKED = (
    _POOL
    + f""", books AS (SELECT *, {D.grams('rn')} AS gb FROM {{address}}), texts AS (SELECT *, {D.grams('q_street')} AS ga FROM pools),
  offers AS (SELECT query_id, q_street, q_city, q_number, ga, b.id, b.n, b.rep, b.r, b.cp AS a_cp, b.c, b.lat, b.lon, b.rn, b.cn, b.gb FROM texts JOIN books b ON pool = 'p:' || b.cp
    UNION ALL SELECT query_id, q_street, q_city, q_number, ga, b.id, b.n, b.rep, b.r, b.cp, b.c, b.lat, b.lon, b.rn, b.cn, b.gb FROM texts JOIN books b ON pool = 'c:' || b.cn),
  scored AS (SELECT *, {D.score(D.similarity('q_street', 'rn', 'ga', 'gb'))} AS score FROM offers),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 5)"""
)


@query("jn01_candidate_pool", "WITH " + _POOL + " SELECT query_id, pool, pool_size FROM pools")
def _(v):
    return G.candidate_pool(G.prepare_queries(v.query), v.address).select("query_id", "pool", "pool_size")


@query(
    "jn02_score_candidates",
    f"""SELECT query_id, round({D.score(D.similarity('q_street', 'rn', D.grams('q_street'), D.grams('rn')))}, 6) AS score
        FROM (SELECT query_id, {D.street('rue')} AS q_street, {D.city('ville')} AS q_city, trim(numero) AS q_number, n, rn, cn FROM {{pair}}) a""",
)
def _(v):
    return G.score_candidates(G.prepare_queries(v.pair)).select("query_id", F.round("score", 6).alias("score"))


@query(
    "jn03_match_addresses",
    "WITH " + _RANKED + """ SELECT p.query_id, rank, id AS address_id, round(score, 6) AS score,
        coalesce(rank = 1 AND score >= 0.72e0, false) AS accepted FROM pools p LEFT JOIN ranked r ON r.query_id = p.query_id""",
)
def _(v):
    found = G.match_addresses(v.query, v.address)
    rows = found.select("query_id", "best", F.posexplode_outer("candidates").alias("rank", "x"))
    first = (col("rank") == 0) & col("best").isNotNull()
    return rows.select(
        "query_id", (col("rank") + 1).cast("bigint").alias("rank"), col("x.address.id").alias("address_id"),
        F.round("x.score", 6).alias("score"), F.coalesce(first, lit(False)).alias("accepted"),
    )


@query(
    "jn04_geocode_parcels",
    "WITH " + _RANKED + """ SELECT p.query_id, CASE WHEN r.score >= 0.72e0 THEN 'ok' WHEN r.id IS NOT NULL THEN 'ambigu' ELSE 'non_geocode' END AS geocode,
        CASE WHEN r.score >= 0.72e0 THEN 'pret' ELSE 'a_verifier' END AS statut, CASE WHEN r.score >= 0.72e0 THEN lat END AS lat,
        CASE WHEN r.score >= 0.72e0 THEN lon END AS lon, CASE WHEN r.score >= 0.72e0 THEN n || rep || ' ' || r || ', ' || a_cp || ' ' || c END AS shown,
        CASE WHEN r.score < 0.72e0 THEN (SELECT COUNT(*) FROM ranked x WHERE x.query_id = p.query_id) END AS candidates
      FROM pools p LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) r ON r.query_id = p.query_id""",
)
def _(v):
    line = join_number_street(col("numero"), col("rue"))
    parcels = v.query.select("query_id", F.struct(line.alias("rue"), "cp", "ville").alias("adresse_raw"))
    return G.geocode_parcels(parcels, v.address).select(
        "query_id", col("geocode.status").alias("geocode"), "statut", "geocode.lat", "geocode.lon",
        col("adresse_affichage").alias("shown"),
        F.when(col("geocode.candidates").isNotNull(), F.size("geocode.candidates")).cast("bigint").alias("candidates"),
    )


_TYPED = """SELECT query_id, CASE query_id % 5 WHEN 0 THEN n || ' ' || substr(r, 5, 4) || ' ' || a_cp WHEN 1 THEN a_cp || ' ' || upper(c) || ' rue'
    WHEN 2 THEN n || ' ' || a_cp WHEN 3 THEN substr(r, 5, 5) || ' sans code' ELSE a_cp END AS query FROM {pair}"""


@query(
    "jn05_search_addresses",
    rf"""WITH typed AS ({_TYPED}), coded AS (SELECT query_id, regexp_extract(query, '\b(\d{{{{5}}}})\b', 1) AS cp, query FROM typed),
      words AS (SELECT query_id, cp, list_filter(string_split(lower(trim(replace(query, cp, ''))), ' '), lambda t: t <> '') AS terms FROM coded WHERE cp <> ''),
      hits AS (SELECT query_id, id, n || rep || ' ' || r || ', ' || a.cp || ' ' || c AS address FROM words w JOIN {{address}} a ON a.cp = w.cp
        WHERE len(list_filter(terms, lambda t: NOT contains(lower(n || rep || ' ' || r || ' ' || c), t))) = 0)
      SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank, id, address FROM hits QUALIFY rank <= 8""",
)
def _(v):
    found = G.search_addresses(v.sql(_TYPED), v.address)
    return found.select("query_id", col("rank").cast("bigint").alias("rank"), "id", "address")


_NEAREST = f"""spots AS (SELECT DISTINCT lat, lon, floor(lon / 0.005e0) AS cx, floor(lat / 0.005e0) AS cy FROM {{place}} WHERE lat IS NOT NULL),
  nodes AS (SELECT node, CAST(lat AS DOUBLE) AS nlat, CAST(lon AS DOUBLE) AS nlon FROM {{node}}),
  near AS (SELECT lat, lon, node, greatest(abs(cx - floor(nlon / 0.005e0)), abs(cy - floor(nlat / 0.005e0))) AS ring,
    {D.haversine('lat', 'lon', 'nlat', 'nlon')} AS d FROM spots, nodes),
  first AS (SELECT lat, lon, MIN(ring) AS r FROM near WHERE ring <= 80 GROUP BY lat, lon),
  snapped AS (SELECT n.lat, n.lon, node, d FROM near n JOIN first f ON f.lat = n.lat AND f.lon = n.lon WHERE ring <= least(r + 1, 80)
    QUALIFY row_number() OVER (PARTITION BY n.lat, n.lon ORDER BY d, node) = 1)"""


@query(
    "jn06_nearest_node",
    "WITH " + _NEAREST.replace("{place}", "{address}") + """ SELECT id, node, round(d, 3) AS metres FROM {address} a
      LEFT JOIN snapped s ON s.lat = a.lat AND s.lon = a.lon""",
)
def _(v):
    return P.nearest_node(v.address, v.node).select("id", "node", F.round("distance_m", 3).alias("metres"))


@query(
    "jn07_snap_points",
    "WITH " + _NEAREST.replace("{place}", "{parcel}") + """ SELECT id, coalesce(node, 0) AS node, round(d, 3) AS metres,
      (node IS NULL OR d > 2000) AS unsnapped FROM {parcel} p LEFT JOIN snapped s ON s.lat = p.lat AND s.lon = p.lon""",
)
def _(v):
    snapped = P.snap_points(v.parcel, v.node)
    return snapped.select("id", "node", F.round("distance_m", 3).alias("metres"), "unsnapped")


def _near_favourite(points: str) -> str:
    return f"""spots AS (SELECT DISTINCT lat, lon FROM {points} WHERE lat IS NOT NULL),
      favs AS (SELECT *, lat AS flat, lon AS flon FROM {{favourite}}),
      hits AS (SELECT s.lat, s.lon, f.id AS fav, f.note, {D.haversine('s.lat', 's.lon', 'flat', 'flon')} AS d FROM spots s, favs f
        WHERE {D.haversine('s.lat', 's.lon', 'flat', 'flon')} <= 60
        QUALIFY row_number() OVER (PARTITION BY s.lat, s.lon ORDER BY d, strip_accents(ville), strip_accents(rue), fav) = 1)"""


@query(
    "jn08_nearest_favourite",
    "WITH " + _near_favourite("{address}") + """ SELECT id, fav, round(d, 3) AS metres FROM {address} a
      LEFT JOIN hits h ON h.lat = a.lat AND h.lon = a.lon""",
)
def _(v):
    near = P.nearest_favourite(v.address.select("id", "lat", "lon"), v.favourite)
    return near.select("id", col("favori.id").alias("fav"), F.round("favori_m", 3).alias("metres"))


@query(
    "jn09_favourite_alerts",
    "WITH " + _near_favourite("{address}") + """ SELECT id, h.note FROM {address} a JOIN hits h ON h.lat = a.lat AND h.lon = a.lon WHERE h.note <> ''""",
)
def _(v):
    return P.favourite_alerts(v.address.select("id", "lat", "lon"), v.favourite).select("id", "favori.note")


@query(
    "jn10_upsert_note",
    "WITH " + _near_favourite("{note}") + """, tied AS (SELECT n.*, h.fav FROM {note} n LEFT JOIN hits h ON h.lat = n.lat AND h.lon = n.lon),
      last AS (SELECT fav, arg_max(note, seq) AS note FROM tied WHERE fav IS NOT NULL GROUP BY fav)
      SELECT f.id, coalesce(l.note, f.note) AS note FROM {favourite} f LEFT JOIN last l ON l.fav = f.id
      UNION ALL SELECT 'N' || seq, note FROM tied WHERE fav IS NULL AND trim(note) <> ''""",
)
def _(v):
    name = F.concat(lit("N"), col("seq").cast("string"))
    return P.upsert_note(v.note, v.favourite, name).select("id", "note")


@query(
    "jn11_stops_with_parcels",
    "SELECT tour_id, ordre, s.colis_id, nom, id IS NULL AS orphan FROM {stop} s LEFT JOIN (SELECT id, nom FROM {parcel}) p ON id = s.colis_id",
)
def _(v):
    return stops_with_parcels(v.stop, v.scan).select("tour_id", "ordre", "colis_id", col("colis_nom").alias("nom"), "orphan")


@query(
    "jn11_mapped_stops",
    "SELECT tour_id, ordre, s.colis_id, lat, lon FROM {stop} s JOIN (SELECT id, lat, lon FROM {parcel}) p ON id = s.colis_id WHERE lat IS NOT NULL",
)
def _(v):
    shown = stops_with_parcels(v.stop, v.scan.where(col("lat").isNotNull()), "inner")
    return shown.select("tour_id", "ordre", "colis_id", col("colis_lat").alias("lat"), col("colis_lon").alias("lon"))


@query(
    "jn12_parcels_from_favourites",
    "SELECT 'P' || id AS id, rue AS nom, cp, ville, lat, lon, 'pret' AS statut, id AS source_favori_id FROM {favourite}",
)
def _(v):
    made = parcels_from_favourites(v.favourite, F.current_timestamp(), F.concat(lit("P"), col("id")))
    return made.select("id", "nom", "adresse_raw.cp", "adresse_raw.ville", "geocode.lat", "geocode.lon", "statut", "source_favori_id")


_PREFIX = "SELECT query_id, substr(upper(c), 1, CAST(query_id % 9 AS INT)) AS prefix FROM {pair}"


@query(
    "ag11_suggest_cities",
    f"""WITH typed AS (SELECT query_id, {D.city('prefix')} AS p FROM ({_PREFIX}) x),
      towns AS (SELECT cn, arg_min(c, id) AS c, arg_min(cp, id) AS cp, MIN(id) AS first FROM {{address}} GROUP BY cn)
      SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY first) AS rank, c, cp
      FROM typed JOIN towns ON starts_with(cn, p) WHERE length(p) >= 2 QUALIFY rank <= 6""",
)
def _(v):
    found = G.suggest_cities(v.sql(_PREFIX), v.address)
    return found.select("query_id", col("rank").cast("bigint").alias("rank"), "c", "cp")
