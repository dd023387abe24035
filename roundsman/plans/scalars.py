"""Queries over the scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from roundsman.functions import geo, links, text
from roundsman.plans import oracle as D
from roundsman.plans.registry import query

col, lit = F.col, F.lit


@query("sc01_strip_accents", "SELECT id, strip_accents(r || c) AS plain FROM {address}")
def _(v):
    return v.address.select("id", text.strip_accents(F.concat("r", "c")).alias("plain"))


@query("sc02_normalize_street", f"SELECT query_id, {D.street('rue')} AS street FROM {{query}}")
def _(v):
    return v.query.select("query_id", text.normalize_street(col("rue")).alias("street"))


@query("sc03_normalize_city", f"SELECT query_id, {D.city('ville')} AS city FROM {{query}}")
def _(v):
    return v.query.select("query_id", text.normalize_city(col("ville")).alias("city"))


@query("sc04_levenshtein", "SELECT query_id, CAST(levenshtein(rue, r) AS BIGINT) AS distance FROM {pair}")
def _(v):
    return v.pair.select("query_id", F.levenshtein("rue", "r").cast("bigint").alias("distance"))


@query(
    "sc05_trigrams",
    f"""SELECT id, array_to_string(list_sort({D.grams('rn')}), '|') AS grams, CAST(len({D.grams('rn')}) AS BIGINT) AS n
        FROM {{address}}""",
)
def _(v):
    grams = text.trigrams(col("rn"))
    return v.address.select("id", grams.alias("g")).select(
        "id", F.array_join(F.array_sort("g"), "|").alias("grams"), F.size("g").cast("bigint").alias("n")
    )


@query(
    "sc06_jaccard",
    f"""SELECT query_id, round({D.jaccard('ga', 'gb')}, 6) AS overlap
        FROM (SELECT query_id, {D.grams('lower(rue)')} AS ga, {D.grams('rn')} AS gb FROM {{pair}}) p""",
)
def _(v):
    grams = v.pair.select("query_id", text.trigrams(F.lower("rue")).alias("a"), text.trigrams(col("rn")).alias("b"))
    return grams.select("query_id", F.round(text.jaccard(col("a"), col("b")), 6).alias("overlap"))


@query(
    "sc07_street_similarity",
    f"""SELECT query_id, round({D.similarity('a', 'rn', D.grams('a'), D.grams('rn'))}, 6) AS similarity
        FROM (SELECT query_id, {D.street('rue')} AS a, rn FROM {{pair}}) p""",
)
def _(v):
    named = v.pair.select("query_id", text.normalize_street(col("rue")).alias("a"), "rn")
    return named.select("query_id", F.round(text.street_similarity(col("a"), col("rn")), 6).alias("similarity"))


@query(
    "sc08_haversine",
    f"SELECT id, round({D.haversine('lat', 'lon', '48.25e0', '5.25e0')}, 3) AS metres FROM {{address}}",
)
def _(v):
    return v.address.select("id", F.round(geo.haversine_m(col("lat"), col("lon"), lit(48.25), lit(5.25)), 3).alias("metres"))


@query(
    "sc09_format_duration",
    """SELECT tour_id, i, j, CASE WHEN isinf(s) THEN '—' WHEN m < 60 THEN m || ' min' WHEN m % 60 = 0 THEN (m // 60) || ' h'
          ELSE (m // 60) || ' h ' || (m % 60) END AS label
        FROM (SELECT tour_id, i, j, s, CASE WHEN isinf(s) THEN 0 ELSE CAST(floor(s / 60 + 0.5) AS BIGINT) END AS m
          FROM (SELECT tour_id, i, j, seconds * 10 AS s FROM {matrix}) a) b""",
)
def _(v):
    return v.matrix.select("tour_id", "i", "j", geo.format_duration(col("seconds") * 10).alias("label"))


@query(
    "sc09_leg_labels",
    """SELECT colis_id, CASE WHEN leg_s IS NULL THEN '—' WHEN m < 60 THEN m || ' min' WHEN m % 60 = 0 THEN (m // 60) || ' h'
          ELSE (m // 60) || ' h ' || (m % 60) END AS label
        FROM (SELECT colis_id, leg_s, CAST(floor(CAST(leg_s AS DOUBLE) * 7 / 60 + 0.5) AS BIGINT) AS m FROM {stop}) a""",
)
def _(v):
    return v.stop.select("colis_id", geo.format_duration(col("leg_s").cast("double") * 7).alias("label"))


_STREETTEXT = """CASE query_id % 4 WHEN 0 THEN n || ' ' || rue WHEN 1 THEN rue || ' ' || n
    WHEN 2 THEN ' ' || n || ' BIS ' || rue ELSE rue END"""


@query(
    "sc10_split_number_street",
    rf"""SELECT query_id,
          CASE WHEN regexp_matches(s, a) THEN trim(regexp_extract(s, a, 1))
            WHEN regexp_matches(s, b) THEN trim(regexp_extract(s, b, 2)) ELSE '' END AS numero,
          CASE WHEN regexp_matches(s, a) THEN trim(regexp_extract(s, a, 2))
            WHEN regexp_matches(s, b) THEN trim(regexp_extract(s, b, 1)) ELSE s END AS rue
        FROM (SELECT query_id, trim({_STREETTEXT}) AS s, '(?i)^(\d+\s*(?:bis|ter|quater)?)\s+(.+)$' AS a,
          '(?i)^(.+?)\s+(\d+\s*(?:bis|ter|quater)?)$' AS b FROM {{pair}}) p""",
)
def _(v):
    parts = v.pair.select("query_id", text.split_number_street(F.expr(_STREETTEXT)).alias("s"))
    return parts.select("query_id", "s.numero", "s.rue")


@query(
    "sc11_join_number_street",
    """SELECT query_id, CASE WHEN trim(numero) = '' THEN trim(rue) ELSE trim(trim(numero) || ' ' || trim(rue)) END AS line
        FROM {query}""",
)
def _(v):
    return v.query.select("query_id", text.join_number_street(col("numero"), col("rue")).alias("line"))


@query("sc12_canonical_address", "SELECT id, n || rep || ' ' || r || ', ' || cp || ' ' || c AS address FROM {address}")
def _(v):
    return v.address.select(
        "id", text.canonical_address(col("n"), col("rep"), col("r"), col("cp"), col("c")).alias("address")
    )


_SHOWN = """CASE WHEN coalesce(adresse_affichage, '') <> '' THEN adresse_affichage
    WHEN rue = '' AND cp = '' AND ville = '' THEN '(adresse à vérifier)' ELSE trim(rue || ', ' || cp || ' ' || ville) END"""


def _shown():
    return text.display_address(col("adresse_affichage"), col("adresse_raw"))


@query("sc13_display_address", f"SELECT id, {_SHOWN} AS shown FROM {{parcel}}")
def _(v):
    return v.scan.select("id", _shown().alias("shown"))


@query(
    "sc14_split_display",
    f"""SELECT id, CASE WHEN position(',' IN s) = 0 THEN s ELSE trim(substr(s, 1, position(',' IN s) - 1)) END AS street,
          CASE WHEN position(',' IN s) = 0 THEN '' ELSE trim(substr(s, position(',' IN s) + 1)) END AS city
        FROM (SELECT id, {_SHOWN} AS s FROM {{parcel}}) p""",
)
def _(v):
    return v.scan.select("id", _shown().alias("s")).select("id", text.split_display(col("s")).alias("x")).select("id", "x.*")


_TYPED = """CASE id % 6 WHEN 0 THEN CAST(id % 90 AS STRING) || '.5, ' || CAST(id % 180 AS STRING) || '.25'
    WHEN 1 THEN '  -' || CAST(id % 90 AS STRING) || '.125abc ,+.5e1' WHEN 2 THEN '1, 2, 3'
    WHEN 3 THEN CAST(id AS STRING) || ', 2' WHEN 4 THEN 'nord, 2' ELSE '48' END"""


@query(
    "sc15_parse_lat_lon",
    rf"""SELECT id, CASE WHEN ok THEN lat END AS lat, CASE WHEN ok THEN lon END AS lon
        FROM (SELECT id, lat, lon, coalesce(n = 2 AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180, false) AS ok
          FROM (SELECT id, len(p) AS n, TRY_CAST(regexp_extract(p[1], num, 1) AS DOUBLE) AS lat,
              TRY_CAST(regexp_extract(p[2], num, 1) AS DOUBLE) AS lon
            FROM (SELECT id, string_split({_TYPED}, ',') AS p, '^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)' AS num
              FROM {{address_raw}}) a) b) c""",
)
def _(v):
    return v.address.select("id", geo.parse_lat_lon(F.expr(_TYPED)).alias("p")).select("id", "p.lat", "p.lon")


_TEMPLATE = "Bonjour {{nom}},  colis dans {{minutes_estimees}} min à : {{adresse}}. "
_FILLED = """trim(regexp_replace(replace(replace(replace(tpl, '{{nom}}', nom), '{{minutes_estimees}}',
    coalesce(CAST(quantite AS STRING), '')), '{{adresse}}', adresse), '[ \t]{{2,}}', ' ', 'g'))"""


@query(
    "sc16_render_template",
    f"""SELECT id, {_FILLED} AS body
        FROM (SELECT id, nom, quantite, {_SHOWN} AS adresse, '{_TEMPLATE}' AS tpl FROM {{parcel}}) p""",
)
def _(v):
    body = text.render_template(lit(_TEMPLATE.format()), col("nom"), col("quantite"), _shown())
    return v.scan.select("id", body.alias("body"))


_MESSAGES = (("Arrivée imminente", "Bonjour {{nom}}, arrivée dans {{minutes_estimees}} min à : {{adresse}}."), ("Rappel", "{{adresse}} (~*)!"))


@query(
    "sc17_message_options",
    f"""SELECT id, CAST(index AS BIGINT) AS index, label, body, 'sms:' || {D.uri('tel')} || '&body=' || {D.uri('body')} AS href
        FROM (SELECT id, tel, index, label, {_FILLED} AS body
          FROM (SELECT id, tel, nom, quantite, {_SHOWN} AS adresse, m.* FROM {{parcel}},
            (VALUES {', '.join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(_MESSAGES))}) m(index, label, tpl)
            WHERE tel <> '') p) q""",
)
def _(v):
    from roundsman.operators.tours import message_options

    stock = F.array(*[F.struct(lit(a).alias("label"), lit(b.format()).alias("body")) for a, b in _MESSAGES])
    return message_options(v.scan.select("id", "tel", "nom", _shown().alias("adresse"), col("quantite").alias("minutes")), stock)


_POINT = r"regexp_replace(CAST(lat AS VARCHAR), '\.0$', '') || ',' || regexp_replace(CAST(lon AS VARCHAR), '\.0$', '')"


@query(
    "sc18_nav_links",
    f"""SELECT id, CASE app WHEN 'waze' THEN CASE WHEN a = '' THEN 'https://waze.com/ul?ll=' || {_POINT} || '&navigate=yes'
            ELSE 'https://waze.com/ul?q=' || {D.uri('a')} || '&navigate=yes' END
          WHEN 'google' THEN 'https://www.google.com/maps/dir/?api=1&destination=' || {D.uri(f"CASE WHEN a = '' THEN {_POINT} ELSE a END")}
            || '&travelmode=driving'
          ELSE 'https://maps.apple.com/?daddr=' || {D.form(f"CASE WHEN a = '' THEN {_POINT} ELSE a END")}
            || CASE WHEN nom = '' THEN '' ELSE '&dname=' || {D.form('nom')} END END AS url,
          'https://www.google.com/maps/search/?api=1&query=' || {D.uri("rue || ' ' || cp || ' ' || ville")} AS search
        FROM (SELECT id, nom, rue, cp, ville, lat, lon, coalesce(adresse_affichage, '') AS a,
          CASE quantite WHEN 1 THEN 'waze' WHEN 2 THEN 'google' ELSE 'apple' END AS app
          FROM {{parcel}}) p""",
)
def _(v):
    """All parcels; one with neither address nor coordinates has no link."""
    app = F.when(col("quantite") == 1, "waze").when(col("quantite") == 2, "google").otherwise("apple")
    raw = F.concat_ws(" ", "adresse_raw.rue", "adresse_raw.cp", "adresse_raw.ville")
    return v.scan.select(
        "id",
        links.nav_url(app, col("lat"), col("lon"), col("nom"), col("adresse_affichage")).alias("url"),
        links.search_url(raw).alias("search"),
    )


@query(
    "sc19_minutes_remaining",
    """SELECT tour_id, ordre, greatest(0, CAST(floor((epoch_us(delivered_at) - epoch_us(TIMESTAMP '1998-06-01 12:00:00')) / 60000000
          + 0.5) AS BIGINT)) AS minutes FROM {stop} WHERE delivered_at IS NOT NULL""",
)
def _(v):
    now = lit("1998-06-01 12:00:00").cast("timestamp_ntz")
    return v.stop.where(col("delivered_at").isNotNull()).select(
        "tour_id", "ordre", geo.minutes_remaining(col("delivered_at"), now).alias("minutes")
    )


@query(
    "sc20_confidence_pct",
    f"""SELECT query_id, least(100, CAST(floor(s * 100 + 0.5) AS BIGINT)) AS pct
        FROM (SELECT query_id, {D.score(D.similarity('q_street', 'rn', D.grams('q_street'), D.grams('rn')))} AS s
          FROM (SELECT query_id, {D.street('rue')} AS q_street, {D.city('ville')} AS q_city, trim(numero) AS q_number, n, rn, cn
            FROM {{pair}}) a) b""",
)
def _(v):
    from roundsman.operators.geocode import prepare_queries, score_candidates

    scored = score_candidates(prepare_queries(v.pair))
    return scored.select("query_id", geo.confidence_pct(col("score")).alias("pct"))
