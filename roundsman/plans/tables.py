"""Queries over table maintenance, imports and exports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roundsman.operators import status as S
from roundsman.operators import tables as T
from roundsman.plans.registry import query
from roundsman.session import scratch_path
from roundsman.sources import files, geojson

col, lit = F.col, F.lit

_BASE = "SELECT o_orderkey AS id, o_orderstatus AS statut, o_totalprice AS price FROM {orders}"
_CHANGES = """SELECT l_orderkey * 2 AS id, l_returnflag AS statut, l_extendedprice AS price,
    l_orderkey * 100 + ordre AS seq FROM {lines}"""


@query(
    "tb01_upsert",
    f"""WITH base AS ({_BASE}), ch AS ({_CHANGES}), last AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)
      SELECT * FROM base WHERE id NOT IN (SELECT id FROM last) UNION ALL SELECT id, statut, price FROM last""",
)
def _(v):
    return T.upsert(v.sql(_BASE), v.sql(_CHANGES), "id", "seq")


_PATCH = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS statut,
    CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 2 END AS price FROM {orders} WHERE o_orderstatus = 'F'"""


@query(
    "tb02_patch",
    f"""SELECT id, coalesce(p.statut, b.statut) AS statut, CASE WHEN p.id IS NOT NULL THEN p.price ELSE b.price END AS price
        FROM ({_BASE}) b LEFT JOIN ({_PATCH}) p USING (id)""".replace("coalesce(p.statut, b.statut)", "coalesce(p.statut, b.statut)"),
)
def _(v):
    # price is named as set even when null; statut only when it has a value
    named = F.when(col("statut").isNull(), F.array(lit("price"))).otherwise(F.array(lit("price"), lit("statut")))
    return T.patch(v.sql(_BASE), v.sql(_PATCH).withColumn("fields", named), "id")


@query(
    "tb03_delete_keys",
    f"""SELECT b.* FROM ({_BASE}) b WHERE NOT EXISTS (SELECT 1 FROM {{lineitem}} WHERE l_orderkey = id AND l_returnflag = 'R')""",
)
def _(v):
    gone = v.lineitem.where(col("l_returnflag") == "R").select(col("l_orderkey").alias("id"))
    return T.delete_keys(v.sql(_BASE), gone, "id")


@query("tb04_lookup", "SELECT id, statut, cp FROM {parcel} WHERE statut = 'pret' AND cp IN (SELECT DISTINCT cp FROM {address})")
def _(v):
    ready = T.lookup(v.parcel, "statut", ["pret"])
    return T.lookup(ready, "cp", v.address).select("id", "statut", "cp")


_SCANS = """SELECT seq AS scan_id, CASE WHEN kind = 'report' THEN NULL WHEN kind = 'archive' THEN '' ELSE colis_id END AS tracking,
    ts AS date_scan FROM {event}"""


@query(
    "tb05_flag_duplicates",
    f"""SELECT scan_id, tracking, date_scan, coalesce(nullif(tracking, '') IS NOT NULL AND (id IS NOT NULL
          OR row_number() OVER (PARTITION BY tracking ORDER BY date_scan, scan_id) > 1), false) AS is_duplicate
        FROM ({_SCANS}) s LEFT JOIN (SELECT id FROM {{parcel}}) p ON id = tracking""",
)
def _(v):
    return T.flag_duplicates(v.sql(_SCANS), v.parcel.select("id"))


# settings of every customer: a stored row may hold null, and unknown keys
_STORED = """SELECT c_custkey AS owner, 'navApp' AS key, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE lower(c_mktsegment) END AS value FROM {customer}
    UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'dureeArretMinutes' ELSE 'other' END, '7' FROM {customer}"""
_DEFAULTS = ", ".join(f"('{k}', '{x}')" for k, x in T.DEFAULT_SETTINGS.items())


@query(
    "tb06_overlay_settings",
    f"""SELECT c_custkey || ':' || d.key AS key, CASE WHEN s.key IS NOT NULL THEN s.value ELSE d.value END AS value
        FROM {{customer}}, (VALUES {_DEFAULTS}) d(key, value) LEFT JOIN ({_STORED}) s ON s.owner = c_custkey AND s.key = d.key""",
)
def _(v):
    pairs = F.array(*[F.struct(lit(k).alias("key"), lit(x).alias("value")) for k, x in T.DEFAULT_SETTINGS.items()])
    owner = F.col("c_custkey").cast("string")
    defaults = v.customer.select(owner.alias("o"), F.explode(pairs).alias("d")).select(
        F.concat("o", lit(":"), "d.key").alias("key"), "d.value"
    )
    stored = v.sql(_STORED).select(F.concat(col("owner").cast("string"), lit(":"), "key").alias("key"), "value")
    return T.overlay_settings(defaults, stored)


@query(
    "tb07_purge_tours",
    """SELECT tour_id, statut FROM {tour} WHERE NOT (statut = 'archivee' AND date_creation < TIMESTAMP '1998-03-03 10:00:00')""",
)
def _(v):
    # 31 August less six months is "31 February", which runs on to 3 March
    return T.purge_tours(v.tour, 6, lit("1998-08-31 10:00:00").cast("timestamp_ntz")).select("tour_id", "statut")


def _places(listed):
    """Rows of a sorted listing with their place in it: the sort's ranges follow each other."""
    spark, part = listed.sparkSession, F.spark_partition_id().alias("_part")
    path = scratch_path(spark, "listing")
    numbered = listed.select("*", part, F.monotonically_increasing_id().alias("_row"))
    numbered.write.parquet(path)
    held = spark.read.parquet(path)
    sizes = held.groupBy("_part").agg(F.count("*").alias("n"), F.min("_row").alias("_first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), lit(0))
    starts = sizes.select("_part", "_first", before.alias("_before"))  # one row per range
    return held.join(F.broadcast(starts), "_part").select(
        *listed.columns, (col("_before") + col("_row") - col("_first") + 1).alias("place")
    )


@query(
    "tb08_list_parcels",
    "SELECT id, CAST(epoch(date_scan) AS BIGINT) AS scanned, row_number() OVER (ORDER BY date_scan NULLS FIRST, id) AS place FROM {parcel}",
)
def _(v):
    listed = _places(T.list_parcels(v.parcel.select("id", "date_scan")))
    return listed.select("id", F.unix_seconds(col("date_scan").cast("timestamp")).alias("scanned"), "place")


@query(
    "tb08_list_favourites",
    "SELECT id, ville, rue, row_number() OVER (ORDER BY strip_accents(ville), strip_accents(lower(rue)), strip_accents(rue) DESC, id) AS place FROM {favourite}",
)
def _(v):
    return _places(T.list_favourites(v.favourite.select("id", "ville", "rue")))


@query(
    "tb09_normalize_templates",
    """SELECT id, i, CASE WHEN i = 1 THEN 'Arrivée imminente' WHEN i = 2 AND nom <> '' THEN nom WHEN i = 4 THEN 'Modèle 4' ELSE 'Modèle ' || i END AS label,
          CASE i WHEN 1 THEN nom WHEN 2 THEN ville WHEN 3 THEN '' ELSE rue END AS body
        FROM {parcel}, (SELECT unnest([CAST(1 AS BIGINT), 2, 3, 4]) AS i) n""",
)
def _(v):
    def item(text=None, label=None, body=None):
        none = lit(None).cast("string")
        return F.struct(*[(none if x is None else x).alias(n) for n, x in (("text", text), ("label", label), ("body", body))])

    four = F.array(item(text=col("nom")), item(label=col("nom"), body=col("ville")), item(), item(text=col("rue")))
    rows = v.parcel.select("id", F.posexplode(T.normalize_templates(four)).alias("i", "t"))
    return rows.select("id", (col("i") + 1).cast("bigint").alias("i"), "t.label", "t.body")


_ADDRESS = "SELECT id, n, rep, r, rn, cp, c, cn, lat, lon FROM {address}"


#: Addresses of one extract document.
_ENTRIES = 1000


@query("io01_read_addresses", _ADDRESS.replace("id, ", "1 AS id_rows, ", 1))
def _(v):
    """Extract files of bounded size, one JSON document each, and how many rows share an id."""
    path = scratch_path(v.spark, "addresses")
    entry = F.struct("n", "rep", "r", "rn", "cp", "c", "cn", "lat", "lon")
    parts = v.address.groupBy("cp").agg(F.ceil(F.count("*") / _ENTRIES).cast("int").alias("_parts"))
    zone = F.concat_ws("-", "cp", F.pmod(F.hash("id"), col("_parts")).cast("string"))
    extracts = v.address.join(parts, "cp").groupBy(zone.alias("zone")).agg(F.collect_list(entry).alias("entries"))
    extracts.write.partitionBy("zone").option("compression", "gzip").json(path)
    found = files.read_addresses(v.spark, path)
    return found.withColumn("id_rows", F.count("*").over(Window.partitionBy("id")).cast("int")).drop("id")


_ASKED = "SELECT DISTINCT cp FROM {query} WHERE query_id % 3 = 0"


@query("io01_address_table", f"SELECT a.* FROM ({_ADDRESS}) a WHERE cp IN ({_ASKED})")
def _(v):
    """The layout by postcode digits, read for the postcodes of some queries."""
    path = scratch_path(v.spark, "address_table")
    files.write_addresses(v.address, path)
    return files.read_address_table(v.spark, path, v.sql(_ASKED))


@query("io01_read_address_lines", _ADDRESS)
def _(v):
    path = scratch_path(v.spark, "addresses")
    v.address.write.option("compression", "gzip").json(path)
    return files.read_address_lines(v.spark, path)


# one region per row of the road grid: m nodes in a line, a road each way between neighbours
_ROWS = "SELECT CAST((node - node % 10) / 10 AS BIGINT) AS g, COUNT(*) AS m, round(SUM(CAST(lat AS DOUBLE) + CAST(lon AS DOUBLE)), 3) AS total FROM {node} GROUP BY 1"


@query(
    "io02_read_graph",
    f"""WITH rows AS ({_ROWS}), hops AS (SELECT g, unnest(range(0, 2 * (m - 1))) AS k FROM rows)
      SELECT 'row-' || g AS region, 'node' AS kind, m AS n, total FROM rows
      UNION ALL SELECT 'row-' || g, 'edge', COUNT(*), CAST(SUM(5 + (g * 31 + k * 17) % 20) AS DOUBLE) FROM hops GROUP BY g
      UNION ALL SELECT 'row-' || g, 'turn', 2 * (m - 2), 0 FROM rows""",
)
def _(v):
    path = scratch_path(v.spark, "graph")
    _graph_documents(v).write.json(path)
    nodes, edges, turns = files.read_graph(v.spark, path, whole_files=False)

    def summed(df, kind, total):
        return df.groupBy("region").agg(lit(kind).alias("kind"), F.count("*").alias("n"), F.round(F.sum(total), 3).alias("total"))

    spot = col("lat").cast("double") + col("lon").cast("double")
    return summed(nodes, "node", spot).unionByName(summed(edges, "edge", col("w").cast("double"))).unionByName(
        summed(turns, "turn", lit(0.0))
    )


@query(
    "io02_read_graph_files",
    """WITH placed AS (SELECT CAST((node - node % 10) / 10 AS BIGINT) AS g, lat, lon,
          row_number() OVER (PARTITION BY CAST((node - node % 10) / 10 AS BIGINT) ORDER BY node) - 1 AS k FROM {node}),
        sizes AS (SELECT g, COUNT(*) AS m FROM placed GROUP BY g),
        hops AS (SELECT g, m, unnest(range(0, 2 * (m - 1))) AS k FROM sizes)
      SELECT 'row-' || g AS region, 'node' AS kind, k AS a, NULL AS b, CAST(lat AS DOUBLE) AS x, CAST(lon AS DOUBLE) AS y, k AS u FROM placed
      UNION ALL SELECT 'row-' || g, 'edge', k, CASE WHEN k % 2 = 0 THEN (k - k % 2) // 2 + 1 ELSE (k - k % 2) // 2 END, CAST(5 + (g * 31 + k * 17) % 20 AS DOUBLE), NULL,
        CASE WHEN k % 2 = 0 THEN (k - k % 2) // 2 ELSE (k - k % 2) // 2 + 1 END FROM hops
      UNION ALL SELECT 'row-' || g, 'turn', k, CASE WHEN k % 2 = 0 THEN k + 2 ELSE k - 2 END, NULL, NULL, k FROM hops
        WHERE CASE WHEN k % 2 = 0 THEN k + 2 < 2 * (m - 1) ELSE k >= 2 END""",
)
def _(v):
    """A file per document, and all rows of its nodes, edges and turns."""
    path = scratch_path(v.spark, "graph")
    _graph_documents(v).repartition("name").write.partitionBy("name").json(path)
    nodes, edges, turns = files.read_graph(v.spark, path)
    none, big = lit(None), "bigint"

    def rows(df, kind, a, b, x, y, u):
        return df.select(
            "region", lit(kind).alias("kind"), a.cast(big).alias("a"), b.cast(big).alias("b"), x.cast("double").alias("x"),
            y.cast("double").alias("y"), u.cast(big).alias("u"),
        )

    return (
        rows(nodes, "node", col("node"), none, col("lat"), col("lon"), col("node"))
        .unionByName(rows(edges, "edge", col("e"), col("v"), col("w"), none, col("u")))
        .unionByName(rows(turns, "turn", col("e"), col("f"), none, none, col("e")))
    )


def _graph_documents(v):
    """Road graph documents, one per grid row; a row never has more than ten nodes."""
    row = ((col("node") - col("node") % 10) / 10).cast("bigint")
    placed = F.struct("node", F.array(col("lat").cast("double"), col("lon").cast("double")).alias("x"))
    rows = v.node.groupBy(row.alias("g")).agg(F.array_sort(F.collect_list(placed)).alias("spots"), F.count("*").alias("m"))
    edges = F.sequence(lit(0).cast("bigint"), 2 * (col("m") - 1) - 1)

    def hop(k):
        left = F.floor(k / 2)
        ends = F.when(k % 2 == 0, F.array(left, left + 1)).otherwise(F.array(left + 1, left))
        weight = 5 + (col("g") * 31 + k * 17) % 20
        return F.concat(F.transform(ends, lambda x: x.cast("double")), F.array(weight.cast("double")))

    def follow(k):
        onward = F.when(k % 2 == 0, k + 2).otherwise(k - 2)
        return F.filter(F.array(onward), lambda x: (x >= 0) & (x < 2 * (col("m") - 1)))

    return rows.select(
        F.concat(lit("row-"), col("g").cast("string")).alias("name"), F.transform("spots", lambda s: s["x"]).alias("nodeCoords"),
        F.transform(edges, hop).alias("edges"), F.transform(edges, follow).alias("edgeAdjacency"),
    )


@query(
    "io03_dataset_meta",
    "SELECT COUNT(*) AS n, MIN(lat) AS min_lat, MAX(lat) AS max_lat, MIN(lon) AS min_lon, MAX(lon) AS max_lon FROM {address}",
)
def _(v):
    return files.dataset_meta(v.address)


_LINE = "CAST(id AS {text}) || ';' || n || ';' || cp || ';' || r"


def _line_files(v, path, lines):
    """A text file per postcode, lines in id order."""
    ordered = lines.repartition("cp").sortWithinPartitions("cp", "id")
    ordered.select("cp", "line").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cp").text(path)


@query(
    "io04_content_version",
    f"""SELECT cp AS name, substr(sha1(string_agg({_LINE.replace("{text}", "VARCHAR")}, chr(10) ORDER BY id) || chr(10)), 1, 16) AS version
        FROM {{address}} GROUP BY cp""",
)
def _(v):
    """Versions of files on disk."""
    path = scratch_path(v.spark, "lines")
    _line_files(v, path, v.address.select("cp", "id", F.expr(_LINE.replace("{text}", "string")).alias("line")))
    return files.content_version(v.spark, path).select(files.folder_name(col("path")).alias("name"), "version")


@query("io04_version_of", "SELECT doc_id, substr(sha1(text), 1, 16) AS version FROM {documents}")
def _(v):
    return v.documents.select("doc_id", files.version_of(F.encode("text", "utf-8")).alias("version"))


@query(
    "io05_refresh",
    """SELECT id, CASE WHEN cp = '10010' THEN n || 'x' ELSE n END AS n, r, cp AS name, CASE WHEN cp = '10010' THEN 2 ELSE 1 END AS load
        FROM {address}""",
)
def _(v):
    """Files are loaded, one of them changes, and the second refresh loads that one only."""
    source, table, manifest = (scratch_path(v.spark, x) for x in ("lines", "table", "manifest"))
    lines = v.address.select("cp", "id", F.expr(_LINE.replace("{text}", "string")).alias("line"))

    def parse(rows):
        part = F.split("value", ";")
        return rows.select(part[0].cast("long").alias("id"), part[1].alias("n"), part[3].alias("r"), "name")

    _line_files(v, source, lines)
    files.refresh(v.spark, source, table, manifest, parse)
    changed = v.address.where("cp = '10010'").withColumn("n", F.concat("n", lit("x")))
    _line_files(v, source, changed.select("cp", "id", F.expr(_LINE.replace("{text}", "string")).alias("line")))
    files.refresh(v.spark, source, table, manifest, parse)
    return files.read_refreshed(v.spark, table, manifest).select("id", "n", "r", "name", "load")


_HELD = "SELECT doc_id AS name, CASE WHEN doc_id % 4 = 0 THEN substr(sha1(text || ' '), 1, 16) ELSE substr(sha1(text), 1, 16) END AS version FROM {documents} WHERE lang <> 'fr'"


@query(
    "io05_stale_datasets",
    f"""SELECT doc_id AS name, NOT (coalesce(t = h.version, false) OR (source = 'src0' AND t IS NULL)) AS stale
        FROM (SELECT doc_id, source, CASE WHEN n_chars > 100 THEN substr(sha1(text), 1, 16) END AS t FROM {{documents}}) d
          LEFT JOIN ({_HELD}) h ON h.name = doc_id""",
)
def _(v):
    names = v.documents.select(col("doc_id").alias("name"), (col("source") == "src0").alias("optional"))
    version = F.when(col("n_chars") > 100, files.version_of(F.encode("text", "utf-8")))
    target = v.documents.select(col("doc_id").alias("name"), version.alias("version"))
    return files.stale_datasets(target, v.sql(_HELD), names)


@query("io06_overwrite_table", _ADDRESS)
def _(v):
    path = scratch_path(v.spark, "table")
    files.overwrite_table(v.address.where(col("rep") != ""), path)
    files.overwrite_table(v.address, path)
    return v.spark.read.parquet(path)


_FEATURE = """'{{"type":"Feature","properties":{{' || {p} || '}},"geometry":{{"type":"Point","coordinates":[' || CAST({x} AS VARCHAR) || ','
    || CAST({y} AS VARCHAR) || ']}}}}'"""


def _feature(p, x="lon", y="lat"):
    return _FEATURE.replace("{p}", p).replace("{x}", x).replace("{y}", y)


@query(
    "io07_stop_features",
    "SELECT id AS colis_id, "
    + _feature("""'"colisId":"' || id || '","statut":"' || p.statut || '"' || coalesce(',"ordre":' || ordre, '')""")
    + " AS json FROM {parcel} p LEFT JOIN {stop} s ON s.colis_id = id WHERE lat IS NOT NULL",
)
def _(v):
    return geojson.stop_features(S.map_features(v.stop, v.parcel))


@query("io07_favourite_features", "SELECT id, " + _feature("""'"favoriId":"' || id || '"'""") + " AS json FROM {favourite}")
def _(v):
    return geojson.favourite_features(v.favourite)


@query(
    "io07_waypoint_features",
    "SELECT tour_id, 'depot' AS kind, " + _feature("""'"kind":"depot"'""", "depot_lon", "depot_lat") + " AS json FROM {tour} UNION ALL "
    "SELECT tour_id, 'arrivee', " + _feature("""'"kind":"arrivee"'""", "return_lon", "return_lat") + " FROM {tour} WHERE return_to_depot",
)
def _(v):
    return geojson.waypoint_features(v.tour)


@query(
    "io08_corrections_json",
    """SELECT query_id AS colis_id, '{{"colis_id":' || query_id || ',"date_correction":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000')
        || '","champs":["' || CASE WHEN numero = '' THEN 'rue' ELSE 'numero' END || '"]}}' AS json FROM {query} JOIN {orders} ON o_orderkey = query_id""",
)
def _(v):
    log = v.query.join(v.orders, col("o_orderkey") == col("query_id")).select(
        col("query_id").alias("colis_id"), col("o_orderdate").alias("date_correction"),
        F.array(F.when(col("numero") == "", lit("rue")).otherwise(lit("numero"))).alias("champs"),
    )
    return geojson.corrections_json(log)
