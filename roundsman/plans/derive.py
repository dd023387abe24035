"""Delivery tables derived from the star-schema tables.

The star schema has no addresses, labels or roads, so the registered queries read
deterministic views over its whole tables: customers become addresses, orders become
tours and labels, line items become stops and parcels, suppliers become road nodes.
``PORTABLE`` is SQL that Spark and DuckDB both run; what the two spell differently is
built by ``Views`` for Spark and stated in ``roundsman.plans.oracle`` for DuckDB.
"""

from __future__ import annotations

from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundsman.functions.text import normalize_city, normalize_street
from roundsman.operators.ranges import block_of, number_rows
from roundsman.session import stored

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


#: Tables that heavy row expressions run over, with the column that spreads them.
_SPREAD = {"customer": "c_custkey", "orders": "o_orderkey", "documents": "doc_id", "events": "event_id"}


def _deg(base: int, number: str, scale: int) -> str:
    return f"{base} + CAST({number} AS DOUBLE) / CAST({scale} AS DOUBLE)"


_ROW = "(CAST((l_suppkey - l_suppkey % 10) / 10 AS BIGINT))"

# some runs of orders make one long tour each
_LONG_ID = "CASE WHEN l_orderkey % 3000 < 72 THEN -1 - CAST((l_orderkey - l_orderkey % 3000) / 3000 AS BIGINT) ELSE l_orderkey END"

PORTABLE: dict[str, str] = {
    "address_raw": f"""
        SELECT c_custkey AS id, CAST(c_custkey % 40 + 1 AS STRING) AS n,
          CASE WHEN c_custkey % 11 = 0 THEN 'B' ELSE '' END AS rep,
          CASE c_custkey % 4 WHEN 0 THEN 'Rue ' || p_name WHEN 1 THEN 'Av. ' || p_name
            WHEN 2 THEN 'Rue de l''Été ' || p_name ELSE 'Bd. du ' || p_name END AS r,
          CAST(10000 + c_nationkey * 10 + c_custkey % 3 AS STRING) AS cp,
          'Saint-' || chr(65 + c_nationkey) || 'évy' AS c,
          {_deg(48, "(c_custkey * 7919) % 10007", 20014)} AS lat, {_deg(5, "(c_custkey * 6101) % 10009", 20018)} AS lon
        FROM {{customer}} JOIN {{part}} ON p_partkey = c_custkey""",
    "pair": """
        SELECT o_orderkey AS query_id,
          CASE o_orderkey % 4 WHEN 0 THEN r WHEN 1 THEN substr(r, 1, 4) || substr(r, 6)
            WHEN 2 THEN upper(r) ELSE replace(r, 'e', '3') END AS rue,
          CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE n END AS numero,
          CASE WHEN o_orderkey % 13 = 0 THEN '99999' ELSE cp END AS cp,
          CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE c END AS ville,
          id AS true_id, n, rep, r, rn, cp AS a_cp, c, cn, lat, lon
        FROM {orders} JOIN {address} ON id = o_custkey""",
    "query": "SELECT query_id, rue, numero, cp, ville FROM {pair}",
    "label": """
        SELECT label_id, CASE shape
            WHEN 0 THEN nom || nl || '06' || eight || nl || nom || nl || rue || ' ' || n || nl || town
            WHEN 1 THEN 'ACME FLEURS' || nl || '7' || eight || nl || nom || nl || n || ' ' || rue || nl || town
            WHEN 2 THEN 'MLLE' || nl || '+336' || eight || nl || 'DUPRE SARL' || nl || nom || nl || 'ZONE NORD' || nl || rue || nl || town
            WHEN 3 THEN 'EXPED CIE' || nl || '5 RUE DU PORT' || nl || '54000 NANCY' || nl || nl || 'SHIP TO:' || nl || nom
              || nl || '03' || eight || nl || n || ' ' || rue || nl || town || nl || nl || code || nl || 'Ref.1: TEL 03' || eight
            WHEN 4 THEN 'ship  to: ' || nom || chr(13) || nl || 'TEL 00336' || eight || chr(13) || nl || n || ' ' || rue
              || chr(13) || nl || town || chr(13) || nl || 'FRANCE' || chr(13) || nl || code
            WHEN 5 THEN 'XAVIER S0PHIE' || nl || nom || nl || '12' || nl || 'FRANCE' || nl || code
            ELSE NULL END AS raw_text, code
        FROM (
          SELECT o_orderkey AS label_id, o_orderkey % 7 AS shape, chr(10) AS nl,
            'CLIENT ' || chr(CAST(65 + o_custkey % 26 AS INT)) || ' MARTEL' AS nom,
            lpad(CAST(o_orderkey % 100000000 AS STRING), 8, '0') AS eight, n, upper(r) AS rue, a_cp || ' ' || upper(c) AS town,
            '1Z' || lpad(CAST(o_orderkey % 100000000 AS STRING), 8, '0') || lpad(CAST(o_orderkey * 7 % 100000000 AS STRING), 8, '0') AS code
          FROM {orders} JOIN {pair} ON query_id = o_orderkey) x""",
    "stop": """
        SELECT l_orderkey AS tour_id, ordre,
          CASE WHEN l_partkey % 17 = 0 THEN 'gone' ELSE '' END || CAST(l_orderkey * 100 + ordre AS STRING) AS colis_id,
          CASE WHEN l_linestatus = 'O' THEN 'a_livrer' WHEN l_returnflag = 'R' THEN 'echec' ELSE 'livre' END AS statut,
          CASE WHEN l_linestatus = 'F' AND l_returnflag <> 'R' AND l_partkey % 7 <> 0
            THEN l_shipdate + ordre * INTERVAL '13' MINUTE END AS delivered_at,
          CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN l_shipdate + ordre * INTERVAL '17' MINUTE END AS failed_at,
          CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE l_quantity * 30 END AS leg_s
        FROM {lines}""",
    "parcel": f"""
        SELECT CAST(l_orderkey * 100 + ordre AS STRING) AS id, l_orderkey AS tour_id,
          CASE WHEN l_partkey % 29 = 0 THEN '' ELSE 'Client ' || CAST(l_suppkey AS STRING) END AS nom,
          CASE WHEN l_partkey % 5 = 0 THEN '' ELSE '06' || lpad(CAST(l_partkey AS STRING), 8, '0') END AS tel,
          CASE WHEN l_partkey % 31 = 0 THEN '' ELSE CAST(l_partkey % 40 + 1 AS STRING) || ' Rue d''' || l_returnflag || 'zé' END AS rue,
          CASE WHEN l_partkey % 31 = 0 THEN '' ELSE CAST(10000 + l_suppkey % 250 AS STRING) END AS cp,
          CASE WHEN l_partkey % 31 = 0 THEN '' ELSE 'Ville ' || l_returnflag END AS ville,
          CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE CAST(l_partkey % 40 + 1 AS STRING) || ' Rue (haute) d''' || l_returnflag || 'zé, '
            || CAST(10000 + l_suppkey % 250 AS STRING) || ' Ville ' || l_returnflag END AS adresse_affichage,
          CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) % 5 END AS quantite,
          l_linenumber = 1 AS avant12h,
          CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 'pret' WHEN l_linestatus = 'O' AND l_returnflag = 'R' THEN 'en_tournee'
            WHEN l_linestatus = 'O' THEN 'a_verifier' WHEN l_returnflag = 'R' THEN 'echec' ELSE 'livre' END AS statut,
          CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE l_shipdate END AS date_scan,
          CASE WHEN l_partkey % 9 = 0 THEN 'ambigu' ELSE 'ok' END AS geocode_status,
          CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE {_deg(48, f"{_ROW} * 4000 + l_partkey % 300", 1000000)} END AS lat,
          CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE {_deg(5, "(l_suppkey % 10) * 4000 + l_partkey % 270", 1000000)} END AS lon
        FROM {{lines}}""",
    "tour": f"""
        SELECT o_orderkey AS tour_id, CASE WHEN o_orderstatus = 'F' THEN 'archivee' ELSE 'en_cours' END AS statut,
          o_orderdate + (o_orderkey % 600) * INTERVAL '1' MINUTE AS date_creation,
          {_deg(48, "o_custkey % 37", 1000)} AS depot_lat, {_deg(5, "o_custkey % 41", 1000)} AS depot_lon,
          o_orderkey % 2 = 0 AS return_to_depot,
          CASE WHEN o_orderkey % 2 = 0 THEN {_deg(48, "o_custkey % 37", 1000)} END AS return_lat,
          CASE WHEN o_orderkey % 2 = 0 THEN {_deg(5, "o_custkey % 41", 1000)} END AS return_lon,
          CAST(floor(o_totalprice / 10) AS DOUBLE) AS total_s
        FROM {{orders}}""",
    "event": """
        SELECT event_id AS seq, ts, CASE event_type WHEN 'view' THEN 'delivered' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'direct'
            WHEN 'click' THEN 'report' ELSE CASE WHEN value > 100 THEN 'archive' ELSE 'delivered' END END AS kind,
          user_id * 5 + event_id % 5 AS tour_id, event_id % 2 + 1 AS ordre,
          CAST((user_id * 5 + event_id % 5) * 10 + event_id % 2 + 1 AS STRING) AS colis_id,
          'motif ' || CAST(event_id % 7 AS STRING) AS raison
        FROM {events}""",
    "node": """
        SELECT s_suppkey AS node, CAST(48 + CAST((s_suppkey - s_suppkey % 10) / 10 AS DOUBLE) * 4 / 1000 AS FLOAT) AS lat,
          CAST(5 + CAST(s_suppkey % 10 AS DOUBLE) * 4 / 1000 AS FLOAT) AS lon FROM {supplier}""",
    "edge": """
        SELECT u * 4 + dir AS e, u, v, CAST(5 + (u * 31 + v * 17) % 20 AS FLOAT) AS w
        FROM (SELECT s_suppkey AS u, s_suppkey + 1 AS v, 0 AS dir FROM {supplier} WHERE s_suppkey % 10 <> 9
          UNION ALL SELECT s_suppkey, s_suppkey - 1, 1 FROM {supplier} WHERE s_suppkey % 10 <> 0
          UNION ALL SELECT s_suppkey, s_suppkey + 10, 2 FROM {supplier}
          UNION ALL SELECT s_suppkey, s_suppkey - 10, 3 FROM {supplier}) d JOIN {node} ON node = v""",
    "turn": """
        SELECT a.e, b.e AS f FROM {edge} a JOIN {edge} b ON a.v = b.u
        WHERE b.v <> a.u AND (a.u + 2 * a.v + 3 * b.v) % 7 <> 0""",
    "tour_size": "SELECT l_orderkey AS tour_id, COUNT(*) AS n FROM {lineitem} GROUP BY l_orderkey",
    "tpoint": """
        SELECT tour_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS STRING) AS colis_id, false AS avant12h, false AS fixed_end FROM {tour_size}
        UNION ALL SELECT l_orderkey, ordre, CAST(l_orderkey * 100 + ordre AS STRING), l_linenumber % 3 = 1, false FROM {lines}
        UNION ALL SELECT tour_id, n + 1, CAST(NULL AS STRING), false, tour_id % 2 = 0 FROM {tour_size}""",
    "matrix": """
        SELECT a.tour_id, a.i, b.i AS j, CASE WHEN a.i = b.i THEN CAST(0 AS DOUBLE)
            WHEN (a.i * 7 + b.i * 3 + a.tour_id) % 23 = 0 THEN CAST('Infinity' AS DOUBLE)
            ELSE CAST(30 + (a.i * 37 + b.i * 91 + a.tour_id * 13) % 600 AS DOUBLE) END AS seconds
        FROM {tpoint} a JOIN {tpoint} b ON a.tour_id = b.tour_id""",
    # tours by order, but for some runs of orders whose lines make one long tour each
    "long_point": f"""
        SELECT tour_id, row_number() OVER (PARTITION BY tour_id ORDER BY l_orderkey, ordre) AS i, noon
        FROM (SELECT {_LONG_ID} AS tour_id,
          l_orderkey, ordre, l_linenumber % 7 = 1 AS noon FROM {{lines}}) x""",
    "long_tpoint": """
        SELECT tour_id, CAST(0 AS BIGINT) AS i, false AS avant12h, false AS fixed_end FROM {long_point} GROUP BY tour_id
        UNION ALL SELECT tour_id, CAST(i AS BIGINT), noon, false FROM {long_point}
        UNION ALL SELECT tour_id, COUNT(*) + 1, false, tour_id % 2 = 0 FROM {long_point} GROUP BY tour_id""",
    "long_matrix": """
        SELECT a.tour_id, a.i, b.i AS j, CASE WHEN a.i = b.i THEN CAST(0 AS DOUBLE)
            ELSE CAST(30 + (a.i * 3701 + b.i * 9103 + a.i * b.i * 17 + a.tour_id * 13) % 601 AS DOUBLE) END AS seconds
        FROM {long_tpoint} a JOIN {long_tpoint} b ON a.tour_id = b.tour_id""",
    "torder": "SELECT tour_id, i - 1 AS pos, i, avant12h FROM {tpoint} WHERE i > 0",
    "level": "SELECT event_id, event_type AS grp, CAST(floor(value) AS BIGINT) % 256 AS level FROM {events}",
    "favourite": f"""
        SELECT 'F' || CAST(id AS STRING) AS id, r AS rue, cp, c AS ville,
          lat + {_deg(0, "id % 5", 5000)} AS lat, lon, CASE WHEN id % 3 = 0 THEN '' ELSE 'Code ' || n END AS note
        FROM {{address}}""",
    "note": f"""
        SELECT query_id AS seq, r AS rue, a_cp AS cp, c AS ville, lat + {_deg(0, "query_id % 2", 10)} AS lat, lon,
          CASE WHEN query_id % 7 = 0 THEN ' ' ELSE 'Note ' || CAST(query_id AS STRING) END AS note FROM {{pair}}""",
}


class Views:
    """Spark DataFrames of the derived views over one data folder, built on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self._table(name)
            else:
                self._made[name] = self.sql(PORTABLE[name])
        return self._made[name]

    def _table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        cores = self.spark.sparkContext.defaultParallelism
        # a table in one small file would be worked on by one task; big ones have splits enough
        if name in _SPREAD and df.rdd.getNumPartitions() < cores:
            df = df.repartition(cores, _SPREAD[name])
        return df

    def keep(self, name: str) -> None:
        """Write a view that several others are made from, so that it is worked out once."""
        setattr(self, name, stored(getattr(self, name)))

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: getattr(self, n) for n in names_in(text)})

    @cached_property
    def address(self) -> DataFrame:
        """Address table with its comparable street and town columns."""
        raw = self.address_raw
        return raw.select(
            "id", "n", "rep", "r", normalize_street(F.col("r")).alias("rn"), "cp", "c",
            normalize_city(F.col("c")).alias("cn"), "lat", "lon",
        )

    @cached_property
    def lines(self) -> DataFrame:
        """Line items numbered inside their order; the line number splits an order into blocks."""
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
        df = self.lineitem.select("l_orderkey", *order, "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
        return number_rows(df, ["l_orderkey"], block_of(F.col("l_linenumber")), order, "ordre")

    @cached_property
    def matrix(self) -> DataFrame:
        lines = self._dealt(self.lineitem.select(F.col("l_orderkey").alias("tour_id"), "l_linenumber"))
        return self._pairs("matrix", lines.groupBy("tour_id").agg(F.count("l_linenumber").alias("m"), F.count("*").alias("n")))

    @cached_property
    def long_matrix(self) -> DataFrame:
        numbered = self.lineitem.where("l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL")
        sizes = self._dealt(numbered.select(F.expr(_LONG_ID).alias("tour_id"))).groupBy("tour_id").agg(F.count("*").alias("n"))
        return self._pairs("long_matrix", sizes.withColumn("m", F.col("n")))

    def _dealt(self, lines: DataFrame) -> DataFrame:
        """Lines by tour in a fixed number of tasks: by the few bytes counted, one task would spell out most pairs."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return lines.where("tour_id IS NOT NULL").repartition(parts, "tour_id")

    def _pairs(self, name: str, sizes: DataFrame) -> DataFrame:
        """A matrix over all pairs of a tour's points, which are 0, the ``m`` last numbers up to ``n``, and ``n`` + 1: they
        follow from ``sizes(tour_id, m, n)``, so no points are numbered and joined with each other."""
        points = F.concat(F.array(F.lit(0).cast("bigint")), F.sequence(F.col("n") - F.col("m") + 1, F.col("n") + 1))
        ends = sizes.select("tour_id", points.alias("p")).select("tour_id", "p", F.explode("p").alias("i"))
        pairs = ends.select(F.struct("tour_id", "i").alias("a"), F.explode("p").alias("j")).select("a", F.struct(F.col("j").alias("i")).alias("b"))
        select, _ = PORTABLE[name].rsplit("FROM", 1)
        return self.spark.sql(f"{select} FROM {{pairs}}", pairs=pairs)

    @cached_property
    def scan(self) -> DataFrame:
        """Parcels with the nested address the operators expect."""
        return self.parcel.select("*", F.struct("rue", "cp", "ville").alias("adresse_raw")).drop("rue", "cp", "ville")


@lru_cache(maxsize=None)
def names_in(text: str) -> tuple[str, ...]:
    """Views and tables a statement refers to as ``{name}``."""
    import string

    return tuple(dict.fromkeys(f for _, f, _, _ in string.Formatter().parse(text) if f))
