"""Queries over label extraction, corrections and image levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from roundsman.functions import labels as L
from roundsman.operators import labels as O
from roundsman.plans.registry import query

col, lit = F.col, F.lit

_WORDS = "|".join(L.STREET_WORDS)
_TRACK = r"1Z\s?[0-9A-Z]{{6}}\s?[0-9A-Z]{{2}}\s?\d{{4}}\s?\d{{4}}"
_TOWN = r"^(\d{{5}})\s+([A-ZÀ-Ü''\- ]+)$"
_DIGITS = r"regexp_replace(line, '\D', '', 'g')"

# one row per label, then one per line; every later step filters and numbers these lines
_LINES = r"""
  texts AS (SELECT label_id, raw_text, replace(coalesce(raw_text, ''), chr(13), '') AS t FROM {label}),
  trimmed AS (SELECT label_id, t, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM texts),
  anchored AS (SELECT *, coalesce(list_position(list_transform(lines, lambda x: regexp_matches(x, '(?i)SHIP\s*TO\s*:?')), true), 0) AS a FROM trimmed),
  rested AS (SELECT *, CASE WHEN a = 0 THEN '' ELSE trim(regexp_replace(lines[a], '(?i)SHIP\s*TO\s*:?', '')) END AS rest FROM anchored),
  behind AS (SELECT label_id, t, lines, CASE WHEN a = 0 THEN lines WHEN rest <> '' THEN list_concat([rest], lines[a + 1:]) ELSE lines[a + 1:] END AS b FROM rested),
  cut AS (SELECT *, coalesce(list_position(list_transform(b, lambda x: regexp_matches(x, '""" + _TOWN + r"""')), true), 0) AS c FROM behind),
  blocks AS (SELECT label_id, t, lines, CASE WHEN c = 0 THEN b ELSE b[:c] END AS block FROM cut),
  kept AS (SELECT label_id, CAST(pos AS BIGINT) AS pos, block[pos] AS line FROM (SELECT label_id, block, unnest(range(1, len(block) + 1)) AS pos FROM blocks) u),
  roled AS (SELECT *, CASE WHEN regexp_matches(line, '""" + _TOWN + r"""') THEN 'town'
      WHEN regexp_matches(line, '(?i)^FRANCE$') OR regexp_matches(line, '""" + _TRACK + r"""') THEN 'skipped'
      WHEN length(""" + _DIGITS + r""") BETWEEN 9 AND 14 THEN 'phone'
      WHEN regexp_matches(line, '^\d') OR regexp_matches(upper(line), '""" + _WORDS + r"""') THEN 'street' ELSE 'name' END AS role FROM kept),
  phones AS (SELECT label_id, pos, '0' || right(""" + _DIGITS + r""", 9) AS phone,
      CASE WHEN regexp_matches(line, '(?i)TEL|PHONE|GSM') OR regexp_matches(line, '^\+|^00')
        OR (length(""" + _DIGITS + r""") = 10 AND regexp_matches(""" + _DIGITS + r""", '^0[1-9]')) THEN 'haute' ELSE 'moyenne' END AS confidence
      FROM roled WHERE role = 'phone'),
  chosen AS (SELECT * FROM phones QUALIFY row_number() OVER (PARTITION BY label_id ORDER BY confidence <> 'haute', pos) = 1)"""

_FIELDS = (
    _LINES
    + r""",
  towns AS (SELECT label_id, regexp_extract(line, '""" + _TOWN + r"""', 1) AS cp, trim(regexp_extract(line, '""" + _TOWN + r"""', 2)) AS ville
    FROM roled WHERE role = 'town'),
  names AS (SELECT label_id, arg_max(line, pos) AS nom FROM roled WHERE role = 'name' GROUP BY label_id),
  streets AS (SELECT label_id, string_agg(line, ' ' ORDER BY pos) AS rue FROM roled WHERE role = 'street' GROUP BY label_id),
  fields AS (SELECT x.label_id, nullif(regexp_replace(regexp_extract(t, '""" + _TRACK + r"""'), '\s', '', 'g'), '') AS tracking, nom,
      phone AS tel, CASE WHEN confidence = 'haute' OR phone = regexp_extract(t, '(?i)Ref\.?\s*1\s*:?\s*TEL\s*(0\d{{9}})', 1)
        THEN 'haute' ELSE 'a_verifier' END AS tel_confidence, rue, cp, ville
    FROM texts x LEFT JOIN names USING (label_id) LEFT JOIN streets USING (label_id) LEFT JOIN towns USING (label_id)
      LEFT JOIN chosen USING (label_id))"""
)


@query("ex01_label_lines", "WITH " + _LINES + " SELECT label_id, array_to_string(lines, '|') AS lines, CAST(len(lines) AS BIGINT) AS n FROM trimmed")
def _(v):
    lines = v.label.select("label_id", L.label_lines(col("raw_text")).alias("l"))
    return lines.select("label_id", F.array_join("l", "|").alias("lines"), F.size("l").cast("bigint").alias("n"))


@query("ex02_ship_block", "WITH " + _LINES + " SELECT label_id, array_to_string(block, '|') AS block FROM blocks")
def _(v):
    lines = v.label.select("label_id", L.label_lines(col("raw_text")).alias("l"))
    return lines.select("label_id", F.array_join(L.ship_block(col("l")), "|").alias("block"))


@query("ex03_tracking", "WITH " + _FIELDS + " SELECT label_id, tracking FROM fields")
def _(v):
    return v.label.select("label_id", L.tracking(col("raw_text")).alias("tracking"))


@query("ex04_classify_lines", "WITH " + _LINES + " SELECT label_id, pos, line, role FROM roled")
def _(v):
    rows = O.classified(v.label).select("label_id", F.posexplode_outer("roles").alias("pos", "x")).where("x IS NOT NULL")
    return rows.select("label_id", (col("pos") + 1).cast("bigint").alias("pos"), "x.line", "x.role")


@query("ex05_phone", "WITH " + _LINES + " SELECT label_id, pos, phone, confidence FROM phones")
def _(v):
    rows = O.classified(v.label).select("label_id", F.posexplode_outer("roles").alias("pos", "x")).where("x IS NOT NULL")
    phones = rows.where(col("x.role") == "phone").select("label_id", "pos", L.phone(col("x.line")).alias("p"))
    return phones.select("label_id", (col("pos") + 1).cast("bigint").alias("pos"), "p.phone", "p.confidence")


@query("ex06_extract_labels", "WITH " + _FIELDS + " SELECT * FROM fields")
def _(v):
    return O.extract_labels(v.label.select("label_id", "raw_text")).drop("raw_text")


@query(
    "ex07_label_debug",
    "WITH " + _FIELDS + """ SELECT label_id, pos, line, CASE role WHEN 'name' THEN 'nom' WHEN 'street' THEN 'rue' WHEN 'phone' THEN 'téléphone'
        ELSE CASE WHEN cp IS NOT NULL AND contains(line, cp) THEN 'cp+ville' ELSE '(ignorée)' END END AS role
      FROM roled LEFT JOIN towns USING (label_id)""",
)
def _(v):
    return O.label_debug(v.label).withColumn("pos", col("pos").cast("bigint"))


_BARCODE = "CASE WHEN label_id % 4 = 0 THEN '1ZBAR' || CAST(label_id AS STRING) WHEN label_id % 4 = 1 THEN '' ELSE NULL END"


@query(
    "ex08_draft_parcels",
    "WITH " + _FIELDS + f""", coded AS (SELECT label_id, nullif({_BARCODE}, '') AS barcode FROM {{label}})
      SELECT label_id, coalesce(barcode, tracking, 'label-' || CAST(label_id AS STRING)) AS id, coalesce(barcode, tracking) AS tracking,
        CASE WHEN barcode IS NOT NULL THEN 'code_barre' WHEN tracking IS NOT NULL THEN 'haute' END AS tracking_confidence,
        coalesce(nom, '') AS nom, coalesce(tel, '') AS tel, tel_confidence, coalesce(rue, '') AS rue, coalesce(cp, '') AS cp,
        coalesce(ville, '') AS ville, 'a_verifier' AS statut, 'ocr' AS source
      FROM fields JOIN coded USING (label_id)""",
)
def _(v):
    read = O.extract_labels(v.label.select("label_id", "raw_text"))
    codes = v.label.select("label_id", F.expr(_BARCODE).alias("barcode"))
    named = F.concat(lit("label-"), col("label_id").cast("string"))
    return O.draft_parcels(read, codes, F.current_timestamp(), named).select(
        "label_id", "id", "tracking", "tracking_confidence", "nom", "tel", "tel_confidence", "adresse_raw.*", "statut", "source"
    )


# what a person typed: the true values of the order's address
_TYPED = """SELECT query_id AS label_id, CASE WHEN query_id % 8 = 1 THEN 'Mme Corrigée' ELSE 'CLIENT ' || chr(CAST(65 + true_id % 26 AS INT)) || ' MARTEL' END AS nom,
    CASE WHEN query_id % 3 = 0 THEN '' ELSE '06' || lpad(CAST(query_id % 100000000 AS STRING), 8, '0') END AS tel,
    n || ' ' || upper(r) AS rue, a_cp AS cp, upper(c) AS ville FROM {pair}"""
_CHANGED = (
    "WITH " + _FIELDS + f""", typed AS ({_TYPED}), changes AS (SELECT label_id,
      list_filter([{', '.join(f"CASE WHEN coalesce(f.{x}, '') <> coalesce(y.{x}, '') THEN '{x}' END" for x in O.FIELDS)}], lambda x: x IS NOT NULL) AS champs
      FROM fields f JOIN typed y USING (label_id) JOIN texts USING (label_id) WHERE coalesce(raw_text, '') <> '')"""
)


def _log(v):
    parcels = v.label.select(col("label_id").alias("colis_id"), col("raw_text").alias("ocr_raw_text"))
    return O.correction_log(parcels, v.sql(_TYPED).withColumnRenamed("label_id", "colis_id"))


@query("ex09_correction_log", _CHANGED + " SELECT label_id, array_to_string(champs, ',') AS champs FROM changes WHERE len(champs) > 0")
def _(v):
    return _log(v).select(col("colis_id").alias("label_id"), F.array_join("champs_modifies", ",").alias("champs"))


@query("ex10_correction_rates", _CHANGED + " SELECT field, COUNT(*) AS n FROM (SELECT unnest(champs) AS field FROM changes) u GROUP BY field")
def _(v):
    return O.correction_rates(_log(v))


_OTSU = """hist AS (SELECT grp, level AS t, COUNT(*) AS h FROM {level} GROUP BY grp, level),
  sums AS (SELECT grp, t, CAST(SUM(h) OVER w AS DOUBLE) AS wb, CAST(SUM(t * h) OVER w AS DOUBLE) AS sb,
      CAST(SUM(h) OVER (PARTITION BY grp) AS DOUBLE) AS n, CAST(SUM(t * h) OVER (PARTITION BY grp) AS DOUBLE) AS s
    FROM hist WINDOW w AS (PARTITION BY grp ORDER BY t ROWS UNBOUNDED PRECEDING)),
  spread AS (SELECT grp, t, wb * (n - wb) * (sb / wb - (s - sb) / (n - wb)) * (sb / wb - (s - sb) / (n - wb)) AS var FROM sums WHERE n > wb),
  best AS (SELECT grp, t FROM spread WHERE var > 0 QUALIFY row_number() OVER (PARTITION BY grp ORDER BY var DESC, t) = 1),
  limits AS (SELECT grp, coalesce(t, 128) AS threshold FROM (SELECT DISTINCT grp FROM hist) g LEFT JOIN best USING (grp))"""


@query("ex11_otsu_threshold", "WITH " + _OTSU + " SELECT grp, threshold FROM limits")
def _(v):
    return O.otsu_threshold(v.level, "grp", "level")


_PIXEL = "SELECT event_id, event_type AS grp, event_id % 256 AS r, (event_id * 7) % 256 AS g, CAST(floor(value) AS BIGINT) % 256 AS b FROM {events}"


@query(
    "ex12_grayscale_binarize",
    f"""WITH pixel AS ({_PIXEL}), gray AS (SELECT event_id, grp, CAST(round_even(r * 0.299e0 + g * 0.587e0 + b * 0.114e0, 0) AS BIGINT) AS level FROM pixel),
      {_OTSU.replace("{level}", "gray")} SELECT event_id, level, CASE WHEN level >= threshold THEN 255 ELSE 0 END AS value
      FROM gray JOIN limits USING (grp)""".replace("CASE WHEN level >= threshold THEN 255 ELSE 0 END", "CAST(CASE WHEN level >= threshold THEN 255 ELSE 0 END AS BIGINT)"),
)
def _(v):
    pixels = v.sql(_PIXEL)
    gray = pixels.select("event_id", "grp", O.grayscale(col("r"), col("g"), col("b")).alias("level"))
    return O.binarize(gray, O.otsu_threshold(gray, "grp", "level"), "grp", "level").select("event_id", "level", "value")
