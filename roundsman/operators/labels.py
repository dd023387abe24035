"""Label extraction, its debug view, parcel drafts and the correction log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roundsman.functions import labels as L
from roundsman.functions.text import none_if_empty, text_or_empty

FIELDS = ("nom", "tel", "rue", "cp", "ville")


def classified(labels: DataFrame) -> DataFrame:
    """Adds ``lines``, ``block`` and ``roles``; one narrow projection per step so that
    no array expression is evaluated twice. (Spread ``roles`` with an outer explode: the
    plain one infers a size filter that is pushed down as a second copy of it all.)"""
    return (
        labels.withColumn("lines", L.label_lines(F.col("raw_text")))
        .withColumn("block", L.after_anchor(F.col("lines")))
        .withColumn("block", L.through_town(F.col("block")))
        .withColumn("roles", L.classify_lines(F.col("block")))
    )


def extract_labels(labels: DataFrame) -> DataFrame:
    """(label_id, raw_text, ...) to the same rows with tracking, name, phone and address.

    Needs no shuffle: every field is an array expression over one row.
    """
    found = (
        classified(labels)
        .withColumn("phones", F.transform(L.lines_with_role(F.col("roles"), "phone"), L.phone))
        .withColumn("chosen", L.best_phone(F.col("phones")))
        .withColumn("town", F.get(L.lines_with_role(F.col("roles"), "town"), F.lit(0)))
        .withColumn("names", L.lines_with_role(F.col("roles"), "name"))
    )
    return found.select(
        *labels.columns,
        L.tracking(F.col("raw_text")).alias("tracking"),
        F.get(F.col("names"), F.size("names") - 1).alias("nom"),
        F.col("chosen.phone").alias("tel"),
        L.phone_confidence(F.col("chosen"), F.col("raw_text")).alias("tel_confidence"),
        none_if_empty(F.array_join(L.lines_with_role(F.col("roles"), "street"), " ")).alias("rue"),
        F.regexp_extract("town", L.TOWN_LINE, 1).alias("cp"),
        L.trim_blanks(F.regexp_extract("town", L.TOWN_LINE, 2)).alias("ville"),
    )


def label_debug(labels: DataFrame) -> DataFrame:
    """One row per kept line: position, text and role in words."""
    rows = classified(labels).withColumn(
        "cp", F.regexp_extract(F.get(L.lines_with_role(F.col("roles"), "town"), F.lit(0)), L.TOWN_LINE, 1)
    )
    return rows.select("label_id", "cp", F.posexplode_outer("roles").alias("pos", "item")).where("item IS NOT NULL").select(
        "label_id",
        (F.col("pos") + 1).alias("pos"),
        F.col("item.line").alias("line"),
        L.role_word(F.col("item.line"), F.col("item.role"), F.col("cp")).alias("role"),
    )


def draft_parcels(
    extracted: DataFrame, barcodes: DataFrame, scanned_at: Column, fallback_id: Column | None = None
) -> DataFrame:
    """Parcel drafts: a barcode beats the tracking read from the text."""
    code = none_if_empty(F.col("barcode"))
    joined = extracted.join(barcodes.select("label_id", "barcode"), "label_id", "left")
    number = F.coalesce(code, F.col("tracking"))
    return joined.select(
        "label_id",
        F.coalesce(number, F.uuid() if fallback_id is None else fallback_id).alias("id"),
        number.alias("tracking"),
        F.when(code.isNotNull(), F.lit("code_barre"))
        .when(F.col("tracking").isNotNull(), F.lit(L.SURE))
        .alias("tracking_confidence"),
        text_or_empty(F.col("nom")).alias("nom"),
        text_or_empty(F.col("tel")).alias("tel"),
        "tel_confidence",
        F.struct(*[text_or_empty(F.col(f)).alias(f) for f in ("rue", "cp", "ville")]).alias("adresse_raw"),
        F.lit(None).cast("string").alias("adresse_affichage"),
        F.lit("non_geocode").alias("geocode_status"),
        F.lit(False).alias("avant12h"),
        F.lit(1).alias("quantite"),
        F.lit("a_verifier").alias("statut"),
        F.lit("ocr").alias("source"),
        F.col("raw_text").alias("ocr_raw_text"),
        scanned_at.alias("date_scan"),
    )


def correction_log(parcels: DataFrame, corrected: DataFrame) -> DataFrame:
    """Fields a person changed against a fresh reading of the stored label text.

    ``parcels(colis_id, ocr_raw_text)``, ``corrected(colis_id, nom, tel, rue, cp, ville)``;
    parcels without text and unchanged ones give no row.
    """
    read = extract_labels(
        parcels.where(text_or_empty(F.col("ocr_raw_text")) != "")
        .withColumn("raw_text", F.col("ocr_raw_text"))
    )
    fixed = corrected.select("colis_id", F.struct(*FIELDS).alias("corrected"))
    pairs = read.join(fixed, "colis_id").withColumn("parsed", F.struct(*FIELDS))
    changed = F.filter(
        F.array(
            *[
                F.when(text_or_empty(F.col(f"parsed.{f}")) != text_or_empty(F.col(f"corrected.{f}")), F.lit(f))
                for f in FIELDS
            ]
        ),
        lambda f: f.isNotNull(),
    )
    keep = [c for c in parcels.columns]
    return (
        pairs.withColumn("champs_modifies", changed)
        .where(F.size("champs_modifies") > 0)
        .select(*keep, "parsed", "corrected", "champs_modifies")
    )


def correction_rates(log: DataFrame) -> DataFrame:
    """How often each field had to be corrected."""
    return (
        log.select(F.explode("champs_modifies").alias("field")).groupBy("field").agg(F.count("*").alias("n"))
    )


def otsu_threshold(df: DataFrame, group: str, level: str) -> DataFrame:
    """Grey level that best splits each group's histogram of levels 0-255.

    The raw rows are reduced to at most 256 counts per group before anything is
    ordered, so a hot group costs no more than any other.
    """
    counts = df.groupBy(group, F.col(level).cast("bigint").alias("t")).agg(F.count("*").alias("h"))
    whole = Window.partitionBy(group)
    upto = whole.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.select(
        group,
        "t",
        F.sum("h").over(upto).alias("below"),
        F.sum(F.col("t") * F.col("h")).over(upto).alias("below_sum"),
        F.sum("h").over(whole).alias("total"),
        F.sum(F.col("t") * F.col("h")).over(whole).alias("total_sum"),
    )
    above = F.col("total") - F.col("below")
    gap = F.col("below_sum") / F.col("below") - (F.col("total_sum") - F.col("below_sum")) / F.nullif(above, F.lit(0))
    spread = F.when(above > 0, F.col("below") * above * gap * gap)
    best = sums.withColumn("spread", spread).groupBy(group).agg(
        F.max_by("t", F.when(F.col("spread") > 0, F.struct("spread", -F.col("t")))).alias("t")
    )
    return best.select(group, F.coalesce("t", F.lit(128)).cast("bigint").alias("threshold"))


def grayscale(r: Column, g: Column, b: Column) -> Column:
    """Weighted luminance of a pixel, rounded half to even."""
    return F.bround(r * 0.299 + g * 0.587 + b * 0.114, 0).cast("bigint")


def binarize(pixels: DataFrame, thresholds: DataFrame, group: str, level: str) -> DataFrame:
    """White at or above the group's threshold, black below."""
    white = F.when(F.col(level) >= F.col("threshold"), F.lit(255)).otherwise(F.lit(0))
    return pixels.join(thresholds, group).withColumn("value", white.cast("bigint")).drop("threshold")
