"""Record maintenance as set operations: upsert, patch, delete, look up, purge, list."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roundsman.functions.text import none_if_empty, text_or_empty


def record_key(id_col: Column, tracking: Column) -> Column:
    """Given id, else tracking number, else a new identifier."""
    return F.coalesce(none_if_empty(id_col), none_if_empty(tracking), F.uuid())


def latest(changes: DataFrame, key: str, order_by: str) -> DataFrame:
    """Last change per key. Rank 1 is pre-selected on each input partition, so a
    key with very many changes never travels whole."""
    w = Window.partitionBy(key).orderBy(F.col(order_by).desc())
    return changes.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def join_known(rows: DataFrame, found: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join of ``found`` on the columns ``on``. Rows with a null key match nothing, so they
    pass by the join instead of meeting in one of its tasks."""
    missing = F.lit(False)
    for key in on:
        missing = missing | F.col(key).isNull()
    added = [F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema if f.name not in on]
    passed = rows.where(missing).select("*", *added)
    return rows.where(~missing).join(found, list(on), "left").unionByName(passed)


def upsert(base: DataFrame, changes: DataFrame, key: str, order_by: str) -> DataFrame:
    """Replace whole records by key and add new ones."""
    last = latest(changes, key, order_by)
    fresh = last.select(*base.columns)
    return base.join(fresh.select(key), key, "left_anti").select(*base.columns).unionByName(fresh)


def patch(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Merge the given fields into existing records; the key never changes.

    ``changes`` holds one row per key. With a column ``fields`` (array of names)
    the named fields are set even to null, without it null means "leave alone".
    """
    flagged = "fields" in changes.columns
    columns = [c for c in changes.columns if c in base.columns and c != key]
    side = changes.select(
        F.col(key), F.struct(*columns, *(["fields"] if flagged else [])).alias("_new")
    )

    def merged(name: str) -> Column:
        if name not in columns:
            return F.col(name)
        new = F.col(f"_new.{name}")
        if not flagged:
            return F.coalesce(new, F.col(name)).alias(name)
        named = F.coalesce(F.array_contains("_new.fields", name), F.lit(False))
        return F.when(named, new).otherwise(F.col(name)).alias(name)

    return base.join(side, key, "left").select(*[merged(c) for c in base.columns])


def delete_keys(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key), key, "left_anti").select(*base.columns)


def clear_tables(tables: dict[str, DataFrame], names: Iterable[str]) -> dict[str, DataFrame]:
    """Empty the named tables, keep the others."""
    gone = set(names)
    return {name: df.where(F.lit(False)) if name in gone else df for name, df in tables.items()}


def lookup(df: DataFrame, column: str, values: DataFrame | Sequence) -> DataFrame:
    """Rows whose column equals one of the values: a pushed-down filter for literals,
    a semi-join for a table of values."""
    if isinstance(values, DataFrame):
        return df.join(values.select(column), column, "left_semi").select(*df.columns)
    return df.where(F.col(column).isin(list(values)))


def flag_duplicates(scans: DataFrame, store: DataFrame, scan_key: str = "scan_id") -> DataFrame:
    """Adds ``is_duplicate``: tracking already stored, or scanned earlier in the batch.

    Earliest scans come from an aggregate, which combines a repeated tracking
    before the shuffle. Scans without tracking take no part in the joins.
    """
    known = none_if_empty(F.col("tracking")).isNotNull()
    order = F.struct("date_scan", scan_key)
    tracked = scans.where(known)
    first = tracked.groupBy("tracking").agg(F.min(order).alias("_first"))
    stored = store.select(F.col("id").alias("tracking")).distinct().withColumn("_stored", F.lit(True))
    seen = first.join(stored, "tracking", "left")
    flagged = tracked.join(seen, "tracking").select(
        *scans.columns, (F.coalesce("_stored", F.lit(False)) | (order > F.col("_first"))).alias("is_duplicate")
    )
    return flagged.unionByName(scans.where(~F.coalesce(known, F.lit(False))).withColumn("is_duplicate", F.lit(False)))


def overlay_settings(defaults: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored value where a row exists (even null), default otherwise; unknown keys drop out."""
    side = stored.select("key", F.col("value").alias("_value"), F.lit(True).alias("_set"))
    value = F.when(F.col("_set"), F.col("_value")).otherwise(F.col("value"))
    return defaults.join(side, "key", "left").select("key", value.alias("value"))


# Defaults of the settings that do not depend on a place.
DEFAULT_SETTINGS = {
    "depotReturn": "false",
    "navApp": "apple",
    "ocrLangs": "fra",
    "avant12hPenaltyMinutes": "20",
    "dureeArretMinutes": "3",
    "autoNavAfterDeliver": "false",
    "storagePersisted": "false",
    "tourHistoryPurgeMonths": "6",
}

# Titles of the three stock messages, by position.
DEFAULT_LABELS = ("Arrivée imminente", "Colis déposé", "Absent au passage")


def months_back(now: Column, months: int) -> Column:
    """``now`` with the month number lowered; a day the month lacks runs on into the next."""
    day = F.add_months(F.trunc(now, "MM"), -months) + (F.dayofmonth(now) - 1)
    return day.cast("timestamp_ntz") + (now - F.date_trunc("day", now).cast("timestamp_ntz"))


def purge_tours(tours: DataFrame, months: int, now: Column) -> DataFrame:
    """Drop archived tours created before the retention limit."""
    old = (F.col("statut") == "archivee") & (F.col("date_creation") < months_back(now.cast("timestamp_ntz"), months))
    return tours.where(~F.coalesce(old, F.lit(False)))


def list_parcels(parcels: DataFrame) -> DataFrame:
    """By scan time, unscanned first."""
    return parcels.orderBy(F.col("date_scan").asc_nulls_first(), "id")


def favourite_order(prefix: str = "") -> list[Column]:
    """Sort keys of the favourites list: town, then street, in language order."""
    return [F.collate(text_or_empty(F.col(prefix + c)), "UNICODE") for c in ("ville", "rue")]


def list_favourites(favourites: DataFrame) -> DataFrame:
    return favourites.orderBy(*favourite_order(), "id")


def normalize_templates(templates: Column, default_labels: Sequence[str] = DEFAULT_LABELS) -> Column:
    """Message templates as struct(label, body).

    Elements are struct(text, label, body): ``text`` is set for the old form, a bare
    string, which takes the stock title of its position.
    """
    stock = F.array(*[F.lit(x) for x in default_labels])

    def fixed(t: Column, i: Column) -> Column:
        numbered = F.concat(F.lit("Modèle "), (i + 1).cast("string"))
        old_label = F.coalesce(none_if_empty(F.get(stock, i)), numbered)
        new_label = F.coalesce(none_if_empty(t["label"]), numbered)
        bare = t["text"].isNotNull()
        return F.struct(
            F.when(bare, old_label).otherwise(new_label).alias("label"),
            F.when(bare, t["text"]).otherwise(text_or_empty(t["body"])).alias("body"),
        )

    return F.transform(F.coalesce(templates, F.array().cast(templates_type())), fixed)


def templates_type() -> str:
    return "array<struct<text:string,label:string,body:string>>"
