"""Column builders for navigation, search and text-message links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roundsman.functions.text import none_if_empty, text_or_empty

# Characters a URI component keeps although form encoding escapes them.
URI_KEPT = {"%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}


def form_encode(col: Column) -> Column:
    """Form encoding: blank becomes ``+``."""
    return F.url_encode(text_or_empty(col))


def uri_encode(col: Column) -> Column:
    """URI component encoding: blank becomes ``%20`` and ``! ' ( ) ~`` stay."""
    out = F.replace(form_encode(col), F.lit("+"), F.lit("%20"))
    for escaped, kept in URI_KEPT.items():
        out = F.replace(out, F.lit(escaped), F.lit(kept))
    return out


def number_text(col: Column) -> Column:
    """Shortest decimal text of a coordinate, never in exponent form, whole numbers without a fraction."""
    whole = F.floor(col)
    tiny = F.rtrim(col.cast("decimal(38,20)").cast("string"), F.lit("0"))
    return (
        F.when(col == whole, whole.cast("bigint").cast("string"))
        .when(F.abs(col) < 0.001, tiny)
        .otherwise(col.cast("double").cast("string"))
    )


def lat_lon_text(lat: Column, lon: Column) -> Column:
    return F.concat(number_text(lat), F.lit(","), number_text(lon))


def nav_url(app: Column, lat: Column, lon: Column, label: Column, adresse: Column) -> Column:
    """Driving link for the chosen app, by address text when known, else by coordinates."""
    address, point = none_if_empty(adresse), lat_lon_text(lat, lon)
    named = F.when(text_or_empty(label) == "", F.lit("")).otherwise(F.concat(F.lit("&dname="), form_encode(label)))
    apple = F.concat(F.lit("https://maps.apple.com/?daddr="), form_encode(F.coalesce(address, point)), named)
    waze = F.concat(
        F.when(address.isNull(), F.concat(F.lit("https://waze.com/ul?ll="), point)).otherwise(
            F.concat(F.lit("https://waze.com/ul?q="), uri_encode(address))
        ),
        F.lit("&navigate=yes"),
    )
    google = F.concat(
        F.lit("https://www.google.com/maps/dir/?api=1&destination="),
        uri_encode(F.coalesce(address, point)),
        F.lit("&travelmode=driving"),
    )
    return F.when(app == "waze", waze).when(app == "google", google).otherwise(apple)


def search_url(query: Column) -> Column:
    return F.concat(F.lit("https://www.google.com/maps/search/?api=1&query="), uri_encode(query))


def sms_url(tel: Column, body: Column) -> Column:
    return F.concat(F.lit("sms:"), uri_encode(tel), F.lit("&body="), uri_encode(body))
