"""Scalar expressions against values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from roundsman.functions import geo, links, text


def values(spark, build, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(build(*[F.col(c) for c in df.columns]).alias("x")).collect()]


def test_street_forms(spark):
    given = ["Av. du Gal Leclerc", "BD. ST MICHEL", "  12, Rte de Nancy ", "Rue de l’Eglise", "Rue de l'Église", None, "Straße œuvre"]
    assert values(spark, text.normalize_street, [(x,) for x in given], "s string") == [
        "avenue du gal leclerc", "boulevard saint michel", "12 route de nancy", "rue de l eglise", "rue de l'eglise", "",
        "stra e uvre",
    ]


def test_city_keeps_hyphens(spark):
    assert values(spark, text.normalize_city, [("SAINT  MIHIEL",), ("Saint-Mihiel",), ("Évêché  Neuf ",), (None,)], "s string") == [
        "saint mihiel", "saint-mihiel", "eveche neuf", "",
    ]


def test_accents_composed_and_combining(spark):
    assert values(spark, text.strip_accents, [("éÀçñŸ ő",), ("éà",), ("ßœæ",)], "s string") == ["eAcnY o", "ea", "ßœæ"]


def test_street_similarity(spark):
    rows = [("rue de la pa1x", "rue de la paix"), ("rue de la paix", "avenue du general leclerc"), ("", "x"), ("a", "a"), (None, "a")]
    got = values(spark, text.street_similarity, rows, "a string, b string")
    assert got == pytest.approx([0.797619, 0.165641, 0.0, 1.0, 0.0], abs=1e-6)


def test_number_split(spark):
    given = ["6 Rue de l'Eglise", "Rue de l'Eglise 6", "12 bis Rue X", "12BIS Rue X", "Rue X 3 ter", "Rue X", "  7\tQuai Y ", None, "12"]
    got = values(spark, text.split_number_street, [(x,) for x in given], "s string")
    assert [tuple(r) for r in got] == [
        ("6", "Rue de l'Eglise"), ("6", "Rue de l'Eglise"), ("12 bis", "Rue X"), ("12BIS", "Rue X"), ("3 ter", "Rue X"),
        ("", "Rue X"), ("7", "Quai Y"), ("", ""), ("", "12"),
    ]


def test_duration(spark):
    given = [0.0, 29.0, 30.0, 3599.0, 3600.0, 5400.0, math.inf, None, math.nan]
    assert values(spark, geo.format_duration, [(x,) for x in given], "s double") == [
        "0 min", "0 min", "1 min", "1 h", "1 h", "1 h 30", "—", "—", "—",
    ]


def test_parse_lat_lon(spark):
    given = ["48.6921, 6.1844", " 48.5abc ,-6e0", "48,6,1", "91, 0", "x, 1", "48", "", None, ".5,+.25", "1.,2."]
    got = values(spark, geo.parse_lat_lon, [(x,) for x in given], "s string")
    assert [tuple(r) if r else None for r in got] == [
        (48.6921, 6.1844), (48.5, -6.0), None, None, None, None, None, None, (0.5, 0.25), (1.0, 2.0),
    ]


def test_template_drops_unknown_values(spark):
    rows = [("Bonjour {nom},  {minutes_estimees} min à {adresse} ", "Zoé", None, "1 Rue X"), (None, "a", 3, "b")]
    got = values(spark, text.render_template, rows, "t string, n string, m int, a string")
    assert got == ["Bonjour Zoé, min à 1 Rue X", ""]


def test_links(spark):
    rows = [
        ("apple", 48.5, 6.0, "Zoé B", "1 Rue d'Été (nord)"), ("waze", 48.5, 6.0, "", ""), ("google", 0.0005, -6.25, None, None),
        ("waze", 1.0, 2.0, None, "a~b*c!"),
    ]
    assert values(spark, links.nav_url, rows, "app string, lat double, lon double, label string, adresse string") == [
        "https://maps.apple.com/?daddr=1+Rue+d%27%C3%89t%C3%A9+%28nord%29&dname=Zo%C3%A9+B",
        "https://waze.com/ul?ll=48.5,6&navigate=yes",
        "https://www.google.com/maps/dir/?api=1&destination=0.0005%2C-6.25&travelmode=driving",
        "https://waze.com/ul?q=a~b*c!&navigate=yes",
    ]


def test_display_address(spark):
    df = spark.sql("""SELECT named_struct('rue', '1 Rue X', 'cp', '54000', 'ville', 'Nancy') AS raw, CAST(NULL AS STRING) AS ok
        UNION ALL SELECT named_struct('rue', '', 'cp', CAST(NULL AS STRING), 'ville', ''), ''
        UNION ALL SELECT named_struct('rue', '1 Rue X', 'cp', '54000', 'ville', 'Nancy'), '2 Rue Y, 54000 Nancy'""")
    shown = df.select(text.display_address(F.col("ok"), F.col("raw")).alias("s"))
    got = [tuple(r) for r in shown.select("s", text.split_display(F.col("s")).alias("x")).select("s", "x.*").collect()]
    assert got == [
        ("1 Rue X, 54000 Nancy", "1 Rue X", "54000 Nancy"), ("(adresse à vérifier)", "(adresse à vérifier)", ""),
        ("2 Rue Y, 54000 Nancy", "2 Rue Y", "54000 Nancy"),
    ]
