"""Label shapes with invented people."""

import pytest
from pyspark.sql import functions as F

from roundsman.operators import labels as O

CASES = {
    "trailing number": (
        "MARTIN J\n0612345678\nMARTIN JULIE\nRUE DU MOULIN 6\n54470 ANSAUVILLE",
        (None, "MARTIN JULIE", "0612345678", "haute", "RUE DU MOULIN 6", "54470", "ANSAUVILLE"),
    ),
    "bare nine digits": (
        "ACME FLEURS\n700112233\nPAUL DURAND\n12 RUE DES LILAS\n55300 SAINT MIHIEL",
        (None, "PAUL DURAND", "0700112233", "a_verifier", "12 RUE DES LILAS", "55300", "SAINT MIHIEL"),
    ),
    "two street lines": (
        "DUPRE\n+33612345678\nDUPRE SARL\nANNE DUPRE\nZONE NORD\n3 IMPASSE X\n54200 TOUL",
        (None, "ANNE DUPRE", "0612345678", "haute", "ZONE NORD 3 IMPASSE X", "54200", "TOUL"),
    ),
    "sender and tracking": (
        "EXPED CIE\n5 RUE DU PORT\n54000 NANCY\n\nSHIP TO:\nLEA PETIT\n1 AVENUE FOCH\n55300 SAINT-MIHIEL\n\n1Z999AA10123456784\nRef.1: TEL 0329000000",
        ("1Z999AA10123456784", "LEA PETIT", None, "a_verifier", "1 AVENUE FOCH", "55300", "SAINT-MIHIEL"),
    ),
    "reference confirms phone": (
        "LEA PETIT\n329000000\n1 AVENUE FOCH\n55300 TOUL\nRef.1: TEL 0329000000",
        (None, "LEA PETIT", "0329000000", "haute", "1 AVENUE FOCH", "55300", "TOUL"),
    ),
    "noise in a name": (
        "SHIP TO:\nPETIT S0PHIE\n0612345678\n6 RUE X\n54470 TOUL",
        (None, "PETIT S0PHIE", "0612345678", "haute", "6 RUE X", "54470", "TOUL"),
    ),
    "anchor and name on a line, CRLF, spaced tracking": (
        "ship  to : LEA PETIT\r\n6 RUE X\r\n54470 TOUL\r\n1Z 999AA1 01 2345 6784\r\n",
        ("1Z999AA10123456784", "LEA PETIT", None, "a_verifier", "6 RUE X", "54470", "TOUL"),
    ),
    "keyword inside a name": ("XAVIER\nLEA PETIT\n54470 TOUL", (None, "LEA PETIT", None, "a_verifier", "XAVIER", "54470", "TOUL")),
    "no town": ("LEA PETIT\nFRANCE\n6 RUE X", (None, "LEA PETIT", None, "a_verifier", "6 RUE X", None, None)),
    "empty": ("", (None, None, None, "a_verifier", None, None, None)),
    "null": (None, (None, None, None, "a_verifier", None, None, None)),
    "prefix 1": ("LEA\nTEL 0611112233\n54470 TOUL", (None, "LEA", "0611112233", "haute", None, "54470", "TOUL")),
    "prefix 2": ("LEA\nTEL 003361111222330\n54470 TOUL", (None, "LEA", None, "a_verifier", None, "54470", "TOUL")),
    "prefix 3": ("LEA\nTEL 00336611112233\n54470 TOUL", (None, "LEA", "0611112233", "haute", None, "54470", "TOUL")),
}


def test_extract(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "label_id string, raw_text string")
    got = {r["label_id"]: tuple(r)[2:] for r in O.extract_labels(df).collect()}
    # fifteen digits are no phone: "TEL ..." then counts as a name line, the last one
    expected = {k: v[1] for k, v in CASES.items()}
    expected["prefix 2"] = (None, "TEL 003361111222330", None, "a_verifier", None, "54470", "TOUL")
    assert got == expected


def test_debug_roles(spark):
    df = spark.createDataFrame([(1, "LEA\n0612345678\n6 RUE X\nFRANCE\n54470 TOUL")], "label_id int, raw_text string")
    roles = [(r["pos"], r["role"]) for r in O.label_debug(df).orderBy("pos").collect()]
    assert roles == [(1, "nom"), (2, "téléphone"), (3, "rue"), (4, "(ignorée)"), (5, "cp+ville")]


def test_corrections(spark):
    text = "LEA PETIT\n6 RUE X\n54470 TOUL"
    parcels = spark.createDataFrame([("a", text), ("b", text), ("c", ""), ("d", None)], "colis_id string, ocr_raw_text string")
    typed = [("a", "LEA PETIT", "", "6 RUE X", "54470", "TOUL"), ("b", "LÉA", None, "6 RUE X", "54470", "Toul"), ("c", "X", "", "", "", "")]
    corrected = spark.createDataFrame(typed, "colis_id string, nom string, tel string, rue string, cp string, ville string")
    log = O.correction_log(parcels, corrected)
    assert [(r["colis_id"], r["champs_modifies"]) for r in log.collect()] == [("b", ["nom", "ville"])]
    assert {(r["field"], r["n"]) for r in O.correction_rates(log).collect()} == {("nom", 1), ("ville", 1)}


def test_draft_prefers_barcode(spark):
    df = spark.createDataFrame([(1, "1Z999AA10123456784\nLEA"), (2, "LEA")], "label_id int, raw_text string")
    codes = spark.createDataFrame([(1, "1ZBAR")], "label_id int, barcode string")
    got = O.draft_parcels(O.extract_labels(df), codes, F.current_timestamp(), F.lit("new")).orderBy("label_id").collect()
    assert [(r["id"], r["tracking"], r["tracking_confidence"]) for r in got] == [("1ZBAR", "1ZBAR", "code_barre"), ("new", None, None)]


def reference_threshold(levels):
    """Straight loop over the histogram."""
    hist = [levels.count(t) for t in range(256)]
    total, sum_all = len(levels), sum(levels)
    below = below_sum = 0
    best, threshold = 0.0, 128
    for t in range(256):
        below += hist[t]
        if below == 0:
            continue
        if below == total:
            break
        below_sum += t * hist[t]
        spread = below * (total - below) * (below_sum / below - (sum_all - below_sum) / (total - below)) ** 2
        if spread > best:
            best, threshold = spread, t
    return threshold


@pytest.mark.parametrize("levels", [[0, 0, 0], [10, 200], [10, 10, 90, 91, 200, 255], list(range(256)), [5, 5, 6]])
def test_otsu(spark, levels):
    df = spark.createDataFrame([("g", x) for x in levels], "g string, level int")
    assert O.otsu_threshold(df, "g", "level").first()["threshold"] == reference_threshold(levels)


def test_grayscale_rounds_half_even(spark):
    got = spark.createDataFrame([(255, 255, 255), (0, 0, 0), (10, 20, 30)], "r int, g int, b int").select(
        O.grayscale(F.col("r"), F.col("g"), F.col("b")).alias("v")
    )
    assert [r["v"] for r in got.collect()] == [255, 0, round(0.299 * 10 + 0.587 * 20 + 0.114 * 30)]
