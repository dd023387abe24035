"""Table maintenance and imports on small tables."""

import datetime as dt
import gzip
import json

from pyspark.sql import functions as F

from roundsman.operators import tables as T
from roundsman.sources import files, geojson


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_upsert_last_change_wins(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    changes = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id int, v string, seq int")
    assert rows(T.upsert(base, changes, "id", "seq"), "id", "v") == [(1, "a"), (2, "y"), (3, "z")]


def test_record_key(spark):
    df = spark.createDataFrame([("i", "t"), ("", "t"), (None, "")], "id string, tracking string")
    got = [r[0] for r in df.select(T.record_key(F.col("id"), F.col("tracking"))).collect()]
    assert got[:2] == ["i", "t"] and len(got[2]) == 36


def test_patch_sets_named_nulls(spark):
    base = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, v string, x double")
    plain = spark.createDataFrame([(1, None, 9.0)], "id int, v string, x double")
    assert rows(T.patch(base, plain, "id"), "id", "v", "x") == [(1, "a", 9.0), (2, "b", 2.0)]
    named = spark.createDataFrame([(2, None, None, ["v"])], "id int, v string, x double, fields array<string>")
    got = {r["id"]: (r["v"], r["x"]) for r in T.patch(base, named, "id").collect()}
    assert got == {1: ("a", 1.0), 2: (None, 2.0)}


def test_clear_keeps_the_rest(spark):
    one = spark.range(3)
    got = T.clear_tables({"colis": one, "tours": one, "favoris": one}, ["colis", "tours"])
    assert {k: df.count() for k, df in got.items()} == {"colis": 0, "tours": 0, "favoris": 3}


def test_duplicates_ignore_missing_tracking(spark):
    scans = spark.createDataFrame(
        [(1, "A", 1), (2, "A", 2), (3, None, 3), (4, None, 4), (5, "", 5), (6, "B", 6)], "scan_id int, tracking string, date_scan int"
    )
    store = spark.createDataFrame([("B",)], "id string")
    assert rows(T.flag_duplicates(scans, store), "scan_id", "is_duplicate") == [
        (1, False), (2, True), (3, False), (4, False), (5, False), (6, True),
    ]


def test_month_overflow(spark):
    now = F.lit("2023-08-31 10:00:00").cast("timestamp_ntz")
    assert spark.range(1).select(T.months_back(now, 6)).first()[0] == dt.datetime(2023, 3, 3, 10)
    tours = spark.createDataFrame(
        [(1, "archivee", dt.datetime(2023, 3, 3, 9)), (2, "archivee", dt.datetime(2023, 3, 3, 10)), (3, "en_cours", dt.datetime(2000, 1, 1)),
         (4, "archivee", None)],
        "tour_id int, statut string, date_creation timestamp_ntz",
    )
    assert rows(T.purge_tours(tours, 6, now), "tour_id") == [(2,), (3,), (4,)]


def test_favourites_in_language_order(spark):
    df = spark.createDataFrame([("1", "Zélande", ""), ("2", "étain", "b"), ("3", "Etain", "a"), ("4", None, "")], "id string, ville string, rue string")
    assert [r["id"] for r in T.list_favourites(df).collect()] == ["4", "3", "2", "1"]  # the accent counts before the capital


def test_import_versions(spark):
    names = spark.createDataFrame([("graph", False), ("ban", False), ("map", True)], "name string, optional boolean")
    held = spark.createDataFrame([("graph", "1"), ("ban", "2")], "name string, version string")
    target = spark.createDataFrame([("graph", "1"), ("ban", "3"), ("map", None)], "name string, version string")
    assert rows(files.stale_datasets(target, held, names), "name", "stale") == [("ban", True), ("graph", False), ("map", False)]
    assert rows(files.stale_datasets(None, held, names), "name", "stale") == [("ban", True), ("graph", True), ("map", False)]


def test_file_versions(spark, tmp_path):
    import hashlib

    (tmp_path / "a.bin").write_bytes(b"abc")
    assert rows(files.content_version(spark, str(tmp_path)), "name", "version") == [("a.bin", hashlib.sha1(b"abc").hexdigest()[:16])]


def test_read_whole_files(spark, tmp_path):
    entry = {"n": "1", "rep": "", "r": "Rue X", "rn": "rue x", "cp": "54200", "c": "Toul", "cn": "toul", "lat": 48.5, "lon": 5.5}
    (tmp_path / "ban.json").write_text(json.dumps({"bbox": {"minLat": 1.0}, "entries": [entry, {**entry, "n": "2"}]}))
    df = files.read_addresses(spark, str(tmp_path / "ban.json"))
    assert rows(df, "n", "cp", "lat") == [("1", "54200", 48.5), ("2", "54200", 48.5)] and df.select("id").distinct().count() == 2
    graph = {"nodeCoords": [[48.6805, 5.89], [48.0, 5.0]], "edges": [[0, 1, 6.67]], "edgeAdjacency": [[]]}
    (tmp_path / "graph.json").write_text(json.dumps(graph))
    nodes, edges, turns = files.read_graph(spark, str(tmp_path / "graph.json"))
    first = nodes.where("node = 0").select(F.col("lat").cast("double")).first()[0]
    assert first != 48.6805 and abs(first - 48.6805) < 1e-5  # rounded to 32 bits
    assert rows(edges, "e", "u", "v") == [(0, 0, 1)] and turns.isEmpty()


def test_addresses_of_many_files(spark, tmp_path):
    for k in range(3):
        text = json.dumps({"entries": [{"n": f"{k}{i}", "cp": "54200", "lat": 48.5, "lon": 5.5} for i in range(2)]})
        if k == 1:
            with gzip.open(tmp_path / "part1.json.gz", "wt") as f:
                f.write(text)
        else:
            (tmp_path / f"part{k}.json").write_text(text)
    df = files.read_addresses(spark, str(tmp_path))
    assert rows(df, "id", "n") == [((k << 31) + i, f"{k}{i}") for k in range(3) for i in range(2)]


def test_features_leave_absent_order_out(spark):
    df = spark.createDataFrame([("a", "pret", None, 48.0, 5.5), ("b", "livre", 2, 48.0, 5.5)], "colis_id string, statut string, ordre int, lat double, lon double")
    got = {r["colis_id"]: json.loads(r["json"]) for r in geojson.stop_features(df).collect()}
    assert "ordre" not in got["a"]["properties"] and got["b"]["properties"]["ordre"] == 2
    assert got["a"]["geometry"] == {"type": "Point", "coordinates": [5.5, 48.0]}


def test_address_table_reads_the_asked_folders_only(spark, tmp_path):
    table = spark.createDataFrame([(i, cp, f"r{i}") for i, cp in enumerate(["01000", "01200", "54000", "54000", "75001"])], "id long, cp string, r string")
    path = str(tmp_path / "addresses")
    files.write_addresses(table, path)
    listed = files.read_address_table(spark, path, ["54000", "01200"])
    assert rows(listed, "id") == [(1,), (2,), (3,)]
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [dept#" in plan and "IN (01,54)" in plan
    codes = spark.createDataFrame([("75001",), ("75001",), (None,), ("99999",)], "cp string")
    assert rows(files.read_address_table(spark, path, codes), "id", "cp") == [(4, "75001")]
    assert rows(files.read_address_table(spark, path), "id", "cp")[0] == (0, "01000")


def test_refresh_reads_changed_files_only(spark, tmp_path):
    source, table, manifest = (str(tmp_path / x) for x in ("source", "table", "manifest"))

    def put(zone, *lines):
        (tmp_path / "source" / f"zone={zone}").mkdir(parents=True, exist_ok=True)
        (tmp_path / "source" / f"zone={zone}" / "part.txt").write_text("\n".join(lines))

    def parse(lines):
        return lines.select("value", "name")

    def state():
        return {r.name: r.stale for r in files.refresh(spark, source, table, manifest, parse).collect()}

    def held():
        return rows(files.read_refreshed(spark, table, manifest), "name", "value", "load")

    put("01", "a", "b")
    put("02", "c")
    assert state() == {"01": True, "02": True} and held() == [("01", "a", 1), ("01", "b", 1), ("02", "c", 1)]
    assert state() == {"01": False, "02": False} and held()[0] == ("01", "a", 1)
    put("02", "d")
    put("03", "e")
    assert state() == {"01": False, "02": True, "03": True}
    assert held() == [("01", "a", 1), ("01", "b", 1), ("02", "d", 3), ("03", "e", 3)]
    (tmp_path / "source" / "zone=01" / "part.txt").unlink()
    assert state() == {"02": False, "03": False} and held() == [("02", "d", 3), ("03", "e", 3)]
