"""Decontamination, language ID, secrets, URL filter, the checking SQL and the pipeline on small inputs."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from roundsman.llm import decontaminate, langid, secrets, url_filter
from roundsman.llm.checks import CHECKS
from roundsman.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def canonical(table):
    names = sorted(table.column_names)
    return names, sorted(tuple(map(str, row)) for row in zip(*[table.column(n).to_pylist() for n in names]))


@data
@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    assert canonical(QUERIES[name](spark, FOLDER).toArrow()) == canonical(con.execute(CHECKS[name]).to_arrow_table())


def test_all_are_registered():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 14)]


def test_windows_of_items(spark):
    items = spark.createDataFrame(
        [("b", " ".join(f"w{i}" for i in range(12))), ("a", "Short  item"), ("c", None), ("d", "--"), ("e", "short item")],
        "item_id string, text string",
    )
    docs = spark.createDataFrame(
        [(1, "é! W0 w1,w2 w3 w4 w5 w6 w7 w8 w9 x"), (2, "a short-item."), (3, "shorts item"), (4, None), (5, ""), (5, "... !"),
         (6, " ".join(f"w{i}" for i in range(12)))],
        "doc_id long, text string, starts string".replace(", starts string", ""),
    ).withColumn("starts", F.lit("x"))
    got = {(r.doc_id, r.n_words, r.n_hit, ",".join(r.item_ids)): (r.starts, r.ends) for r in decontaminate.scan(docs, items).collect()}
    assert got == {
        (1, 12, 10, "b"): ([3], [32]), (2, 3, 2, "a,e"): ([2], [12]), (3, 2, 0, ""): ([], []), (4, 0, 0, ""): ([], []),
        (5, 0, 0, ""): ([], []), (6, 12, 12, "b"): ([0], [37]),
    }
    assert decontaminate.scan(docs, items.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.scan(docs.limit(0), items).count() == 0
    with pytest.raises(ValueError, match="scan in parts"):
        decontaminate.scan(docs, items, max_item_bytes=10)


def test_languages(spark):
    rows = [(i, "the cat and the dog are here", "en") for i in range(8)] + [(i + 8, "le chat et le chien sont ici", "fr") for i in range(8)]
    model = langid.fit(spark.createDataFrame(rows + [(50, None, "en"), (51, "xx", None)], "doc_id long, text string, lang string"))
    docs = spark.createDataFrame(
        [(1, "The dogs", "a"), (2, "les chiens", "b"), (3, None, "c"), (4, "12 ² !", "d"), (5, "", "e"), (6, "the " * 50_000, "f")],
        "doc_id long, text string, score string",
    )
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "en", 2: "fr", 3: "und", 4: "und", 5: "und", 6: "en"}
    assert all(0 <= s <= 1 for _, s in got.values())
    empty = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}


@data
def test_languages_held_out(spark):
    got = QUERIES["op5_language_id"](spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet"), "doc_id")
    right, n = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 30 and right > 0.97


def test_secret_spans(spark):
    text = "Password: 'hunter2x' token=token=abc AKIA" + "A1" * 8 + " " + "0a" * 12 + "\napi-key=nothing secret: abc"
    docs = spark.createDataFrame([(1, text), (2, text), (3, None), (4, ""), (5, "é password=éa"), (None, "token=123456")], "doc_id long, text string")
    rows = secrets.scan(docs).select("id", secrets.listing(F.col("found")).alias("spans")).collect()
    got = {r.id: r.spans for r in rows}
    assert len(rows) == 6 and got[1] == got[2] == "assign:0:19,assign:21:36,access:37:57,hex:58:82"
    assert (got[3], got[4], got[5], got[None]) == ("", "", "", "assign:0:12")
    assert secrets.scan(docs.limit(0)).count() == 0
    clean = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    assert clean[1].startswith("[secret]' [secret] [secret] [secret]\napi-key") and clean[3] is None and clean[5] == "é password=éa"


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    docs = spark.createDataFrame([(1, "token=123456"), (2, "token=123456"), (3, "nothing")], "doc_id long, text string")
    secrets.findings(docs, ledger=ledger)
    size = spark.read.parquet(ledger).count()
    assert size == 2 * len(secrets.RULES)
    more = docs.unionByName(spark.createDataFrame([(4, "secret=abcdef")], docs.schema))
    rows = {r.id: secrets and len(r.found) for r in secrets.scan(more, ledger=ledger).collect()}
    assert rows == {1: 1, 2: 1, 3: 0, 4: 1} and spark.read.parquet(ledger).count() == size + len(secrets.RULES)
    newer = (*secrets.BASE[:2], secrets.Rule("hex", "[0-9a-f]{24,}", 0, 24, version=2))
    secrets.findings(more, ledger=ledger, rules=newer)
    assert spark.read.parquet(ledger).where("rule = 'hex@2'").count() == 3


def test_urls(spark):
    rules = spark.sql("SELECT * FROM VALUES ('org', '/', 'allow'), ('ex.org', '/a', 'block'), ('ex.org', '/a', 'allow') AS r(host, path, verdict)")
    urls = ["http://EX.org/a/b?x", "http://sub.ex.org/abc", "http://ex.org", "http://notex.org/a", "//ex.org/a", None, "", "x://org/", "http://ex.org?/a"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert got == {
        0: ("ex.org", "/a/b", "ex.org/a", "block"), 1: ("sub.ex.org", "/abc", "ex.org/a", "block"), 2: ("ex.org", "", None, "allow"),
        3: ("notex.org", "/a", "org/", "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"),
        7: ("org", "/", "org/", "allow"), 8: ("ex.org", "", None, "allow"),
    }
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    levels = url_filter.build_cascade(universe)
    assert len(levels) > 1
    assert universe.where(url_filter.member(F.col("key"), levels) != F.col("listed")).count() == 0
    with pytest.raises(ValueError, match="split the list"):
        url_filter.build_cascade(universe, max_keys=5)


def test_pipeline_stages(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, long, "en"), (2, long + " more", "en"), (3, "123", "en"), (4, None, None), (5, "a leaked short item here", "en"),
        (6, "my token=123456 is out", "en"), (7, "clean text without anything", "en"), (7, "clean text without anything", "en"),
    ]
    docs = spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("x", "Short item")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [
        (1, long), (6, "my [secret] is out"), (7, "clean text without anything"),
    ]
    assert all(len(r.ids) == 4 * r.n_tokens and r.n_chars == len(r.text) for r in got)
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "item_id string, text string").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_equal_rows_are_scanned_once(spark, tmp_path):
    text = "token=123456 " + "x" * 200_000
    rows = [(1, text)] * 6 + [(2, text), (None, "secret=abcdefg"), (None, "secret=abcdefg"), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ledger = str(tmp_path / "ledger")
    got = secrets.scan(docs, ledger=ledger).collect()
    assert len(got) == 10 and sorted(len(r.found) for r in got) == [0] + [1] * 9
    held = spark.read.parquet(ledger)
    assert held.count() == held.select("blob", "rule").distinct().count() == 3 * len(secrets.RULES)
    assert secrets.scan(docs, ledger=ledger).count() == 10 and spark.read.parquet(ledger).count() == 3 * len(secrets.RULES)


def test_clashing_columns_are_kept(spark, tmp_path):
    """Columns named as a stage's own ones come through every stage but the last as they were."""
    names = ["lang_pred", "score", "has_letters", "n_words", "n_hit", "item_ids", "starts", "ends", "_found", "_blob", "found", "blob", "_id", "_mark", "id", "mark", "Score_"]
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, "en", *names), (1, text, "en", *names), (2, "my token=123456 here", "en", *names)], ["doc_id", "text", "lang", *names])
    spark.createDataFrame([("x", "not there at all")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "secret_scan":
            docs = docs.withColumn("n_chars", F.lit(0).cast("long"))
        columns = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
    rows = docs.collect()
    assert sorted((r.doc_id, r.text) for r in rows) == [(1, text), (2, "my [secret] here")]
    assert all(r[n] == n for r in rows for n in names)


def plain_languages(rows, docs):
    """Words first, then ever shorter n-grams, one text after the other."""
    import math
    import re
    from collections import Counter

    def grams(word, n):
        return [f"<{word}>"[i : i + n] for i in range(len(word) + 3 - n)]

    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    langs = sorted({lang for _, lang in rows})
    counts = {size: {lang: Counter() for lang in langs} for size in range(5)}
    for text, lang in set(rows):
        for w in words(text):
            counts[0][lang][w] += 1
            for size in range(1, 5):
                counts[size][lang].update(grams(w, size))
    known = {size: set().union(*by.values()) for size, by in counts.items()}

    def log(size, unit, lang):
        by = counts[size][lang]
        return math.log((by[unit] + 0.5) / (by.total() + 0.5 * (len(known[size]) + 1)))

    out = []
    for text in docs:
        sums = dict.fromkeys(langs, 0.0)
        for w in words(text):
            found = [(0, [w])] if w in known[0] else [(n, [g for g in grams(w, n) if g in known[n]]) for n in (4, 3, 2, 1)]
            size, units = next(((n, u) for n, u in found if u), (1, []))
            for lang in langs:
                if units:
                    sums[lang] += sum(log(size, u, lang) for u in units) / len(units)
        top = max(sums.values())
        best = next(lang for lang in langs if sums[lang] == top)
        out.append((best if words(text) else "und", 1 / sum(math.exp(s - top) for s in sums.values()) if words(text) else 0.0))
    return out


def test_languages_as_plain_version(spark):
    import random

    rng = random.Random(6)
    stems = {"en": ["the", "with", "house", "ing", "er"], "fr": ["le", "été", "maison", "eau", "ch"], "de": ["der", "straße", "haus", "ung", "ö"]}
    word = lambda lang: "".join(rng.choices(stems[lang], k=rng.randrange(1, 4)))
    text = lambda lang, n: " ".join(word(lang) for _ in range(n))
    rows = [(text(lang, rng.randrange(0, 30)), lang) for lang in stems for _ in range(20)]
    docs = [text(lang, 12) for lang in stems for _ in range(15)] + ["zzz qqq", "日本 the", "x" * 300, "", None, "7", "İstanbul ΑΣ", "été " * 2000]
    # one id for all rows, and one text many times: ids have no say, copies count once
    table = spark.createDataFrame([(1, t, g) for t, g in rows] + [(1, *rows[0])] * 200, "doc_id long, text string, lang string")
    got = langid.predict(spark.createDataFrame(enumerate(docs), "n long, text string"), langid.fit(table)).orderBy("n").collect()
    for r, (lang, score) in zip(got, plain_languages(rows, docs), strict=True):
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-4), r.text
    few = langid.fit(table, sample_rows=30)
    assert few[0] and len(few[1][0][0]) < len(langid.fit(table)[1][0][0])


def test_ids_do_not_decide_for_other_groups(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [
        (0, b), (1, b), (1, a), (3, a), (1, a + " more"), (None, a), (None, c), (None, c + " more"), (None, c.upper()),
        (None, None), (None, None), (None, ""), (5, ""), (5, " "), (6, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, "").collect()]
    grouped = sorted((t[0].lower(), i) for i, t in got if (t or "").strip())
    assert grouped == [("a", 1), ("b", 0), ("c", None)]
    assert sorted(map(str, (r for r in got if not (r[1] or "").strip()))) == sorted(map(str, rows[9:]))


def test_missing_labels_reject_no_document(spark):
    rows = [(1, "some text", None), (2, "12 !", None), (3, None, None), (4, "", None), (None, "Ünder", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.language(spark, docs, "")
    assert got.columns == docs.columns
    assert {(r.doc_id, r.text) for r in got.collect()} == {(1, "some text"), (None, "Ünder")}
