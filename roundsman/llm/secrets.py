"""Secret scan over an incremental blob ledger, in built-in functions only.

Every version of a text is addressed by its SHA-256. The ledger holds one row per scanned
blob and rule version; a run scans only the pairs it does not hold, appends them, and joins
the findings back to all paths that carry the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from roundsman.llm.common import free_name
from roundsman.session import cut_lineage, scratch_path


@dataclass(frozen=True)
class Rule:
    """``group`` of the pattern must have at least ``least`` characters; raise ``version`` with any change."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


BASE = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]{24,}", 0, 24),  # same spans as all runs, then those of 24 characters and more
)
ADDED = (
    Rule("pem", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE + ADDED
LEDGER = "blob binary, rule string, spans array<struct<start:int,end:int>>"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def find(text: Column, rule: Rule) -> Column:
    """Spans (code points, end exclusive) of a rule's matches, leftmost and not overlapping.

    What lies between the matches comes from ``split`` with the same pattern, so an offset is
    the running length of the pieces and matches before it.
    """
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    pieces = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole))
    steps = F.arrays_zip(pieces, whole, value).cast("array<struct<piece:string,whole:string,value:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["whole"])
        span = F.struct(start.alias("start"), end.alias("end"))
        kept = F.when(F.length(x["value"]) >= rule.least, F.array_append(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct(end.alias("at"), kept.alias("spans"))

    none = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return F.when(F.size(whole) > 0, F.aggregate(steps, start, step, lambda acc: acc["spans"])).otherwise(none)


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], LEDGER)


def findings(
    docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES,
    doc_id: str = "doc_id", text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger does not hold; (paths(id, blob), findings(blob, found)).

    ``found`` is an array of (start, rank of the rule, end, kind), one row per blob that has
    any. ``ledger`` is a Parquet folder that outlives the run; without one a new folder below
    the shared folder serves this run only. A null text is the empty one. A repeated text is
    scanned once. An empty input gives no rows.
    """
    spark = docs.sparkSession
    ledger = ledger or scratch_path(spark, "ledger")
    versions_at = scratch_path(spark, "versions")
    source = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    # a path and the content it had: all that later steps need to know of a version
    source.select("id", blob_of(F.col("body")).alias("blob")).write.parquet(versions_at)
    versions = spark.read.parquet(versions_at)
    known = open_ledger(spark, ledger).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    wanted = F.array(*[F.lit(r.name) for r in rules])
    # of the rows with the blob's smallest id, how many have it: equal rows cannot be told apart by id
    first = versions.groupBy("blob", "id").agg(F.count("*").alias("n")).groupBy("blob").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n")).alias("s")
    )
    unseen = (
        first.select("blob", F.col("s.id").alias("of"), F.col("s.n").alias("n"))
        .join(known, "blob", "left")
        .withColumn("todo", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))))
        .where(F.size("todo") > 0)
        .select("of", "blob", "todo", "n")
    )

    def rows_of(blobs: DataFrame) -> DataFrame:
        # texts stream past the small hash table of what is to be scanned; they are not sorted
        met = source.join(blobs.drop("n").hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("of")))
        return met.where(blob_of(F.col("body")) == F.col("blob"))

    unseen = cut_lineage(unseen)
    # equal rows become one before the scan; the others need no look at each other
    work = rows_of(unseen.where("n = 1")).unionByName(rows_of(unseen.where("n > 1")).dropDuplicates(["blob"]))
    rows = F.array(*[
        F.when(
            F.array_contains("todo", r.name),
            F.struct(F.lit(r.name).alias("rule"), find(F.col("body"), r).alias("spans")),
        )
        for r in rules
    ])
    work.select("blob", F.inline(F.array_compact(rows))).write.mode("append").parquet(ledger)
    place = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    spans = (
        open_ledger(spark, ledger).where(F.col("rule").isin([r.name for r in rules]) & (F.size("spans") > 0))
        .select("blob", F.element_at(place, F.col("rule")).alias("rank"), "spans").dropDuplicates(["blob", "rank"])
        .select("blob", F.transform("spans", lambda s: F.struct(
            s["start"].alias("start"), F.col("rank"), s["end"].alias("end"), F.get(kinds, F.col("rank")).alias("kind")
        )).alias("spans"))
        .groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("found"))
    )
    return versions, spans


def scan(docs: DataFrame, **options) -> DataFrame:
    """(id, blob, found) of every row of ``docs``; options as of :func:`findings`."""
    versions, spans = findings(docs, **options)
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return versions.join(spans, "blob", "left").withColumn("found", F.coalesce("found", none)).select("id", "blob", "found")


def redacted(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with every found span of the text replaced by a mark; a null text stays null."""
    _, spans = findings(docs, text=text, **options)
    blob, found = free_name(docs, "blob"), free_name(docs, "found")
    spans = spans.select(F.col("blob").alias(blob), F.col("found").alias(found))
    joined = docs.join(spans.hint("shuffle_hash"), blob_of(F.col(text)) == F.col(blob), "left")
    clean = F.when(F.col(found).isNull(), F.col(text)).otherwise(redact(F.col(text), F.col(found)))
    return joined.withColumn(text, clean).select(*docs.columns)


def listing(found: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """The text with every found span replaced by ``mark``; overlapping spans become one mark."""
    def step(acc: Column, s: Column) -> Column:
        gap = F.when(
            s["start"] >= acc["at"],
            F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)),
        ).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(
        found, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    )
