"""Reading the two import files, versions of their contents, and refreshing tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from roundsman.session import cut_lineage

_TEXT = ("n", "rep", "r", "rn", "cp", "c", "cn")

ADDRESS_FILE = T.StructType([
    T.StructField("bbox", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("entries", T.ArrayType(T.StructType(
        [T.StructField(f, T.StringType()) for f in _TEXT]
        + [T.StructField(f, T.DoubleType()) for f in ("lat", "lon")]
    ))),
])

GRAPH_FILE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("nodeCoords", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("edges", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("edgeAdjacency", T.ArrayType(T.ArrayType(T.IntegerType()))),
])


def read_addresses(spark: SparkSession, path: str) -> DataFrame:
    """Address rows of one or many extract files, plain or gzip-compressed JSON.

    Ids follow the file and its entry order: file rank in the high digits, entry number
    in the low ones, so that no global numbering pass is needed.
    """
    docs = spark.read.schema(ADDRESS_FILE).option("multiLine", True).json(path)
    docs = docs.select(F.col("_metadata.file_path").alias("_path"), "entries")
    # one row per file, so the ranking stays small whatever the files hold
    files = docs.select("_path").distinct().select(
        F.col("_path"), (F.row_number().over(W.orderBy("_path")) - 1).cast("long").alias("_file")
    )
    rows = docs.join(files, "_path").select("_file", F.posexplode("entries").alias("_at", "e"))
    return rows.select((F.col("_file") * F.lit(1 << 31) + F.col("_at")).alias("id"), "e.*")


def read_address_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same rows from a line-delimited export, which splits over tasks at any size."""
    entry = ADDRESS_FILE["entries"].dataType.elementType
    schema = T.StructType([T.StructField("id", T.LongType()), *entry.fields])
    return spark.read.schema(schema).json(path)


def write_addresses(df: DataFrame, path: str) -> None:
    """Address table laid out by the leading two postcode digits, the pruning key of a match."""
    df.withColumn("dept", F.substring("cp", 1, 2)).write.mode("overwrite").partitionBy("dept").parquet(path)


def _read_parted(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A table laid out by ``key``, read as text: a postcode's leading zero is no number's."""
    found = spark.read.parquet(path).schema
    fields = [T.StructField(f.name, T.StringType() if f.name == key else f.dataType) for f in found]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def read_address_table(spark: SparkSession, path: str, postcodes: DataFrame | Sequence[str] | None = None) -> DataFrame:
    """Addresses as ``write_addresses`` has laid them out, all or those of some postcodes.

    Only folders of the asked postcodes' leading digits are read: a list becomes a filter on
    the folder, a table ``postcodes(cp)`` a join on it that prunes while the query runs.
    """
    table = _read_parted(spark, path, "dept")
    if postcodes is None:
        return table.drop("dept")
    if isinstance(postcodes, DataFrame):
        codes = postcodes.select("cp").where(F.col("cp").isNotNull()).distinct().withColumn("dept", F.substring("cp", 1, 2))
        return table.join(codes, ["dept", "cp"], "left_semi").drop("dept")
    codes = sorted(set(postcodes))
    return table.where(F.col("dept").isin([c[:2] for c in codes]) & F.col("cp").isin(codes)).drop("dept")


def read_graph(spark: SparkSession, path: str, whole_files: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, turns) of road graph files; coordinates and weights rounded to 32 bits.

    Each document is one region, named by its ``name`` field or else by its file; numbers
    count inside the region. ``whole_files`` reads one document per file, otherwise one
    per line, which splits over tasks.
    """
    doc = spark.read.schema(GRAPH_FILE).option("multiLine", whole_files).json(path)
    doc = doc.withColumn("region", F.coalesce("name", F.input_file_name()))
    nodes = doc.select("region", F.posexplode("nodeCoords").alias("node", "x")).select(
        "region", "node", F.col("x")[0].cast("float").alias("lat"), F.col("x")[1].cast("float").alias("lon")
    )
    edges = doc.select("region", F.posexplode("edges").alias("e", "x")).select(
        "region", "e", F.col("x")[0].cast("int").alias("u"), F.col("x")[1].cast("int").alias("v"),
        F.col("x")[2].cast("float").alias("w"),
    )
    turns = doc.select("region", F.posexplode("edgeAdjacency").alias("e", "next")).select(
        "region", "e", F.explode("next").alias("f")
    )
    return nodes, edges, turns


def dataset_meta(df: DataFrame) -> DataFrame:
    """Row count and bounding box of a table with ``lat`` and ``lon``."""
    return df.agg(
        F.count("*").alias("n"), F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
        F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"),
    )


def version_of(content: Column) -> Column:
    """First 16 hexadecimal digits of the content's SHA-1."""
    return F.substring(F.sha1(content), 1, 16)


def content_version(spark: SparkSession, path: str) -> DataFrame:
    """(name, version, path) of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), version_of(F.col("content")).alias("version"), "path")


def stale_datasets(target: DataFrame | None, current: DataFrame, names: DataFrame) -> DataFrame:
    """(name, stale): what an import has to load again.

    ``names(name, optional)`` lists the datasets. Without a target manifest everything
    but the optional ones is stale; an optional dataset the manifest does not version
    counts as up to date.
    """
    if target is None:
        target = names.select("name", F.lit(None).cast("string").alias("version")).where(F.lit(False))
    wanted = target.select("name", F.col("version").alias("_t"))
    held = current.select("name", F.col("version").alias("_c"), F.lit(True).alias("_has"))
    same = F.coalesce(F.col("_t") == F.col("_c"), F.lit(False)) & F.coalesce("_has", F.lit(False))
    unversioned = F.coalesce(F.col("_t"), F.lit("")) == ""
    fresh = same | (F.col("optional") & unversioned)
    return names.join(wanted, "name", "left").join(held, "name", "left").select("name", (~fresh).alias("stale"))


def overwrite_table(df: DataFrame, path: str) -> None:
    """Full refresh: the new rows replace whatever the table held."""
    df.write.mode("overwrite").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def folder_name(path: Column) -> Column:
    """Dataset of a file: the value in the name of the folder it is in (``cp=54000`` gives 54000)."""
    folder = F.element_at(F.split(path, "/"), -2)
    return F.element_at(F.split(folder, "="), -1)


def refresh(
    spark: SparkSession, source: str, table: str, manifest: str, parse: Callable[[DataFrame], DataFrame],
    dataset: Callable[[Column], Column] = folder_name,
) -> DataFrame:
    """Bring ``table`` up to date with the text files below ``source``: (name, version, stale).

    A dataset is one or more files. The manifest holds the version of every dataset as last
    loaded; only datasets with another version are read, by ``parse`` over (value, name), and
    only their folders of the table are replaced. Rows carry the number of the ``load`` that
    wrote them. The table is written ahead of the manifest, so a refresh that broke off is
    done again by the next one. Datasets whose files are gone leave the manifest and with it
    what ``read_refreshed`` returns.
    """
    versions = content_version(spark, source).groupBy(dataset(F.col("path")).alias("name")).agg(
        version_of(F.array_join(F.array_sort(F.collect_list("version")), ",")).alias("version"), F.collect_list("path").alias("paths")
    )
    versions = cut_lineage(versions)
    held = _held(spark, manifest)
    number = 1 if held is None else (held.agg(F.max("load")).first()[0] or 0) + 1
    current = versions.select("name", "version").where(F.lit(False)) if held is None else held.select("name", "version")
    names = versions.select("name", F.lit(False).alias("optional"))
    state = cut_lineage(stale_datasets(versions.select("name", "version"), current, names).join(versions, "name"))
    # file names, as many as the listing of the folder itself holds
    paths = [r.path for r in state.where("stale").select(F.explode("paths").alias("path")).collect()]
    if paths:
        lines = spark.read.text(paths).select("value", dataset(F.col("_metadata.file_path")).alias("name"))
        parse(lines).withColumn("load", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "name"
        ).parquet(table)
    listed = state.select("name", "version", F.lit(number).alias("load"))
    listed.write.parquet(f"{manifest}/number={number}")
    return state.select("name", "version", "stale")


def _held(spark: SparkSession, manifest: str) -> DataFrame | None:
    """The newest manifest, if there is one."""
    if not _exists(spark, manifest):
        return None
    every = spark.read.parquet(manifest)
    newest = every.agg(F.max("number")).first()[0]
    return every.where(F.col("number") == newest)


def read_refreshed(spark: SparkSession, table: str, manifest: str) -> DataFrame:
    """The table's rows of all datasets the manifest lists."""
    held = _held(spark, manifest).select("name")
    return _read_parted(spark, table, "name").join(held.withColumn("name", F.col("name").cast("string")), "name", "left_semi")
