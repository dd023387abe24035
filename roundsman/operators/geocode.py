"""Fuzzy matching of parcel addresses against an address table."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from roundsman.functions.text import (
    canonical_address,
    none_if_empty,
    normalize_city,
    normalize_street,
    similarity_from_overlap,
    split_number_street,
    text_or_empty,
    trigram_codes,
    trim_blanks,
)
from roundsman.operators import street_match
from roundsman.session import cut_lineage

# the code travels with the task, so executors need not have this package installed
cloudpickle.register_pickle_by_value(street_match)

# Score parts and limits of the match.
NUMBER_BONUS = 0.15
CITY_BONUS = 0.35
ACCEPT_FROM = 0.72
CANDIDATES = 5
SEARCH_RESULTS = 8

#: Streets of a pool in one block of the comparison.
BLOCK_STREETS = 256

ADDRESS_COLUMNS = ("id", "n", "rep", "r", "rn", "cp", "c", "cn", "lat", "lon")


def prepare_queries(queries: DataFrame) -> DataFrame:
    """Adds the comparable forms ``q_street``, ``q_city``, ``q_number``."""
    return queries.select(
        "*",
        normalize_street(F.col("rue")).alias("q_street"),
        normalize_city(F.col("ville")).alias("q_city"),
        trim_blanks(text_or_empty(F.col("numero"))).alias("q_number"),
    )


def _by_postcode(cp: Column) -> Column:
    return F.concat(F.lit("p:"), cp)


def _by_city(cn: Column) -> Column:
    return F.concat(F.lit("c:"), cn)


def _no_key(rows: DataFrame) -> Column:
    """A key for rows that look nothing up: it matches nothing, but spreads them over all tasks."""
    plain = [f.name for f in rows.schema if isinstance(f.dataType, AtomicType)]
    return F.concat(F.lit("\x00"), F.xxhash64(*plain).cast("string"))


def candidate_pool(queries: DataFrame, addresses: DataFrame) -> DataFrame:
    """Names the pool of addresses each query is compared with, its size, and whether all
    of it lies in one town.

    The pool is the query's postcode; only if no address has it, and a town is
    given, the pool is the town. Pools are named, not spelled out: pairing every
    query with every address of a hot postcode would be quadratic.
    """
    by_cp = addresses.where(F.col("cp").isNotNull()).groupBy(F.col("cp").alias("_post")).agg(
        F.count("*").alias("_n_cp"), (F.min("cn") == F.max("cn")).alias("_one")
    )
    by_cn = addresses.groupBy(F.col("cn").alias("_town")).agg(F.count("*").alias("_n_cn"))
    spread = _no_key(queries)
    tagged = queries.withColumn("_post", F.coalesce(F.col("cp"), spread)).join(by_cp, "_post", "left")
    city = F.col("q_city") if "q_city" in queries.columns else normalize_city(F.col("ville"))
    tagged = tagged.withColumn("q_city", city).withColumn(
        "_town", F.when(F.col("_n_cp").isNull() & (F.col("q_city") != ""), F.col("q_city")).otherwise(spread)
    )
    return tagged.join(by_cn, "_town", "left").select(
        *queries.columns,
        F.when(F.col("_n_cp").isNotNull(), _by_postcode(F.col("cp")))
        .when(F.col("_n_cn").isNotNull(), _by_city(F.col("_town")))
        .alias("pool"),
        F.coalesce("_n_cp", "_n_cn", F.lit(0)).alias("pool_size"),
        # a town pool holds one town by definition
        F.coalesce("_one", F.lit(True)).alias("one_town"),
    )


def score_columns(similarity: Column, q_number: Column, q_city: Column, n: Column, cn: Column) -> Column:
    """Street similarity plus the house-number and town bonuses; not capped."""
    same_number = (q_number != "") & (text_or_empty(n) != "") & (q_number == trim_blanks(text_or_empty(n)))
    same_city = (q_city != "") & (text_or_empty(cn) == q_city)
    return (
        similarity
        + F.when(same_number, F.lit(NUMBER_BONUS)).otherwise(F.lit(0.0))
        + F.when(same_city, F.lit(CITY_BONUS)).otherwise(F.lit(0.0))
    )


def score_candidates(pairs: DataFrame) -> DataFrame:
    """Adds ``score`` to (q_street, q_city, q_number) paired with address columns."""
    coded = pairs.withColumn("grams", trigram_codes(text_or_empty(F.col("rn")))).withColumn(
        "q_grams", trigram_codes(F.col("q_street"))
    )
    return _with_similarity(coded, "rn").select(
        *pairs.columns,
        score_columns(F.col("similarity"), F.col("q_number"), F.col("q_city"), F.col("n"), F.col("cn")).alias("score"),
    )


def _with_similarity(pairs: DataFrame, street: str) -> DataFrame:
    """Adds ``similarity`` of q_street and a street, whose trigram codes are given.

    The shared trigrams are counted in a projection of their own, so once per pair.
    """
    counted = pairs.withColumn("_shared", F.size(F.array_intersect("q_grams", "grams")))
    return counted.withColumn(
        "similarity",
        similarity_from_overlap(
            F.col("q_street"), text_or_empty(F.col(street)), F.size("q_grams"), F.size("grams"), F.col("_shared")
        ),
    ).drop("_shared")


def _facets(number: Column, city: Column) -> Column:
    """The four groups an address belongs to: all, same number, same town, both."""
    return F.array(
        F.lit("*"),
        F.concat(F.lit("n|"), number),
        F.concat(F.lit("c|"), city),
        F.concat(F.lit("b|"), number, F.lit("|"), city),
    )


def _useful_facets(number: Column, city: Column) -> Column:
    """Facets worth looking at. In a pool of one town the town splits nothing: the town
    facets either equal the others or hold no address."""
    few = F.array(F.lit("*"), F.concat(F.lit("n|"), number))
    return F.when(F.col("one_town"), few).otherwise(_facets(number, city))


def _street_shelf(addresses: DataFrame, pools: DataFrame, k: int) -> DataFrame:
    """One row per (pool, facet, street) with its ``k`` lowest-id addresses.

    Addresses outside ``pools`` are dropped first. The rank limit is applied on each
    input partition before the shuffle, so a hot street travels as at most ``k`` rows
    per partition.
    """
    number, city = trim_blanks(text_or_empty(F.col("n"))), text_or_empty(F.col("cn"))
    # joined on the plain columns: joining on the pool would leave a hot pool in one task
    # for the ranking as well, which groups by pool
    postcodes = pools.where(F.col("pool").startswith("p:")).select(F.substr("pool", F.lit(3)).alias("cp"), "one_town")
    towns = pools.where(F.col("pool").startswith("c:")).select(F.substr("pool", F.lit(3)).alias("cn"), "one_town")
    by_cp = addresses.join(postcodes, "cp").select(*ADDRESS_COLUMNS, "one_town", _by_postcode(F.col("cp")).alias("pool"))
    by_cn = addresses.join(towns, "cn").select(*ADDRESS_COLUMNS, "one_town", _by_city(F.col("cn")).alias("pool"))
    faceted = by_cp.unionByName(by_cn).select(
        "pool", F.explode_outer(_useful_facets(number, city)).alias("facet"), text_or_empty(F.col("rn")).alias("street"),
        F.struct(*ADDRESS_COLUMNS).alias("address"),
    )
    w = Window.partitionBy("pool", "facet", "street").orderBy("address.id")
    low = faceted.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)
    return low.groupBy("pool", "facet", "street").agg(F.array_sort(F.collect_list("address")).alias("shelf"))


def _blocks(rows: DataFrame, by: str) -> DataFrame:
    """Rows with ``block``: those of a (pool, facet) in blocks of about ``BLOCK_STREETS``, by a column's hash."""
    n = rows.groupBy("pool", "facet").agg(F.ceil(F.count("*") / BLOCK_STREETS).cast("int").alias("_blocks"))
    return rows.join(n, ["pool", "facet"]).withColumn("block", F.pmod(F.hash(by), F.col("_blocks"))).drop("_blocks")


def best_streets(wanted: DataFrame, shelves: DataFrame, k: int) -> DataFrame:
    """(pool, facet, q_street, street, first_id, similarity, edits): the streets that can be among
    the ``k`` most similar of each query street, with their exact similarity.

    Blocks of query streets meet blocks of streets of their (pool, facet), so a row of the join
    stands for thousands of pairs; ``street_match`` compares them. ``edits`` adds up to the
    number of edit distances worked out.
    """
    asked = _blocks(wanted.select("pool", "facet", "q_street"), "q_street").groupBy("pool", "facet", "block").agg(
        F.collect_list("q_street").alias("queries")
    )
    streets = shelves.select("pool", "facet", "street", F.col("shelf")[0]["id"].alias("first_id"))
    kind = streets.schema["first_id"].dataType.simpleString()
    offered = _blocks(streets, "street").groupBy("pool", "facet", "block").agg(F.collect_list(F.struct("street", "first_id")).alias("s"))
    blocks = asked.drop("block").join(offered.select("pool", "facet", "s"), ["pool", "facet"]).select(
        "pool", "facet", "queries", F.col("s.street").alias("streets"), F.col("s.first_id").alias("first_ids")
    )
    schema = f"pool string, facet string, q_street string, street string, first_id {kind}, similarity double, edits long"
    return blocks.mapInArrow(street_match.best_rows(k, [c.split(" ")[0] for c in schema.split(", ")]), schema)


def _ranked(items: DataFrame, keep: list[str], k: int) -> DataFrame:
    """(keep, items): the first ``k`` addresses of ``items``, an array of struct(minus score, address),
    by score and id. An address, told by its id, can occur several times; its best score counts."""
    ordered = items.select(*keep, F.sort_array("items").alias("items"))
    # copies with one score are neighbours; other repeats of an id are rare and looked for only where ids repeat
    alone = F.filter(
        "items", lambda x, i: (i == 0) | ~F.get("items", i - 1)["address"]["id"].eqNullSafe(x["address"]["id"])
    )
    first = F.filter(
        "items",
        lambda x, i: ~F.exists(F.slice("items", F.lit(1), i), lambda y: y["address"]["id"].eqNullSafe(x["address"]["id"])),
    )
    repeats = F.size(F.array_distinct("items.address.id")) < F.size("items")
    for kept in (alone, first):
        ordered = ordered.select(*keep, F.when(repeats, kept).otherwise(F.col("items")).alias("items"))
    return ordered.select(*keep, F.slice("items", 1, k).alias("items"))


def candidate_lists(queries: DataFrame, addresses: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """(pool, q_street, q_city, q_number, candidates): the ``k`` best addresses of each distinct
    query, best first, exactly, without pairing queries and addresses one by one.

    A score is the street similarity plus bonuses that depend only on whether number
    and town agree. An address in the overall top ``k`` is therefore also in the top
    ``k`` by (similarity, id) of the group that shares its bonuses: all addresses,
    same number, same town, or both. Within a group only distinct streets are
    compared, each standing for its ``k`` lowest ids, and edit distances are worked out only
    where ``best_streets`` finds that they can matter. Equal queries are compared once.
    Both lists, of distinct queries and of streets, are written out once because several
    steps start from them. A group that is still too big for a task is split by AQE's
    skew join. Addresses travel in lists: a group's best streets with their addresses in one
    row, and from there to the query the group's ``k`` best by score.
    """
    asked = cut_lineage(
        queries.select("pool", "one_town", "q_street", "q_city", "q_number").where(F.col("pool").isNotNull()).distinct()
    )
    shelves = cut_lineage(_street_shelf(addresses, asked.select("pool", "one_town").distinct(), k))
    looked_up = asked.select("*", F.explode_outer(_useful_facets(F.col("q_number"), F.col("q_city"))).alias("facet"))
    wanted = looked_up.select("pool", "q_street", "facet").distinct()
    # only names and numbers go through the ranking; the addresses are fetched for its winners
    best = Window.partitionBy("pool", "facet", "q_street").orderBy(F.col("similarity").desc(), "first_id")
    winners = (
        best_streets(wanted, shelves, k)
        .drop("edits")
        .withColumn("_rank", F.row_number().over(best))
        .where(F.col("_rank") <= k)
    )
    offered = (
        winners.join(shelves, ["pool", "facet", "street"])
        .groupBy("pool", "facet", "q_street")
        .agg(F.collect_list(F.struct("similarity", "shelf")).alias("streets"))
    )

    def scored(street: Column) -> Column:
        def item(address: Column) -> Column:
            score = score_columns(street["similarity"], F.col("q_number"), F.col("q_city"), address["n"], address["cn"])
            return F.struct((-score).alias("minus"), address.alias("address"))

        return F.transform(street["shelf"], item)

    key = ["pool", "q_street", "q_city", "q_number"]
    by_facet = looked_up.join(offered, ["pool", "facet", "q_street"]).select(
        *key, F.flatten(F.transform("streets", scored)).alias("items")
    )
    # the same address can come in by several facets, with the same score
    merged = _ranked(by_facet, key, k).groupBy(*key).agg(F.flatten(F.collect_list("items")).alias("items"))
    return _ranked(merged, key, k).select(
        *key, F.transform("items", lambda x: F.struct((-x["minus"]).alias("score"), x["address"].alias("address"))).alias("candidates")
    )


def top_candidates(queries: DataFrame, addresses: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """The lists of ``candidate_lists`` with a row per address: (pool, q_street, q_city, q_number,
    address, score, rank)."""
    lists = candidate_lists(queries, addresses, k)
    rows = lists.select(*[c for c in lists.columns if c != "candidates"], F.posexplode_outer("candidates").alias("pos", "x"))
    return rows.where("x IS NOT NULL").select(
        "pool", "q_street", "q_city", "q_number", "x.address", "x.score", (F.col("pos") + 1).alias("rank")
    )


def match_addresses(
    queries: DataFrame, addresses: DataFrame, k: int = CANDIDATES, threshold: float = ACCEPT_FROM
) -> DataFrame:
    """Queries (rue, cp, ville, numero) with ``candidates``, the up to ``k`` best addresses
    by score, and ``best``, the first one if its score reaches the threshold."""
    pooled = candidate_pool(prepare_queries(queries), addresses)
    key = ["pool", "q_street", "q_city", "q_number"]
    lists = candidate_lists(pooled, addresses, k)
    first = F.get(F.col("candidates"), F.lit(0))
    keyed = pooled.withColumn("pool", F.coalesce(F.col("pool"), _no_key(pooled)))
    return keyed.join(lists, key, "left").select(
        *queries.columns,
        F.when(first["score"] >= threshold, first).alias("best"),
        "candidates",
    )


def geocode_parcels(parcels: DataFrame, addresses: DataFrame) -> DataFrame:
    """Geocode result and the parcel status that follows from it.

    ``parcels`` has ``adresse_raw`` struct(rue, cp, ville).
    """
    split = parcels.withColumn("_s", split_number_street(F.col("adresse_raw.rue")))
    asked = split.select(
        *parcels.columns,
        F.col("_s.rue").alias("rue"),
        F.col("_s.numero").alias("numero"),
        F.col("adresse_raw.cp").alias("cp"),
        F.col("adresse_raw.ville").alias("ville"),
    )
    matched = match_addresses(asked, addresses)
    place = F.col("best.address")
    status = (
        F.when(F.col("best").isNotNull(), F.lit("ok"))
        .when(F.size(F.coalesce("candidates", F.array())) > 0, F.lit("ambigu"))
        .otherwise(F.lit("non_geocode"))
    )
    replaced = {"geocode", "adresse_affichage", "statut"}
    return matched.withColumn("_status", status).select(
        *[c for c in parcels.columns if c not in replaced],
        F.struct(
            F.col("_status").alias("status"),
            place["lat"].alias("lat"),
            place["lon"].alias("lon"),
            F.when(F.col("_status") == "ambigu", F.col("candidates")).alias("candidates"),
        ).alias("geocode"),
        F.when(
            F.col("best").isNotNull(), canonical_address(place["n"], place["rep"], place["r"], place["cp"], place["c"])
        ).alias("adresse_affichage"),
        F.when(F.col("_status") == "ok", F.lit("pret")).otherwise(F.lit("a_verifier")).alias("statut"),
    )


def _haystack() -> Column:
    text = F.concat(
        text_or_empty(F.col("n")), text_or_empty(F.col("rep")), F.lit(" "), text_or_empty(F.col("r")), F.lit(" "),
        text_or_empty(F.col("c")),
    )
    return F.lower(text)


def search_addresses(queries: DataFrame, addresses: DataFrame, k: int = SEARCH_RESULTS) -> DataFrame:
    """Free-text search: a 5-digit postcode is required, every other word must occur.

    A word of three letters or more also has its first three letters occur. Addresses are listed
    under their letter groups as (postcode, group, id) only; a query takes the ids that all
    groups of its words list and fetches those addresses. Queries of shorter words meet the
    whole postcode.
    """
    text = F.coalesce(F.col("query"), F.lit(""))
    cp = none_if_empty(F.regexp_extract(text, r"\b(\d{5})\b", 1))
    # only the first occurrence of the postcode is taken out
    rest = F.lower(trim_blanks(F.regexp_replace(text, r"^(.*?)\b\d{5}\b", "$1")))
    asked = (
        queries.withColumn("cp", cp)
        .where(F.col("cp").isNotNull() & (F.length(text) >= 4))
        .withColumn("terms", F.filter(F.split(rest, r"\s+"), lambda t: t != ""))
    )
    heads = F.array_distinct(F.transform(F.filter("terms", lambda t: F.length(t) >= 3), lambda t: F.substring(t, 1, 3)))
    cells = cut_lineage(asked.select("cp", "terms", heads.alias("grams")).distinct())
    named = addresses.join(cells.select("cp").distinct(), "cp", "left_semi")
    hay = named.select("cp", "id", _haystack().alias("_hay"))
    starts = F.sequence(F.lit(1), F.length("_hay") - 2)
    grams = F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("_hay"), i, F.lit(3))))
    postings = hay.where(F.length("_hay") >= 3).select("cp", "id", F.explode(grams).alias("gram"))
    keyed = cells.where(F.size("grams") > 0).select("*", F.explode("grams").alias("gram"))
    listed = (
        keyed.join(postings, ["cp", "gram"])
        .groupBy("cp", "terms", "id")
        # a row per word group; an id may be listed twice under one
        .agg(F.size(F.collect_set("gram")).alias("_n"), F.first(F.size("grams")).alias("_all"))
        .where(F.col("_n") == F.col("_all"))
        .select("cp", "terms", F.col("id").alias("_id"))
    )
    whole = named.select(*ADDRESS_COLUMNS, _haystack().alias("_hay"))
    by_gram = listed.join(whole.withColumnRenamed("cp", "_cp"), (F.col("cp") == F.col("_cp")) & F.col("_id").eqNullSafe(F.col("id")))
    by_cp = cells.where(F.size("grams") == 0).join(whole, "cp")
    hits = by_gram.select("cp", "terms", *[c for c in whole.columns if c != "cp"]).unionByName(by_cp.drop("grams")).where(
        F.forall("terms", lambda t: F.contains(F.col("_hay"), t))
    )
    w = Window.partitionBy("cp", "terms").orderBy("id")
    top = (
        hits.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .select(
            "cp",
            "terms",
            "rank",
            "id",
            canonical_address(F.col("n"), F.col("rep"), F.col("r"), F.col("cp"), F.col("c")).alias("address"),
        )
    )
    return asked.join(top, ["cp", "terms"]).select(*queries.columns, "rank", "id", "address")


def suggest_cities(prefixes: DataFrame, addresses: DataFrame, k: int = 6) -> DataFrame:
    """First ``k`` distinct towns starting with each typed prefix of two letters or more.

    Each town is listed under all its prefixes once, so the lookup is an equi-join.
    Towns come in the order of their lowest address id.
    """
    asked = prefixes.withColumn("typed", normalize_city(trim_blanks(text_or_empty(F.col("prefix")))))
    asked = asked.where(F.length("typed") >= 2)
    towns = addresses.groupBy("cn").agg(F.min(F.struct("id", "c", "cp")).alias("t"))
    spread = towns.where(F.length("cn") >= 2).select(
        F.explode_outer(F.transform(F.sequence(F.lit(2), F.length("cn")), lambda i: F.substring(F.col("cn"), F.lit(1), i))).alias("typed"),
        F.col("t.id").alias("town_id"), F.col("t.c").alias("c"), F.col("t.cp").alias("town_cp"),
    )
    w = Window.partitionBy("typed").orderBy("town_id")
    top = (
        spread.join(asked.select("typed").distinct(), "typed", "left_semi")
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
    )
    return asked.join(top, "typed").select(*prefixes.columns, "rank", "c", F.col("town_cp").alias("cp"))
