"""URL filter: a Bloom filter cascade that is exact over the keys the corpus can ask for.

Level one encodes the listed keys, level two the keys of the corpus that level one takes for
listed by mistake, level three the listed keys that level two takes for mistakes, and so on.
The first level that does not know a key decides it. Since the levels are built over every
key the pages can produce, the answer is exact for each of them, and a page needs no join.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundsman.llm.common import ascii_lower
from roundsman.session import cut_lineage

#: Most listed keys of one cascade. Its filters then take a few MB at most: a listed key
#: costs about 1.44 * log2(keys of the corpus / listed keys) + 6 bits over all levels.
MAX_KEYS = 200_000
#: Hash functions of the levels after the first.
LATER_HASHES = 3


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def _positions(key: Column, level: dict) -> list[Column]:
    return [
        F.pmod(F.xxhash64(key, F.lit(level["seed"]), F.lit(i)), F.lit(level["bits"])) for i in range(level["hashes"])
    ]


def _knows(key: Column, level: dict) -> Column:
    words = F.array(*[F.lit(w) for w in level["words"]])
    hit = [
        F.getbit(F.element_at(words, F.floor(p / 64).cast("int") + 1), (p % 64).cast("int")) == 1
        for p in _positions(key, level)
    ]
    return reduce(lambda a, b: a & b, hit)


def _level(keys: DataFrame, count: int, hashes: int, seed: int) -> dict:
    """Encode ``keys(key)``; what comes to the driver is the filter, of a size set by ``count``."""
    bits = 64 * max(1, math.ceil(count * hashes / math.log(2) / 64))
    level = {"bits": bits, "hashes": hashes, "seed": seed}
    rows = (
        keys.select(F.explode(F.array(*_positions(F.col("key"), level))).alias("p"))
        .groupBy(F.floor(F.col("p") / 64).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 AS int))")).alias("mask"))
        .collect()
    )
    words = [0] * (bits // 64)
    for row in rows:
        words[row.word] = row.mask
    return level | {"words": words}


def build_cascade(universe: DataFrame, max_keys: int = MAX_KEYS) -> list[dict]:
    """Levels for ``universe(key, listed)``, one row per key. Raises beyond ``max_keys`` listed keys."""
    counts = {r.listed: r["count"] for r in universe.groupBy("listed").count().collect()}
    listed, others = counts.get(True, 0), counts.get(False, 0)
    if listed > max_keys:
        raise ValueError(f"{listed} listed keys; a cascade holds {max_keys}: split the list")
    levels: list[dict] = []
    side, other, count = universe.where("listed"), universe.where("not listed"), listed
    while count:
        hashes = LATER_HASHES if levels else min(30, max(1, math.ceil(math.log2(max(2, others / listed)))))
        levels.append(_level(side, count, hashes, len(levels)))
        wrong = cut_lineage(other.where(_knows(F.col("key"), levels[-1])))
        side, other, count = wrong, side, wrong.count()
    return levels


def member(key: Column, levels: list[dict]) -> Column:
    """Exact membership of a key of the universe the levels were built for."""
    answer = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        answer = F.when(~_knows(key, levels[i]), F.lit(i % 2 == 1)).otherwise(answer)
    return answer


def filter_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", max_keys: int = MAX_KEYS
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (columns of these names are replaced).

    ``rules(host, path, verdict)``: hosts in lower case, paths from ``/`` on, verdict allow or
    block. A rule fits its host and all subdomains if the page's path starts with the rule's;
    the longest one (host and path together, then the longer host) decides, and where the same
    key is listed twice, block does. A page that no rule fits is not listed: allow. A null URL
    or one without ``://`` has an empty host and path, which no rule fits.
    """
    listed = rules.select(
        F.concat("host", "path").alias("key"), F.length("host").alias("h"), F.length("path").alias("p"), "verdict"
    )
    shapes = [(r.h, r.p) for r in listed.select("h", "p").distinct().collect()]
    shapes.sort(key=lambda s: (s[0] + s[1], s[0]), reverse=True)
    out = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})

    def candidate(h: int, p: int) -> Column:
        own = F.length("host") == h
        below = (F.length("host") > h) & (F.substring("host", -(h + 1), 1) == ".")
        fits = (own | below) & (F.length("path") >= p)
        return F.when(fits, F.concat(F.substring("host", -h, h), F.substring("path", 1, p)))

    keys = F.array_compact(F.array(*[candidate(h, p) for h, p in shapes])) if shapes else F.array().cast("array<string>")
    universe = cut_lineage(
        out.select(F.explode(keys).alias("key"), F.lit(False).alias("listed"))
        .unionByName(listed.select("key", F.lit(True).alias("listed")))
        .groupBy("key").agg(F.max("listed").alias("listed"))
    )
    known = build_cascade(universe, max_keys)
    verdicts = cut_lineage(listed.groupBy("key").agg(F.max(F.col("verdict") == "block").alias("listed")))
    blocked = build_cascade(verdicts, max_keys)
    rule = F.get(F.filter(keys, lambda k: member(k, known)), F.lit(0))
    out = out.withColumn("rule", rule)
    block = F.col("rule").isNotNull() & member(F.col("rule"), blocked)
    return out.withColumn("verdict", F.when(block, "block").otherwise("allow"))
