"""DuckDB spellings used by the checking SQL, and assembly of its WITH clause."""

from __future__ import annotations

from roundsman.functions.text import STREET_ABBREVIATIONS
from roundsman.plans.derive import PORTABLE, TABLES, names_in


def street(x: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STREET_ABBREVIATIONS.items())
    words = f"regexp_replace(strip_accents(lower(coalesce({x}, ''))), '[^a-z0-9\\s''-]', ' ', 'g')"
    words = f"string_split(trim(regexp_replace({words}, '\\s+', ' ', 'g')), ' ')"
    return f"array_to_string(list_transform({words}, lambda t: CASE t {cases} ELSE t END), ' ')"


def city(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower(coalesce({x}, ''))), '\\s+', ' ', 'g'))"


def grams(x: str) -> str:
    return f"list_distinct(list_transform(range(1, length({x}) + 2), lambda i: substr('  ' || {x} || ' ', i, 3)))"


def jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"(CAST({both} AS DOUBLE) / (len({a}) + len({b}) - {both}))"


def similarity(a: str, b: str, ga: str, gb: str) -> str:
    edit = f"(CAST(1 AS DOUBLE) - CAST(levenshtein({a}, {b}) AS DOUBLE) / greatest(length({a}), length({b})))"
    half = "CAST(0.5 AS DOUBLE)"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN CAST(0 AS DOUBLE) ELSE {edit} * {half} + {jaccard(ga, gb)} * {half} END"


def score(sim: str) -> str:
    """Score over columns q_number, q_city, n, cn."""
    return (
        f"({sim} + CASE WHEN q_number <> '' AND n <> '' AND q_number = trim(n) THEN CAST(0.15 AS DOUBLE) ELSE 0 END"
        " + CASE WHEN q_city <> '' AND cn = q_city THEN CAST(0.35 AS DOUBLE) ELSE 0 END)"
    )


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (
        f"power(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * power(sin(radians(({lon2}) - ({lon1})) / 2), 2)"
    )
    return f"(asin(sqrt({a})) * 12742000)"


def uri(x: str) -> str:
    out = f"url_encode(coalesce({x}, ''))"
    for escaped, kept in (("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*")):
        out = f"replace({out}, '{escaped}', '{kept}')"
    return out


def form(x: str) -> str:
    return f"replace(replace(replace(url_encode(coalesce({x}, '')), '%20', '+'), '~', '%7E'), '%2A', '*')"


_STREETS = street("r")
_CITIES = city("c")

#: Views whose DuckDB text differs from Spark's.
NATIVE = {
    "address": f"SELECT id, n, rep, r, {_STREETS} AS rn, cp, c, {_CITIES} AS cn, lat, lon FROM {{address_raw}}",
    "lines": """SELECT *, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ordre FROM {lineitem}""",
    "asked": f"SELECT *, {street('rue')} AS q_street, {city('ville')} AS q_city, trim(numero) AS q_number FROM {{query}}",
}


def statement(text: str) -> str:
    """Full DuckDB statement: the views the text needs, in order, then the text."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in ordered:
            return
        for inner in names_in(NATIVE.get(name) or PORTABLE[name]):
            visit(inner)
        ordered.append(name)

    for name in names_in(text):
        visit(name)

    def named(sql: str) -> str:
        names = names_in(sql)
        return sql.format(**{n: n if n in TABLES else f"v_{n}" for n in names})

    views = ",\n".join(f"v_{n} AS ({named(NATIVE.get(n) or PORTABLE[n])})" for n in ordered)
    body = named(text).strip()
    if body.upper().startswith("WITH RECURSIVE"):
        body = body[len("WITH RECURSIVE"):]
        return f"WITH RECURSIVE {views}{',' if views else ''} {body}"
    if body.upper().startswith("WITH"):
        body = body[len("WITH"):]
        return f"WITH {views}{',' if views else ''} {body}"
    return f"WITH {views} {body}" if views else body
