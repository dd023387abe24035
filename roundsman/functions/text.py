"""Column builders for address text: folding, similarity, splitting, joining."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Street-type abbreviations and their full forms.
STREET_ABBREVIATIONS = {
    "av": "avenue",
    "ave": "avenue",
    "bd": "boulevard",
    "bld": "boulevard",
    "boul": "boulevard",
    "pl": "place",
    "che": "chemin",
    "chem": "chemin",
    "rte": "route",
    "imp": "impasse",
    "all": "allee",
    "sq": "square",
    "fg": "faubourg",
    "st": "saint",
    "ste": "sainte",
}

# Fixed value: text shown when a parcel has no usable address.
UNKNOWN_ADDRESS = "(adresse à vérifier)"


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Precomposed letters and the base letter left once U+0300-036F marks go."""
    composed, plain = [], []
    for start, stop in ((0xC0, 0x250), (0x370, 0x530), (0x1E00, 0x2000)):
        for code in range(start, stop):
            letter = chr(code)
            kept = "".join(c for c in unicodedata.normalize("NFD", letter) if not "\u0300" <= c <= "\u036f")
            if kept != letter and len(kept) == 1:
                composed.append(letter)
                plain.append(kept)
    return "".join(composed), "".join(plain)


# Fixed value: every character a text trim removes, beyond the plain blank.
BLANKS = (
    " \t\n\x0b\x0c\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
#: The same set as a regular-expression class.
BLANK = "[" + BLANKS + "]"


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def trim_blanks(col: Column) -> Column:
    return F.trim(col, F.lit(BLANKS))


def none_if_empty(col: Column) -> Column:
    return F.when(col != "", col)


def strip_accents(col: Column) -> Column:
    """Drop combining marks, precomposed or not; ligatures and ß stay."""
    composed, plain = _accent_table()
    return F.regexp_replace(F.translate(col, composed, plain), "[\\u0300-\\u036f]", "")


def _collapse(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, BLANK + "+", " "))


def normalize_street(raw: Column) -> Column:
    """Comparable street name: folded, punctuation dropped, abbreviations expanded."""
    folded = strip_accents(F.lower(text_or_empty(raw)))
    words = F.split(_collapse(F.regexp_replace(folded, r"[^a-z0-9\s'-]", " ")), " ")
    full = F.create_map(*[F.lit(x) for pair in STREET_ABBREVIATIONS.items() for x in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(full, w), w)), " ")


def normalize_city(raw: Column) -> Column:
    """Comparable town name: folded and collapsed; hyphens are significant."""
    return _collapse(strip_accents(F.lower(text_or_empty(raw))))


def trigrams(text: Column) -> Column:
    """Distinct three-letter windows of the text padded by two blanks before, one after."""
    padded = F.concat(F.lit("  "), text, F.lit(" "))
    starts = F.sequence(F.lit(1), F.length(text) + 1)
    return F.array_distinct(F.transform(starts, lambda i: F.substring(padded, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays of distinct values; two empty arrays are alike."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / F.nullif(either, F.lit(0)))


def trigram_codes(text: Column) -> Column:
    """The distinct trigrams of plain ASCII text as whole numbers, which compare faster."""
    padded = F.concat(F.lit("  "), text, F.lit(" "))
    starts = F.sequence(F.lit(1), F.length(text) + 1)

    def code(i: Column) -> Column:
        first, second, third = (F.ascii(F.substring(padded, i + k, F.lit(1))) for k in range(3))
        return first * 16384 + second * 128 + third

    return F.array_distinct(F.transform(starts, code))


def similarity_from_overlap(a: Column, b: Column, n_a: Column, n_b: Column, shared: Column) -> Column:
    """Even mix of edit-distance ratio and trigram overlap, from the counts of distinct and
    shared trigrams; 0 when either text is empty."""
    edit = F.lit(1.0) - F.levenshtein(a, b) / F.nullif(F.greatest(F.length(a), F.length(b)), F.lit(0))
    mixed = edit * 0.5 + shared / (n_a + n_b - shared) * 0.5
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(mixed)


def street_similarity(a: Column, b: Column) -> Column:
    """Similarity of two comparable street names; for joins, count trigrams once per side instead."""
    a, b = text_or_empty(a), text_or_empty(b)

    def shared(grams: Column) -> Column:
        counts = F.struct(
            F.size(grams[0]).alias("a"), F.size(grams[1]).alias("b"), F.size(F.array_intersect(grams[0], grams[1])).alias("both")
        )
        return F.transform(F.array(counts), lambda n: similarity_from_overlap(a, b, n["a"], n["b"], n["both"]))[0]

    # a lambda over a one-element array evaluates its argument once
    return F.transform(F.array(F.array(trigrams(a), trigrams(b))), shared)[0]


def split_number_street(raw: Column) -> Column:
    """House number, leading or trailing, apart from the street: struct(numero, rue)."""
    s = trim_blanks(text_or_empty(raw))
    number = rf"(\d+{BLANK}*(?:bis|ter|quater)?)"
    lead = rf"(?i)^{number}{BLANK}+(.+)$"
    tail = rf"(?i)^(.+?){BLANK}+{number}$"

    def part(pattern: str, group: int) -> Column:
        return trim_blanks(F.regexp_extract(s, pattern, group))

    def pair(number: Column, street: Column) -> Column:
        return F.struct(number.alias("numero"), street.alias("rue"))

    return (
        F.when(s.rlike(lead), pair(part(lead, 1), part(lead, 2)))
        .when(s.rlike(tail), pair(part(tail, 2), part(tail, 1)))
        .otherwise(pair(F.lit(""), s))
    )


def join_number_street(number: Column, street: Column) -> Column:
    n, r = trim_blanks(text_or_empty(number)), trim_blanks(text_or_empty(street))
    return F.when(n == "", r).otherwise(trim_blanks(F.concat(n, F.lit(" "), r)))


def canonical_address(n: Column, rep: Column, r: Column, cp: Column, c: Column) -> Column:
    """Reference spelling of an address: ``{n}{rep} {r}, {cp} {c}``."""
    number = F.when(text_or_empty(n) == "", F.lit("")).otherwise(F.concat(n, text_or_empty(rep), F.lit(" ")))
    return F.concat(number, text_or_empty(r), F.lit(", "), text_or_empty(cp), F.lit(" "), text_or_empty(c))


def display_address(canonical: Column, raw: Column) -> Column:
    """Confirmed address if there is one, else the scanned one, else a fixed notice."""
    rue, cp, ville = (text_or_empty(raw.getField(f)) for f in ("rue", "cp", "ville"))
    scanned = trim_blanks(F.concat(rue, F.lit(", "), cp, F.lit(" "), ville))
    nothing = (rue == "") & (cp == "") & (ville == "")
    return F.coalesce(none_if_empty(canonical), F.when(nothing, F.lit(UNKNOWN_ADDRESS)).otherwise(scanned))


def split_display(address: Column) -> Column:
    """Two display lines cut at the first comma: struct(street, city)."""
    comma = F.locate(",", address)
    street = F.when(comma == 0, address).otherwise(trim_blanks(F.substring_index(address, ",", 1)))
    city = F.when(comma == 0, F.lit("")).otherwise(trim_blanks(F.substring(address, comma + 1, F.length(address))))
    return F.struct(street.alias("street"), city.alias("city"))


def render_template(template: Column, nom: Column, minutes: Column, adresse: Column) -> Column:
    """Fill ``{nom}``, ``{minutes_estimees}`` and ``{adresse}``; unknown values vanish."""
    text = text_or_empty(template)
    for mark, value in (
        ("{nom}", nom),
        ("{minutes_estimees}", minutes.cast("string")),
        ("{adresse}", adresse),
    ):
        text = F.replace(text, F.lit(mark), text_or_empty(value))
    return trim_blanks(F.regexp_replace(text, "[ \t]{2,}", " "))


def matches_text(needle: Column, *fields: Column) -> Column:
    """Case-insensitive containment over the joined fields; a blank needle matches."""
    wanted = F.lower(trim_blanks(text_or_empty(needle)))
    hay = F.lower(F.concat_ws(" ", *[text_or_empty(f) for f in fields]))
    return (wanted == "") | F.contains(hay, wanted)
