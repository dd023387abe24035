"""Column builders that turn the text read from a parcel label into fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roundsman.functions.text import BLANK, none_if_empty, text_or_empty, trim_blanks

# Markers and line shapes of the label layout.
ANCHOR = f"(?i)SHIP{BLANK}*TO{BLANK}*:?"
TRACKING = f"1Z{BLANK}?[0-9A-Z]{{6}}{BLANK}?[0-9A-Z]{{2}}{BLANK}?\\d{{4}}{BLANK}?\\d{{4}}"
TOWN_LINE = f"^(\\d{{5}}){BLANK}+([A-ZÀ-Ü'\\- ]+)$"
REFERENCE_PHONE = f"(?i)Ref\\.?{BLANK}*1{BLANK}*:?{BLANK}*TEL{BLANK}*(0\\d{{9}})"
PHONE_MARK = "(?i)TEL|PHONE|GSM"

# Words that make a line a street line, wherever they occur in it.
STREET_WORDS = (
    "RUE", "AVENUE", "AV", "BD", "BOULEVARD", "ROUTE", "CHEMIN", "IMPASSE",
    "ALLEE", "ALLÉE", "ZONE", "ZI", "ZAC", "LIEU-DIT", "LIEU DIT", "HAMEAU",
    "LOTISSEMENT", "RESIDENCE", "RÉSIDENCE", "PLACE", "COURS", "QUAI", "VOIE",
    "TER", "BIS", "FAUBOURG",
)

# Confidence words.
SURE, FAIR, UNSURE = "haute", "moyenne", "a_verifier"

#: Words shown to a person for each line role.
ROLE_WORDS = {"name": "nom", "street": "rue", "phone": "téléphone"}


def _first_true(flags: Column) -> Column:
    return F.array_position(flags, F.lit(True)).cast("int")


def _digits(line: Column) -> Column:
    return F.regexp_replace(line, r"\D", "")


def label_lines(text: Column) -> Column:
    """Non-empty trimmed lines."""
    lines = F.split(F.replace(text_or_empty(text), F.lit("\r"), F.lit("")), "\n")
    return F.filter(F.transform(lines, trim_blanks), lambda line: line != "")


def after_anchor(lines: Column) -> Column:
    """Lines that follow the recipient marker; all lines when there is none."""
    at = _first_true(F.transform(lines, lambda line: line.rlike(ANCHOR)))
    marked = F.get(lines, at - 1)
    rest = trim_blanks(F.regexp_replace(marked, "^(.*?)" + ANCHOR, "$1"))
    following = F.slice(lines, at + 1, F.size(lines))
    joined = F.when(rest != "", F.concat(F.array(rest), following)).otherwise(following)
    return F.when(at == 0, lines).otherwise(joined)


def through_town(block: Column) -> Column:
    """The block up to and including its first postcode-and-town line."""
    at = _first_true(F.transform(block, lambda line: line.rlike(TOWN_LINE)))
    return F.when(at == 0, block).otherwise(F.slice(block, F.lit(1), at))


def ship_block(lines: Column) -> Column:
    return through_town(after_anchor(lines))


def tracking(text: Column) -> Column:
    """First tracking number anywhere in the text, blanks removed; null when none."""
    found = F.regexp_extract(F.replace(text_or_empty(text), F.lit("\r"), F.lit("")), f"({TRACKING})", 1)
    return none_if_empty(F.regexp_replace(found, BLANK, ""))


def line_role(line: Column) -> Column:
    """town, skipped, phone, street or name."""
    count = F.length(_digits(line))
    worded = F.upper(line).rlike("|".join(STREET_WORDS))
    return (
        F.when(line.rlike(TOWN_LINE), F.lit("town"))
        .when(line.rlike("(?i)^FRANCE$") | line.rlike(TRACKING), F.lit("skipped"))
        .when(count.between(9, 14), F.lit("phone"))
        .when(line.rlike(r"^\d") | worded, F.lit("street"))
        .otherwise(F.lit("name"))
    )


def classify_lines(block: Column) -> Column:
    return F.transform(block, lambda line: F.struct(line.alias("line"), line_role(line).alias("role")))


def phone(line: Column) -> Column:
    """Last nine digits behind a 0, with the confidence its shape deserves."""
    digits = _digits(line)
    plain = (F.length(digits) == 10) & digits.rlike("^0[1-9]")
    marked = line.rlike(PHONE_MARK) | line.rlike(r"^\+|^00") | plain
    return F.struct(
        F.when(F.length(digits) >= 9, F.concat(F.lit("0"), F.right(digits, F.lit(9)))).alias("phone"),
        F.when(marked, F.lit(SURE)).otherwise(F.lit(FAIR)).alias("confidence"),
    )


def lines_with_role(classified: Column, role: str) -> Column:
    return F.transform(F.filter(classified, lambda x: x["role"] == role), lambda x: x["line"])


def best_phone(phones: Column) -> Column:
    """First phone with high confidence, else the first one."""
    return F.coalesce(F.get(F.filter(phones, lambda p: p["confidence"] == SURE), F.lit(0)), F.get(phones, F.lit(0)))


def phone_confidence(chosen: Column, text: Column) -> Column:
    """Confidence of the chosen phone after a cross-check with the reference line."""
    ref = F.regexp_extract(F.replace(text_or_empty(text), F.lit("\r"), F.lit("")), REFERENCE_PHONE, 1)
    sure = (chosen["confidence"] == SURE) | (chosen["phone"] == ref)
    return F.when(F.coalesce(sure, F.lit(False)), F.lit(SURE)).otherwise(F.lit(UNSURE))


def role_word(line: Column, role: Column, cp: Column) -> Column:
    """Role of a kept line in words; a line holding the postcode counts as the town line."""
    shown = F.lit(None).cast("string")
    for key, word in ROLE_WORDS.items():
        shown = F.when(role == key, F.lit(word)).otherwise(shown)
    holds = F.coalesce(F.contains(line, cp), F.lit(False))
    return F.coalesce(shown, F.when(holds, F.lit("cp+ville")).otherwise(F.lit("(ignorée)")))
