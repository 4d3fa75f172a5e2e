"""Tolerant value coercions and rule-list categories for landed records."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

from textlab.functions.text import collapse_ws, strip_space

# Texts read as true.
TRUE_TEXTS = ("true", "1", "t", "yes", "y")


@lru_cache(maxsize=None)
def _digits() -> tuple[str, str]:
    """The decimal digits of all scripts beyond ASCII, and what they stand for."""
    found = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
    return "".join(found), "".join(str(unicodedata.digit(c)) for c in found)


def safe_int(value: Column) -> Column:
    """Integers as they are, text of digits (of any script) as a number, anything else null."""
    text = strip_space(value.cast("string"))
    scripts, ascii_digits = _digits()
    # The type is known when the query is planned, so only one branch is left to run.
    return F.when(F.typeof(value).isin("tinyint", "smallint", "int", "bigint"), value.try_cast("bigint")).when(
        # Tested before the cast: a failing cast raises and catches inside the JVM, row by row.
        text.rlike("^[0-9]+\\z"), text.try_cast("bigint")
    ).when(text.rlike("^(?U)\\d+\\z"), F.translate(text, scripts, ascii_digits).try_cast("bigint"))


def first_truthy(*values: Column) -> Column:
    """First value that is neither null nor blank text."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def to_bool(value: Column) -> Column:
    return F.coalesce(F.lower(strip_space(value.cast("string"))).isin(*TRUE_TEXTS), F.lit(False))


_DATE = r"^(?U)\d{4}-\d{2}-\d{2}\z"
WALK_DEPTH = 6


def _members(value: Column) -> Column:
    """What an array or object holds; nothing for single values."""
    none = F.array().cast("array<variant>")
    listed = F.try_variant_get(value, "$", "array<variant>")
    return F.coalesce(listed, F.map_values(F.try_variant_get(value, "$", "map<string,variant>")), none)


def walk_dates(level: Column, depth: int = WALK_DEPTH) -> Column:
    """struct of level and found, from an array of parsed values: the date strings among them and
    ``depth`` levels below, and the values beneath those levels."""

    def step(s: Column, _: Column) -> Column:
        # A date is a string; an object's or array's own text never is one.
        texts = F.transform(s["level"], lambda v: F.try_variant_get(v, "$", "string"))
        below = F.flatten(F.transform(s["level"], _members))
        walked = F.struct(below.alias("level"), F.array_union(s["found"], F.filter(texts, lambda t: t.rlike(_DATE))).alias("found"))
        return F.when(F.size(s["level"]) > 0, walked).otherwise(s)

    start = F.struct(level.alias("level"), F.array().cast("array<string>").alias("found"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(depth)), start, step)


def age_at(birth: Column, reference: str) -> Column:
    """Completed years at the reference date; unreadable dates give null."""
    born = F.try_to_date(birth.cast("string"), "yyyy-MM-dd")
    ref = F.to_date(F.lit(reference))
    later = (F.month(born) * 100 + F.dayofmonth(born)) > (F.month(ref) * 100 + F.dayofmonth(ref))
    return F.year(ref) - F.year(born) - later.cast("int")


# Degree patterns, first match wins; None keeps the whole matched phrase.
DEGREES = (
    ("profesor", None),
    ("doktor", None),
    (r"magister\s+inżynier", "magister inżynier"),
    ("magister", "magister"),
    ("lekarz", None),
    ("inżynier", "inżynier"),
    ("licencjat", "licencjat"),
)


def highest_degree(schools: Column, degrees=DEGREES) -> Column:
    """Highest degree named after a dash.

    The test ignores case but the phrase is cut out case-sensitively, so a capitalised
    phrase is recognised and still gives null.
    """
    text = F.coalesce(schools, F.lit(""))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for stem, label in degrees:
        phrase = F.nullif(
            F.regexp_extract(text, rf"(?U)-\s*({stem}[^,;()]*)\s*(?:[(,;]|$)", 1), F.lit("")
        )
        out = out.when(
            text.rlike(rf"(?iuU)-\s*{stem}"), F.lit(label) if label else phrase
        )
    return collapse_ws(out.otherwise(None))


def normalise_degree(degree: Column) -> Column:
    short = F.regexp_replace(degree, r"^profesor.*$", "profesor")
    return F.regexp_replace(
        short, r"(?U)^doktor\s*-\s*samodzielny\s+pracownik\s+naukowy$", "doktor"
    )


def count_pattern(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern))


POSTGRADUATE = r"(?iuU)studia\s+podyplomowe"


def term_ordinal(tenure: Column) -> Column:
    """One plus the Roman numerals named in the first term segment (or in the whole text)."""
    text = strip_space(F.coalesce(tenure, F.lit("")))
    segment = F.nullif(F.regexp_extract(text, r"(?iuU)Sejm RP\s+(.+?)\s+kadencji", 1), F.lit(""))
    romans = F.regexp_count(
        F.coalesce(segment, text), F.lit(r"(?U)\b(?:I|II|III|IV|V|VI|VII|VIII|IX|X)\b")
    )
    return F.when(F.lower(text) == "brak", 1).otherwise(romans + 1)


# Ordered comment rules (pattern, bin, finer bin).
COMMENT_RULES = (
    (
        r"\bparlamentu europejskiego\b|mandat posła do parlamentu europejskiego",
        "Mandat w Parlamencie Europejskim",
        "Parlament Europejski",
    ),
    (
        r"utrata prawa wybieralno",
        "Utrata prawa wybieralności",
        "Utrata prawa wybieralności",
    ),
    (r"\bzmarł\b|\bzmarla\b|\bzmarła\b|\bzgon\b", "Zgon", "Zgon"),
    (
        r"prezydenta miasta|burmistrza|wójta|wojta|marszałka województwa|marszalka wojewodztwa",
        "Objęcie funkcji w samorządzie",
        "Samorząd",
    ),
    (
        r"kancelarii prezydenta rp|gabinetu prezydenta rp|szefa kancelarii prezydenta rp|kancelarii prezydenta",
        "Objęcie funkcji w administracji centralnej",
        "Kancelaria Prezydenta RP",
    ),
    (r"sekretarza stanu", "Objęcie funkcji w administracji centralnej", "Sekretarz stanu"),
    (r"narodowego banku polskiego|\bnbp\b", "Objęcie funkcji w administracji centralnej", "NBP"),
)
# Labels where no rule applies.
OTHER_COMMENT = "Inne (z komentarza)"
OTHER_REASON = "Inne (z powodu)"
ACTIVE, UNKNOWN = "Aktywny", "Nieznane"


def bin_comment(comment: Column, rules=COMMENT_RULES, other: str = OTHER_COMMENT) -> tuple[Column, Column]:
    """(bin, finer bin) by the first matching rule; blank gives nulls."""
    text = F.lower(strip_space(F.coalesce(comment, F.lit(""))))

    def pick(which: int) -> Column:
        out = F.when(text == "", F.lit(None).cast("string"))
        for rule in rules:
            out = out.when(text.rlike(f"(?iuU){rule[0]}"), rule[which])
        return out.otherwise(other)

    return pick(1), pick(2)


def bin_reason(reason: Column) -> Column:
    # Stems and labels.
    text = F.lower(strip_space(F.coalesce(reason, F.lit(""))))
    return (
        F.when(text == "", F.lit(None).cast("string"))
        .when(F.contains(text, F.lit("zgon")), "Zgon")
        .when(F.contains(text, F.lit("zrzeczenie")), "Zrzeczenie się mandatu")
        .otherwise(OTHER_REASON)
    )


def degree_level(education: Column, degree: Column, higher: str = "wyższe") -> Column:
    """Short label of the degree level, for any education."""
    # Degrees and labels.
    return (
        F.when(education.isNull() | (education != higher), "wykszt. śr.")
        .when(degree == "profesor", "prof.")
        .when(degree == "doktor habilitowany", "dr hab.")
        .when(degree == "doktor", "dr")
        .when(degree.isin("magister", "magister inżynier"), "II st.")
        .when(degree.isin("licencjat", "inżynier"), "I st.")
        .otherwise("tyt. zaw.")
    )


def sex_label(code: Column) -> Column:
    # Codes and labels.
    return (
        F.when(code.isin("M", "mężczyzna", "Mężczyzna", "Mezczyzna"), "Mężczyźni")
        .when(code.isin("K", "kobieta", "Kobieta"), "Kobiety")
    )
