"""Inflected variants of personal names, used to drop names from term statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textlab.functions.text import ascii_fold
from textlab.functions.words import CASE_SUFFIXES, EXTRA_NAMES, SURNAME_FORMS


def name_parts(names: DataFrame, column: str) -> DataFrame:
    """Distinct lower-cased parts (longer than two characters) of full names."""
    parts = F.split(F.regexp_replace(F.lower(column), "[-,]", " "), r"(?U)\s+")
    return (
        names.select(F.explode(parts).alias("part")).where(F.length("part") > 2).distinct()
    )


def _bases(part: Column) -> Column:
    stem = F.substr(part, F.lit(1), F.length(part) - 2)
    ends_el = part.endswith("eł")
    return F.array_distinct(
        F.array_compact(
            F.array(
                part,
                ascii_fold(part),
                F.replace(part, F.lit("ł"), F.lit("l")),
                F.when(ends_el, F.concat(stem, F.lit("ł"))),
                F.when(ends_el, F.concat(stem, F.lit("l"))),
            )
        )
    )


def _forms(base: Column) -> Column:
    """Case endings on the bare form, plus the gendered forms of adjectival surnames."""
    stem = F.substr(base, F.lit(1), F.length(base) - 3)
    surname = F.when(F.lit(False), F.array().cast("array<string>"))
    for ending, forms in SURNAME_FORMS.items():
        surname = surname.when(
            base.endswith(ending), F.array(*[F.concat(stem, F.lit(f)) for f in forms])
        )
    cases = F.array(*[F.concat(base, F.lit(s)) for s in CASE_SUFFIXES])
    return F.concat(cases, surname.otherwise(F.array().cast("array<string>")))


def name_variants(*sources: tuple[DataFrame, str], extra=EXTRA_NAMES) -> DataFrame:
    """One distinct ``name`` per variant, closed under accent folding.

    Narrow per name part; the one shuffle is the final distinct.
    """
    parts = None
    for df, column in sources:
        found = name_parts(df, column)
        parts = found if parts is None else parts.unionByName(found)
    spark = parts.sparkSession
    variants = parts.select(F.explode(_bases(F.col("part"))).alias("base")).select(
        F.explode(_forms(F.col("base"))).alias("name")
    )
    if extra:
        variants = variants.unionByName(
            spark.createDataFrame([(n,) for n in extra], "name string")
        )
    both = F.array_distinct(F.array(F.col("name"), ascii_fold(F.col("name"))))
    return variants.select(F.explode(both).alias("name")).distinct()
