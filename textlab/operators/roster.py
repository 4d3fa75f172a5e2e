"""Cleaning of the member roster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textlab.functions.text import canonical_label, strip_space
from textlab.functions.values import (
    ACTIVE,
    POSTGRADUATE,
    UNKNOWN,
    age_at,
    bin_comment,
    bin_reason,
    count_pattern,
    highest_degree,
    normalise_degree,
    term_ordinal,
    to_bool,
)

# Label variants of the same club.
CLUB_LABELS = {
    "Polska2050-TD": "Polska2050",
    "Polska2050_TD": "Polska2050",
    "PSL-TD": "PSL",
    "PSL_TD": "PSL",
}
REFERENCE_DATE = "2026-01-11"

# Columns of the finished roster, in order.
ROSTER_COLUMNS = """
imieNazwisko klub dataUr wiek miejsceUr plec ukonczonaSzkola wyksztalcenie
najwyzszyStopienNaukowy liczbaStudiowPodyplomowych zawod nrOkreguWyborczego okregWyborczy
wojewodztwoOkreguWyborczego liczbaGlosow stazParlamentarny ktoraKadencja czyAktywny
powodNieaktywnosci nieaktywnoscKomentarz nieaktywnoscKategoria
""".split()

# Landed column → roster column.
ROSTER_NAMES = {
    "firstLastName": "imieNazwisko",
    "club": "klub",
    "birthDate": "dataUr",
    "birthLocation": "miejsceUr",
    "profession": "zawod",
    "ukonczona_szkola": "ukonczonaSzkola",
    "educationLevel": "wyksztalcenie",
    "districtNum": "nrOkreguWyborczego",
    "districtName": "okregWyborczy",
    "voivodeship": "wojewodztwoOkreguWyborczego",
    "numberOfVotes": "liczbaGlosow",
    "staz_parlamentarny": "stazParlamentarny",
    "active": "czyAktywny",
    "inactiveCause": "powodNieaktywnosci",
    "waiverDesc": "nieaktywnoscKomentarz",
}


def reshape(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Keep, order and rename columns in one projection."""
    return df.select(*[F.col(old).alias(new) for old, new in names.items()])


def apply_overrides(df: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Replace single cells; ``overrides``: key, column, value (text)."""
    columns = [c for c in df.columns if c != key]
    types = dict(df.dtypes)
    wide = overrides.groupBy(key).agg(
        *[F.max(F.when(F.col("column") == c, F.col("value"))).alias(f"_{c}") for c in columns]
    )
    return df.join(wide, key, "left").select(
        key, *[F.coalesce(F.col(f"_{c}").try_cast(types[c]), F.col(c)).alias(c) for c in columns]
    )


def join_profiles(members: DataFrame, profiles: DataFrame) -> DataFrame:
    """Members with the profile of the same name, if any."""
    return members.join(
        profiles.select(F.col("name").alias("firstLastName"), "staz_parlamentarny", "ukonczona_szkola"),
        "firstLastName",
        "left",
    )


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def inactivity(df: DataFrame) -> DataFrame:
    """Adds reason, comment and final categories of inactive members."""
    active = to_bool(F.col("czyAktywny"))
    comment, finer = bin_comment(F.col("nieaktywnoscKomentarz"))
    reason = bin_reason(F.col("powodNieaktywnosci"))

    def inactive_only(value: Column) -> Column:
        return F.when(~active, value)

    return df.select(
        "*",
        inactive_only(reason).alias("powod_bin"),
        inactive_only(comment).alias("komentarz_bin"),
        inactive_only(finer).alias("komentarz_subbin"),
        F.when(active, ACTIVE).otherwise(F.coalesce(comment, reason, F.lit(UNKNOWN))).alias("nieaktywnosc_bin"),
        inactive_only(finer).alias("nieaktywnosc_subbin"),
    )


def clean_roster(raw: DataFrame, reference_date: str = REFERENCE_DATE) -> DataFrame:
    """Derived roster columns in one narrow projection; the published category is the
    comment category."""
    return (
        inactivity(raw)
        .withColumns(
            {
                "klub": canonical_label(F.col("klub"), CLUB_LABELS),
                "wiek": age_at(F.col("dataUr"), reference_date),
                "najwyzszyStopienNaukowy": normalise_degree(highest_degree(F.col("ukonczonaSzkola"))),
                "liczbaStudiowPodyplomowych": count_pattern(F.col("ukonczonaSzkola"), POSTGRADUATE),
                "ktoraKadencja": term_ordinal(F.col("stazParlamentarny")),
                "czyAktywny": to_bool(F.col("czyAktywny")),
            }
        )
        .withColumnRenamed("komentarz_bin", "nieaktywnoscKategoria")
    )


def raw_roster(members: DataFrame) -> DataFrame:
    """Landed members, joined with their profiles, under the roster's column names."""
    return reshape(members, ROSTER_NAMES)


def published_roster(raw: DataFrame, sexes: DataFrame, key: str, reference_date: str = REFERENCE_DATE) -> DataFrame:
    """The finished roster in its column order; ``sexes``: key, plec."""
    return clean_roster(raw.join(sexes, key, "left"), reference_date).select(*ROSTER_COLUMNS)


def load_roster(df: DataFrame, artefacts: dict[str, str] | None = None) -> DataFrame:
    """Types of the published roster file and repair of a known text artefact."""
    # Fixed value: an education level written as a tuple.
    artefacts = artefacts or {"('średnie ogólne',)": "średnie ogólne"}
    return df.withColumns(
        {
            "dataUr": F.try_to_date(F.col("dataUr").cast("string"), "yyyy-MM-dd"),
            "wyksztalcenie": canonical_label(F.col("wyksztalcenie"), artefacts),
            "czyAktywny": F.col("czyAktywny").try_cast("boolean"),
            "nrOkreguWyborczego": F.col("nrOkreguWyborczego").cast("string"),
        }
    )


def place_lookup(members: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members with cached coordinates, places still to look up).

    Blank places stay without coordinates.
    """
    place = F.nullif(strip_space(F.col("miejsceUr")), F.lit(""))
    places = members.select(place.alias("miejsceUr")).where("miejsceUr is not null").distinct()
    missing = places.join(cache.select("miejsceUr"), "miejsceUr", "left_anti")
    stale = [c for c in ("miejsceUrLan", "miejsceUrLon") if c in members.columns]
    return members.drop(*stale).join(cache, "miejsceUr", "left"), missing


def extend_cache(cache: DataFrame, found: DataFrame) -> DataFrame:
    """Cache plus newly looked-up places, and unresolved ones with null coordinates."""
    return cache.unionByName(found)
