"""Demographic queries on the cleaned roster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textlab.functions.text import half_even, n_label, pct_label
from textlab.functions.values import degree_level, sex_label
from textlab.operators.stats import complete_grid, share_of_total, summary_by

# Display order of clubs, sexes, degree levels and inactivity reasons.
CLUB_ORDER = (
    "PiS",
    "KO",
    "PSL",
    "Polska2050",
    "Lewica",
    "Konfederacja",
    "niez.",
    "Razem",
    "Republikanie",
    "Konfederacja_KP",
)
SEX_ORDER = ("Mężczyźni", "Kobiety")
DEGREE_LEVELS = ("prof.", "dr hab.", "dr", "II st.", "I st.", "tyt. zaw.", "wykszt. śr.")
REASON_LEVELS = (
    "Zgon",
    "Utrata prawa wybieralności",
    "Objęcie funkcji w samorządzie",
    "Objęcie funkcji w administracji centralnej",
    "Mandat w Parlamencie Europejskim",
)
SEATS = 460


def position(value: Column, levels) -> Column:
    """Place of a value in a fixed order, null outside it."""
    out = F.when(F.lit(False), F.lit(None).cast("int"))
    for i, level in enumerate(levels, start=1):
        out = out.when(value == level, i)
    return out.otherwise(None)


def active(mp: DataFrame) -> DataFrame:
    return mp.where("czyAktywny")


def active_totals(mp: DataFrame) -> DataFrame:
    return mp.agg(
        F.count_if("czyAktywny").alias("aktywny"),
        F.count_if(~F.col("czyAktywny")).alias("nieaktywny"),
        F.count("*").alias("suma"),
    )


def by_club(mp: DataFrame) -> DataFrame:
    return mp.groupBy("klub").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "klub")


def seat_share(mp: DataFrame, order=CLUB_ORDER, seats: int = SEATS) -> DataFrame:
    n = active(mp).where("klub is not null").groupBy("klub").agg(F.count("*").alias("seats"))
    pct = F.col("seats") / seats
    return n.select(
        "klub", "seats", position(F.col("klub"), order).alias("ord"), pct.alias("pct"),
        pct_label(pct).alias("pct_lab"),
    ).orderBy(F.asc_nulls_last("ord"), "klub")


def inactive_by_reason(mp: DataFrame, reasons=REASON_LEVELS, clubs=None) -> DataFrame:
    """Counts per (reason, club); values outside the given levels become null, and stay."""

    def limited(column: str, levels) -> Column:
        return F.when(F.col(column).isin(*levels), F.col(column)).alias(column)

    rows = mp.where(~F.col("czyAktywny")).select(
        limited("nieaktywnoscKategoria", reasons),
        limited("klub", clubs) if clubs else F.col("klub"),
    )
    return rows.groupBy("nieaktywnoscKategoria", "klub").agg(F.count("*").alias("n"))


def inactive_list(mp: DataFrame, except_reason: str) -> DataFrame:
    return (
        mp.where(~F.col("czyAktywny") & (F.col("nieaktywnoscKategoria") != except_reason))
        .select("imieNazwisko", "klub", "nieaktywnoscKategoria", "nieaktywnoscKomentarz")
        .orderBy("nieaktywnoscKategoria", "imieNazwisko")
    )


def age_summary(mp: DataFrame, keys: list[str] = ()) -> DataFrame:
    return summary_by(active(mp).where("wiek is not null"), list(keys), "wiek")


def at_least(mp: DataFrame, condition: Column, n: int) -> DataFrame:
    return mp.agg((F.count_if(condition) >= n).alias("holds"))


def youngest(mp: DataFrame, n: int = 5) -> DataFrame:
    return (
        active(mp)
        .orderBy(F.asc_nulls_last("wiek"), F.asc_nulls_last("dataUr"), "imieNazwisko")
        .limit(n)
        .select("imieNazwisko", "klub", "dataUr", "wiek")
    )


def club_median_order(mp: DataFrame) -> DataFrame:
    """Clubs by falling median age, with labels and the overall range for the axis.

    Ages are whole years, so the percentile state is bounded; the window is over clubs.
    """
    per_club = (
        active(mp)
        .where("wiek is not null and klub is not null")
        .groupBy("klub")
        .agg(
            F.count("*").alias("n"),
            F.percentile("wiek", 0.5).alias("med"),
            F.min("wiek").alias("_lo"),
            F.max("wiek").alias("_hi"),
        )
    )
    every = Window.partitionBy()
    return per_club.select(
        "klub",
        "n",
        "med",
        half_even(F.col("med")).alias("med_label"),
        n_label(F.col("klub"), F.col("n")).alias("label"),
        F.row_number().over(Window.orderBy(F.desc("med"), "klub")).alias("ord"),
        F.min("_lo").over(every).alias("x_min"),
        F.max("_hi").over(every).alias("x_max"),
    )


def sex_counts(mp: DataFrame, keys: list[str] = ()) -> DataFrame:
    return (
        active(mp)
        .select(*keys, sex_label(F.col("plec")).alias("plec"))
        .where(" and ".join(f"{c} is not null" for c in (*keys, "plec")))
        .groupBy(*keys, "plec")
        .agg(F.count("*").alias("n"))
    )


def sex_share(mp: DataFrame) -> DataFrame:
    counted = share_of_total(sex_counts(mp), "n", "_p")
    return counted.select("plec", "n", pct_label(F.col("_p"), 1).alias("pct")).orderBy(F.desc("n"), "plec")


def sex_seats(mp: DataFrame, seats: int = SEATS) -> DataFrame:
    pct = F.col("n") / seats
    return sex_counts(mp).select(
        F.col("plec").alias("party"),
        F.col("n").alias("seats"),
        position(F.col("plec"), SEX_ORDER).alias("ord"),
        pct.alias("pct"),
        pct_label(pct).alias("pct_lab"),
    )


def women_share(mp: DataFrame, women: str = "Kobiety") -> DataFrame:
    """Share of each sex per club, with the share of women and the club order by it.

    The share of women comes from a window over the (club, sex) counts, so the counts are
    not joined with themselves.
    """
    club = Window.partitionBy("klub")
    counted = sex_counts(mp, ["klub"])
    shares = counted.withColumn("total", F.sum("n").over(club)).withColumn(
        "prop", F.col("n") / F.col("total")
    )
    of_women = F.max(F.when(F.col("plec") == women, F.col("prop"))).over(club)
    out = shares.withColumn("women_share", F.coalesce(of_women, F.lit(0.0)))
    return out.select(
        "klub",
        "plec",
        "n",
        "total",
        "prop",
        "women_share",
        pct_label(F.col("prop")).alias("pct_lab"),
        n_label(F.col("klub"), F.col("total")).alias("label"),
        F.dense_rank().over(Window.orderBy("women_share", "klub")).alias("ord"),
        (F.col("women_share") == 0).alias("no_women"),
    )


def education_counts(mp: DataFrame) -> DataFrame:
    return (
        active(mp)
        .groupBy("wyksztalcenie")
        .agg(F.count("*").alias("liczba"))
        .orderBy(F.desc("liczba"), "wyksztalcenie")
    )


def _levels(mp: DataFrame) -> DataFrame:
    return active(mp).where("klub is not null").select(
        "klub",
        degree_level(F.col("wyksztalcenie"), F.col("najwyzszyStopienNaukowy")).alias("kategoria"),
    )


def degree_bins(mp: DataFrame) -> DataFrame:
    n = _levels(mp).groupBy("kategoria").agg(F.count("*").alias("n"))
    return share_of_total(n, "n", "p").withColumn(
        "ord", position(F.col("kategoria"), tuple(reversed(DEGREE_LEVELS)))
    )


def degree_grid(mp: DataFrame) -> DataFrame:
    """Percentage of each degree level per club on the complete (club, level) grid."""
    n = _levels(mp).groupBy("klub", "kategoria").agg(F.count("*").alias("n"))
    totals = n.groupBy("klub").agg(F.sum("n").alias("total"))
    grid = complete_grid(n, totals.select("klub"), "kategoria", list(DEGREE_LEVELS), {"n": 0})
    pct = F.lit(100.0) * F.col("n") / F.col("total")
    return grid.join(totals, "klub").select(
        "klub",
        "kategoria",
        "n",
        "total",
        pct.alias("pct"),
        F.concat(F.format_string("%.0f", F.bround(pct, 0)), F.lit("%")).alias("label"),
    )


def degree_pivot_order(mp: DataFrame) -> DataFrame:
    """One row per club, a column per level, clubs ordered by all levels descending."""
    wide = degree_grid(mp).groupBy("klub").pivot("kategoria", list(DEGREE_LEVELS)).agg(F.first("pct"))
    order = [F.desc(f"`{level}`") for level in DEGREE_LEVELS]
    return wide.withColumn("ord", F.row_number().over(Window.orderBy(*order, "klub")))


def postgraduate_any(mp: DataFrame) -> DataFrame:
    some = F.col("liczbaStudiowPodyplomowych").cast("int") > 0
    n = active(mp).groupBy(some.alias("ma_podyplomowe")).agg(F.count("*").alias("liczba"))
    label = F.when(
        F.col("ma_podyplomowe"), "Ma jakiekolwiek studia podyplomowe (≥1)"
    ).otherwise("Brak studiów podyplomowych (0)")
    return share_of_total(n, "liczba", "odsetek").select(label.alias("kategoria"), "liczba", "odsetek")


def postgraduate_distribution(mp: DataFrame, levels=tuple(range(7))) -> DataFrame:
    """Counts completed over the levels; other values keep their rows, as a completion does."""
    n = active(mp).groupBy(F.col("liczbaStudiowPodyplomowych").alias("studia")).agg(
        F.count("*").alias("liczba")
    )
    axis = mp.sparkSession.createDataFrame([(x,) for x in levels], "studia int")
    shared = share_of_total(
        axis.join(n, "studia", "full").fillna({"liczba": 0}), "liczba", "odsetek"
    )
    label = F.when(F.col("liczba") == 0, "").otherwise(
        F.concat(F.col("liczba").cast("string"), F.lit(" ("), pct_label(F.col("odsetek"), 1), F.lit(")"))
    )
    return shared.withColumn("label", label)


def postgraduate_heat(mp: DataFrame, levels=tuple(range(7))) -> DataFrame:
    """(club, count) grid with the share inside the club."""
    n = active(mp).where("klub is not null").groupBy(
        "klub", F.col("liczbaStudiowPodyplomowych").alias("studia")
    ).agg(F.count("*").alias("liczba"))
    shared = share_of_total(n, "liczba", "odsetek", ["klub"])
    clubs = n.select("klub").distinct()
    grid = clubs.select("klub", F.explode(F.array(*[F.lit(x) for x in levels])).alias("studia"))
    full = grid.join(shared, ["klub", "studia"], "full").fillna({"liczba": 0, "odsetek": 0.0})
    return full.withColumn(
        "label",
        F.concat(F.col("liczba").cast("string"), F.lit(" ("), pct_label(F.col("odsetek"), 1), F.lit(")")),
    )


def with_default(ids: DataFrame, column: str, mapping: DataFrame, label: str, default: str) -> DataFrame:
    """Distinct ids with their mapped label, or the default."""
    return ids.select(column).distinct().join(mapping, column, "left").withColumn(
        label, F.coalesce(label, F.lit(default))
    )
