"""Roster cleaning and demographic queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlab.functions import values as V
from textlab.operators import extras as K, roster as H, roster_report as I, rows as W, stats as S
from textlab.plans.oracle import pct_sql, quoted, sql
from textlab.plans.registry import Registry, rounded
from textlab.plans.tables import Tables

Q = Registry()

# Levels that the queries order clubs by.
CLUBS = ("BUILDING", "FURNITURE", "PSL", "HOUSEHOLD", "MACHINERY")
PE = "Mandat w Parlamencie Europejskim"

# --- cleaning ---------------------------------------------------------------------------


def _overrides(t: Tables):
    """Corrections drawn from the orders: the priority replaces a segment, the total a balance."""
    newest = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("o_orderpriority").alias("p"), F.max("o_totalprice").alias("v")
    )
    cells = F.array(
        F.struct(F.lit("c_mktsegment").alias("column"), F.col("p").alias("value")),
        F.struct(F.lit("c_acctbal").alias("column"), F.col("v").cast("string").alias("value")),
    )
    return newest.select("c_custkey", F.inline(cells))


@Q.add(
    "apply_overrides",
    """SELECT c_custkey, c_name, c_nationkey, round(coalesce(v, c_acctbal), 8) AS c_acctbal,
  coalesce(p, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS p,
  max(o_totalprice) AS v FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
)
def apply_overrides(t: Tables):
    return rounded(H.apply_overrides(t.customer, _overrides(t), "c_custkey"))


@Q.add(
    "attach_ordered",
    """SELECT c_custkey, c_name, supplier_name FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS r FROM customer)
JOIN (SELECT s_name AS supplier_name, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier) USING (r)""",
)
def attach_ordered(t: Tables):
    return W.attach_by_position(
        t.customer.select("c_custkey", "c_name"), "c_custkey", t.supplier, "s_suppkey", "s_name", "supplier_name"
    )


@Q.add(
    "reshape_columns",
    'SELECT n_name AS nazwa, n_nationkey AS id, count(c_custkey) AS "liczbaCzlonkow" FROM nation'
    " LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2",
)
def reshape_columns(t: Tables):
    sizes = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    clubs = t.nation.join(sizes, F.col("c_nationkey") == F.col("n_nationkey"), "left").withColumn(
        "membersCount", F.coalesce("n", F.lit(0)).cast("bigint")
    )
    names = {"n_name": "nazwa", "n_nationkey": "id", "membersCount": "liczbaCzlonkow"}
    return H.reshape(clubs, names).orderBy(F.desc("liczbaCzlonkow"), "id")


@Q.add(
    "key_symdiff",
    """SELECT coalesce(a, b) AS key, CASE WHEN a IS NULL THEN 'right' ELSE 'left' END AS side FROM
  (SELECT DISTINCT o_custkey AS a FROM orders) FULL JOIN (SELECT c_custkey AS b FROM customer WHERE c_acctbal > 1000) ON a = b
WHERE a IS NULL OR b IS NULL""",
)
def key_symdiff(t: Tables):
    return W.key_difference(
        t.orders.select(F.col("o_custkey").alias("key")),
        t.customer.where("c_acctbal > 1000").select(F.col("c_custkey").alias("key")),
        "key",
    )


@Q.add(
    "label_count", "SELECT count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS n, count(*) AS total FROM customer"
)
def label_count(t: Tables):
    return t.customer.agg(
        F.count_if(F.col("c_mktsegment") == "BUILDING").alias("n"), F.count("*").alias("total")
    )


@Q.add(
    "roster_join",
    """SELECT c_name AS "firstLastName", c_custkey AS id, 'tenure ' || CAST(o_orderkey AS VARCHAR) AS staz_parlamentarny,
  o_orderpriority AS ukonczona_szkola FROM customer LEFT JOIN orders
  ON c_name = 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AND o_orderstatus = 'F'""",
)
def roster_join(t: Tables):
    """Members and profiles meet on the name alone; a repeated name repeats the member."""
    profiles = t.orders.where("o_orderstatus = 'F'").select(
        F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("name"),
        F.concat(F.lit("tenure "), F.col("o_orderkey").cast("string")).alias("staz_parlamentarny"),
        F.col("o_orderpriority").alias("ukonczona_szkola"),
    )
    members = t.customer.select(F.col("c_name").alias("firstLastName"), F.col("c_custkey").alias("id"))
    return H.join_profiles(members, profiles)


@Q.add(
    "roster_duplicates",
    "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1",
)
def roster_duplicates(t: Tables):
    return H.duplicate_keys(t.orders, "o_custkey")


_NULLABLE = ("klub", "dataUr", "plec", "ukonczonaSzkola", "wyksztalcenie", "najwyzszyStopienNaukowy", "zawod")


@Q.add(
    "null_profile",
    sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(\"{c}\") AS filled, count(*) - count(\"{c}\") AS missing FROM mp"
            for c in _NULLABLE
        ),
        "mp",
    ),
)
def null_profile(t: Tables):
    return S.null_profile(t.roster, list(_NULLABLE))


@Q.add(
    "degree_extract",
    sql('SELECT id, CASE WHEN id IS NOT NULL THEN "deg0" END AS degree FROM (SELECT mp.id, d AS "deg0" FROM mp JOIN'
        " (SELECT id, trim(regexp_replace(CASE"
        " WHEN regexp_matches(s, '(?i)-\\s*profesor') THEN nullif(regexp_extract(s, '-\\s*(profesor[^,;()]*)', 1), '')"
        " WHEN regexp_matches(s, '(?i)-\\s*doktor') THEN nullif(regexp_extract(s, '-\\s*(doktor[^,;()]*)', 1), '')"
        " WHEN regexp_matches(s, '(?i)-\\s*magister\\s+inżynier') THEN 'magister inżynier'"
        " WHEN regexp_matches(s, '(?i)-\\s*magister') THEN 'magister'"
        " WHEN regexp_matches(s, '(?i)-\\s*lekarz') THEN nullif(regexp_extract(s, '-\\s*(lekarz[^,;()]*)', 1), '')"
        " WHEN regexp_matches(s, '(?i)-\\s*inżynier') THEN 'inżynier'"
        " WHEN regexp_matches(s, '(?i)-\\s*licencjat') THEN 'licencjat' END, '\\s+', ' ', 'g')) AS d"
        " FROM (SELECT id, coalesce(\"ukonczonaSzkola\", '') AS s FROM mp)) USING (id))", "mp"),
)
def degree_extract(t: Tables):
    return t.raw_roster.select("id", V.highest_degree(F.col("ukonczonaSzkola")).alias("degree"))


@Q.add("degree_normalise", sql('SELECT id, "najwyzszyStopienNaukowy" AS degree FROM mp', "mp"))
def degree_normalise(t: Tables):
    degree = V.normalise_degree(V.highest_degree(F.col("ukonczonaSzkola")))
    return t.raw_roster.select("id", degree.alias("degree"))


@Q.add("count_pattern", sql('SELECT id, "liczbaStudiowPodyplomowych" AS n FROM mp', "mp"))
def count_pattern(t: Tables):
    return t.raw_roster.select("id", V.count_pattern(F.col("ukonczonaSzkola"), V.POSTGRADUATE).alias("n"))


@Q.add("value_counts", sql('SELECT "najwyzszyStopienNaukowy", count(*) AS n FROM mp GROUP BY 1', "mp"))
def value_counts(t: Tables):
    return S.value_counts(t.roster, "najwyzszyStopienNaukowy")


@Q.add(
    "describe",
    " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count({c}) AS n, round(avg({c}), 2) AS mean, round(stddev_samp({c}), 2) AS sd,"
        f" round(min({c}::DOUBLE), 2) AS min, round(quantile_cont({c}::DOUBLE, 0.25), 2) AS p25,"
        f" round(quantile_cont({c}::DOUBLE, 0.5), 2) AS p50, round(quantile_cont({c}::DOUBLE, 0.75), 2) AS p75,"
        f" round(max({c}::DOUBLE), 2) AS max FROM lineitem"
        for c in ("l_quantity", "l_extendedprice", "l_linenumber")
    ),
)
def describe(t: Tables):
    return S.describe(t.lineitem, ["l_quantity", "l_extendedprice", "l_linenumber"])


@Q.add("term_ordinal", sql('SELECT id, "ktoraKadencja" AS term FROM mp', "mp"))
def term_ordinal(t: Tables):
    return t.raw_roster.select("id", V.term_ordinal(F.col("stazParlamentarny")).alias("term"))


@Q.add("age_at", sql("SELECT id, wiek FROM mp", "mp"))
def age_at(t: Tables):
    return t.raw_roster.select("id", V.age_at(F.col("dataUr"), H.REFERENCE_DATE).alias("wiek"))


@Q.add("to_bool", sql('SELECT id, "czyAktywny" AS active FROM mp', "mp"))
def to_bool(t: Tables):
    return t.raw_roster.select("id", V.to_bool(F.col("czyAktywny")).alias("active"))


_BIN_SQL = 'SELECT id, "nieaktywnoscKategoria" AS bin, komentarz_subbin AS finer FROM mp'


@Q.add("bin_rules", sql(_BIN_SQL, "mp"))
def bin_rules(t: Tables):
    found, finer = V.bin_comment(F.col("nieaktywnoscKomentarz"))
    return t.raw_roster.select("id", found.alias("bin"), finer.alias("finer"))


@Q.add("bin_reason", sql("SELECT id, powod_bin AS bin FROM mp", "mp"))
def bin_reason(t: Tables):
    return t.raw_roster.select("id", V.bin_reason(F.col("powodNieaktywnosci")).alias("bin"))


_FINAL = "CASE WHEN \"czyAktywny\" THEN 'Aktywny' ELSE coalesce(\"nieaktywnoscKategoria\", powod_bin, 'Nieznane') END"


@Q.add("inactivity", sql(f"SELECT id, {_FINAL} AS nieaktywnosc_bin, komentarz_subbin AS nieaktywnosc_subbin FROM mp", "mp"))
def inactivity(t: Tables):
    return H.inactivity(t.raw_roster).select("id", "nieaktywnosc_bin", "nieaktywnosc_subbin")


@Q.add(
    "group_size",
    sql(f"SELECT * FROM (SELECT {_FINAL} AS nieaktywnosc_bin, komentarz_subbin AS nieaktywnosc_subbin, count(*) AS n"
        ' FROM mp WHERE NOT "czyAktywny" GROUP BY 1, 2) WHERE nieaktywnosc_subbin IS NOT NULL', "mp"),
)
def group_size(t: Tables):
    keys = ["nieaktywnosc_bin", "nieaktywnosc_subbin"]
    rows = t.roster.where(~F.col("czyAktywny")).dropna(subset=keys)
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)


def _cache(t: Tables):
    """Known places: nations of some regions, with coordinates made from the keys."""
    return t.nation.where("n_regionkey < 3").select(
        F.concat(F.lit("Miasto "), F.col("n_nationkey").cast("string")).alias("miejsceUr"),
        (F.col("n_nationkey") + 0.5).cast("double").alias("miejsceUrLan"),
        (F.col("n_regionkey") + 0.25).cast("double").alias("miejsceUrLon"),
    )


@Q.add(
    "place_lookup",
    sql("""SELECT mp.id, trim("miejsceUr") AS "miejsceUr", CASE WHEN n_regionkey < 3 THEN n_nationkey + 0.5::DOUBLE END AS "miejsceUrLan",
  CASE WHEN n_regionkey < 3 THEN n_regionkey + 0.25::DOUBLE END AS "miejsceUrLon"
FROM mp LEFT JOIN nation ON trim("miejsceUr") = 'Miasto ' || CAST(n_nationkey AS VARCHAR)""", "mp"),
)
def place_lookup(t: Tables):
    members = t.raw_roster.select("id", F.trim("miejsceUr").alias("miejsceUr"))
    return H.place_lookup(members, _cache(t))[0].select("id", "miejsceUr", "miejsceUrLan", "miejsceUrLon")


@Q.add(
    "place_missing",
    sql("""SELECT DISTINCT trim("miejsceUr") AS "miejsceUr" FROM mp WHERE trim("miejsceUr") <> ''
  AND trim("miejsceUr") NOT IN (SELECT 'Miasto ' || CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey < 3)""", "mp"),
)
def place_missing(t: Tables):
    return H.place_lookup(t.raw_roster.select("id", "miejsceUr"), _cache(t))[1]


_ROSTER = (
    "id imieNazwisko klub dataUr wiek plec ukonczonaSzkola wyksztalcenie najwyzszyStopienNaukowy"
    " liczbaStudiowPodyplomowych zawod nrOkreguWyborczego liczbaGlosow stazParlamentarny ktoraKadencja czyAktywny"
    " powodNieaktywnosci nieaktywnoscKomentarz nieaktywnoscKategoria"
).split()


@Q.add(
    "roster_load",
    sql("SELECT " + ", ".join(
        f'CAST("{c}" AS VARCHAR) AS "{c}"' if c == "dataUr" else f'"{c}"' for c in _ROSTER) + " FROM mp", "mp"),
)
def roster_load(t: Tables):
    return rounded(t.roster.select(*_ROSTER))


# --- exploration ------------------------------------------------------------------------

@Q.add(
    "active_totals",
    sql('SELECT count(*) FILTER (WHERE "czyAktywny") AS aktywny, count(*) FILTER (WHERE NOT "czyAktywny") AS nieaktywny,'
        " count(*) AS suma FROM mp", "mp"),
)
def active_totals(t: Tables):
    return I.active_totals(t.roster)


@Q.add("active_by_club", sql("SELECT klub, count(*) AS n FROM amp GROUP BY 1", "amp"))
def active_by_club(t: Tables):
    return I.by_club(I.active(t.roster))


@Q.add("inactive_by_club", sql('SELECT klub, count(*) AS n FROM mp WHERE NOT "czyAktywny" GROUP BY 1', "mp"))
def inactive_by_club(t: Tables):
    return I.by_club(t.roster.where(~F.col("czyAktywny")))


_CLUB_ORD = "CAST(nullif(list_position([" + quoted(CLUBS) + "], klub), 0) AS INT)"


@Q.add(
    "seat_share",
    sql(f"SELECT klub, seats, {_CLUB_ORD} AS ord, round(seats / 460.0::DOUBLE, 8) AS pct,"
        f" {pct_sql('seats / 460.0::DOUBLE')} AS pct_lab FROM (SELECT klub, count(*) AS seats FROM amp"
        " WHERE klub IS NOT NULL GROUP BY 1)", "amp"),
)
def seat_share(t: Tables):
    return rounded(I.seat_share(t.roster, CLUBS))


_REASONS = quoted(I.REASON_LEVELS)


@Q.add(
    "inactive_by_reason",
    sql(f'SELECT CASE WHEN "nieaktywnoscKategoria" IN ({_REASONS}) THEN "nieaktywnoscKategoria" END AS "nieaktywnoscKategoria",'
        f" CASE WHEN klub IN ({quoted(CLUBS)}) THEN klub END AS klub, count(*) AS n FROM mp"
        ' WHERE NOT "czyAktywny" GROUP BY 1, 2', "mp"),
)
def inactive_by_reason(t: Tables):
    return I.inactive_by_reason(t.roster, clubs=CLUBS)


@Q.add(
    "inactive_list",
    sql('SELECT "imieNazwisko", klub, "nieaktywnoscKategoria", "nieaktywnoscKomentarz" FROM mp WHERE NOT "czyAktywny"'
        f" AND \"nieaktywnoscKategoria\" <> '{PE}'", "mp"),
)
def inactive_list(t: Tables):
    return I.inactive_list(t.roster, PE)


_AGE_SQL = (
    "count(*) AS n, round_even(avg(wiek), 2) AS mean, round_even(stddev_samp(wiek), 2) AS sd,"
    " min(wiek) AS min, round_even(quantile_cont(wiek::DOUBLE, 0.25), 0) AS q1,"
    " round_even(quantile_cont(wiek::DOUBLE, 0.5), 0) AS median,"
    " round_even(quantile_cont(wiek::DOUBLE, 0.75), 0) AS q3, max(wiek) AS max FROM amp WHERE wiek IS NOT NULL"
)


@Q.add("age_summary", sql(f"SELECT {_AGE_SQL}", "amp"))
def age_summary(t: Tables):
    return I.age_summary(t.roster)


@Q.add("age_by_club", sql(f"SELECT klub, {_AGE_SQL} GROUP BY klub", "amp"))
def age_by_club(t: Tables):
    return I.age_summary(t.roster, ["klub"]).orderBy("median", "klub")


@Q.add(
    "age_histogram",
    sql("SELECT CAST(floor((wiek - 20) / 5.0) * 5 + 20 AS BIGINT) AS bin_left, count(*) AS n FROM amp"
        " WHERE wiek IS NOT NULL GROUP BY 1", "amp"),
)
def age_histogram(t: Tables):
    return S.histogram(I.active(t.roster), "wiek", 5, 20)


@Q.add("at_least_n", sql("SELECT count(*) FILTER (WHERE wiek < 30) >= 3 AS holds FROM amp", "amp"))
def at_least_n(t: Tables):
    return I.at_least(I.active(t.roster), F.col("wiek") < 30, 3)


@Q.add(
    "youngest_top5",
    sql('SELECT "imieNazwisko", klub, CAST("dataUr" AS VARCHAR) AS "dataUr", wiek FROM amp'
        ' ORDER BY wiek NULLS LAST, amp."dataUr" NULLS LAST, "imieNazwisko" LIMIT 5', "amp"),
)
def youngest_top5(t: Tables):
    return rounded(I.youngest(t.roster, 5))


@Q.add(
    "club_median_order",
    sql("""SELECT klub, n, med, round_even(med, 0) AS med_label, klub || '  (n=' || CAST(n AS VARCHAR) || ')' AS label,
  row_number() OVER (ORDER BY med DESC, klub) AS ord, min(lo) OVER () AS x_min, max(hi) OVER () AS x_max FROM (
  SELECT klub, count(*) AS n, quantile_cont(wiek::DOUBLE, 0.5) AS med, min(wiek) AS lo, max(wiek) AS hi FROM amp
  WHERE wiek IS NOT NULL AND klub IS NOT NULL GROUP BY 1)""", "amp"),
)
def club_median_order(t: Tables):
    return I.club_median_order(t.roster)


_SEX = "CASE WHEN plec = 'M' THEN 'Mężczyźni' WHEN plec IN ('K', 'kobieta') THEN 'Kobiety' END"


@Q.add(
    "sex_share",
    sql(f"SELECT plec, n, {pct_sql('n / sum(n) OVER ()', 1)} AS pct FROM (SELECT {_SEX} AS plec, count(*)::DOUBLE AS nd,"
        f" count(*) AS n FROM amp WHERE {_SEX} IS NOT NULL GROUP BY 1)", "amp"),
)
def sex_share(t: Tables):
    return I.sex_share(t.roster)


@Q.add(
    "sex_seats",
    sql(f"SELECT party, seats, CASE party WHEN 'Mężczyźni' THEN 1 ELSE 2 END AS ord, round(seats / 460.0::DOUBLE, 8) AS pct,"
        f" {pct_sql('seats / 460.0::DOUBLE')} AS pct_lab FROM (SELECT {_SEX} AS party, count(*) AS seats FROM amp"
        f" WHERE {_SEX} IS NOT NULL GROUP BY 1)", "amp"),
)
def sex_seats(t: Tables):
    return rounded(I.sex_seats(t.roster))


@Q.add(
    "women_share",
    sql(f"""SELECT klub, plec, n, CAST(total AS BIGINT) AS total, round(n / total, 8) AS prop, round(women, 8) AS women_share,
  {pct_sql('n / total')} AS pct_lab, klub || '  (n=' || CAST(CAST(total AS BIGINT) AS VARCHAR) || ')' AS label,
  dense_rank() OVER (ORDER BY women, klub) AS ord, women = 0 AS no_women FROM (
  SELECT *, coalesce(max(n / total) FILTER (WHERE plec = 'Kobiety') OVER (PARTITION BY klub), 0.0) AS women FROM (
  SELECT *, CAST(sum(n) OVER (PARTITION BY klub) AS DOUBLE) AS total FROM (
  SELECT klub, {_SEX} AS plec, count(*) AS n FROM amp WHERE klub IS NOT NULL AND {_SEX} IS NOT NULL GROUP BY 1, 2)))""", "amp"),
)
def women_share(t: Tables):
    return rounded(I.women_share(t.roster))


@Q.add("education_counts", sql("SELECT wyksztalcenie, count(*) AS liczba FROM amp GROUP BY 1", "amp"))
def education_counts(t: Tables):
    return I.education_counts(t.roster)


_LEVEL = """CASE WHEN wyksztalcenie IS NULL OR wyksztalcenie <> 'wyższe' THEN 'wykszt. śr.'
  WHEN "najwyzszyStopienNaukowy" = 'profesor' THEN 'prof.' WHEN "najwyzszyStopienNaukowy" = 'doktor habilitowany' THEN 'dr hab.'
  WHEN "najwyzszyStopienNaukowy" = 'doktor' THEN 'dr' WHEN "najwyzszyStopienNaukowy" LIKE 'magister%' THEN 'II st.'
  WHEN "najwyzszyStopienNaukowy" IN ('licencjat', 'inżynier') THEN 'I st.' ELSE 'tyt. zaw.' END"""
_LEVELS = quoted(I.DEGREE_LEVELS)


@Q.add(
    "degree_bins",
    sql(f"SELECT kategoria, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 8) AS p,"
        f" CAST(8 - list_position([{_LEVELS}], kategoria) AS INT) AS ord FROM (SELECT {_LEVEL} AS kategoria, count(*) AS n"
        " FROM amp WHERE klub IS NOT NULL GROUP BY 1)", "amp"),
)
def degree_bins(t: Tables):
    return rounded(I.degree_bins(t.roster))


_GRID = f"""
lv AS (SELECT klub, {_LEVEL} AS kategoria, count(*) AS n FROM amp WHERE klub IS NOT NULL GROUP BY 1, 2),
tot AS (SELECT klub, count(*) AS total FROM amp WHERE klub IS NOT NULL GROUP BY 1),
grid AS (SELECT klub, kategoria, coalesce(n, 0) AS n, total, 100.0::DOUBLE * coalesce(n, 0) / total AS pct
  FROM tot CROSS JOIN (SELECT unnest([{_LEVELS}]) AS kategoria) LEFT JOIN lv USING (klub, kategoria))
"""


@Q.add(
    "degree_grid",
    sql("", "amp").rstrip() + "," + _GRID + "SELECT klub, kategoria, n, total, round(pct, 8) AS pct,"
    " printf('%.0f', round_even(pct, 0)) || '%' AS label FROM grid",
)
def degree_grid(t: Tables):
    return rounded(I.degree_grid(t.roster))


_WIDE = ", ".join(
    f"max(pct) FILTER (WHERE kategoria = '{x}') AS \"{x}\"" for x in I.DEGREE_LEVELS
)
_BY_LEVELS = ", ".join(f'"{x}" DESC' for x in I.DEGREE_LEVELS)


@Q.add(
    "degree_pivot_order",
    sql("", "amp").rstrip() + "," + _GRID + "SELECT klub, "
    + ", ".join(f'round("{x}", 8) AS "{x}"' for x in I.DEGREE_LEVELS)
    + f", row_number() OVER (ORDER BY {_BY_LEVELS}, klub) AS ord FROM (SELECT klub, {_WIDE} FROM grid GROUP BY 1) w",
)
def degree_pivot_order(t: Tables):
    return rounded(I.degree_pivot_order(t.roster))


_N = '"liczbaStudiowPodyplomowych"'


@Q.add(
    "postgrad_any",
    sql(f"SELECT CASE WHEN has THEN 'Ma jakiekolwiek studia podyplomowe (≥1)' ELSE 'Brak studiów podyplomowych (0)' END"
        " AS kategoria, liczba, round(liczba / CAST(sum(liczba) OVER () AS DOUBLE), 8) AS odsetek FROM"
        f" (SELECT {_N} > 0 AS has, count(*) AS liczba FROM amp GROUP BY 1)", "amp"),
)
def postgrad_any(t: Tables):
    return rounded(I.postgraduate_any(t.roster))


@Q.add(
    "postgrad_dist",
    sql(f"""SELECT studia, liczba, round(p, 8) AS odsetek, CASE WHEN liczba = 0 THEN '' ELSE CAST(liczba AS VARCHAR) || ' ('
  || {pct_sql('p', 1)} || ')' END AS label FROM (SELECT studia, liczba, liczba / CAST(sum(liczba) OVER () AS DOUBLE) AS p FROM (
  SELECT CAST(range AS INT) AS studia, count({_N}) AS liczba FROM range(0, 7) LEFT JOIN amp ON {_N} = range GROUP BY 1))""", "amp"),
)
def postgrad_dist(t: Tables):
    return rounded(I.postgraduate_distribution(t.roster))


@Q.add(
    "postgrad_heat",
    sql("", "amp").rstrip() + f""",
g AS (SELECT klub, {_N} AS studia, count(*) AS c FROM amp WHERE klub IS NOT NULL GROUP BY 1, 2),
f AS (SELECT klub, CAST(range AS INT) AS studia, coalesce(c, 0) AS liczba, coalesce(c, 0) / CAST(total AS DOUBLE) AS p
  FROM (SELECT klub, sum(c) AS total FROM g GROUP BY 1) CROSS JOIN range(0, 7)
  LEFT JOIN (SELECT klub, studia AS range, c FROM g) USING (klub, range))
SELECT klub, studia, liczba, round(p, 8) AS odsetek, CAST(liczba AS VARCHAR) || ' (' || {pct_sql('p', 1)} || ')' AS label FROM f""",
)
def postgrad_heat(t: Tables):
    return rounded(I.postgraduate_heat(t.roster))


_NUMERIC = ("wiek", "liczbaStudiowPodyplomowych", "liczbaGlosow", "ktoraKadencja")


def _cell(a: str, b: str) -> str:
    both = f'"{a}" IS NULL OR "{b}" IS NULL'
    return (
        f"SELECT '{a}' AS var1, '{b}' AS var2, CASE WHEN count(*) FILTER (WHERE {both}) = 0"
        f' THEN round(corr("{a}"::DOUBLE, "{b}"::DOUBLE), 8) END AS value FROM mp'
    )


@Q.add("corr_matrix", sql(" UNION ALL ".join(_cell(a, b) for a in _NUMERIC for b in _NUMERIC), "mp"))
def corr_matrix(t: Tables):
    return rounded(S.correlation_matrix(t.roster, list(_NUMERIC)))


@Q.add(
    "linear_fit",
    sql('SELECT CAST(regr_count(wiek, "ktoraKadencja") AS BIGINT) AS n, round(regr_slope(wiek, "ktoraKadencja"), 8) AS slope,'
        ' round(regr_intercept(wiek, "ktoraKadencja"), 8) AS intercept, round(regr_r2(wiek, "ktoraKadencja"), 8) AS r2 FROM mp', "mp"),
)
def linear_fit(t: Tables):
    return rounded(S.linear_fit(t.roster, "wiek", "ktoraKadencja"))


# The tail by the finite sums in cos² of the angle whose tangent is t / sqrt(v), v even or odd.
P_VALUE_SQL = """,
f AS (SELECT regr_slope(wiek, "ktoraKadencja") AS slope, regr_r2(wiek, "ktoraKadencja") AS r2, CAST(regr_count(wiek, "ktoraKadencja") AS BIGINT) - 2 AS v FROM mp),
k AS (SELECT unnest(range(1, CASE WHEN v % 2 = 0 THEN v // 2 ELSE (v - 1) // 2 END)) AS k FROM f),
terms AS (SELECT exp(sum(ln(CASE WHEN v % 2 = 0 THEN (2 * k - 1) / (2 * k) ELSE 2 * k / (2 * k + 1) END)) OVER (ORDER BY k) + k * ln(1 - r2)) AS x FROM k, f),
s AS (SELECT 1 + coalesce(sum(x), 0) AS s FROM terms)
SELECT round(slope, 8) AS slope, round(1 - CASE WHEN v % 2 = 0 THEN sqrt(r2) * s
  ELSE 2 / pi() * (asin(sqrt(r2)) + CASE WHEN v > 1 THEN sqrt(r2) * sqrt(1 - r2) * s ELSE 0 END) END, 8) AS p_value FROM f, s"""


@Q.add("linear_fit_p", sql("", "mp").rstrip() + P_VALUE_SQL)
def linear_fit_p(t: Tables):
    return rounded(S.linear_fit_p_value(t.roster, "wiek", "ktoraKadencja"))


@Q.add(
    "box_stats",
    """WITH h AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median,
  quantile_cont(l_extendedprice, 0.75) AS q3, count(*) AS n FROM lineitem GROUP BY 1),
j AS (SELECT h.*, l_extendedprice AS x, l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS near
  FROM lineitem JOIN h USING (l_returnflag))
SELECT l_returnflag, any_value(n) AS n, round(min(x) FILTER (WHERE near), 8) AS whisker_low, round(any_value(q1), 8) AS q1,
  round(any_value(median), 8) AS median, round(any_value(q3), 8) AS q3, round(max(x) FILTER (WHERE near), 8) AS whisker_high,
  count(*) FILTER (WHERE NOT near) AS outliers FROM j GROUP BY 1""",
)
def box_stats(t: Tables):
    return rounded(S.box_stats(t.lineitem, ["l_returnflag"], "l_extendedprice"))


@Q.add(
    "distinct_default",
    "SELECT DISTINCT c_nationkey, CASE WHEN n_regionkey < 3 THEN r_name ELSE '#7A7A7A' END AS label FROM customer"
    " JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey",
)
def distinct_default(t: Tables):
    mapping = t.nation.where("n_regionkey < 3").join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    labels = mapping.select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("label"))
    return I.with_default(t.customer, "c_nationkey", labels, "label", "#7A7A7A")


# --- outline queries on tables ------------------------------------------------------------

@Q.add(
    "recipient_heat",
    "SELECT c_mktsegment, o_orderpriority, n, round(n / CAST(sum(n) OVER (PARTITION BY c_mktsegment) AS DOUBLE), 8) AS share"
    " FROM (SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)",
)
def recipient_heat(t: Tables):
    """Orders are counted per customer before the join, so a busy customer is a few rows."""
    sent = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    joined = sent.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    return rounded(K.recipient_heat(joined, "c_mktsegment", "o_orderpriority", "n"))


@Q.add(
    "activity_timeline",
    "SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS period, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2",
)
def activity_timeline(t: Tables):
    return rounded(K.activity_timeline(t.lineitem, "l_shipdate", "l_returnflag", "month"))
