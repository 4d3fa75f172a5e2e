"""Building blocks of the equivalent SQL texts: named table expressions and their order."""

from __future__ import annotations

import re

from textlab.functions.values import COMMENT_RULES, DEGREES, OTHER_COMMENT
from textlab.functions.words import CASE_SUFFIXES, EXTRA_NAMES, FOLD_SUFFIXES, LETTERS, SURNAME_FORMS
from textlab.plans.tables import NEEDLES, RAW_ROSTER, SPOKEN, STOPWORDS, WRITTEN


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def rows(values) -> str:
    return ", ".join(f"('{v}')" for v in values)


WORD = f"[{LETTERS}]+"
VOWEL = "[aeiouyąęó]"
STOP = quoted(STOPWORDS)
SUFFIX = "|".join(FOLD_SUFFIXES)


def fold_sql(column: str) -> str:
    return f"regexp_replace({column}, '^(.{{3,}}?)({SUFFIX})$', '\\1')"


def keep_sql(column: str) -> str:
    return (
        f"length({column}) > 2 AND {column} NOT IN ({STOP}) AND regexp_matches({column}, '{VOWEL}')"
        f" AND {column} NOT IN (SELECT name FROM names)"
        f" AND strip_accents({column}) NOT IN (SELECT name FROM names)"
    )


_SURNAMES = " UNION ALL ".join(
    f"SELECT left(base, length(base) - 3) || form FROM bases, (VALUES {rows(forms)}) f(form)"
    f" WHERE base LIKE '%{ending}'"
    for ending, forms in SURNAME_FORMS.items()
)


def pct_sql(share: str, digits: int = 0) -> str:
    """Half-even percentage label."""
    return f"printf('%.{digits}f', round_even({share} * 100.0, {digits})) || '%'"


def quantiles_sql(x: str, p: float) -> str:
    return f"quantile_cont(CAST({x} AS DOUBLE), {p})"


def _word_edges(pattern: str) -> str:
    """Word borders of any script: RE2 knows those of ASCII only."""
    parts = []
    for part in pattern.split("|"):
        part = re.sub(r"^\\b", r"(^|[^\\p{L}\\p{N}_])", part)
        parts.append(re.sub(r"\\b$", r"($|[^\\p{L}\\p{N}_])", part))
    return "|".join(parts)


def _comment_sql(which: int) -> str:
    """The comment rules as branches of a CASE over ``kom``: 1 the bin, 2 the finer one."""
    whens = [f"WHEN regexp_matches(kom, {quoted([_word_edges(r[0])])}) THEN {quoted([r[which]])}" for r in COMMENT_RULES]
    return "\n         ".join([*whens, f"ELSE {quoted([OTHER_COMMENT])}"])


def _degree_sql() -> str:
    """The degree rules as branches of a CASE over ``szk``."""
    whens = []
    for stem, label in DEGREES:
        phrase = f"nullif(regexp_extract(szk, '-\\s*({stem}[^,;()]*)\\s*(?:[(,;]|$)', 1), '')"
        whens.append(f"WHEN regexp_matches(szk, '(?i)-\\s*{stem}') THEN {quoted([label]) if label else phrase}")
    return "\n      ".join(whens)


# Name → (text, names it needs).
PARTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "docs": (
        "SELECT doc_id, source AS club, lang AS source, 1.0::DOUBLE / (doc_id % 3 + 1) AS weight, text"
        " FROM documents",
        (),
    ),
    "parts": (
        "SELECT part FROM (SELECT DISTINCT unnest(regexp_split_to_array("
        "regexp_replace(lower(name), '[-,]', ' ', 'g'), '\\s+')) AS part"
        " FROM (SELECT p_name AS name FROM part UNION ALL SELECT s_name FROM supplier)) WHERE length(part) > 2",
        (),
    ),
    "bases": (
        "SELECT DISTINCT base FROM (SELECT unnest([part, strip_accents(part), replace(part, 'ł', 'l'),"
        " CASE WHEN part LIKE '%eł' THEN left(part, length(part) - 2) || 'ł' END,"
        " CASE WHEN part LIKE '%eł' THEN left(part, length(part) - 2) || 'l' END]) AS base FROM parts)"
        " WHERE base IS NOT NULL",
        ("parts",),
    ),
    "names": (
        "SELECT DISTINCT unnest([name, strip_accents(name)]) AS name FROM ("
        f"SELECT base || suffix AS name FROM bases, (VALUES {rows(CASE_SUFFIXES)}) s(suffix)"
        f" UNION ALL {_SURNAMES} UNION ALL SELECT * FROM (VALUES {rows(EXTRA_NAMES)}) m(name))",
        ("bases",),
    ),
    "lex_entries": (
        f"SELECT word, CAST((length(word) + item_id) % 5 - 2 AS DOUBLE) AS val FROM"
        f" (SELECT item_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS word FROM benchmark)",
        (),
    ),
    "lex": ("SELECT lower(word) AS token, avg(val) AS val FROM lex_entries GROUP BY 1", ("lex_entries",)),
    "raw_tok": (
        f"SELECT doc_id, club, source, weight, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM"
        f" (SELECT doc_id, club, source, weight, regexp_extract_all(lower(text), '{WORD}') AS w FROM docs)",
        ("docs",),
    ),
    # The token rules are tested once per distinct word.
    "kept_words": (
        f"SELECT DISTINCT token FROM raw_tok WHERE {keep_sql('token')}",
        ("raw_tok", "names"),
    ),
    "tok": (
        f"SELECT doc_id, club, source, weight, pos, token, {fold_sql('token')} AS lemma"
        " FROM raw_tok JOIN kept_words USING (token)",
        ("kept_words",),
    ),
    "complex": (
        f"SELECT doc_id, count(*) AS words, count(*) FILTER"
        f" (WHERE len(regexp_extract_all(token, '{VOWEL}+')) >= 3) AS hard FROM raw_tok GROUP BY 1",
        ("raw_tok",),
    ),
    "sentences": (
        "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[\\\\.!?…]+'),"
        " lambda p: regexp_replace(p, '\\s', '', 'g') <> '')) AS sentences FROM docs",
        ("docs",),
    ),
    "scores": (
        "SELECT doc_id, avg(val) AS s FROM tok JOIN lex USING (token) GROUP BY 1",
        ("tok", "lex"),
    ),
    "metrics": (
        "SELECT d.doc_id, d.club, d.source, d.weight, coalesce(s.s, 0.0) AS sentiment,"
        " CASE WHEN words > 0 AND sentences > 0 THEN 0.4 * (words::DOUBLE / sentences + 100.0 * hard / words)"
        " ELSE 0.0 END AS fog_index,"
        " CASE WHEN words > 0 AND sentences > 0 THEN words::DOUBLE / sentences ELSE 0.0 END AS avg_sentence_len,"
        " CASE WHEN words > 0 AND sentences > 0 THEN words ELSE 0 END AS word_count,"
        " CASE WHEN words > 0 AND sentences > 0 THEN sentences ELSE 0 END AS sentence_count"
        " FROM docs d LEFT JOIN complex USING (doc_id) LEFT JOIN sentences USING (doc_id)"
        " LEFT JOIN scores s USING (doc_id)",
        ("docs", "complex", "sentences", "scores"),
    ),
    "style": (
        "SELECT club, source, count(*) AS n_docs,"
        " sum(sentiment * weight) / sum(weight) AS sentiment_mean, median(sentiment) AS sentiment_median,"
        " stddev_pop(sentiment) AS sentiment_std,"
        " sum(fog_index * weight) / sum(weight) AS fog_mean, median(fog_index) AS fog_median,"
        " quantile_cont(fog_index, 0.25) AS fog_p25, quantile_cont(fog_index, 0.75) AS fog_p75,"
        " stddev_pop(fog_index) AS fog_std,"
        " sum(word_count * weight) / sum(weight) AS words_mean,"
        " quantile_cont(word_count::DOUBLE, 0.5) AS words_median"
        " FROM metrics GROUP BY club, source",
        ("metrics",),
    ),
    "uni": (
        "SELECT source, club, lemma AS term, count(*) AS tf FROM tok GROUP BY ALL",
        ("tok",),
    ),
    "grams": (
        "SELECT source, club, term, n AS ngram_len, count(*) AS tf FROM ("
        "SELECT source, club, lemma || ' ' || l1 AS term, 2 AS n FROM led"
        " UNION ALL SELECT source, club, lemma || ' ' || l1 || ' ' || l2, 3 FROM led)"
        " WHERE term IS NOT NULL GROUP BY ALL",
        ("led",),
    ),
    "led": (
        "SELECT source, club, lemma, lead(lemma, 1) OVER w AS l1, lead(lemma, 2) OVER w AS l2"
        " FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos)",
        ("tok",),
    ),
    "mp": (
        """
  SELECT id, "imieNazwisko",
    CASE WHEN klub IN ('Polska2050-TD', 'Polska2050_TD') THEN 'Polska2050'
         WHEN klub IN ('PSL-TD', 'PSL_TD') THEN 'PSL' ELSE klub END AS klub,
    CAST("dataUr" AS DATE) AS "dataUr",
    2026 - year(CAST("dataUr" AS DATE)) - CASE WHEN strftime(CAST("dataUr" AS DATE), '%m-%d') > '01-11' THEN 1 ELSE 0 END AS wiek,
    "miejsceUr", plec, "ukonczonaSzkola",
    CASE WHEN wyksztalcenie = '(''średnie ogólne'',)' THEN 'średnie ogólne' ELSE wyksztalcenie END AS wyksztalcenie,
    CASE WHEN deg LIKE 'profesor%' THEN 'profesor'
         WHEN deg = 'doktor - samodzielny pracownik naukowy' THEN 'doktor' ELSE deg END AS "najwyzszyStopienNaukowy",
    len(regexp_extract_all(coalesce("ukonczonaSzkola", ''), '(?i)studia\\s+podyplomowe')) AS "liczbaStudiowPodyplomowych",
    zawod, CAST("nrOkreguWyborczego" AS VARCHAR) AS "nrOkreguWyborczego", "liczbaGlosow", "stazParlamentarny",
    CASE WHEN "stazParlamentarny" IS NULL OR "stazParlamentarny" = 'brak' THEN 1 ELSE 1 + len(regexp_extract_all(
      coalesce(nullif(regexp_extract("stazParlamentarny", '(?i)sejm rp\\s+(.+?)\\s+kadencji', 1), ''), "stazParlamentarny"),
      '\\b(?:I|II|III|IV|V|VI|VII|VIII|IX|X)\\b')) END AS "ktoraKadencja",
    act AS "czyAktywny", "powodNieaktywnosci", "nieaktywnoscKomentarz",
    CASE WHEN act THEN NULL WHEN trim(coalesce("powodNieaktywnosci", '')) = '' THEN NULL
         WHEN lower("powodNieaktywnosci") LIKE '%zgon%' THEN 'Zgon'
         WHEN lower("powodNieaktywnosci") LIKE '%zrzeczenie%' THEN 'Zrzeczenie się mandatu'
         ELSE 'Inne (z powodu)' END AS powod_bin,
    CASE WHEN act OR trim(coalesce("nieaktywnoscKomentarz", '')) = '' THEN NULL {BIN} END AS "nieaktywnoscKategoria",
    CASE WHEN act OR trim(coalesce("nieaktywnoscKomentarz", '')) = '' THEN NULL {FINER} END AS komentarz_subbin
  FROM (SELECT *, lower(trim(coalesce("nieaktywnoscKomentarz", ''))) AS kom,
    coalesce(lower(trim("czyAktywny")) IN ('true', '1', 't', 'yes', 'y'), false) AS act,
    trim(regexp_replace(CASE
      {DEGREE} END, '\\s+', ' ', 'g')) AS deg
    FROM (SELECT *, coalesce("ukonczonaSzkola", '') AS szk FROM raw_mp))
""".replace("{BIN}", _comment_sql(1)).replace("{FINER}", _comment_sql(2)).replace("{DEGREE}", _degree_sql()),
        ("raw_mp",),
    ),
    "raw_mp": (RAW_ROSTER.replace("{customer}", "customer").replace("{orders}", "orders"), ()),
    "amp": ('SELECT * FROM mp WHERE "czyAktywny"', ("mp",)),
}


def sql(body: str, *needs: str, **instead: str) -> str:
    """``body`` after the WITH list of everything it needs, dependencies first; ``instead`` gives
    other texts for some names."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in PARTS[name][1]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({instead.get(n, PARTS[n][0])})" for n in order) + "\n" + body


def mention_sql(needle: str) -> str:
    return (
        f"len(regexp_extract_all(strip_accents(lower(text)), '(?:^|[^\\p{{L}}\\p{{N}}_]){needle}'))"
    )


__all__ = ["sql", "quoted", "fold_sql", "pct_sql", "mention_sql", "NEEDLES", "WRITTEN", "SPOKEN", "STOP", "WORD", "VOWEL"]
