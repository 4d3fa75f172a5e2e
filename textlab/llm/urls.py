"""URL filter by host reputation: labelled outcomes shrunk from host to domain to suffix.

Built-in DataFrame functions alone.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from textlab.sources.sinks import materialise

LEVELS = ("suffix", "domain", "host")


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Columns host (A-Z lower-cased) and path added; both empty for null or without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract("_rest", "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(F.col("_rest"), F.length(host) + 1, F.length("_rest")), "^[^?#]*", 0)
    return (
        pages.withColumn("_rest", F.coalesce(rest, F.lit("")))
        .withColumns({"host": F.translate(host, string.ascii_uppercase, string.ascii_lowercase), "path": path})
        .drop("_rest")
    )


def matching_rule(rules: list[tuple[str, str]], host: Column, path: Column) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does; rules are (verdict, "host/path")."""
    found = F.lit(None).cast("struct<rule string, verdict string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, p = rule.split("/", 1)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


# Suffixes of two labels under which names are registered.
TWO_LABELS = (
    "ac.jp ac.nz ac.uk co.id co.il co.in co.jp co.kr co.nz co.th co.uk co.za com.ar com.au com.br com.cn com.co com.hk com.mx"
    " com.my com.pl com.sg com.tr com.tw com.ua edu.au go.jp gov.au gov.uk ne.jp net.au net.cn or.jp org.au org.cn org.nz org.uk"
).split()
_IP = r"^([0-9]+(\.[0-9]+){3}|\[.*)$"


def levels_of(host: Column) -> dict[str, Column]:
    """Registered domain and suffix of a host without its port: suffixes are the last label, or two
    where ``TWO_LABELS`` has them, domains one label more; an address in numbers stands for itself."""
    name = F.regexp_replace(host, ":[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    wide = two.isin(TWO_LABELS)
    alone = name.rlike(_IP)
    domain = F.when(alone, name).when(wide, F.substring_index(name, ".", -3)).otherwise(two)
    return {"domain": domain, "suffix": F.when(alone, name).when(wide, two).otherwise(F.substring_index(name, ".", -1))}


def reputations(outcomes: DataFrame, default_strength: float = 2.0, max_strength: float = 1000.0) -> DataFrame:
    """(host, labelled, alpha, beta) of every host in ``outcomes`` (host, good), good null if unlabelled.

    At each level a group's prior is Beta(s * m, s * (1 - m)): m the posterior mean of the group
    above (the corpus mean at the top), s estimated from how much the groups of the level differ
    beyond binomial noise (moments), ``default_strength`` where fewer than two groups are
    labelled or s has no estimate. Hosts are counted before anything is joined, so a hot host
    is one row; two numbers a level reach the driver.
    """
    labelled = (F.sum(F.when(F.col("good").isNotNull(), 1).otherwise(0))).alias("n")
    counts = outcomes.groupBy("host").agg(labelled, F.sum(F.col("good").cast("long")).alias("k"))
    hosts = materialise(counts.select("host", "n", F.coalesce("k", F.lit(0)).alias("k")).withColumns(levels_of(F.col("host"))), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    above = (total["k"] or 0) + 0.5, (total["n"] or 0) + 1.0
    groups = hosts
    for i, level in enumerate(LEVELS):
        upper = LEVELS[:i]
        own = hosts.groupBy(level, *upper).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        if i == 0:
            own = own.withColumn("m", F.lit(above[0] / above[1]))
        else:
            own = own.join(groups.select(LEVELS[i - 1], "m"), LEVELS[i - 1])
        s = _strength(own, default_strength, max_strength)
        own = own.withColumns({"alpha": F.col("k") + s * F.col("m"), "beta": F.col("n") - F.col("k") + s * (1 - F.col("m"))})
        groups = own.withColumn("m", F.col("alpha") / (F.col("alpha") + F.col("beta")))
    return groups.select("host", F.col("n").alias("labelled"), "alpha", "beta")


def _strength(groups: DataFrame, default: float, highest: float) -> float:
    """s such that group rates vary by m(1-m)/(s+1) around their prior means m."""
    r = (
        groups.where("n > 0")
        .agg(
            F.count("*").alias("g"),
            F.sum(F.expr("cast(n as double) * (k / n - m) * (k / n - m)")).alias("spread"),
            F.sum(F.expr("m * (1 - m)")).alias("noise"),
            F.sum(F.expr("(n - 1) * m * (1 - m)")).alias("scale"),
        )
        .first()
    )
    if r["g"] < 2 or not r["scale"] or r["scale"] <= 0:
        return default
    # E[spread] = sum m(1-m) (1 + (n-1) / (s+1))
    excess = (r["spread"] - r["noise"]) / r["scale"]
    return highest if excess <= 1 / (highest + 1) else max(0.0, min(highest, 1 / excess - 1))


def judge(pages: DataFrame, rules: list[tuple[str, str]], z: float = 1.0, least: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, bound, labelled) of every row of ``pages``.

    A page that a rule fits has the rule's verdict and is a labelled outcome of its host. Any
    other is allowed if the host's posterior mean less ``z`` deviations (``bound``) reaches
    ``least``. Only page_id and url are read, other columns do not matter. A null url, or one
    without "://", has an empty host, which is a host like any other. Repeated rows give
    repeated results and count as often. An empty table gives none.
    """
    parsed = with_host_and_path(pages.select("page_id", "url")).select(
        "page_id", "host", "path", matching_rule(rules, F.col("host"), F.col("path")).alias("r")
    )
    good = F.col("r.verdict") == "allow"
    known = reputations(parsed.select("host", good.alias("good")))
    mean = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    deviation = F.sqrt(mean * (1 - mean) / (F.col("alpha") + F.col("beta") + 1))
    bounds = known.select("host", "labelled", (mean - z * deviation).alias("bound"))
    return parsed.join(bounds, "host").select(
        "page_id", "host", "path", "r.rule",
        F.coalesce("r.verdict", F.when(F.col("bound") >= least, "allow").otherwise("block")).alias("verdict"),
        F.round("bound", 9).alias("bound"), "labelled",
    )


def sql(rules: list[tuple[str, str]], z: float = 1.0, least: float = 0.5, default: float = 2.0, highest: float = 1000.0) -> str:
    """The same in DuckDB's SQL."""
    whens = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        h, p = rule.split("/", 1)
        whens.append(f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '/{p}') THEN '{verdict} {rule}'")
    wide = ", ".join(f"'{s}'" for s in TWO_LABELS)
    strength = f"""(SELECT CASE WHEN count(*) < 2 OR coalesce(sum((n - 1) * m * (1 - m)), 0) <= 0 THEN {default}
      WHEN (sum(n * (k / n - m) * (k / n - m)) - sum(m * (1 - m))) / sum((n - 1) * m * (1 - m)) <= 1.0 / ({highest} + 1) THEN {highest}
      ELSE greatest(0.0, least({highest}, sum((n - 1) * m * (1 - m)) / (sum(n * (k / n - m) * (k / n - m)) - sum(m * (1 - m))) - 1)) END
      FROM {{0}} WHERE n > 0)"""
    return f"""
WITH u AS (
  SELECT page_id, CASE WHEN coalesce(strpos(url, '://'), 0) > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), v AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u
), w AS (
  SELECT page_id, translate(raw, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM v
), x AS (
  SELECT *, CASE {" ".join(whens)} END AS r, regexp_replace(host, ':[0-9]*$', '') AS name FROM w
), y AS (
  SELECT *, regexp_extract(name, '([^.]*[.])?[^.]*$') AS two, regexp_matches(name, '{_IP}') AS alone FROM x
), z AS (
  SELECT page_id, host, path, r, CASE WHEN alone THEN name WHEN two IN ({wide}) THEN regexp_extract(name, '([^.]*[.])?[^.]*[.][^.]*$') ELSE two END AS domain,
    CASE WHEN alone THEN name WHEN two IN ({wide}) THEN two ELSE regexp_extract(name, '[^.]*$') END AS suf FROM y
), h AS (
  SELECT host, any_value(domain) AS domain, any_value(suf) AS suf, count(r) AS n, count(*) FILTER (WHERE r LIKE 'allow %') AS k FROM z GROUP BY host
), s0 AS (
  SELECT suf, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, (SELECT (sum(k) + 0.5) / (sum(n) + 1.0) FROM h) AS m FROM h GROUP BY suf
), s1 AS (
  SELECT suf, (k + s * m) / (n + s) AS m FROM s0, {strength.format("s0")} AS t(s)
), d0 AS (
  SELECT domain, any_value(suf) AS suf, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, any_value(s1.m) AS m FROM h JOIN s1 USING (suf) GROUP BY domain
), d1 AS (
  SELECT domain, (k + s * m) / (n + s) AS m FROM d0, {strength.format("d0")} AS t(s)
), h0 AS (
  SELECT host, n::DOUBLE AS n, k::DOUBLE AS k, d1.m FROM h JOIN d1 USING (domain)
), h1 AS (
  SELECT host, n, k + s * m AS a, n - k + s * (1 - m) AS b FROM h0, {strength.format("h0")} AS t(s)
), b AS (
  SELECT host, n::BIGINT AS labelled, a / (a + b) - {z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM h1
)
SELECT page_id, host, path, substr(r, strpos(r, ' ') + 1) AS rule,
  coalesce(split_part(r, ' ', 1), CASE WHEN bound >= {least} THEN 'allow' ELSE 'block' END) AS verdict, round(bound, 9) AS bound, labelled
FROM x JOIN b USING (host)
"""
