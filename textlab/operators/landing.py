"""Raw landed records to dimension and fact tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from textlab.functions.text import slugify
from textlab.functions.values import first_truthy, safe_int, walk_dates
from textlab.sources.sinks import materialise


def dim_members(listed: DataFrame, details: DataFrame, id_columns=("id", "alt_id", "mpId")) -> DataFrame:
    """Member list completed by details; rows without an id drop out.

    ``listed``: the alternative id columns, firstLastName, name, club; ``details``: mp_id and
    the detail fields.
    """
    keyed = listed.select(
        safe_int(first_truthy(*[F.col(c).cast("string") for c in id_columns])).alias("mp_id"),
        "firstLastName",
        "name",
        "club",
    ).where("mp_id is not null and mp_id <> 0")
    det = details.select("mp_id", *[F.col(c).alias(f"d_{c}") for c in details.columns if c != "mp_id"])
    blank = F.lit(None).cast("string")
    return keyed.join(det, "mp_id", "left").select(
        "mp_id",
        first_truthy(F.col("firstLastName"), F.col("name"), F.col("d_firstLastName"), blank).alias("name"),
        first_truthy(F.col("club"), F.col("d_club"), blank).alias("club"),
        first_truthy(F.col("d_districtName")).alias("districtName"),
        first_truthy(F.col("d_voivodeship")).alias("voivodeship"),
        F.try_to_date(F.col("d_birthDate"), "yyyy-MM-dd").alias("birthDate"),
        first_truthy(F.col("d_birthPlace")).alias("birthPlace"),
        first_truthy(F.col("d_educationLevel"), F.col("d_education")).alias("educationLevel"),
        first_truthy(F.col("d_profession")).alias("profession"),
    )


def dim_clubs(clubs: DataFrame) -> DataFrame:
    return clubs.select(
        first_truthy(F.col("id")).alias("club_id"),
        first_truthy(F.col("name")).alias("name"),
        F.nullif(F.col("membersCount"), F.lit(0)).alias("membersCount"),
    )


def member_slugs(members: DataFrame) -> DataFrame:
    return members.select("mp_id", "name", slugify(F.col("name")).alias("slug"))


def record_dates(records: DataFrame, json: str = "json", name: str = "dates") -> DataFrame:
    """``records`` with the distinct sorted YYYY-MM-DD strings among the values of a JSON text, at any depth.

    Texts are parsed once, keys and dates inside longer strings do not count, escaped letters
    do. A few levels are walked within a row by expressions; rows that nest deeper, if there are
    any, go on from a written table in further rounds. Null and unreadable texts, and by
    the parser's rule objects that repeat a key, have none.
    """
    columns = [c for c in records.columns if c != name]
    level = F.array_compact(F.array(F.try_parse_json(json)))
    found = records.select(*columns, F.array().cast("array<string>").alias("_found"), level.alias("_level"))
    out = []
    while True:
        stepped = found.withColumn("_w", walk_dates(F.col("_level")))
        walked = materialise(stepped.select(*columns, F.array_union("_found", "_w.found").alias("_found"), F.col("_w.level").alias("_level")), "record-dates")
        out.append(walked.where(F.size("_level") == 0).select(*columns, F.array_sort("_found").alias(name)))
        found = walked.where(F.size("_level") > 0)
        if found.isEmpty():
            return reduce(DataFrame.unionByName, out)


def proceeding_days(proceedings: DataFrame, details: DataFrame) -> DataFrame:
    """Distinct (num, day): dates of the detail record, else of the first list entry.

    Both inputs: num and the record as JSON text in ``json``; proceedings besides with ``pos``, the
    place in the list.
    """
    listed = proceedings.where("num is not null")
    first = listed.groupBy("num").agg(F.min_by("json", "pos").alias("json"))
    entries = record_dates(first, name="_listed").select("num", "_listed")
    found = record_dates(details, name="_detail").select("num", "_detail")
    days = F.when(F.size("_detail") > 0, F.col("_detail")).otherwise(F.col("_listed"))
    # Both sides have a row per record. A plan would go by their small files, of which the dates are
    # a small part, and broadcast them.
    return (
        entries.join(found.hint("merge"), "num", "left")
        .select("num", F.explode(days).alias("day"))
        .distinct()
    )


def statement_index(days: DataFrame, term: int) -> DataFrame:
    """One row per statement of a day file; files without number or date are skipped."""
    return (
        days.where("coalesce(proceedingNum, 0) <> 0 and coalesce(date, '') <> ''")
        .select("proceedingNum", "date", F.explode("statements").alias("st"))
        .select(
            F.lit(term).alias("term"),
            "proceedingNum",
            "date",
            F.col("st.num").alias("statementNum"),
            safe_int(F.col("st.memberID")).alias("memberID"),
            F.nullif(F.col("st.name"), F.lit("")).alias("name"),
            F.nullif(F.col("st.function"), F.lit("")).alias("function"),
            F.col("st.startDateTime").alias("startDateTime"),
            F.col("st.endDateTime").alias("endDateTime"),
            F.col("st.rapporteur").alias("rapporteur"),
            F.col("st.secretary").alias("secretary"),
            F.col("st.unspoken").alias("unspoken"),
        )
    )


def member_folder(mp_id: Column, slug: Column) -> Column:
    return F.concat(
        F.when(mp_id < 1000, F.lpad(mp_id.cast("string"), 3, "0")).otherwise(mp_id.cast("string")),
        F.lit("-"),
        slug,
    )


def statement_routes(index: DataFrame, slugs: DataFrame) -> DataFrame:
    """Relative landing path of every statement page."""
    known = index.join(slugs.select(F.col("mp_id").alias("memberID"), "slug"), "memberID", "left")
    slug = F.coalesce(F.col("slug"), slugify(F.col("name")))
    folder = F.when(
        F.col("memberID") > 0, F.concat(F.lit("html_by_mp/"), member_folder(F.col("memberID"), slug))
    ).otherwise(F.lit("html_non_mp"))
    page = F.concat(
        F.lit("/p"),
        F.col("proceedingNum").cast("string"),
        F.lit("/d"),
        F.col("date"),
        F.lit("/s"),
        F.col("statementNum").cast("string"),
        F.lit(".html"),
    )
    return known.select("proceedingNum", "date", "statementNum", F.concat(folder, page).alias("path"))


def author_pointers(details: DataFrame, slugs: DataFrame, root: str, prefix: str) -> DataFrame:
    """One pointer per (text, author with a numeric id). ``details``: num, from array<string>."""
    authors = details.select("num", F.explode("from").alias("_a")).select(
        "num", safe_int(F.col("_a")).alias("mp_id")
    ).where("mp_id is not null")
    known = authors.join(slugs.select("mp_id", "slug"), "mp_id", "left")
    folder = member_folder(F.col("mp_id"), F.coalesce("slug", F.lit("unknown")))
    return known.select(
        "mp_id",
        "num",
        F.concat(
            F.lit(f"{root}/by_author_ptr/"), folder, F.lit(f"/{prefix}"), F.col("num").cast("string"),
            F.lit(".json"),
        ).alias("ptr_path"),
    )


def reply_rows(details: DataFrame, api_root: str) -> DataFrame:
    """Replies that have a key, with the address of their text."""
    return (
        details.select("num", F.explode("replies").alias("r"))
        .where("coalesce(r.key, '') <> ''")
        .select(
            "num",
            F.col("r.key").alias("key"),
            F.concat_ws("/", F.lit(api_root), F.col("num").cast("string"), F.lit("reply"), F.col("r.key"),
                        F.lit("body")).alias("url"),
        )
    )


def attachment_rows(details: DataFrame, default_name: str = "attachment.bin") -> DataFrame:
    """Attachments with an address, of replies that have a key."""
    return (
        details.select("num", F.explode("replies").alias("r"))
        .where("coalesce(r.key, '') <> ''")
        .select("num", F.col("r.key").alias("key"), F.explode("r.attachments").alias("a"))
        .where("coalesce(a.URL, '') <> ''")
        .select(
            "num",
            "key",
            F.col("a.URL").alias("url"),
            F.coalesce(F.nullif(F.col("a.name"), F.lit("")), F.lit(default_name)).alias("name"),
        )
    )


def numbered_pairs(entries: DataFrame, code: str, number_keys: list[str]) -> DataFrame:
    """Distinct (code, number), the number being the first truthy of alternative keys."""
    number = safe_int(first_truthy(*[F.col(k).cast("string") for k in number_keys]))
    return entries.select(code, number.alias("num")).where("num is not null").distinct()


def distinct_numbers(entries: DataFrame, column: str) -> DataFrame:
    """Distinct usable numbers of paginated lists, in order."""
    return entries.select(safe_int(F.col(column)).alias("num")).where("num is not null").distinct().orderBy("num")


def not_landed(wanted: DataFrame, landed: DataFrame, keys: list[str], size: str = "length", force: bool = False) -> DataFrame:
    """Resume: keys without a non-empty landed file, or all of them when forced."""
    if force:
        return wanted
    # Distinct keys combine on the map side, so a key landed many times is one row here.
    done = landed.where(F.col(size) > 0).select(*keys).distinct()
    return wanted.join(done, keys, "left_anti")


def load_summary(listing: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Landed files per kind; ``kinds``: label → pattern of the path."""
    cells = F.array(
        *[F.when(F.col("path").rlike(pattern), F.lit(label)) for label, pattern in kinds.items()]
    )
    return (
        listing.select(F.explode(F.array_compact(cells)).alias("kind"))
        .groupBy("kind")
        .agg(F.count("*").alias("files"))
    )
