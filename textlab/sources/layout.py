"""Files clustered along a space-filling curve, with the ranges each of them holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textlab.operators.rows import slice_of

_BITS = 8
RANGES = "_ranges"


def _number(column: str, kind: str) -> Column:
    """A long or double in the order of the values: of a text, its first seven bytes."""
    c = F.col(column)
    if kind == "string":
        return F.conv(F.rpad(F.substring(F.hex(c), 1, 14), 14, "0"), 16, 10).cast("long")
    if kind == "date":
        return F.unix_date(c).cast("long")
    return c.cast("double")


def curve_place(df: DataFrame, by: list[str]) -> Column:
    """Place of a row on the Z curve through the approximate ranks of its columns, null ranked first."""
    kinds, shares = dict(df.dtypes), [i / 2**_BITS for i in range(1, 2**_BITS)]
    found = df.agg(*(F.percentile_approx(_number(c, kinds[c]), shares, 10_000).alias(c) for c in by)).first()
    place = F.lit(0).cast("long")
    for i, c in enumerate(by):
        rank = slice_of(_number(c, kinds[c]), sorted(set(found[c] or [])))
        for bit in range(_BITS):
            place = place.bitwiseOR(F.shiftleft(F.shiftright(rank, bit).bitwiseAND(F.lit(1)).cast("long"), bit * len(by) + i))
    return place


def write_clustered(df: DataFrame, path: str, by: list[str], files: int) -> str:
    """``df`` as about ``files`` Parquet files of rows that lie together in all columns ``by`` (numbers,
    dates, times or texts), and a table of the least and greatest value of each file.

    Ranks are told by 255 approximate quantiles a column, which is what reaches the driver. Rows
    of one place on the curve may go on over several files, so a hot value is split.
    """
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(1 << 20))
    placed = df.withColumns({"_z": curve_place(df, by), "_salt": salt})
    placed.repartitionByRange(files, "_z", "_salt").sortWithinPartitions("_z").drop("_z", "_salt").write.parquet(path)
    spark = df.sparkSession
    ends = [f(F.col(c)).alias(f"{end}_{c}") for c in by for end, f in (("low", F.min), ("high", F.max))]
    spark.read.schema(df.schema).parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(*ends).write.parquet(f"{path}/{RANGES}")
    return path


def read_clustered(spark: SparkSession, path: str, schema, bounds: dict[str, tuple]) -> DataFrame:
    """Rows with low <= column <= high for every column of ``bounds``, from the files whose ranges meet them.

    Either end may be None. The names of these files reach the driver, as for any scan.
    """
    ranges, wanted = spark.read.parquet(f"{path}/{RANGES}"), F.lit(True)
    for c, (low, high) in bounds.items():
        if low is not None:
            ranges, wanted = ranges.where(F.col(f"high_{c}") >= low), wanted & (F.col(c) >= low)
        if high is not None:
            ranges, wanted = ranges.where(F.col(f"low_{c}") <= high), wanted & (F.col(c) <= high)
    files = [r["file"] for r in ranges.select("file").collect()]
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*files).where(wanted)
