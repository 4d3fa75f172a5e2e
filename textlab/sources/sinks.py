"""Writers, and the folder that intermediate files go to."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F


@lru_cache(maxsize=1)
def _local_root() -> str:
    root = tempfile.mkdtemp(prefix="textlab-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir.

    Without that setting only a local session may go on, in a temporary folder that goes with
    the process; a cluster must name a folder that all executors reach.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        root = _local_root()
    return f"{root.rstrip('/')}/textlab/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, partition_by: list[str] = ()) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, outlives executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str, columns: list[str], sep: str = ",", header: bool = True) -> str:
    """Fixed column order; missing values as empty text, blanks at both ends kept."""
    df.select(*columns).write.csv(
        path, header=header, sep=sep, nullValue="", emptyValue="", quote='"', escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    return path


def write_parquet(df: DataFrame, path: str, columns: list[str], partition_by: list[str] = ()) -> str:
    """Selected columns. Rows go straight to the partition folders, without a shuffle by
    the partition value, so a hot one stays spread over tasks."""
    df.select(*columns).write.partitionBy(*partition_by).parquet(path)
    return path


def write_json(df: DataFrame, path: str, partition_by: list[str] = ()) -> str:
    df.write.partitionBy(*partition_by).json(path)
    return path


def write_json_arrays(df: DataFrame, path: str, key: str, page_size: int = 100) -> str:
    """One array of records per line, at most ``page_size`` keys in each (keys are unique
    numbers, so a page is bounded)."""
    page = F.floor(F.col(key) / page_size)
    (
        df.groupBy(page.alias("_page"))
        .agg(F.to_json(F.sort_array(F.collect_list(F.struct(*df.columns)))).alias("value"))
        .select("value")
        .write.text(path)
    )
    return path


def write_text_files(df: DataFrame, path: str, partition_by: list[str]) -> str:
    """``value`` as text, a folder for each key. Every task moves its own files into place as it
    ends (the committer's second way); by the first the driver would move them all, one by one."""
    df.write.partitionBy(*partition_by).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
    return path


def pointer_records(pointers: DataFrame, kind: str, root: str) -> DataFrame:
    """{type, num, target} records, with the author to partition the files by."""
    return pointers.select(
        "mp_id",
        F.lit(kind).alias("type"),
        "num",
        F.concat(F.lit(f"{root}/by_num/"), F.col("num").cast("string")).alias("target"),
    )
