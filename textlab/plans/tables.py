"""Roles of the given tables: which table plays corpus, lexicon, roster and landing zone."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from textlab.functions.text import raw_tokens
from textlab.functions.words import DOMAIN_STOPWORDS
from textlab.operators.corpus import lexicon
from textlab.operators.names import name_variants
from textlab.operators.roster import clean_roster, load_roster

# Function words of the corpus languages: the base stop list of the queries.
FUNCTION_WORDS = tuple(
    """
    the and for that with this from are was not les des une que qui dans pour par sur est
    der die und das den von ein eine mit los las del una por con para como
    """.split()
)
STOPWORDS = tuple(sorted({*FUNCTION_WORDS, *DOMAIN_STOPWORDS}))

# The two channels that stand for written and spoken texts.
WRITTEN, SPOKEN = "en", "de"

BLOCKS = {
    "block_a": [f"src{i}" for i in range(8)],
    "block_b": [f"src{i}" for i in range(8, 16)],
}
NEEDLES = ("tion", "ther")

# Member profiles as a projection of customers; valid in Spark SQL and ANSI SQL alike.
RAW_ROSTER = """
SELECT
  c.c_custkey AS id,
  c.c_name AS "imieNazwisko",
  CASE WHEN c.c_custkey % 41 = 0 THEN NULL
       WHEN c.c_custkey % 10 = 3 THEN 'PSL-TD'
       ELSE c.c_mktsegment END AS klub,
  CAST(make_date(
    CAST(year(o.first_order) - (c.c_custkey * 7) % 53 AS INT),
    CAST(month(o.first_order) AS INT),
    CAST(CASE WHEN day(o.first_order) > 28 THEN 28 ELSE day(o.first_order) END AS INT)
  ) AS STRING) AS "dataUr",
  CASE WHEN c.c_nationkey % 9 = 0 THEN ' ' ELSE ' Miasto ' || CAST(c.c_nationkey AS STRING) END AS "miejsceUr",
  CASE c.c_custkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'K' WHEN 2 THEN 'kobieta' WHEN 3 THEN 'x' ELSE 'M' END AS plec,
  CASE WHEN c.c_custkey % 19 = 0 THEN NULL ELSE
    'Uczelnia ' || CAST(c.c_nationkey AS STRING) || ' - ' ||
    CASE c.c_custkey % 11
      WHEN 0 THEN 'profesor nauk  technicznych' WHEN 1 THEN 'doktor habilitowany' WHEN 2 THEN 'Doktor'
      WHEN 3 THEN 'magister inżynier' WHEN 4 THEN 'Magister' WHEN 5 THEN 'lekarz medycyny'
      WHEN 6 THEN 'inżynier' WHEN 7 THEN 'licencjat' WHEN 8 THEN 'doktor - samodzielny pracownik naukowy'
      WHEN 9 THEN 'doktor' ELSE 'technik' END
    || ' (1999)' || repeat(', Studia  podyplomowe', CAST(c.c_custkey % 4 AS INT)) END AS "ukonczonaSzkola",
  CASE c.c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '(''średnie ogólne'',)' WHEN 2 THEN 'średnie ogólne'
       ELSE 'wyższe' END AS wyksztalcenie,
  CASE WHEN c.c_custkey % 23 = 0 THEN NULL ELSE 'zawód ' || CAST(c.c_nationkey AS STRING) END AS zawod,
  c.c_nationkey AS "nrOkreguWyborczego",
  CAST(floor(c.c_acctbal) AS INT) AS "liczbaGlosow",
  CASE c.c_nationkey % 5 WHEN 0 THEN 'brak' WHEN 1 THEN NULL WHEN 2 THEN 'Sejm RP VII, VIII kadencji'
       WHEN 3 THEN 'poseł IX kadencji' ELSE 'sejm rp VI, VII, VIII i IX kadencji, Senat X kadencji' END AS "stazParlamentarny",
  CASE WHEN c.c_acctbal <= 0 THEN 'False' WHEN c.c_custkey % 3 = 0 THEN ' Yes ' WHEN c.c_custkey % 3 = 1 THEN '1'
       ELSE 'true' END AS "czyAktywny",
  CASE WHEN c.c_acctbal > 0 THEN NULL ELSE
    CASE c.c_custkey % 4 WHEN 0 THEN 'Zgon' WHEN 1 THEN 'Zrzeczenie' WHEN 2 THEN 'inny powód' ELSE ' ' END
  END AS "powodNieaktywnosci",
  CASE WHEN c.c_acctbal > 0 THEN NULL ELSE
    CASE c.c_custkey % 9
      WHEN 0 THEN 'Mandat posła do Parlamentu Europejskiego' WHEN 1 THEN 'utrata prawa wybieralności'
      WHEN 2 THEN 'poseł zmarł nagle' WHEN 3 THEN 'funkcja Burmistrza' WHEN 4 THEN 'szef Kancelarii Prezydenta RP'
      WHEN 5 THEN 'sekretarza stanu' WHEN 6 THEN 'zarząd NBP' WHEN 7 THEN 'inna przyczyna' ELSE NULL END
  END AS "nieaktywnoscKomentarz"
FROM {customer} c
LEFT JOIN (SELECT o_custkey, MIN(o_orderdate) AS first_order FROM {orders} GROUP BY o_custkey) o
  ON o.o_custkey = c.c_custkey
"""


class Tables:
    """The given tables of one folder and the roles derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def docs(self) -> DataFrame:
        """Corpus rows: club, source (channel), weight and text."""
        return self.dealt(self.raw_docs, "doc_id")

    def dealt(self, df: DataFrame, key: str) -> DataFrame:
        """Rows dealt to ``spark.textlab.partitions`` tasks where that is set, else as scanned.

        For tables that lie in one split on a machine of many cores; a cluster leaves it unset.
        """
        parts = int(self.spark.conf.get("spark.textlab.partitions", "0"))
        return df.repartition(parts, key) if parts else df

    @cached_property
    def raw_docs(self) -> DataFrame:
        """The same rows as scanned."""
        return self.documents.select(
            "doc_id",
            F.col("source").alias("club"),
            F.col("lang").alias("source"),
            (F.lit(1.0) / (F.col("doc_id") % 3 + 1)).alias("weight"),
            "text",
        )

    @cached_property
    def lexicon_entries(self) -> DataFrame:
        """Every word occurrence of the benchmark items, with a value from its row."""
        words = self.benchmark.select("item_id", F.explode(raw_tokens(F.col("text"))).alias("word"))
        return words.select(
            "word", ((F.length("word") + F.col("item_id")) % 5 - 2).cast("double").alias("val")
        )

    @cached_property
    def lexicon(self) -> DataFrame:
        return lexicon(self.lexicon_entries)

    @cached_property
    def names(self) -> DataFrame:
        """Name variants of the listed names (parts) and of the speakers' names (suppliers)."""
        return name_variants((self.part, "p_name"), (self.supplier, "s_name"))

    @cached_property
    def raw_roster(self) -> DataFrame:
        return self.spark.sql(
            RAW_ROSTER.replace('"', "`"), customer=self.customer, orders=self.orders
        )

    @cached_property
    def roster(self) -> DataFrame:
        return load_roster(clean_roster(self.raw_roster))
