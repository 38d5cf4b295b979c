"""Operator 10: secret scans over an incremental ledger of blobs.

A text is addressed by its SHA-256. The ledger has a row for each pair of blob and rule version
that was ever scanned, with what was found, also when that is nothing. A run scans only the
pairs the ledger lacks, one text for each, adds them, and joins findings back to every row.

Built-in functions only. Null text counts as empty. Rows with a null id and repeated rows keep
their own result. Other columns are not read. Empty tables give empty results and add nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored
from .spans import SPANS, chained, counted, joined, matches, none

BASE = ("assign", "access", "hex")
VERSION = "rules-1"
LEDGER = f"blob string, version string, spans {SPANS}"

# The base patterns, written so that they take linear time.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
# Further rules of this library.
PEM = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
HUB = r"gh[opsur]_[A-Za-z0-9]{36,}+"
JWT = r"eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"


def secret_spans(text: Column) -> Column:
    def when(mark: str, spans: Column) -> Column:
        return F.when(text.contains(mark), spans).otherwise(none())

    return chained([
        matches(text, "assign", 0, ASSIGN, lambda v: F.length(v) >= 8, group=2),
        when("AKIA", matches(text, "access", 1, ACCESS)),
        matches(text, "hex", 2, HEX),
        when("PRIVATE KEY-----", matches(text, "pem", 3, PEM)),
        when("gh", matches(text, "hub", 4, HUB)),
        when("eyJ", matches(text, "jwt", 5, JWT)),
    ])


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """What the ledger holds; nothing where the folder does not exist yet."""
    try:
        return spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], LEDGER)


def scan_secrets(docs: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text", version: str = VERSION, rules=secret_spans) -> DataFrame:
    """``id, blob, spans`` of every row; adds what was unseen to the ledger folder."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    blob = F.sha2("_text", 256)
    paths = stored(texts.select("_id", blob.alias("blob")), "op10-paths")
    known = read_ledger(spark, ledger).where(F.col("version") == version).select("blob")
    unseen = stored(paths.groupBy("blob").agg(F.min("_id").alias("rep")).join(known, "blob", "left_anti"), "op10-unseen")

    one = texts.join(unseen, texts["_id"].eqNullSafe(unseen["rep"])).where(blob == F.col("blob"))
    entries = one.select("blob", F.lit(version).alias("version"), rules(F.col("_text")).alias("spans"))
    # Repeated rows of an id give the same entry several times.
    entries.groupBy("blob", "version").agg(F.first("spans").alias("spans")).write.mode("append").parquet(ledger)

    hits = read_ledger(spark, ledger).where((F.col("version") == version) & (F.size("spans") > 0)).groupBy("blob").agg(F.first("spans").alias("spans"))
    return paths.join(hits, "blob", "left").select(F.col("_id").alias(id_col), "blob", F.coalesce("spans", none()).alias("spans"))


def secret_report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digest of the base kinds, and all spans."""
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select(
        F.col(id_col), *[counted(F.col("spans"), k).alias(f"n_{k}") for k in BASE], F.sha2(joined(base, False), 256).alias("base_sha256"), joined(F.col("spans"), False).alias("spans"), "blob",
    )
