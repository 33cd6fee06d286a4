"""Signal bundles (one JSON object with three item lists) and question sets (JSONL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from sigsight import config as C

ITEM = StructType([
    StructField("service", StringType()),
    StructField("occurred_at", StringType()),
    StructField("content", StringType()),
    StructField("event_type", StringType()),
    StructField("severity", StringType()),
    StructField("correlation_id", StringType()),
    StructField("metadata", StringType()),  # a JSON object read into a string keeps its text
])
CORRUPT = "_corrupt_record"
BUNDLE = StructType([*[StructField(s, ArrayType(ITEM)) for s in C.SOURCE_ORDER], StructField(CORRUPT, StringType())])

QUESTION = StructType([
    StructField("id", StringType()),
    StructField("category", StringType()),
    StructField("question", StringType()),
    StructField("ground_truth_event_ids", ArrayType(StringType())),
    StructField("start_time", StringType()),
    StructField("end_time", StringType()),
    StructField("expected_answer_substring", StringType()),
    StructField(CORRUPT, StringType()),
])


def explode_bundle(bundles: DataFrame) -> DataFrame:
    """S1 + S3: bundle rows → raw items (source, pos, item fields); a null list counts as empty, a corrupt bundle has none."""
    if CORRUPT in bundles.columns:
        bundles = bundles.where(F.col(CORRUPT).isNull())
    parts = []
    for s in C.SOURCE_ORDER:
        items = F.coalesce(F.col(s), F.array().cast(ArrayType(ITEM)))
        parts.append(bundles.select(F.lit(s).alias("source"), F.posexplode(items).alias("pos", "item"))
                     .select("source", "pos", "item.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rejects(rows: DataFrame) -> DataFrame:
    """(raw): the texts of ``rows`` (bundles or question lines) that are not what they should be."""
    # A JSON scan must read a column besides the corrupt text; the first one's size or length is at least -1.
    first = next(c for c in rows.columns if c != CORRUPT)
    other = F.size(first) if first in C.SOURCE_ORDER else F.char_length(first)
    return rows.where(F.col(CORRUPT).isNotNull() & (F.coalesce(other, F.lit(0)) >= -1)).select(F.col(CORRUPT).alias("raw"))


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Bundle file(s), one whole JSON object each; an unreadable one keeps its text in ``_corrupt_record``."""
    return spark.read.schema(BUNDLE).option("multiLine", True).json(path)


def read_signal_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(raw items, rejected bundles) of bundle file(s)."""
    bundles = read_bundles(spark, path)
    return explode_bundle(bundles), rejects(bundles)


def parse_bundles(texts: DataFrame, text_col: str) -> DataFrame:
    """S1 + S3 for bundles held as JSON texts: ``texts`` with the bundle's columns."""
    read = F.from_json(F.col(text_col), BUNDLE, {"columnNameOfCorruptRecord": CORRUPT})
    return texts.withColumn("_b", read).select(*texts.columns, "_b.*")


def read_questions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(questions, rejected lines) of a JSONL question set; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    read = lines.select(F.from_json("value", QUESTION, {"columnNameOfCorruptRecord": CORRUPT}).alias("q")).select("q.*")
    return read.where(F.col(CORRUPT).isNull()).drop(CORRUPT), rejects(read)
