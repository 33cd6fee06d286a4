"""The training-corpus pipeline: five stages over ``documents``, each one of the llm operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents`` (doc_id, text, lang, source, n_chars).

Defined cases, stage by stage: language ID drops null and letterless texts and
keeps repeated rows; near duplicates keep one row of each group, the one with the
least doc_id (null last; ties by the text), whether rows share an id or not, so
unrelated texts under one id all stay; decontamination judges each row by itself
and keeps texts without a word; the secret scan keeps every row, a null text stays
null; packing turns a null text into the end mark alone.  Very long texts go
through whole, extra columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigsight.llm import decontamination, langid, packing, secrets, simhash
from sigsight.llm.common import DOC_COLUMNS, fold, table
from sigsight.session import cut_lineage

#: A document is rejected if no language explains this share of its n-grams, and that is sure: the share found in n
#: n-grams is below it by more than chance leaves room for (Hoeffding's bound) but once in so many.
LEAST_LANGUAGE_SCORE = 0.2
SURE = 1000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or surely of no learned language; learns from the training folds.

    Without any row of known language nothing can be told, and all rows stay.
    """
    docs = docs.select(*DOC_COLUMNS)
    filters = langid.train(docs.filter(fold(3) != 1))
    if not filters.languages:
        return docs
    told = langid.identify(docs, filters, DOC_COLUMNS)
    room = F.sqrt(F.lit(math.log(SURE)) / (2 * F.greatest("n_grams", F.lit(1))))
    some = F.col("score") + room >= LEAST_LANGUAGE_SCORE
    return told.filter((F.col("lang_pred") != langid.UNDETERMINED) & some).select(*DOC_COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: the one with the least doc_id, null last, ties by the text.

    Rows are told apart by id and text: rows that only share an id are judged by
    their texts, and so are rows without an id.
    """
    docs = docs.select(*DOC_COLUMNS)
    marked = cut_lineage(simhash.fingerprints(docs.withColumn("row_hash", F.xxhash64("text")), keep=["doc_id", "row_hash"]))
    rows = simhash.grouped(marked).groupBy("group", "doc_id", "row_hash").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_hash", "n"))
    kept = cut_lineage(rows.groupBy("group").agg(first.alias("r")).select(F.col("r.doc_id").alias("_id"), F.col("r.row_hash").alias("_hash"), "r.n"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    single = docs.join(kept.filter("n = 1"), same, "left_semi")
    return single.unionByName(docs.join(kept.filter("n > 1"), same, "left_semi").dropDuplicates(["doc_id", "text"]))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontamination.clean(docs.select(*DOC_COLUMNS), items)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; n_chars is the new length."""
    redact = F.pandas_udf(secrets.redacted, "string")
    marked = docs.select("doc_id", redact("text").alias("text"), "lang", "source")
    return marked.withColumn("n_chars", F.char_length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dups", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("packing", pack_sequences),
]

#: Trained filters, fingerprint groups and token ids cannot be had from SQL;
#: tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what each keeps is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
