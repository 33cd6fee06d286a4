"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Every run of ``WINDOW`` words of an item is a window (a shorter item is one
window).  A document can hold a window only if it holds each of its words, so
one word suffices as join prefix: the one that is rarest over all documents.  The
documents' words are joined with those prefixes, the word's position in the
window bounds where the window may lie, and the words there are compared with
the window as a whole.

The prefix table is broadcast only while its counted rows are at most
``BROADCAST_ROWS``; a larger one is joined by a shuffle on the word, carrying
each word's neighbourhood, never the whole text.  Before that shuffle the
documents' words pass a bit filter of the prefix words, of a fixed size, so that
only words that may be prefixes move; and their counts are combined in the tasks.

Defined cases: null texts have no words; documents or items without words have
no windows; repeated document rows get equal answers, repeated items count once;
an item with a null id marks its words but is not listed; empty tables give no
rows or no hits; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigsight.llm.common import table
from sigsight.session import cut_lineage

WINDOW = 10
BROADCAST_ROWS = 200_000
#: 64-bit words of the filter (8 MB).
FILTER_SLOTS = 1 << 20
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ROW = ["doc_id", "row_hash"]


def words(text: Column) -> Column:
    """Lower-cased (A-Z alone) words of a text; null has none."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lower = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.coalesce(F.filter(F.split(lower, _GAPS), lambda w: w != F.lit("")), F.array().cast("array<string>"))


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, window, parts): every window of every item."""
    parted = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0) \
        .withColumn("n", F.least(F.lit(size), F.size("w")))
    at = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1))
    return parted.select("item_id", "w", "n", at.alias("at")) \
        .select("item_id", F.slice("w", F.col("at"), F.col("n")).alias("parts")) \
        .select("item_id", F.array_join("parts", " ").alias("window"), "parts").distinct()


def _placed_words(docs: DataFrame, size: int) -> DataFrame:
    """One row per word: its row, word, position, and the words a window through it can touch."""
    parted = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), words(F.col("text")).alias("w"))
    placed = parted.select("doc_id", "row_hash", "w", F.posexplode("w").alias("pos", "word"))
    low = F.greatest(F.col("pos") - (size - 1), F.lit(0))
    return placed.select("doc_id", "row_hash", "word", "pos", low.alias("low"), F.size("w").alias("n_words"),
                         F.slice("w", low + 1, F.lit(2 * size - 1)).alias("near"))


def _bit(word: str) -> tuple[Column, Column]:
    """The filter word and the bit in it of a word."""
    h = F.xxhash64(word)
    return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(FILTER_SLOTS - 1)).cast("int"), h.bitwiseAND(F.lit(63)).cast("int")


def _passing(placed: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``placed`` whose word may be one of ``known``; never fewer than those whose word is."""
    slot, bit = _bit("word")
    one = F.lit(1).cast("long")
    set_ = known.select(slot.alias("slot"), F.call_function("shiftleft", one, bit).alias("mask")).groupBy("slot").agg(F.bit_or("mask").alias("mask"))
    every = known.sparkSession.range(FILTER_SLOTS).select(F.col("id").cast("int").alias("slot")).join(set_, "slot", "left")
    masks = every.agg(F.array_sort(F.collect_list(F.struct("slot", F.coalesce("mask", F.lit(0).cast("long")).alias("mask")))).alias("m"))
    filter_ = masks.select(F.col("m.mask").alias("filter"))  # one row of a fixed size
    held = F.getbit(F.element_at("filter", slot + 1), bit) == 1
    return placed.join(F.broadcast(filter_), held).drop("filter")


def prefixes(docs: DataFrame, wins: DataFrame, size: int = WINDOW) -> DataFrame:
    """(word, window, lead, length): each distinct window under its rarest word that documents hold."""
    parts = wins.select("window", F.size("parts").alias("length"), F.posexplode("parts").alias("lead", "word"))
    vocabulary = cut_lineage(parts.select("word").distinct())
    n, every = vocabulary.count(), _placed_words(docs, size).select("word")
    if n <= BROADCAST_ROWS:
        seen = every.join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n"))
    else:
        seen = _passing(every, vocabulary).groupBy("word").agg(F.count("*").alias("n")).join(vocabulary, "word")
    ranked = parts.distinct().join(seen, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = ranked.groupBy("window", "length").agg(F.min(F.struct("n", "word", "lead")).alias("best"))
    return best.filter("best.n > 0").select("best.word", "window", "best.lead", "length")


def occurrences(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Where windows occur, (doc_id, row_hash, window, start, length), and the windows by item."""
    wins = cut_lineage(windows(items, size))
    joined = cut_lineage(prefixes(docs, wins.select("window", "parts").distinct(), size))
    start = F.col("pos") - F.col("lead")
    n, placed = joined.count(), _placed_words(docs, size)
    met = placed.join(F.broadcast(joined), "word") if n <= BROADCAST_ROWS \
        else _passing(placed, joined.select("word").distinct()).join(joined, "word")
    found = met \
        .filter((start >= 0) & (start + F.col("length") <= F.col("n_words"))) \
        .filter(F.array_join(F.slice("near", start - F.col("low") + 1, F.col("length")), " ") == F.col("window"))
    return found.select(*_ROW, "window", start.alias("start"), "length"), wins


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Every row's doc_id and row_hash with n_words, n_hit, n_items, items_sha256, contaminated."""
    found, wins = occurrences(docs, items, size)
    found = cut_lineage(found)
    hit = found.select(*_ROW, F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("at")) \
        .distinct().groupBy(*_ROW).agg(F.count("*").alias("n_hit"))
    by_item = found.select(*_ROW, "window").distinct().join(wins.select("item_id", "window"), "window") \
        .select(*_ROW, F.col("item_id").cast("string").alias("item")).distinct() \
        .groupBy(*_ROW).agg(F.array_sort(F.collect_list("item")).alias("items"))
    none = F.array().cast("array<string>")
    marks = hit.join(by_item, [hit[c].eqNullSafe(by_item[c]) for c in _ROW], "left") \
        .select(*[hit[c].alias(f"_{c}") for c in _ROW], "n_hit", "items")
    every = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    items_found = F.coalesce("items", none)
    return every.join(marks, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _ROW], "left").select(
        *_ROW, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(items_found).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_found, ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs."""
    found = cut_lineage(occurrences(docs, items, size)[0].select(*_ROW).distinct())
    marks = found.select(*[F.col(c).alias(f"_{c}") for c in _ROW])
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.xxhash64("text").eqNullSafe(F.col("_row_hash"))
    return docs.join(marks, same, "left_anti")


def op6_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return contamination(docs, items).drop("row_hash")
