"""Ranked lexical search: accumulator-limited term-at-a-time over document shards.

The query terms of a block of items are looked up in every whole text once; the
postings (which query terms a document holds, how often) are written to the
shared folder, and Spark counts the statistics from them: N documents, L terms,
df of each query term.  Each task then holds the postings of a shard of its
documents, term by term, and answers every item on it: rarest term first, a
document gets an accumulator when a term meets it; once the sum of the largest
contributions still to come is below the k-th partial score, no accumulator is
created any more, and the later terms only update the survivors.  Partial scores
never fall, so no document of the final k best is missed, and survivors' scores
are exact.  A shard gives at most k rows an item; two ranked merges (first in
groups of shards) give the k best of all.

Weights come from doubles, all else is 64-bit integer arithmetic.

Defined cases: a null or termless text counts nowhere; an item without a term,
or of terms no document holds, has no rows; rows of ``documents`` are documents
even if ids repeat, and a null doc_id sorts last among equal scores; rows of
items that share item_id and text are one item, different texts under one
item_id are ranked apart; very long texts are read whole; columns other than
the two ids and ``text`` are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigsight.llm.common import table
from sigsight.session import cut_lineage

TOP = 50
#: Items are answered in blocks of at most about so many bytes of text.
BLOCK_BYTES = 4 << 20
#: A shard holds about so many postings; a task with more answers several shards.
SHARD_POSTINGS = 4_000_000
#: Shards whose best are merged before the last merge: so many groups.
MERGE_GROUPS = 256
LAST = np.iinfo(np.int64).max


def _folding() -> bytes:
    """Digits, letters (lower-cased) and bytes from 128 stay; all others become spaces."""
    to = bytearray(b" " * 128 + bytes(range(128, 256)))
    for c in b"0123456789abcdefghijklmnopqrstuvwxyz":
        to[c] = c
    for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        to[c] = c + 32
    return bytes(to)


FOLDING = _folding()


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLDING).split()


def texts_of(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8 bytes; null is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


POSTINGS = "doc_id long, n long, terms array<int>, tf array<int>"


def index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tf) of every document: its length and the terms of ``vocabulary`` it holds."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.get
        for batch in batches:
            lengths, ends, ids, tf = [], [0], [], []
            for text in texts_of(batch.column("text")):
                words = terms_of(text)
                found = Counter(i for i in map(known, words) if i is not None)
                lengths.append(len(words))
                ids += found.keys()
                tf += found.values()
                ends.append(len(ids))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(lengths, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32()))], names=["doc_id", "n", "terms", "tf"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, POSTINGS)


@dataclass
class Plan:
    """What every shard needs: the items' terms, rarest first, the weights, N and L."""

    items: list[list[int]]
    weights: list[int]
    documents: int
    length: int
    top: int


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Shard:
    """Postings of some documents, term by term."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, plan: Plan):
        order = np.argsort(term, kind="stable")
        self.ids, self.doc = ids, doc[order]
        m = 100 - 50 + (50 * n.astype(np.int64) * plan.documents) // plan.length
        tf = tf[order].astype(np.int64)
        self.part = (1_000_000_000 * tf) // (1000 * tf + 20 * m[self.doc])
        self.starts = np.searchsorted(term[order], np.arange(len(plan.weights) + 1))
        self.most = np.zeros(len(plan.weights), dtype=np.int64)
        held = np.flatnonzero(np.diff(self.starts))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.part, self.starts[held])

    def search(self, terms: list[int], weights: list[int], top: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of the ``top`` best of the shard, in no order; terms come rarest first."""
        terms = [t for t in terms if weights[t] > 0 and self.starts[t] < self.starts[t + 1]]
        scores = np.zeros(len(self.ids), dtype=np.int64)
        survivors = np.zeros(len(self.ids), dtype=bool)
        to_come = sum(weights[t] * int(self.most[t]) for t in terms)
        creating = True
        for t in terms:
            docs, part = (x[self.starts[t] : self.starts[t + 1]] for x in (self.doc, self.part))
            to_come -= weights[t] * int(self.most[t])
            if creating:
                survivors[docs] = True
            else:
                met = survivors[docs]
                docs, part = docs[met], part[met]
            scores[docs] += weights[t] * part
            if creating and to_come < int(scores.max()):
                partial = scores[survivors]
                creating = len(partial) < top or to_come >= np.partition(partial, len(partial) - top)[len(partial) - top]
        found = np.flatnonzero(survivors & (scores > 0))
        best = found[np.lexsort((self.ids[found], -scores[found]))[:top]]
        return best, scores[best]


RANKED = "item int, doc_id long, score long"


def _answer(shared, batches: Iterator[pa.RecordBatch], shard_postings: int) -> Iterator[pa.RecordBatch]:
    plan: Plan = shared.value
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(len(b.column("terms").flatten()) for b in held) >= shard_postings:
            yield _shard_answers(held, plan)
            held = []
    if held:
        yield _shard_answers(held, plan)


def _shard_answers(batches: list[pa.RecordBatch], plan: Plan) -> pa.RecordBatch:
    rows = pa.Table.from_batches(batches).combine_chunks()
    terms = rows.column("terms").combine_chunks()
    sizes = np.diff(terms.offsets.to_numpy())
    ids = rows.column("doc_id").fill_null(LAST).to_numpy()
    shard = Shard(ids, rows.column("n").to_numpy(), np.repeat(np.arange(len(sizes)), sizes), terms.flatten().to_numpy(),
                  rows.column("tf").combine_chunks().flatten().to_numpy(), plan)
    items, docs, scores = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, words in enumerate(plan.items):
        best, score = shard.search(words, plan.weights, plan.top)
        items.append(np.full(len(best), i, np.int32))
        docs.append(ids[best])
        scores.append(score)
    docs = np.concatenate(docs)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(items)), pa.array(docs, mask=docs == LAST), pa.array(np.concatenate(scores))],
                                      names=["item", "doc_id", "score"])


def _best(ranked: DataFrame, top: int, *group: str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search_block(docs: DataFrame, texts: list[str], top: int = TOP, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """(item, rank, doc_id, score): the ``top`` best documents for each of the texts, told by position."""
    spark = docs.sparkSession
    words = [list(dict.fromkeys(terms_of((t or "").encode()))) for t in texts]
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
    postings = cut_lineage(index(docs, vocabulary).filter("n > 0"))
    documents, length = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    counted = postings.select(F.explode("terms").alias("term")).groupBy("term").count()
    df = {r["term"]: r["count"] for r in counted.collect()}  # one row a query term of the block at most
    weights = [weight(documents, df.get(i, 0)) for i in range(len(vocabulary))]
    rarest_first = [sorted((vocabulary[w] for w in ws), key=lambda i: (-weights[i], i)) for ws in words]
    shared = spark.sparkContext.broadcast(Plan(rarest_first, weights, documents, max(length, 1), top))
    ranked = postings.filter(F.size("terms") > 0).mapInArrow(lambda batches: _answer(shared, batches, shard_postings), RANKED)
    ranked = ranked.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)))
    return _best(_best(ranked, top, "item", "group"), top, "item").select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``top`` best documents with a score above 0 for every item.

    Items (item_id, text) are answered in blocks, dealt by a hash; only one block's
    texts and term counts are at the driver and in a broadcast at a time.
    """
    spark = docs.sparkSession
    items = items.select("item_id", F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    answers = []
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        if rows:
            names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item int, item_id long")
            answers.append(search_block(docs, [r["text"] for r in rows], top, shard_postings).join(F.broadcast(names), "item"))
    if not answers:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    whole = answers[0]
    for more in answers[1:]:
        whole = whole.unionByName(more)
    return whole.select("item_id", "rank", "doc_id", "score")


def op12_ranked_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The 50 best documents for each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same ranking from plain joins and sums.
ORACLE_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS d, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents WHERE text IS NOT NULL),
lens AS (SELECT d, doc_id, len(ts) AS n FROM words WHERE len(ts) > 0),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM lens),
tf AS (SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(ts) AS t FROM words) GROUP BY d, t),
item_terms AS (
  SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark WHERE text IS NOT NULL),
weights AS (
  SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), totals),
scored AS (
  SELECT i.item_id, i.text, l.doc_id, l.d,
         sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 20 * (100 - 50 + (50 * l.n * o.docs) // o.total))))::BIGINT AS score
  FROM item_terms i JOIN weights w USING (t) JOIN tf f USING (t) JOIN lens l USING (d), totals o
  GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
