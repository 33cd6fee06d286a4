"""Spelling variant grouping through Bloom-guided edit neighbourhoods.

Words are counted once over all texts (per task, then in Spark); the vocabulary
is every word of enough characters and occurrences.  Two words are near if one
code point more, less or other tells them apart.  Each word's deletions and
replacements are generated as hashes, a batch at a time in numpy, and probed
against blocked Bloom filters, one per word length; only the positives become
strings and shuffle to an exact join with the vocabulary, which removes the
filter's false positives.  Insertions need no probes: they are the other side
of a deletion, and of two words that differ by a replacement only the smaller
one's is generated.  So every near pair is found exactly once.

The filters are built by Spark (bit-wise or per filter word) and broadcast in
blocks of at most ``BLOCK_WORDS`` vocabulary words: a length with more is split
by hash, further blocks are further passes over the vocabulary, so that what is
broadcast does not grow with the data.

Characters lie within U+0000 to U+00FF, so a word is as many Latin-1 bytes as it
has code points.

Defined cases: null, empty or letterless texts have no words; repeated rows
count each; a null doc_id counts as an empty one in the hash that picks runs to
damage; very long texts are read whole, very long words generate their whole
neighbourhood in pieces; columns other than ``doc_id`` and ``text`` are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigsight.llm.common import table
from sigsight.session import cut_lineage

LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A word's form occurs at least so many times as often as the word.
FORM_FACTOR = 5
#: One run in so many, told by a hash of document and run, loses a character.
DAMAGE = 199
_RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")

#: Different words a task counts before it hands the counts on.
FLUSH_WORDS = 400_000
#: Words in the filters of one broadcast (16 bits each: 32 MB).
BLOCK_WORDS = 16_000_000
BITS_PER_WORD = 16
#: 64-bit words of a filter block; a probe stays inside its block.
LANES = 8
#: Words whose neighbourhoods one task generates.
TASK_WORDS = 16_384
#: Probes generated at a time.
PROBES = 1 << 21

# Fixed odd numbers: the base of the rolling hash and the two multipliers of its mixing.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def words_of(doc_id: int | None, text: bytes) -> Counter:
    """Words (Latin-1 bytes) of a text after damage, with their occurrences."""
    found: Counter = Counter()
    seed = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
    for run, n in Counter(map(bytes.lower, _RUN.findall(text))).items():
        if len(run) < LEAST_LENGTH:
            continue
        h = zlib.crc32(run, seed)
        word = run.decode().encode("latin-1")
        if h % DAMAGE == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= LEAST_LENGTH:
            found[word] += n
    return found


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            held.update(words_of(doc_id, text or b""))
            if len(held) >= FLUSH_WORDS:
                yield _counted(held)
                held = Counter()
    if held:
        yield _counted(held)


def _counted(held: Counter) -> pa.RecordBatch:
    words = pa.array([w.decode("latin-1") for w in held], pa.string())
    return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of every word that is long and frequent enough."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= LEAST_COUNT)


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    np.multiply.accumulate(np.full(max(n - 1, 0), BASE), out=out[1:])
    return out


def hashes(codes: np.ndarray) -> np.ndarray:
    """Rolling hashes of words of one length, a row of code points each: the sum of code x BASE^position."""
    return (codes.astype(np.uint64) * _powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX[0]
    h = (h ^ (h >> np.uint64(27))) * MIX[1]
    return h ^ (h >> np.uint64(31))


def slots(h: np.ndarray, blocks: int, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """The filter word that each mixed hash has in this half of its block, and the three bits it sets there."""
    block = ((h >> np.uint64(33)) * np.uint64(blocks)) >> np.uint64(31)
    bits = h if lane == 0 else mixed(h + BASE)
    at = block * np.uint64(LANES) + np.uint64(lane * LANES // 2) + (bits & np.uint64(LANES // 2 - 1))
    mask = np.uint64(1) << ((bits >> np.uint64(2)) & np.uint64(63))
    for i in (8, 14):
        mask |= np.uint64(1) << ((bits >> np.uint64(i)) & np.uint64(63))
    return at.astype(np.int64), mask


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The part of its length's filters that a mixed hash belongs to."""
    return (mixed(h ^ MIX[0]) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def blocks_for(words: int) -> int:
    return max(1, -(-words * BITS_PER_WORD // (64 * LANES)))


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, indexes, code points) of the words of each length."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    for length in np.unique(sizes).tolist():
        which = np.flatnonzero(sizes == length)
        joined = "".join([words[i] for i in which.tolist()]).encode("latin-1")
        yield length, which, np.frombuffer(joined, dtype=np.uint8).reshape(len(which), length)


def deletions(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position, rows, hashes) of the words less one code point; of a run of equal ones only the last goes."""
    length = codes.shape[1]
    terms = codes.astype(np.uint64) * _powers(length)
    nearer = codes[:, 1:].astype(np.uint64) * _powers(length)[: length - 1]
    before, after = np.zeros(len(codes), dtype=np.uint64), nearer.sum(axis=1, dtype=np.uint64)
    for at in range(length):
        rows = np.flatnonzero(codes[:, at] != codes[:, at + 1]) if at < length - 1 else np.arange(len(codes))
        yield at, rows, (before + after)[rows]
        before = before + terms[:, at]
        if at < length - 1:
            after = after - nearer[:, at]


def replacements(codes: np.ndarray, h: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(position, rows, new codes, hashes) of the words with a larger code point at one position."""
    powers = _powers(codes.shape[1])
    for at in range(codes.shape[1]):
        rest = h - codes[:, at].astype(np.uint64) * powers[at]
        rows, which = np.nonzero(codes[:, at][:, None] < alphabet[None, :])
        yield at, rows, alphabet[which], rest[rows] + (alphabet.astype(np.uint64) * powers[at])[which]


class Filters:
    """Blocked Bloom filters of one block of the vocabulary: the filter words of its (length, part)."""

    def __init__(self, lanes: dict[tuple[int, int], np.ndarray], parts: dict[int, int]):
        self.lanes, self.parts = lanes, parts

    def holding(self, length: int, h: np.ndarray) -> np.ndarray:
        """Indexes of the hashes of words of a length that these filters may hold."""
        numbers = [number for size, number in self.lanes if size == length]
        if not numbers or not len(h):
            return np.zeros(0, dtype=np.int64)
        h = mixed(h)
        part = part_of(h, self.parts[length]) if self.parts[length] > 1 else np.zeros(len(h), dtype=np.uint64)
        out = []
        for number in numbers:
            lanes = self.lanes[length, number]
            held = np.arange(len(h)) if self.parts[length] == 1 else np.flatnonzero(part == number)
            for lane in range(2):
                at, mask = slots(h[held], len(lanes) // LANES, lane)
                held = held[(lanes[at] & mask) == mask]
            out.append(held)
        return np.concatenate(out)


def _probe(shared, alphabet: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, edit) of every generated edit that the filters may hold."""
    filters: Filters = shared.value
    for batch in batches:
        words, counts = batch.column("word").to_pylist(), batch.column("n").to_numpy()
        for length, which, codes in by_length(words):
            step = max(1, PROBES // (length + len(alphabet)))
            for low in range(0, len(which), step):
                some = which[low : low + step]
                rows, edits = _positives(filters, length, codes[low : low + step], alphabet)
                if rows:
                    met = some[np.array(rows)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([words[i] for i in met.tolist()]), pa.array(counts[met]), pa.array(edits, pa.string())],
                        names=["word", "n", "edit"])


def _positives(filters: Filters, length: int, codes: np.ndarray, alphabet: np.ndarray) -> tuple[list[int], list[str]]:
    rows_met: list[int] = []
    edits: list[str] = []
    h = hashes(codes)
    for at, rows, probes in deletions(codes):
        for i in rows[filters.holding(length - 1, probes)].tolist():
            rows_met.append(i)
            edits.append((codes[i, :at].tobytes() + codes[i, at + 1 :].tobytes()).decode("latin-1"))
    for at, rows, new, probes in replacements(codes, h, alphabet):
        met = filters.holding(length, probes)
        for i, code in zip(rows[met].tolist(), new[met].tolist(), strict=True):
            rows_met.append(i)
            edits.append((codes[i, :at].tobytes() + bytes([code]) + codes[i, at + 1 :].tobytes()).decode("latin-1"))
    return rows_met, edits


def _set_bits(sizes: dict[int, int], parts: dict[int, int]):
    """(length, part, at, mask): the filter words that the vocabulary's words set bits in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, _, codes in by_length(batch.column("word").to_pylist()):
                h = mixed(hashes(codes))
                part = part_of(h, parts[length]).astype(np.int32)
                for lane in range(2):
                    at, mask = slots(h, blocks_for(-(-sizes[length] // parts[length])), lane)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(h), length, np.int32)), pa.array(part), pa.array(at), pa.array(mask.view(np.int64))],
                        names=["length", "part", "at", "mask"])

    return run


def filter_blocks(words: DataFrame, sizes: dict[int, int], block_words: int = BLOCK_WORDS) -> Iterator[Filters]:
    """The filters of the whole vocabulary, block by block; ``sizes`` counts its words by length."""
    parts = {k: -(-n // block_words) for k, n in sizes.items()}
    bits = words.select("word").mapInArrow(_set_bits(sizes, parts), "length int, part int, at long, mask long")
    bits = cut_lineage(bits.groupBy("length", "part", "at").agg(F.bit_or("mask").alias("mask")))
    block: list[tuple[int, int]] = []
    room = block_words
    for key in [(k, p) for k in sizes for p in range(parts[k])]:
        each = -(-sizes[key[0]] // parts[key[0]])
        if block and each > room:
            yield _filters(bits, block, sizes, parts)
            block, room = [], block_words
        block.append(key)
        room -= each
    if block:
        yield _filters(bits, block, sizes, parts)


def _filters(bits: DataFrame, block: list[tuple[int, int]], sizes: dict[int, int], parts: dict[int, int]) -> Filters:
    lanes = {}
    for length, part in block:
        rows = bits.filter((F.col("length") == length) & (F.col("part") == part)).select("at", "mask").toArrow()
        lanes[length, part] = np.zeros(blocks_for(-(-sizes[length] // parts[length])) * LANES, dtype=np.uint64)
        lanes[length, part][rows.column("at").to_numpy()] = rows.column("mask").to_numpy().view(np.uint64)
    return Filters(lanes, {k: parts[k] for k, _ in block})


def near_pairs(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n, near, near_n): each pair of near words once; ``words`` is (word, n), read once a block."""
    spark = words.sparkSession
    counted = words.groupBy(F.char_length("word").cast("int").alias("length")).count().orderBy("length").collect()
    sizes = {r["length"]: r["count"] for r in counted}
    signs = words.select(F.explode(F.split("word", "")).alias("sign")).distinct().collect()  # 90 different ones at most
    alphabet = np.array(sorted(ord(r["sign"]) for r in signs if r["sign"]), dtype=np.uint8)
    dealt = words.repartition(max(1, -(-sum(sizes.values()) // TASK_WORDS)), "word")
    found = None
    for filters in filter_blocks(words, sizes, block_words):
        shared = spark.sparkContext.broadcast(filters)
        edits = dealt.mapInArrow(lambda batches, shared=shared: _probe(shared, alphabet, batches), "word string, n long, edit string")
        found = edits if found is None else found.unionByName(edits)
    if found is None:
        return spark.createDataFrame([], "word string, n long, near string, near_n long")
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return found.join(known, F.col("edit") == F.col("near")).select("word", "n", "near", "near_n")


def _roots(links: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of forms; ``links`` is (word, form).

    A form occurs several times as often as its word, so chains end; each round
    doubles what a step spans.
    """
    spans = cut_lineage(links.select("word", F.col("form").alias("root")))
    while True:
        next_ = spans.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = spans.join(next_, "root", "left")
        longer = cut_lineage(joined.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        spans = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            return spans


def variants(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the vocabulary."""
    words = cut_lineage(vocabulary(docs))
    pairs = near_pairs(words, block_words)
    other = pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    # The most frequent near word, the smallest of equal ones; combined before the shuffle.
    best = F.min(F.struct((-F.col("near_n")).alias("turn"), F.col("near").alias("form")))
    near = pairs.unionByName(other).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    near = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                                   F.col("best.form").alias("_near"), (-F.col("best.turn")).alias("_near_n"))
    fits = F.col("_near_n") >= FORM_FACTOR * F.col("n")
    formed = cut_lineage(near.select("word", "n", "n_near", F.when(fits, F.col("_near")).alias("form"), F.when(fits, F.col("_near_n")).alias("form_n")))
    roots = _roots(formed.filter("form is not null"))
    return formed.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``documents``."""
    return variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")
