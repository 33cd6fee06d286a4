"""Substring dedup: an FM-index per shard, documents streamed against it by backward search.

A window of ``WINDOW`` consecutive words is repeated if its words also start
anywhere else, in the same document or another.  Shards are made by content, so
that a document meets only shards that can hold its windows: in each window the
``GRAM``-word string of least hash is its anchor, hence equal windows have equal
anchors, and a run of windows around one anchor is a segment of the text.

1. Documents are dealt into chunks.  Each chunk counts its anchors; Spark adds
   the counts up, and those that occur once need no further step.
2. Each chunk sends the segments of the other anchors, equal ones once with
   their number, to the shard of the anchor.  An anchor of more than
   ``HOT_SEGMENTS`` different segments, as counted a chunk in step 1, is dealt out
   further by its windows' hashes, to as many shards as their number asks for.
3. A shard builds a compressed FM-index of its different segments, weighted by
   their numbers, and streams them: backward search over the wavelet matrix
   yields for each position the longest match that occurs twice; the windows
   whose match reaches ``WINDOW`` words are answered to the chunk.  A segment
   sent by several chunks is answered without a search.
4. Each chunk marks its documents' words and cuts them.

Hashes only decide where segments meet; what is equal is told by the words.

Defined cases: null text has no words; documents under WINDOW words stay whole;
a null or repeated doc_id is a document like any other, repeated rows repeat each
other; very long texts are one document in one chunk; a passage in a third of all
documents is sent once a chunk; columns other than ``doc_id`` and ``text`` are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigsight.llm.common import slabs, table
from sigsight.llm.fm_index import FMIndex

WINDOW = 35
GRAM = 6
#: Bytes of text in a chunk, about.
CHUNK_BYTES = 8 << 20
#: Words that a chunk hashes at a time come from texts of about so many bytes.
SLAB_BYTES = 1 << 20
#: Segments of an anchor above which its windows are dealt out to several shards.
HOT_SEGMENTS = 4096
#: Words after which a shard is closed at the next anchor.
SHARD_WORDS = 1_000_000
# Fixed odd numbers: the bases of the hashes of words and of word strings, and the multiplier of their mixing.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
MIX = np.uint64(0xD6E8FEB86659FD93)

MARK = "chunk long, anchor long, n long, different long"
SEGMENT = "anchor long, part long, chunk long, segment int, n int, text binary"
ANSWER = "chunk long, segment int, windows long"
RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"
_RESULT_TYPE = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                          ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string())])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def _strings(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every ``width`` neighbours, put together from those of powers of two."""
    out, done, power, base = None, 0, h, int(BASES[1])
    for bit in range(width.bit_length()):
        size = 1 << bit
        if width & size:
            part = power[done : len(h) - width + 1 + done]
            out = part.copy() if out is None else out * np.uint64(base) + part
            done += size
        if size * 2 <= width:
            power = power[: len(power) - size] * np.uint64(base) + power[size:]
            base = base * base % (1 << 64)
    return out


@dataclass
class Slab:
    """Words of some texts and the segments of their windows."""

    blob: bytes
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # first and last window of each segment
    last: np.ndarray
    anchor: np.ndarray
    window: np.ndarray  # hashes of all windows

    def names(self) -> np.ndarray:
        """Hashes of the segments: their first and last windows overlap, so these and the length tell the words."""
        return _mixed(self.window[self.first] * BASES[0] + self.window[self.last] * BASES[1] + (self.last - self.first).astype(np.uint64))

    def text(self, first: int, last: int) -> bytes:
        return self.blob[self.starts[first] : self.ends[last + WINDOW - 1]]


def _slab(texts: list[bytes]) -> Slab | None:
    """Words and segments of texts of words that are parted by one space each."""
    blob = b" ".join(texts)
    signs = np.frombuffer(blob, dtype=np.uint8)
    gaps = np.flatnonzero(signs == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(signs)]])
    if len(starts) < WINDOW:
        return None
    sizes = ends - starts
    powers = np.full(int(sizes.max()) + 1, BASES[0])
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    inside = np.arange(len(signs)) - np.repeat(starts, np.append(sizes[:-1] + 1, sizes[-1]))
    values = (signs.astype(np.uint64) + np.uint64(1)) * powers[inside]
    values[gaps] = 0
    words = _mixed(np.add.reduceat(values, starts))
    counts = np.array([t.count(b" ") + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts)), counts)
    grams = _mixed(_strings(words, GRAM))
    offset = sliding_window_view((grams >> np.uint64(32)).astype(np.uint32), WINDOW - GRAM + 1).argmin(axis=1)
    windows = np.flatnonzero(owner[: len(offset)] == owner[WINDOW - 1 :])
    at = windows + offset[windows]
    new = np.flatnonzero(at[1:] != at[:-1]) + 1 if len(at) else np.zeros(0, dtype=np.int64)
    cuts = np.concatenate([[0], new]) if len(at) else new
    return Slab(blob, starts, ends, windows[cuts], windows[np.append(cuts[1:], len(at)) - 1] if len(at) else windows[cuts],
                grams[at[cuts]].view(np.int64), _mixed(_strings(words, WINDOW)))


def _texts(column: pa.ChunkedArray) -> list[bytes]:
    """Texts as words parted by one space; null is empty."""
    return [b" ".join(t.split()) if t else b"" for t in column.cast(pa.binary()).to_pylist()]


def _slabs(texts: list[bytes]) -> Iterator[tuple[list[int], Slab | None]]:
    """Slabs of the texts in their sort order, with the texts' numbers; texts without a word are left out."""
    order = sorted((i for i, t in enumerate(texts) if t), key=texts.__getitem__)
    for a, b in slabs([texts[i] for i in order], SLAB_BYTES):
        yield order[a:b], _slab([texts[i] for i in order[a:b]])


def _marks(key: tuple, rows: pa.Table) -> pa.Table:
    """Step 1: the chunk's anchors, their segments' numbers and how many of those differ."""
    found = [(slab.anchor, slab.names()) for _, slab in _slabs(_texts(rows.column("text"))) if slab is not None]
    anchor = np.concatenate([np.zeros(0, np.int64), *[a for a, _ in found]])
    name = np.concatenate([np.zeros(0, np.uint64), *[s for _, s in found]])
    order = np.lexsort((name, anchor))
    anchor, name = anchor[order], name[order]
    starts = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])) if len(anchor) else np.zeros(0, np.int64)
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (name[1:] != name[:-1])) if len(anchor) else np.zeros(0, bool)
    n = np.diff(np.append(starts, len(anchor)))
    different = np.add.reduceat(new.astype(np.int64), starts) if len(starts) else starts
    return pa.table({"chunk": pa.array(np.full(len(starts), key[0].as_py(), np.int64)), "anchor": anchor[starts],
                     "n": n.astype(np.int64), "different": different.astype(np.int64)})


@dataclass
class Found:
    """A slab's segments whose anchors repeat: their windows and number among the chunk's different segments."""

    texts: list[int]
    slab: Slab | None
    first: np.ndarray
    last: np.ndarray
    number: np.ndarray


def _repeated(texts: list[bytes], anchors: np.ndarray, totals: np.ndarray, hot: int) -> tuple[list[Found], dict, list[int]]:
    """Segments of the given anchors: where they are, the chunk's different ones (anchor, part, text) and how often each.

    The enumeration depends on the chunk's texts alone, not on their order, so it can be made again.
    """
    order = np.argsort(anchors)
    anchors, totals = anchors[order], totals[order]
    known: dict[tuple[int, int, bytes], int] = {}
    times: list[int] = []
    out = []
    for numbers, slab in _slabs(texts):
        if slab is None or not len(anchors):
            out.append(Found(numbers, slab, *(np.zeros(0, np.int64),) * 3))
            continue
        at = np.minimum(np.searchsorted(anchors, slab.anchor), len(anchors) - 1)
        held = anchors[at] == slab.anchor
        first, last, anchor, total = slab.first[held], slab.last[held], slab.anchor[held], totals[at[held]]
        part = np.zeros(len(first), dtype=np.int64)
        if (total > hot).any():
            # Windows of a dealt anchor part from their neighbours, so shards are as many as the windows ask for.
            parts = np.where(total > hot, -(-total * (WINDOW - GRAM + 1) // hot), 1)
            first, last, anchor, part = _dealt(slab, first, last, anchor, parts)
        number = np.empty(len(first), dtype=np.int64)
        for i, (f, z, *key) in enumerate(zip(first.tolist(), last.tolist(), anchor.tolist(), part.tolist(), strict=True)):
            number[i] = known.setdefault((*key, slab.text(f, z)), len(known))
            if number[i] == len(times):
                times.append(0)
            times[number[i]] += 1
        out.append(Found(numbers, slab, first, last, number))
    return out, known, times


def _dealt(slab: Slab, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The segments cut where neighbouring windows belong to different parts of their anchor."""
    sizes = last - first + 1
    of = np.repeat(np.arange(len(first)), sizes)
    windows = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[of]
    part = (slab.window[windows] % parts[of].astype(np.uint64)).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero((of[1:] != of[:-1]) | (part[1:] != part[:-1])) + 1])
    return windows[cuts], windows[np.append(cuts[1:], len(of)) - 1], anchor[of[cuts]], part[cuts]


def _segments(hot: int):
    """Step 2: the chunk's different segments of repeated anchors."""

    def run(key: tuple, rows: pa.Table, marks: pa.Table) -> pa.Table:
        _, known, times = _repeated(_texts(rows.column("text")), marks.column("anchor").to_numpy(), marks.column("n").to_numpy(), hot)
        anchors, parts, texts = zip(*known, strict=True) if known else ((), (), ())
        return pa.table({"anchor": pa.array(anchors, pa.int64()), "part": pa.array(parts, pa.int64()),
                         "chunk": pa.array([key[0].as_py()] * len(known), pa.int64()), "segment": pa.array(range(len(known)), pa.int32()),
                         "n": pa.array(np.minimum(np.array(times, dtype=np.int32), 2)), "text": pa.array(texts, pa.binary())})

    return run


class Shard:
    """Different segments with their numbers, and who asks for them."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.weights: list[int] = []
        self.asked: list[tuple[int, int, int]] = []
        self.words = 0

    def add(self, chunk: int, segment: int, n: int, text: bytes) -> None:
        number = self.numbers.setdefault(text, len(self.numbers))
        if number == len(self.weights):
            self.weights.append(0)
            self.words += text.count(b" ") + 1
        self.weights[number] += n
        self.asked.append((chunk, segment, number))

    def repeated_windows(self) -> np.ndarray:
        """For each segment the bits of its windows that occur twice."""
        names: dict[bytes, int] = {}
        split = [t.split(b" ") for t in self.numbers]
        words = np.array([names.setdefault(w, len(names) + 1) for ws in split for w in ws], dtype=np.int64)
        lengths = np.array([len(ws) for ws in split], dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        weights = np.array(self.weights, dtype=np.int64)
        windows = lengths - WINDOW + 1
        bits = (np.int64(1) << windows) - 1
        once = np.flatnonzero(weights < 2)
        if len(once) and len(lengths) > 1:
            index = FMIndex(words, lengths, weights)
            matched = index.matching_statistics(words, starts[once], lengths[once], 2) >= WINDOW
            at = np.cumsum(lengths[once]) - lengths[once]
            bits[once] = 0
            for w in range(int(windows[once].max())):
                some = np.flatnonzero(windows[once] > w)
                bits[once[some]] |= matched[at[some] + w].astype(np.int64) << w
        else:
            bits[once] = 0
        return bits

    def answers(self) -> pa.RecordBatch:
        bits = self.repeated_windows()
        chunk, segment, number = np.array(self.asked, dtype=np.int64).reshape(-1, 3).T
        told = np.flatnonzero(bits[number] != 0)
        return pa.RecordBatch.from_arrays([pa.array(chunk[told]), pa.array(segment[told].astype(np.int32)), pa.array(bits[number[told]])],
                                          names=["chunk", "segment", "windows"])


def _search_shards(batches: Iterator[pa.RecordBatch], shard_words: int) -> Iterator[pa.RecordBatch]:
    """Step 3: rows come sorted by anchor and part; a shard takes whole ones."""
    shard, before = Shard(), None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("anchor", "part", "chunk", "segment", "n", "text")]
        for anchor, part, *row in zip(*columns, strict=True):
            if shard.words >= shard_words and (anchor, part) != before:
                yield shard.answers()
                shard = Shard()
            before = (anchor, part)
            shard.add(*row)
    if shard.asked:
        yield shard.answers()


def _cut(hot: int):
    """Step 4: each document's repeated words go."""

    def run(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        texts = _texts(rows.column("text"))
        is_mark = told.column("anchor").is_valid().to_numpy()
        marks, answers = told.filter(pa.array(is_mark)), told.filter(pa.array(~is_mark))
        found, known, _ = _repeated(texts, marks.column("anchor").to_numpy(), marks.column("n").to_numpy(), hot)
        bits = np.zeros(len(known), dtype=np.int64)
        bits[answers.column("segment").to_numpy()] = answers.column("n").to_numpy()
        gone: dict[int, np.ndarray] = {}
        for each in found:
            if len(each.number) and bits[each.number].any():
                gone.update(_gone(each, bits[each.number], texts))
        spans, n_removed, kept = [], [], []
        for i, text in enumerate(texts):
            mask = gone.get(i)
            edges = np.zeros(0, dtype=np.int64) if mask is None else np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
            spans.append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
            n_removed.append(0 if mask is None else int(mask.sum()))
            kept.append((text if mask is None else b" ".join(compress(text.split(b" "), (mask == 0).tolist()))).decode())
        n_words = [t.count(b" ") + 1 if t else 0 for t in texts]
        return pa.Table.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                     pa.array(spans, _RESULT_TYPE.field("spans").type), pa.array(kept, pa.string())], schema=_RESULT_TYPE)

    return run


def _gone(found: Found, bits: np.ndarray, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(text, 1 for each word covered by a repeated window) of the slab's texts that have one."""
    change = np.zeros(len(found.slab.starts) + 1, dtype=np.int64)
    for w in range(int((found.last - found.first).max()) + 1):
        at = found.first[(bits >> w) & 1 == 1] + w
        np.add.at(change, at, 1)
        np.add.at(change, at + WINDOW, -1)
    covered = (np.cumsum(change[:-1]) > 0).astype(np.int8)
    at = 0
    for i in found.texts:
        n = texts[i].count(b" ") + 1
        if covered[at : at + n].any():
            yield i, covered[at : at + n]
        at += n


def remove_repeats(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, hot: int = HOT_SEGMENTS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept) of every row: removed word ranges (end exclusive) and what is left."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    # The partition tells repeated rows apart.
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(chunks)))
    # All three steps read the same columns, so that the texts are shuffled once.  Equal anchors meet once a chunk; the window adds up instead of a join back to the chunks.
    marks = dealt.groupBy("chunk").applyInArrow(_marks, MARK)
    every = Window.partitionBy("anchor")
    marks = marks.select("chunk", "anchor", F.sum("n").over(every).alias("_n"), F.sum("different").over(every).alias("n")) \
        .filter("_n > 1").drop("_n")
    segments = dealt.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(_segments(hot), SEGMENT)
    sorted_ = segments.repartition(chunks, "anchor", "part").sortWithinPartitions("anchor", "part")
    answers = sorted_.mapInArrow(lambda batches: _search_shards(batches, shard_words), ANSWER)
    none = F.lit(None).cast("long")
    told = marks.select("chunk", "anchor", F.lit(None).cast("int").alias("segment"), "n") \
        .unionByName(answers.select("chunk", none.alias("anchor"), "segment", F.col("windows").alias("n")))
    return dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_cut(hot), RESULT)


def op11_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The same removal from lists of words.
ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (
  SELECT d, p, array_to_string(ws[p:p+34], ' ') AS w
  FROM (SELECT d, ws, unnest(range(1, greatest(len(ws) - 34, 0) + 1)) AS p FROM docs)),
repeated AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
gone AS (SELECT DISTINCT d, unnest(range(p, p + 35)) AS place FROM windows JOIN repeated USING (w)),
words AS (SELECT d, unnest(range(1, len(ws) + 1)) AS place, unnest(ws) AS word FROM docs),
kept AS (SELECT d, string_agg(word, ' ' ORDER BY place) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (d, place) GROUP BY d)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (d)
"""
