"""SimHash near-duplicates through an inverted index of positional bytes.

A 64-bit fingerprint is eight positional bytes.  Fingerprints that differ in at
most four bits share at least four of them, and every choice of four positions
holds one of the twenty position triples in ``TRIPLES``.  So the index lists
each distinct fingerprint under its twenty triples; within a posting, pairs
whose tally of shared positional bytes reaches the guaranteed minimum are kept
and verified by their differing bits.  A posting yields only the edges of a
spanning forest, never all its pairs; large postings are listed again under a
fourth byte.  Equal fingerprints are one entry from the start.

Defined cases: a null or wordless text has fingerprint zero and links like any
other; fewer words than the shingle length form one shingle; repeated rows
share a fingerprint; very long texts are hashed whole; rows with a null doc_id
link like any other, and a component's id is the least one that is not null (null
if there is none); columns other than ``doc_id`` and ``text`` are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigsight.llm.common import table, utf8
from sigsight.llm.graph import components
from sigsight.session import cut_lineage

SHINGLE = 4
DISTANCE = 4
SEED = 42
POSITIONS = 8
#: Rows of one fingerprint that don't move to meet its component, and the share of all rows beyond which they don't:
#: so at most HOT_SHARES fingerprints are broadcast.
HOT_ROWS = 10_000
HOT_SHARES = 10_000
#: A posting of more fingerprints than this is listed again under a fourth byte.
LARGE_POSTING = 4096


def _triples() -> list[tuple[int, int, int]]:
    """Position triples such that any four of the eight positions hold one.

    The positions fall into three classes in a ring; a triple lies inside a
    class, or has two positions in a class and one in the next.
    """
    of = [p % 3 for p in range(POSITIONS)]
    out = []
    for a in range(POSITIONS):
        for b in range(a + 1, POSITIONS):
            for c in range(b + 1, POSITIONS):
                n = [sum(of[p] == k for p in (a, b, c)) for k in range(3)]
                if any(n[k] == 3 or (n[k] == 2 and n[(k + 1) % 3] == 1) for k in range(3)):
                    out.append((a, b, c))
    return out


TRIPLES = _triples()


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = min(shingle, len(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - n]]
    hashes = np.array([xxhash.xxh64_intdigest(line[a : b - 1], SEED) for a, b in zip(starts, ends[n - 1 :], strict=True)],
                      dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = ones * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """(doc_id or the columns ``keep``, fp): the fingerprint's bits as a signed long."""

    @F.pandas_udf("long")
    def simhash(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in utf8(text)], dtype=np.uint64).view(np.int64))

    return docs.select(*(keep or ["doc_id"]), simhash("text").alias("fp"))


def linked(one: np.uint64, others: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Which of the others link to ``one``: tally shared positional bytes, then verify."""
    differing = others ^ one
    shared = (differing.view(np.uint8).reshape(-1, POSITIONS) == 0).sum(axis=1)
    kept = shared >= POSITIONS - distance
    kept[kept] = np.bitwise_count(differing[kept]) <= distance
    return kept


def forest(fps: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """For each fingerprint the index of the first one in its group of linked ones."""
    root = np.arange(len(fps))
    left = np.arange(len(fps))
    while len(left) > 1:
        first, left = left[0], left[1:]
        todo = [first]
        while todo and len(left):
            found = linked(fps[todo.pop()], fps[left], distance)
            if found.any():
                todo += left[found].tolist()
                root[left[found]] = first
                left = left[~found]
    return root


def _postings_to_edges(distance: int):
    def edges(group: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        ids, fps = group
        if len(fps) < 2:
            return ids[:0], ids[:0]
        root = forest(fps, distance)
        tied = root != np.arange(len(fps))
        return ids[tied], ids[root[tied]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by posting; only the posting in hand is kept between batches."""
        held: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            key = rows[["key", "fourth"]].to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            yield from _edges(rows.iloc[:last], cuts, edges)
            held = rows.iloc[last:].reset_index(drop=True)
        if held is not None:
            yield from _edges(held, np.array([len(held)]), edges)

    return run


def _edges(rows: pd.DataFrame, cuts: np.ndarray, edges) -> Iterator[pd.DataFrame]:
    ids, fps = rows["root"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
    found, at = [], 0
    for cut in cuts.tolist():
        found.append(edges((ids[at:cut], fps[at:cut])))
        at = cut
    if found:
        yield pd.DataFrame({"u": np.concatenate([u for u, _ in found]), "v": np.concatenate([v for _, v in found])})


def _byte(position: int):
    return F.shiftrightunsigned("fp", 8 * position).bitwiseAND(F.lit(255))


def postings(classes: DataFrame) -> DataFrame:
    """(key, fourth, fp, root): ``classes`` under their triples, in large postings under a fourth byte outside the triple."""
    keys = [
        sum((_byte(p) * F.lit(256**i) for i, p in enumerate(t)), F.lit(k << 24)) for k, t in enumerate(TRIPLES)
    ]
    listed = classes.select("root", "fp", F.explode(F.array(*keys)).alias("key"))
    listed = listed.withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1")
    # The fourth byte, with its position; triples take three of the positions, so it is one of the other five.
    fourth = F.array(*[_byte(p) + F.lit(256 * (p + 1)) for p in range(POSITIONS)])
    listed = listed.withColumn("fourth", F.explode(F.when(F.col("n") > LARGE_POSTING, fourth).otherwise(F.array(F.lit(0).cast("long")))))
    others = F.array(*[F.array(F.lit(0), *[F.lit(p + 1) for p in range(POSITIONS) if p not in t]) for t in TRIPLES])
    allowed = F.element_at(others, (F.shiftright("key", 24) + 1).cast("int"))
    return listed.filter(F.array_contains(allowed, F.shiftright("fourth", 8).cast("int"))).select("key", "fourth", "fp", "root")


def links(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (u, v) between roots of ``classes`` (root, fp) that connect what links within ``distance``.

    Needs ``distance`` of 4 at most: beyond it, four shared bytes are not guaranteed.
    """
    if distance > POSITIONS - 4:
        raise ValueError("the index guarantees four shared bytes up to a distance of 4")
    dealt = postings(classes).repartition("key", "fourth").sortWithinPartitions("key", "fourth", "fp")
    return dealt.mapInPandas(_postings_to_edges(distance), "u long, v long")


def grouped(marked: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Rows with a fingerprint ``fp`` and their ``doc_id``, with their ``group`` (a fingerprint of the component) and ``component_id``.

    Fingerprints are linked, whoever holds them; ids come in afterwards.
    ``marked`` is read several times: hand over a checkpointed frame.
    """
    classes = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    found = components(links(classes.select(F.col("fp").alias("root"), "fp"), distance))
    named = classes.join(found, F.col("fp") == F.col("node"), "left") \
        .select("fp", "least", "n", F.coalesce("component", "fp").alias("group"))
    ids = named.groupBy("group").agg(F.min("least").alias("component_id"))
    named = cut_lineage(named.join(ids, "group").select("fp", "n", "group", "component_id"))
    # Fingerprints that many rows share are few: their rows stay where they are, and meet them in a broadcast.
    rows = classes.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(named.filter(F.col("n") > max(HOT_ROWS, rows // HOT_SHARES)).drop("n"))
    return marked.join(hot, "fp").unionByName(marked.join(hot, "fp", "left_anti").join(named.drop("n"), "fp"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``."""
    return grouped(cut_lineage(fingerprints(docs, shingle)), distance).select("doc_id", "fp", "component_id")


def op7_simhash_near_dups(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint in hex, component_id of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
