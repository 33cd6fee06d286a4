"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are hashed words, hashed 3-grams of its outline (runs of letters,
digits and spaces shrunk to one sign, punctuation as it is) and the repetition
of a word by the next one.  Weighted term frequencies of a bounded labelled
sample give, by a truncated singular value decomposition, the latent space.  The
sample's vectors are broadcast; every document's vector is multiplied with all
of them, block by block, and its ``NEIGHBOURS`` most similar rows vote with
their similarity to the power ``SHARPNESS``.

Defined cases: null text is empty; a text without terms, or one without a
similar row, scores the sample's share of label 1 (0.5 without any labelled
row); equal texts score equally; ties in similarity go to the row that comes
first by doc_id; repeated labels of a doc_id count once, the larger one; columns
other than those named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigsight.llm.common import fold, slabs, table, utf8

#: Training bound: about so many labelled rows, taken by a hash of doc_id.
SAMPLE_ROWS = 3000
RANK = 48
NEIGHBOURS = 25
SHARPNESS = 6
OUTLINE_TERMS = 2048
WORD_TERMS = 1024
TERMS = OUTLINE_TERMS + WORD_TERMS + 1
WORD_WEIGHT = 0.3
THRESHOLD = 0.7
BLOCK = 512
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def _signs() -> np.ndarray:
    """Outline sign of each byte: 0 capital, 1 small, 2 other letter, 3 digit, 4 space; ASCII punctuation itself."""
    sign = np.arange(256, dtype=np.uint8)
    sign[128:] = 2
    sign[:33] = 4
    sign[10] = 10
    sign[48:58] = 3
    sign[65:91] = 0
    sign[97:123] = 1
    return sign


SIGNS = _signs()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    up = np.full(n, np.uint64(_BASE))
    up[0] = 1
    down = np.full(n, np.uint64(pow(_BASE, -1, 1 << 64)))
    down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def term_counts(texts: list[bytes]) -> np.ndarray:
    """Term frequencies (rows: texts), each block of terms scaled to its own total."""
    n = len(texts)
    blob = np.frombuffer(b"".join(t + b"\n" for t in texts), dtype=np.uint8)
    owner = np.repeat(np.arange(n), [len(t) + 1 for t in texts])
    sign = SIGNS[blob]
    shrunk = np.ones(len(sign), dtype=bool)
    shrunk[1:] = (sign[1:] != sign[:-1]) | (sign[1:] > 4) | (owner[1:] != owner[:-1])
    line, mine = sign[shrunk].astype(np.uint64), owner[shrunk]
    gram = (line[:-2] << np.uint64(16)) | (line[1:-1] << np.uint64(8)) | line[2:]
    whole = mine[:-2] == mine[2:]
    outline = ((gram[whole] * _MIX) >> np.uint64(53)).astype(np.int64) % OUTLINE_TERMS
    out = np.zeros((n, TERMS))
    out[:, :OUTLINE_TERMS] = _frequencies(mine[:-2][whole], outline, n, OUTLINE_TERMS)

    letter = SIGNS[blob] <= 2
    edge = np.flatnonzero(np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(len(blob) + 1)
    small = np.where(sign == 0, blob + 32, blob).astype(np.uint64)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(small * up[:-1], dtype=np.uint64)])
    word = (sums[ends] - sums[starts]) * down[starts]
    whose = owner[starts]
    bucket = ((word * _MIX) >> np.uint64(54)).astype(np.int64) % WORD_TERMS
    out[:, OUTLINE_TERMS : OUTLINE_TERMS + WORD_TERMS] = _frequencies(whose, bucket, n, WORD_TERMS)
    again = (word[1:] == word[:-1]) & (whose[1:] == whose[:-1])
    words = np.maximum(np.bincount(whose, minlength=n), 1)
    out[:, -1] = np.bincount(whose[1:][again], minlength=n) / words
    return out


def _frequencies(owner: np.ndarray, term: np.ndarray, n: int, width: int) -> np.ndarray:
    counts = np.bincount(owner * width + term, minlength=n * width).reshape(n, width)
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


@dataclass
class Voters:
    """The latent space and the labelled vectors in it."""

    weight: np.ndarray
    space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @classmethod
    def fit(cls, counts: np.ndarray, labels: np.ndarray, rank: int = RANK) -> Voters:
        rare = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1
        rare[OUTLINE_TERMS:-1] *= WORD_WEIGHT
        rows = np.sqrt(counts) * rare
        rank = min(rank, *rows.shape)
        # Truncated SVD by subspace iteration from a fixed start.
        basis = np.random.default_rng(7).standard_normal((rows.shape[1], min(rank + 8, *rows.shape)))
        for _ in range(4):
            basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
        _, _, turn = np.linalg.svd(rows @ basis, full_matrices=False)
        space = basis @ turn[:rank].T
        return cls(rare.astype(np.float32), space.astype(np.float32), _unit(rows @ space).astype(np.float32),
                   labels.astype(np.float32))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        out = np.full(len(texts), float(self.labels.mean()))
        k = min(NEIGHBOURS, len(self.labels))
        for a, b in slabs(texts):
            for c in range(a, b, BLOCK):
                d = min(b, c + BLOCK)
                rows = np.sqrt(term_counts(texts[c:d])).astype(np.float32) * self.weight
                near = _unit(rows @ self.space) @ self.vectors.T
                cut = np.partition(near, -k, axis=1)[:, -k][:, None]
                # All rows more similar than the k-th, then those as similar as it in order, up to k.
                above, equal = near > cut, near == cut
                chosen = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)))
                votes = np.where(chosen, np.maximum(near, 0), 0) ** SHARPNESS
                total = votes.sum(axis=1)
                told = total > 1e-9
                out[c:d][told] = (votes @ self.labels)[told] / total[told]
        return np.clip(out, 0.0, 1.0)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-12)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Voters:
    """Voters from labelled rows (doc_id, label); the sampled rows alone reach the driver."""
    known = labels.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    n, scale = known.count(), 1 << 30
    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < int(scale * min(1.0, sample_rows / max(n, 1))))

    def counted(text: pd.Series) -> pd.Series:
        raw = utf8(text)
        rows = [r for a, b in slabs(raw) for c in range(a, b, BLOCK) for r in term_counts(raw[c : min(b, c + BLOCK)])]
        return pd.Series([np.stack([np.flatnonzero(r), r[r > 0]]).ravel().tolist() for r in rows], dtype=object)

    counts = F.pandas_udf(counted, "array<double>")
    # Of rows that share an id the smallest text is learned from.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")) \
        .select("doc_id", "label", counts("text").alias("terms")).toPandas()
    rows = rows.sort_values("doc_id")
    matrix = np.zeros((len(rows), TERMS))
    for i, terms in enumerate(rows["terms"]):
        half = len(terms) // 2
        matrix[i, np.asarray(terms[:half], dtype=np.int64)] = terms[half:]
    if not len(rows):
        none = np.zeros((0, 0), dtype=np.float32)
        return Voters(none, none, none, np.zeros(0, dtype=np.float32))
    return Voters.fit(matrix, rows["label"].to_numpy())


def vote(docs: DataFrame, voters: Voters, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each row with its score."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(utf8(text)).astype(float))

    return docs.select(*keep, score("text").alias("score"))


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learned from the other folds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold(4) == 2)
    labels = table(spark, sf_dir, "labels").filter(fold(4) != 2) \
        .select("doc_id", F.col("quality").cast("double").alias("label"))
    voters = train(docs.filter(~F.col("held_out")), labels)
    return vote(docs, voters, ["doc_id", "held_out"]) \
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
