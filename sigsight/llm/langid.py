"""Language identification by language-bitmask n-gram filters.

Every language has a Bloom filter of the byte 4-grams of its training rows.  The filters are
bit-sliced: slot ``s`` is one word whose bit ``l`` belongs to language ``l``, so
a gram's ``PROBES`` slots and-ed together give at once all languages that hold
it.  A text's grams are looked up, the bits are counted per language, and each
count is corrected for the share of lookups that the language's filter answers
wrongly: ``(hits - n * f) / (1 - f)`` with ``f = fill ** PROBES``.  The language
with the largest corrected share wins (ties: the first in sort order); the score
is that share, 0 to 1.  The filters are as large as the sample's grams ask for.

Defined cases: null text, or text without a letter: ``und`` with score 0; no
gram known to any language: the language with most training rows, score 0;
null, empty or repeated rows are answered row by row; columns other than
``doc_id``, ``text`` and ``lang`` are ignored; an empty table gives no rows;
a table without training rows gives ``und`` everywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigsight.llm.common import fold, slabs, table, utf8

GRAM = 4
PROBES = 2
#: A filter has so many slots for each gram of the language with most of them, 2^18 at least.
SLOTS_PER_GRAM = 8
LEAST_SLOTS_LOG2 = 18
# Fixed odd multipliers of the two probes.
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)
#: Training bound: about so many rows of each language, taken by a hash of doc_id and text.
ROWS_PER_LANGUAGE = 2000
UNDETERMINED = "und"
# A letter is what str.isalpha calls one; word signs that are none are digits and numbers such as "\u00bd".
_WORD_SIGN = re.compile(r"[^\W\d_]")


def _folding() -> np.ndarray:
    """ASCII letters to lower case, other ASCII to a space, bytes from 128 as they are."""
    to = np.full(256, 32, dtype=np.uint8)
    to[128:] = np.arange(128, 256)
    to[97:123] = np.arange(97, 123)
    to[65:91] = np.arange(97, 123)
    return to


FOLDING = _folding()


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """4-grams of the texts (as integers) and the number of the text each belongs to.

    Runs of spaces count as one; each text stands between spaces.
    """
    blob = np.frombuffer(b"".join(b" " + t + b" " for t in texts), dtype=np.uint8)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    folded = FOLDING[blob]
    space = folded == 32
    keep = np.ones(len(folded), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1] & (owner[1:] == owner[:-1]))
    folded, owner = folded[keep].astype(np.uint64), owner[keep]
    if len(folded) < GRAM:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    n = len(folded) - GRAM + 1
    code = np.zeros(n, dtype=np.uint64)
    for i in range(GRAM):
        code = (code << np.uint64(8)) | folded[i : i + n]
    whole = owner[:n] == owner[GRAM - 1 :]
    return code[whole], owner[:n][whole]


def _slots(code: np.ndarray, probe: int, log2: int) -> np.ndarray:
    return ((code * MULTIPLIERS[probe]) >> np.uint64(64 - log2)).astype(np.int64)


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _WORD_SIGN.finditer(text))


@dataclass
class Filters:
    """Bit-sliced Bloom filters; 64 languages to a slice."""

    languages: list[str]
    slices: list[np.ndarray]
    false_rate: np.ndarray
    fallback: str

    @classmethod
    def build(cls, by_language: dict[str, np.ndarray], fallback: str) -> Filters:
        languages = sorted(by_language)
        most = max((len(g) for g in by_language.values()), default=1)
        log2 = max(LEAST_SLOTS_LOG2, int(most * SLOTS_PER_GRAM - 1).bit_length())
        slices = [np.zeros(1 << log2, dtype=np.uint64) for _ in range(0, max(1, len(languages)), 64)]
        fill = np.zeros(len(languages))
        for i, lang in enumerate(languages):
            bit = np.uint64(1) << np.uint64(i % 64)
            words = slices[i // 64]
            for probe in range(PROBES):
                words[np.unique(_slots(by_language[lang], probe, log2))] |= bit
            fill[i] = np.count_nonzero(words & bit) / len(words)
        return cls(languages, slices, fill**PROBES, fallback)

    def shares(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share of each text's grams that each language holds, and the number of its grams."""
        code, owner = grams(texts)
        log2 = len(self.slices[0]).bit_length() - 1 if self.slices else 0
        total = np.bincount(owner, minlength=len(texts)).astype(float)
        out = np.zeros((len(texts), len(self.languages)))
        for k, words in enumerate(self.slices):
            held = words[_slots(code, 0, log2)]
            for probe in range(1, PROBES):
                held &= words[_slots(code, probe, log2)]
            for i in range(64 * k, min(64 * k + 64, len(self.languages))):
                one = ((held >> np.uint64(i % 64)) & np.uint64(1)).astype(bool)
                hits = np.bincount(owner[one], minlength=len(texts))
                out[:, i] = (hits - total * self.false_rate[i]) / (1 - self.false_rate[i])
        return np.clip(out / np.maximum(total, 1)[:, None], 0.0, 1.0), total

    def decide(self, texts: pd.Series) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Each text's language, score and number of grams."""
        raw = utf8(texts)
        names, scores, looked_up = [UNDETERMINED] * len(raw), np.zeros(len(raw)), np.zeros(len(raw))
        if not self.languages:
            return names, scores, looked_up
        lettered = [isinstance(t, str) and has_letter(t) for t in texts]
        for a, b in slabs(raw):
            shares, looked_up[a:b] = self.shares(raw[a:b])
            best = shares.argmax(axis=1)
            for i in range(a, b):
                if lettered[i]:
                    scores[i] = shares[i - a, best[i - a]]
                    names[i] = self.languages[best[i - a]] if scores[i] > 0 else self.fallback
        return names, scores, looked_up


def _distinct_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, part in batch.groupby("lang"):
            raw = utf8(part["text"])
            for a, b in slabs(raw, 1 << 22):
                yield pd.DataFrame({"lang": lang, "gram": np.unique(grams(raw[a:b])[0]).astype(np.int64)})


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Filters:
    """Filters of all grams of the sampled rows of known language; those grams alone are gathered on the driver."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not rows:
        return Filters([], [], np.zeros(0), UNDETERMINED)
    fallback = min(rows, key=lambda k: (-rows[k], k))
    scale = 1 << 30
    bar = F.create_map(*[F.lit(x) for k, n in rows.items() for x in (k, min(scale, int(scale * rows_per_language / n)))])
    sample = known.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(scale)) < F.element_at(bar, F.col("lang")))
    held = sample.select("lang", "text").mapInPandas(_distinct_grams, "lang string, gram long").distinct().toPandas()
    return Filters.build({k: g["gram"].to_numpy().astype(np.uint64) for k, g in held.groupby("lang")}, fallback)


def identify(docs: DataFrame, filters: Filters, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each row with lang_pred, score and the number of n-grams looked up."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    @F.pandas_udf("lang_pred string, score double, n_grams long")
    def decide(text: pd.Series) -> pd.DataFrame:
        names, scores, looked_up = shared.value.decide(text)
        return pd.DataFrame({"lang_pred": names, "score": scores, "n_grams": looked_up.astype(np.int64)})

    return docs.withColumn("_found", decide("text")).select(*keep, "_found.lang_pred", "_found.score", "_found.n_grams")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from the other folds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", fold(3) == 1)
    filters = train(docs.filter(~F.col("held_out")))
    return identify(docs.drop("lang"), filters, ["doc_id", "held_out"])
