"""Packing into training sequences by vector bin packing.

Each example is a vector (tokens, segments, loss-bearing tokens), each sequence
a bin with a limit in every dimension.  The next example placed is the one that
fits and has the largest dot product with the room left; if none fits, the best
one is cut to fill the room.  Whole sequences of a long document need no
packing; the rest of each document enters a pool, and each task packs the pool
of its own input split, so nothing is shuffled and no group is gathered.

A sequence that ends short (segment limit, end of the split) is divided into
sequences whose lengths are powers of two, which need no padding.

Of an example the last tokens are loss-bearing, as many as a column of ``pack``
says (an answer behind its prompt; without the column all are); a cut example
keeps them where they are.

Token ids are those of ``tokenizers``.  tiktoken gives the same several times
faster where the file is a plain byte-level BPE with merges in id order, which is
checked; with any other file tokenizers does all of the work.

Defined cases: a null or empty text is the end token alone; each of several
equal rows is packed for itself; a null doc_id stays null; a null loss count is
0, one beyond the tokens all of them; very long texts become many full
sequences; other columns are ignored; an empty table gives no rows.  Sequence
numbers are the input split's number and a counter within it.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sigsight.llm.common import table

END = 0
POOL = 1024
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 256
    loss: int = 1024


def _byte_of_sign() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable sign; this maps signs to bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def is_plain(spec: dict) -> bool:
    """Whether tiktoken can stand in: byte-level BPE by the usual pattern, merges in the order of the ids they make."""
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    if not plain or spec["normalizer"] or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return False
    made = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    special = {t["content"] for t in spec["added_tokens"]}
    others = [t for t in model["vocab"] if len(t) > 1 and t not in special]
    return None not in made and made == sorted(set(made)) and len(others) == len(made)


@lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding | None:
    """The vocabulary of a tokenizers file for tiktoken; None if that would not give the same ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if not is_plain(spec):
        return None
    signs = _byte_of_sign()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(signs[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def encode(path: str, text: str) -> np.ndarray:
    """The ids that ``tokenizers`` gives.

    tiktoken's regex engine gives up on white-space runs of about a million
    characters; such a text is encoded by tokenizers itself.
    """
    fast = encoder(path)
    try:
        if fast is not None:
            return fast.encode_to_numpy(text, allowed_special="all")
    except ValueError:
        pass
    return np.array(_tokenizer(path).encode(text, add_special_tokens=False).ids, dtype="<u4")


def head_of(loss: int, length: int, n: int) -> int:
    """Loss-bearing tokens among the first ``n`` of ``length``, of which the last ``loss`` are loss-bearing."""
    return max(0, n - (length - loss))


class Packer:
    """Packs the examples of one input split; examples wait in a bounded pool."""

    def __init__(self, limits: Limits, first_sequence: int, cut: bool = True):
        self.limits = limits
        self.room_of = np.array([limits.tokens, limits.segments, limits.loss], dtype=np.int64)
        self.next = first_sequence
        self.cut = cut
        self.vectors = np.empty((0, 3), dtype=np.int64)
        self.examples: list[tuple] = []
        self.pieces: list[tuple] = []

    def add(self, examples: list[tuple], vectors: list[tuple[int, int, int]]) -> None:
        """Each example is (key, start, ids, total); its vector (tokens, segments, loss)."""
        self.examples += examples
        if vectors:
            self.vectors = np.concatenate([self.vectors, np.array(vectors, dtype=np.int64)])
        while len(self.examples) >= POOL:
            self.fill_one()

    def flush(self) -> None:
        while self.examples:
            self.fill_one()

    def sequence(self, members: list[tuple]) -> None:
        """Each member is (key, start, ids, total, loss)."""
        at = 0
        for key, start, ids, total, loss in members:
            self.pieces.append((key, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, at, int(loss)))
            at += len(ids)
        self.next += 1

    def _take(self, i: int) -> tuple:
        taken = (*self.examples[i], self.vectors[i, 2])
        last = len(self.examples) - 1
        self.examples[i], self.vectors[i] = self.examples[last], self.vectors[last]
        self.examples.pop()
        self.vectors = self.vectors[:last]
        return taken

    def fill_one(self) -> None:
        room, members = self.room_of.copy(), []
        while len(self.examples) and room[:2].min() > 0:
            worth = (self.vectors / self.room_of) @ (room / self.room_of)
            fits = (self.vectors <= room).all(axis=1)
            if fits.any():
                i = int(np.where(fits, worth, -1.0).argmax())
                room -= self.vectors[i]
                members.append(self._take(i))
            elif self.cut and len(some := np.flatnonzero(self._heads(room))):
                members.append(self._cut(int(some[worth[some].argmax()]), room))
            elif members:
                break
            else:
                raise ValueError("an example exceeds the limits and cutting is off")
        self._close(members)

    def _heads(self, room: np.ndarray) -> np.ndarray:
        """How many of each example's first tokens the room takes; the loss-bearing ones are its last."""
        return np.minimum(np.minimum(self.vectors[:, 0], room[0]), self.vectors[:, 0] - self.vectors[:, 2] + room[2])

    def _cut(self, i: int, room: np.ndarray) -> tuple:
        """The head of example ``i`` that fills the room; its tail stays in the pool."""
        key, start, ids, total = self.examples[i]
        n, loss = int(self._heads(room)[i]), int(self.vectors[i, 2])
        head_loss = head_of(loss, len(ids), n)
        self.examples[i] = (key, start + n, ids[n:], total)
        self.vectors[i] = (len(ids) - n, 1, loss - head_loss)
        room -= np.array([n, 1, head_loss])
        if n == len(ids):
            self._take(i)
        return key, start, ids[:n], total, head_loss

    def _close(self, members: list[tuple]) -> None:
        left = sum(len(m[2]) for m in members)
        if not self.cut or left == self.limits.tokens:
            self.sequence(members)
            return
        members.reverse()
        while left:
            size = 1 << (left.bit_length() - 1)
            part, need = [], size
            while need:
                key, start, ids, total, loss = members.pop()
                if len(ids) > need:
                    head_loss = head_of(loss, len(ids), need)
                    members.append((key, start + need, ids[need:], total, loss - head_loss))
                    ids, loss = ids[:need], head_loss
                part.append((key, start, ids, total, loss))
                need -= len(ids)
            self.sequence(part)
            left -= size


def _pack_split(path: str, limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits, TaskContext.get().partitionId() << 40)
        for batch in batches:
            counts = batch.column("loss").to_pylist()
            for key, text, count in zip(batch.column("doc_id").to_pylist(), batch.column("text"), counts, strict=True):
                ids = np.append(encode(path, text.as_py() or ""), END).astype("<u4")
                loss = min(max(count or 0, 0), len(ids))
                at, full = 0, limits.tokens
                while len(ids) - at >= full and (head := head_of(loss, len(ids) - at, full)) <= limits.loss:
                    packer.sequence([(key, at, ids[at : at + full], len(ids), head)])
                    at, loss = at + full, loss - head
                if at < len(ids):
                    packer.add([(key, at, ids[at:], len(ids))], [(len(ids) - at, 1, loss)])
            yield _rows(packer)
        packer.flush()
        yield _rows(packer)

    return run


def _rows(packer: Packer) -> pa.RecordBatch:
    columns = list(zip(*packer.pieces, strict=True)) or [()] * len(_COLUMNS)
    packer.pieces = []
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=_COLUMNS)


def pack(docs: DataFrame, path: str | None = None, limits: Limits = Limits(), loss: str | None = None) -> DataFrame:
    """The pieces of every row's token ids, packed within ``limits``.

    ``loss`` names a column with the number of loss-bearing tokens at an example's
    end, the end token included; without it all tokens are loss-bearing.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    counted = docs[loss].cast("long") if loss else F.lit(1 << 60)
    rows = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"), counted.alias("loss"))
    return rows.mapInArrow(_pack_split(path, limits), SCHEMA)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    return pack(table(spark, sf_dir, "documents"))
