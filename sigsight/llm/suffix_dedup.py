"""Removal of byte strings that an earlier document holds, by a distributed suffix merge sort.

A byte goes if a ``WINDOW``-byte string over it also starts in a document with a
smaller doc_id.  Sorting every suffix would move many times the text, so the
sort takes anchored suffixes: in each window the ``GRAM``-byte string of least
hash is its anchor, hence equal windows have their anchor at the same offset.

1. Documents are dealt into chunks.  Each chunk sends the hashes of its anchors
   to buckets; a bucket answers, one bit each, which ones several documents hold.
2. Each chunk sorts the suffixes at those anchors (with the bytes before the
   anchor behind them, nearest first), equal ones once with their smallest
   document, and sends them front-coded, split into key ranges.
3. Each range merges its sorted runs with a loser tree that keeps, per run, the
   prefix shared with the last suffix put out, so that known prefixes are never
   compared again; the merge yields the shared prefixes of neighbours.  Suffixes
   that share the anchor stand together; for every window around the anchor the
   smallest document is found and answered to the chunks.
   An anchor with more than ``HOT_CONTEXTS`` different contexts, as counted a
   chunk in step 1, does not enter the sort: its windows are dealt by their bytes
   to buckets, once a chunk, and a bucket answers the smallest document of each.
4. Each chunk marks and cuts its documents.

Sampled key ranges balance the load; they do not touch the result.  A bucket or
range holds a suffix at most once a chunk, however often documents repeat it.

Defined cases: null text is empty and documents under WINDOW bytes stay whole; a
null doc_id counts as larger than any other; rows of one doc_id never remove
from each other; very long texts are one document in one chunk; columns other
than doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigsight.llm.common import slabs, table, whole_text

WINDOW = 50
GRAM = 20
BEFORE = WINDOW - GRAM
OFFSETS = BEFORE + 1
KEY = WINDOW + BEFORE + 2
CHUNK_BYTES = 8 << 20
#: Rows whose anchors are sampled for the key ranges.
SAMPLE_ROWS = 2000
#: Contexts of an anchor above which its windows are dealt out one by one.
HOT_CONTEXTS = 1 << 15
#: Fewer occurrences of an anchor in a chunk count as one context.
MANY = 4
#: Buckets of dealt windows to a chunk.
SPREAD = 8
LAST = (1 << 63) - 1
SLAB = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
ANSWER = "chunk long, part long, piece long, plain binary, single binary, minima binary, windows binary"
ANSWER_COLUMNS = [c.split()[0] for c in ANSWER.split(", ")]
RESULT = "rank long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every ``width`` neighbours."""
    done = 1
    while done * 2 <= width:
        x = pick(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(n, SLAB + 1).bit_length()
    if size not in _POWERS:
        _POWERS.clear()
        pair = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        _POWERS[size] = (pair[0], pair[1])
    up, down = _POWERS[size]
    return up[:n], down[:n]


def _rank(code: np.ndarray) -> np.ndarray:
    """The order of strings as anchors; mixes their hashes in place."""
    code ^= code >> np.uint64(32)
    code *= _MIX
    code ^= code >> np.uint64(29)
    return (code >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def anchors(blob: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of all windows that lie in one document, and their hashes."""
    n = len(blob)
    if n < WINDOW:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((blob.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    code = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]
    rank = _rank(code)
    least = _slide(rank, OFFSETS, np.minimum)
    least[owner[: len(least)] != owner[WINDOW - 1 : WINDOW - 1 + len(least)]] = 0
    edge = np.zeros(BEFORE, dtype=np.uint32)
    chosen = rank == _slide(np.concatenate([edge, least, edge]), OFFSETS, np.maximum)
    at = np.flatnonzero(chosen)
    return at, code[at]


class Chunk:
    """The documents of a chunk, by rank, and the anchors in them."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values("rank", kind="stable")
        self.ranks = rows["rank"].to_numpy()
        self.texts = [bytes(t) for t in rows["text"]]
        self.slabs = list(slabs(self.texts, SLAB))
        self.found = [anchors(blob, owner) for blob, _, owner in (self.slab(a, b) for a, b in self.slabs)]

    def slab(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of some documents, the begin of each, and the document of each byte."""
        sizes = [len(t) for t in self.texts[a:b]]
        return (np.frombuffer(b"".join(self.texts[a:b]), dtype=np.uint8), np.cumsum([0, *sizes]),
                np.repeat(np.arange(b - a), sizes))

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchor hashes, sorted, and whether several documents of the chunk hold each."""
        codes, docs = [], []
        for (a, b), (at, code) in zip(self.slabs, self.found, strict=True):
            ends = np.cumsum([len(t) for t in self.texts[a:b]])
            codes.append(code)
            docs.append(self.ranks[a:b][np.searchsorted(ends, at, side="right")])
        code, doc = np.concatenate([*codes, np.empty(0, np.uint64)]), np.concatenate([*docs, np.empty(0, np.int64)])
        if not len(code):
            return code, np.empty(0, dtype=bool)
        order = np.argsort(code, kind="stable")
        code, doc = code[order], doc[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        return code[first], several

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """The anchor hashes with ``MANY`` occurrences or more, sorted, and the number of different contexts of each."""
        code, n = np.unique(np.concatenate([*(c for _, c in self.found), np.empty(0, np.uint64)]), return_counts=True)
        return np.unique(self.suffixes(code[n >= MANY]).code, return_counts=True)

    def suffixes(self, repeated: np.ndarray) -> Suffixes:
        """The suffixes at the anchors whose hash is among the sorted ``repeated``."""
        keys, where, whose, codes = [], [], [], []
        for n, (a, b) in enumerate(self.slabs):
            at, code = self.found[n]
            if not len(repeated) or not len(at):
                continue
            blob, begins, owner = self.slab(a, b)
            own = repeated[np.minimum(np.searchsorted(repeated, code), len(repeated) - 1)] == code
            at = at[own]
            doc = owner[at]
            after = np.minimum(begins[doc + 1] - at, WINDOW)
            before = np.minimum(at - begins[doc], BEFORE)
            key = np.zeros((len(at), KEY), dtype=np.uint8)
            padded = np.concatenate([np.zeros(BEFORE, np.uint8), blob, np.zeros(WINDOW, np.uint8)])
            for j in range(WINDOW):
                key[:, j] = np.where(j < after, padded[at + BEFORE + j], 0)
            for j in range(BEFORE):
                key[:, WINDOW + j] = np.where(j < before, padded[at + BEFORE - 1 - j], 0)
            key[:, -2], key[:, -1] = after + 1, before + 1
            keys.append(key)
            where.append(np.column_stack([np.full(len(at), n), at]))
            whose.append(doc + a)
            codes.append(code[own])
        if not keys:
            return Suffixes(np.zeros((0, KEY), np.uint8), np.zeros((0, 2), np.int64), np.zeros(0, np.int64), self.ranks,
                            np.zeros(0, np.uint64))
        return Suffixes(np.concatenate(keys), np.concatenate(where), np.concatenate(whose), self.ranks, np.concatenate(codes))


class Suffixes:
    """Sorted distinct keys of a chunk, the smallest document and anchor hash of each, and where they occur."""

    def __init__(self, keys: np.ndarray, where: np.ndarray, doc: np.ndarray, ranks: np.ndarray, code: np.ndarray):
        strings = np.ascontiguousarray(keys).view(f"S{KEY}").reshape(-1)
        distinct, self.of = np.unique(strings, return_inverse=True)
        self.keys = np.ascontiguousarray(distinct).view(np.uint8).reshape(-1, KEY)
        self.where, self.doc = where, doc
        self.least = np.full(len(distinct), LAST, dtype=np.int64)
        np.minimum.at(self.least, self.of, ranks[doc])
        self.code = np.zeros(len(distinct), dtype=np.uint64)
        self.code[self.of] = code

    def anchors(self) -> np.ndarray:
        """The anchor strings of the keys, sorted as they are."""
        return np.ascontiguousarray(self.keys[:, :GRAM]).view(f"S{GRAM}").reshape(-1)


def front_code(keys: np.ndarray) -> tuple[bytes, bytes]:
    """Shared prefix lengths of sorted keys with their predecessors, and what follows the shared parts."""
    same = np.zeros(len(keys), dtype=np.uint8)
    if len(keys) > 1:
        same[1:] = (keys[1:] != keys[:-1]).argmax(axis=1)
    return same.tobytes(), keys[np.arange(keys.shape[1]) >= same[:, None]].tobytes()


def front_decode(shared: bytes, tails: bytes, width: int = KEY) -> list[bytes]:
    out, last, at = [], b"", 0
    for n in shared:
        last = last[:n] + tails[at : at + width - n]
        at += width - n
        out.append(last)
    return out


def _first_difference(a: bytes, b: bytes, start: int) -> int:
    if a[start : start + 1] != b[start : start + 1]:
        return start
    x = int.from_bytes(a[start:], "big") ^ int.from_bytes(b[start:], "big")
    return len(a) - (x.bit_length() + 7) // 8


def merge_runs(runs: list[tuple[list[bytes], bytes]]) -> Iterator[tuple[int, int, int]]:
    """(shared, run, index) in sorted order; ``shared``: the prefix in common with the one before.

    ``runs``: sorted keys and their shared prefix lengths.  A loser tree: every
    inner node keeps the loser of the match played there, every run the prefix
    its head shares with the winner that beat it.  The longer shared prefix wins
    without a look at the keys; equal ones are compared from there on.
    """
    leaves = 1 << max(1, (len(runs) - 1).bit_length())
    heads = [r[0][0] if r[0] else None for r in runs] + [None] * (leaves - len(runs))
    index, shared = [0] * leaves, [0] * leaves
    losers = [-1] * leaves

    def beats(a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; sets the loser's shared prefix."""
        if heads[a] is None or heads[b] is None:
            return heads[b] is None
        if shared[a] != shared[b]:
            return shared[a] > shared[b]
        x, y, start = heads[a], heads[b], shared[a]
        at = _first_difference(x, y, start) if start < len(x) else start
        if at >= len(x) or x[at] < y[at]:
            shared[b] = at
            return True
        shared[a] = at
        return False

    def build(node: int) -> int:
        if node >= leaves:
            return node - leaves
        a, b = build(2 * node), build(2 * node + 1)
        win, lose = (a, b) if beats(a, b) else (b, a)
        losers[node] = lose
        return win

    winner = build(1)
    while heads[winner] is not None:
        yield shared[winner], winner, index[winner]
        keys, lcps = runs[winner]
        index[winner] += 1
        if index[winner] < len(keys):
            heads[winner], shared[winner] = keys[index[winner]], lcps[index[winner]]
        else:
            heads[winner] = None
        node = (winner + leaves) >> 1
        while node:
            if not beats(winner, losers[node]):
                winner, losers[node] = losers[node], winner
            node >>= 1


def window_minima(keys: np.ndarray, group: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For distinct keys, grouped by anchor, the smallest document of every window (by bytes before the anchor).

    LAST where a key has no such window.  Windows meet by a 64-bit hash; the
    bytes are compared wherever that would remove something.
    """
    order = np.argsort(least, kind="stable")
    keys, group, least = keys[order], group[order], least[order]
    line = np.concatenate([keys[:, WINDOW : WINDOW + BEFORE][:, ::-1], keys[:, :WINDOW]], axis=1)
    up, down = _powers(BEFORE + WINDOW)
    sums = np.zeros((len(keys), line.shape[1] + 1), dtype=np.uint64)
    np.cumsum((line.astype(np.uint64) + np.uint64(1)) * up, axis=1, out=sums[:, 1:])
    offsets = np.arange(OFFSETS)
    starts = BEFORE - offsets
    code = (sums[:, starts + WINDOW] - sums[:, starts]) * down[starts]
    code = (code ^ (group.astype(np.uint64) * np.uint64(_BASE))[:, None]) * _MIX + (offsets.astype(np.uint64) * np.uint64(_BASE))
    code ^= code >> np.uint64(31)
    after, before = (keys[:, c].astype(np.int64)[:, None] - 1 for c in (-2, -1))
    row, o = np.nonzero((before >= offsets) & (after >= WINDOW - offsets))
    code = code[row, o]
    # Rows come by document, so the first of equal windows has the smallest one.
    sort = np.argsort(code, kind="stable")
    new = np.append(True, code[sort][1:] != code[sort][:-1]) if len(sort) else np.zeros(0, dtype=bool)
    first = np.empty(len(sort), dtype=np.int64)
    first[sort] = sort[np.flatnonzero(new)][np.cumsum(new) - 1]
    best = row[first]
    check = np.flatnonzero(least[best] < least[row])
    same = (o[first[check]] == o[check]) & (group[best[check]] == group[row[check]])
    window = np.lib.stride_tricks.sliding_window_view(line, WINDOW, axis=1)
    for at in range(0, len(check), 1 << 16):
        c = check[at : at + (1 << 16)]
        same[at : at + (1 << 16)] &= (window[row[c], BEFORE - o[c]] == window[best[c], BEFORE - o[c]]).all(axis=1)
    out = np.full((len(keys), OFFSETS), LAST, dtype=np.int64)
    if same.all():
        out[row, o] = least[best]
    else:  # two different windows with one hash: compare all by their bytes
        low: dict[tuple[int, int, bytes], int] = {}
        for r, k in zip(row.tolist(), o.tolist(), strict=True):
            out[r, k] = low.setdefault((int(group[r]), k, window[r, BEFORE - k].tobytes()), int(least[r]))
    back = np.empty_like(out)
    back[order] = out
    return back


@dataclass
class Windows:
    """Distinct windows of some keys, each with its offset behind it, in the buckets of their bytes' hash."""

    row: np.ndarray
    offset: np.ndarray
    of: np.ndarray
    lines: np.ndarray
    least: np.ndarray
    by_bucket: dict[int, np.ndarray]


def windows(found: Suffixes, parts: int) -> Iterator[Windows]:
    """The windows around the anchors that are theirs, slice by slice of the keys.

    Of all windows around an anchor only those in which no other string has a
    lesser hash: the others have an anchor of their own, and are found there.
    """
    up, down = _powers(BEFORE + WINDOW)
    offsets = np.arange(OFFSETS)
    starts = BEFORE - offsets
    for begin in range(0, len(found.keys), 1 << 13):
        keys, least = found.keys[begin : begin + (1 << 13)], found.least[begin : begin + (1 << 13)]
        line = np.concatenate([keys[:, WINDOW : WINDOW + BEFORE][:, ::-1], keys[:, :WINDOW]], axis=1)
        sums = np.zeros((len(keys), line.shape[1] + 1), dtype=np.uint64)
        np.cumsum((line.astype(np.uint64) + np.uint64(1)) * up, axis=1, out=sums[:, 1:])
        rank = _rank((sums[:, GRAM:] - sums[:, :-GRAM]) * down[: line.shape[1] - GRAM + 1])
        lowest = np.lib.stride_tricks.sliding_window_view(rank, OFFSETS, axis=1).min(axis=2)
        after, before = (keys[:, c].astype(np.int64)[:, None] - 1 for c in (-2, -1))
        row, o = np.nonzero((before >= offsets) & (after >= WINDOW - offsets) & (lowest[:, starts] == rank[:, [BEFORE]]))
        code = (sums[:, starts + WINDOW] - sums[:, starts]) * down[starts]
        code = (code ^ (code >> np.uint64(31))) * _MIX + (offsets.astype(np.uint64) * np.uint64(_BASE))
        bytes_of = np.lib.stride_tricks.sliding_window_view(line, WINDOW, axis=1)[row, BEFORE - o]
        whole = np.concatenate([bytes_of, (o + 1).astype(np.uint8)[:, None]], axis=1)
        lines, first, of = np.unique(whole.view(f"S{WINDOW + 1}").reshape(-1), return_index=True, return_inverse=True)
        low = np.full(len(lines), LAST, dtype=np.int64)
        np.minimum.at(low, of, least[row])
        yield Windows(row + begin, o, of, lines, low, _grouped(_bucket(code[row, o][first], parts * SPREAD)))


def _bucket(code: np.ndarray, parts: int) -> np.ndarray:
    return ((code >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)


def _grouped(group: np.ndarray) -> dict[int, np.ndarray]:
    """For each group the indices of its members, in order: one sort for all groups."""
    order = np.argsort(group, kind="stable")
    found, first = np.unique(group[order], return_index=True)
    return dict(zip(found.tolist(), np.split(order, first[1:]), strict=True)) if len(group) else {}


def _send_hashes(parts: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(rows)
        code, several = chunk.hashes()
        contexts = np.ones(len(code), dtype="<u4")
        many, n = chunk.contexts()
        contexts[np.searchsorted(code, many)] = n
        out = []
        for k, own in _grouped(_bucket(code, parts)).items():
            more = np.flatnonzero(contexts[own] > 1)
            out.append((k, int(rows["chunk"].iloc[0]), _five(code[own]), np.packbits(several[own]).tobytes(),
                        np.column_stack([more, contexts[own][more]]).astype("<u4").tobytes()))
        return pd.DataFrame(out, columns=["bucket", "chunk", "codes", "several", "contexts"])

    return run


def _five(code: np.ndarray) -> bytes:
    """The five low bytes of each hash: with the bucket enough to tell hashes apart; a clash only adds a candidate."""
    return np.ascontiguousarray(code.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _find_repeated(hot_contexts: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sent, held = [], []
        for codes, several in zip(rows["codes"], rows["several"], strict=True):
            wide = np.zeros((len(codes) // 5, 8), dtype=np.uint8)
            wide[:, :5] = np.frombuffer(codes, dtype=np.uint8).reshape(-1, 5)
            sent.append(wide.view("<u8").reshape(-1))
            held.append(np.unpackbits(np.frombuffer(several, dtype=np.uint8), count=len(wide)).astype(bool))
        every, contexts = np.unique(np.concatenate([np.unique(c) for c in sent]), return_counts=True)
        repeated = np.unique(np.concatenate([every[contexts > 1], *[c[s] for c, s in zip(sent, held, strict=True)]]))
        for codes, more in zip(sent, rows["contexts"], strict=True):
            index, n = np.frombuffer(more, dtype="<u4").reshape(-1, 2).astype(np.int64).T
            np.add.at(contexts, np.searchsorted(every, codes[index]), n - 1)
        hot = every[contexts > hot_contexts]
        out = []
        for chunk, codes in zip(rows["chunk"], sent, strict=True):
            at = np.searchsorted(repeated, codes)
            mask = (at < len(repeated)) & (np.append(repeated, np.uint64(0))[at] == codes)
            if mask.any():
                dealt = np.packbits(np.isin(codes[mask], hot)).tobytes() if len(hot) else None
                out.append((chunk, int(rows["bucket"].iloc[0]), np.packbits(mask).tobytes(), dealt))
        return pd.DataFrame(out, columns=["chunk", "part", "mask", "hot"])

    return run


def _repeated(chunk: Chunk, masks: pd.DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The chunk's anchor hashes that the buckets marked, sorted: those to be sorted, and the hot ones."""
    code, _ = chunk.hashes()
    by_bucket = _grouped(_bucket(code, parts))
    none = np.empty(0, dtype=np.uint64)
    found, hot = [none], [none]
    for k, mask, dealt in zip(masks["part"], masks["mask"], masks["hot"], strict=True):
        own = code[by_bucket[k]]
        own = own[np.unpackbits(np.frombuffer(mask, dtype=np.uint8), count=len(own)).astype(bool)]
        is_hot = np.zeros(len(own), dtype=bool)
        if dealt is not None:
            is_hot = np.unpackbits(np.frombuffer(dealt, dtype=np.uint8), count=len(own)).astype(bool)
        found.append(own[~is_hot])
        hot.append(own[is_hot])
    return np.sort(np.concatenate(found)), np.sort(np.concatenate(hot))


def _send_suffixes(parts: int, cuts: np.ndarray):
    def run(rows: pd.DataFrame, masks: pd.DataFrame) -> pd.DataFrame:
        columns = ["range", "chunk", "piece", "shared", "tails", "least"]
        if not len(rows) or not len(masks):
            return pd.DataFrame([], columns=columns)
        chunk = Chunk(rows)
        repeated, hot = _repeated(chunk, masks, parts)
        run_of = chunk.suffixes(repeated)
        bounds = [0, *np.searchsorted(run_of.anchors(), cuts).tolist(), len(run_of.keys)]
        out = []
        for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            if b > a:
                out.append((k, int(rows["chunk"].iloc[0]), 0, *front_code(run_of.keys[a:b]), run_of.least[a:b].tobytes()))
        for piece, x in enumerate(windows(chunk.suffixes(hot), parts)):
            for k, own in x.by_bucket.items():
                out.append((parts + k, int(rows["chunk"].iloc[0]), piece, b"", x.lines[own].tobytes(), x.least[own].tobytes()))
        return pd.DataFrame(out, columns=columns)

    return run


def _least_of_windows(rows: pd.DataFrame) -> pd.DataFrame:
    """Answers per piece of a chunk: which of its windows an earlier document holds, and the smallest one."""
    lines = [np.frombuffer(t, dtype=f"S{WINDOW + 1}") for t in rows["tails"]]
    least = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in rows["least"]])
    distinct, of = np.unique(np.concatenate(lines), return_inverse=True)
    low = np.full(len(distinct), LAST, dtype=np.int64)
    np.minimum.at(low, of, least)
    out, begin = [], 0
    for chunk, part, piece, own in zip(rows["chunk"], rows["range"], rows["piece"], lines, strict=True):
        best = low[of[begin : begin + len(own)]]
        lower = np.flatnonzero(best < least[begin : begin + len(own)])
        begin += len(own)
        if len(lower):
            out.append((chunk, part, piece, None, None, None, np.column_stack([lower, best[lower]]).tobytes()))
    return pd.DataFrame(out, columns=ANSWER_COLUMNS)


def _merge_range(rows: pd.DataFrame) -> pd.DataFrame:
    """Answers per chunk: for its suffixes of this range, the smallest document of all windows, or of each."""
    if not rows["shared"].iloc[0]:
        return _least_of_windows(rows)
    rows = rows.sort_values("chunk")
    chunks = rows["chunk"].tolist()
    runs = [(front_decode(s, t), s) for s, t in zip(rows["shared"], rows["tails"], strict=True)]
    least = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in rows["least"]])
    begin = np.cumsum([0, *(len(keys) for keys, _ in runs)])
    shared, run, index = np.array(list(merge_runs(runs)), dtype=np.int64).reshape(-1, 3).T
    place = begin[run] + index
    mine = least[place]
    # Keys that share the anchor are one group, equal keys of several runs one number: no comparison is needed.
    group, number = np.cumsum(shared < GRAM), np.cumsum(shared < KEY)
    number -= number[0]
    first = np.flatnonzero(np.append(True, np.diff(number) > 0))
    low = np.minimum.reduceat(mine, first)
    kinds = np.bincount(group[first])
    alone = kinds[group] == 1
    plain = alone & (low[number] < mine)

    texts = np.frombuffer(b"".join(b"".join(keys) for keys, _ in runs), dtype=np.uint8).reshape(-1, KEY)
    many = np.flatnonzero(kinds[group[first]] > 1)
    minima, sought = [], np.full(len(low), -1)
    sought[many] = np.arange(len(many))
    at = 0
    while at < len(many):
        end = min(at + (1 << 14), len(many))
        while end < len(many) and group[first[many[end]]] == group[first[many[end - 1]]]:
            end += 1
        part = many[at:end]
        minima.append(window_minima(texts[place[first[part]]], group[first[part]], low[part]))
        at = end
    minima = np.concatenate([*minima, np.zeros((0, OFFSETS), dtype=np.int64)])
    single = np.flatnonzero(~alone)
    single = single[minima[sought[number[single]]].min(axis=1, initial=LAST) < mine[single]]
    plain = np.flatnonzero(plain)
    plain_of, single_of = _grouped(run[plain]), _grouped(run[single])
    none = np.empty(0, dtype=np.int64)
    out = []
    for r, chunk in enumerate(chunks):
        p, q = plain[plain_of.get(r, none)], single[single_of.get(r, none)]
        if len(p) or len(q):
            out.append((chunk, int(rows["range"].iloc[0]), 0, np.column_stack([index[p], low[number[p]]]).tobytes(),
                        index[q].tobytes(), minima[sought[number[q]]].tobytes(), None))
    return pd.DataFrame(out, columns=ANSWER_COLUMNS)


def _cut_chunk(parts: int, cuts: np.ndarray):
    def run(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in RESULT.split(", ")]
        if not len(rows):
            return pd.DataFrame([], columns=columns)
        chunk = Chunk(rows)
        masks = answers[answers["mask"].notna()]
        repeated, hot = _repeated(chunk, masks, parts)
        found = chunk.suffixes(repeated)
        bounds = np.array([0, *np.searchsorted(found.anchors(), cuts)])
        everywhere = found.least.copy()
        by_window: dict[int, np.ndarray] = {}
        for _, x in answers[answers["plain"].notna()].iterrows():
            base = bounds[x["part"]]
            pairs = np.frombuffer(x["plain"], dtype=np.int64).reshape(-1, 2)
            everywhere[base + pairs[:, 0]] = pairs[:, 1]
            minima = np.frombuffer(x["minima"], dtype=np.int64).reshape(-1, OFFSETS)
            for i, low in zip(np.frombuffer(x["single"], dtype=np.int64), minima, strict=True):
                by_window[int(base + i)] = low
        special = np.zeros(len(found.keys), dtype=np.int64)
        special[list(by_window)] = np.arange(1, len(by_window) + 1)
        minima = np.array([np.zeros(OFFSETS, dtype=np.int64), *by_window.values()])
        cover = [np.zeros(sum(len(t) for t in chunk.texts[a:b]) + 1, dtype=np.int32) for a, b in chunk.slabs]
        _mark(chunk, found, cover, lambda key: np.where(special[key][:, None] > 0, minima[special[key]], everywhere[key][:, None]))
        if len(hot):
            dealt = chunk.suffixes(hot)
            lowest = _hot_minima(dealt, answers[answers["windows"].notna()], parts)
            _mark(chunk, dealt, cover, lambda key: lowest[key])
        return pd.DataFrame(list(_kept(chunk, cover)), columns=columns)

    return run


def _hot_minima(found: Suffixes, answers: pd.DataFrame, parts: int) -> np.ndarray:
    """The smallest document of every window around the hot anchors; LAST where the window is another anchor's."""
    told: dict[tuple[int, int], bytes] = {(x["piece"], x["part"] - parts): x["windows"] for _, x in answers.iterrows()}
    out = np.full((len(found.keys), OFFSETS), LAST, dtype=np.int64)
    for piece, x in enumerate(windows(found, parts)):
        for k, own in x.by_bucket.items():
            pairs = np.frombuffer(told.get((piece, k), b""), dtype=np.int64).reshape(-1, 2)
            x.least[own[pairs[:, 0]]] = pairs[:, 1]
        out[x.row, x.offset] = x.least[x.of]
    return out


def _mark(chunk: Chunk, found: Suffixes, cover: list[np.ndarray], lowest) -> None:
    """Counts in ``cover``, as steps up and down, the windows of which ``lowest`` (of keys) tells an earlier document."""
    offsets = np.arange(OFFSETS)
    for at in range(0, len(found.of), 1 << 16):
        part = slice(at, at + (1 << 16))
        key, mine = found.of[part], chunk.ranks[found.doc[part]][:, None]
        after, before = (found.keys[key, c].astype(np.int64)[:, None] - 1 for c in (-2, -1))
        row, o = np.nonzero((lowest(key) < mine) & (before >= offsets) & (after >= WINDOW - offsets))
        slab, start = found.where[part][row, 0], found.where[part][row, 1] - o
        for n in np.unique(slab):
            own, size = start[slab == n], len(cover[n])
            cover[n] += (np.bincount(own, minlength=size) - np.bincount(own + WINDOW, minlength=size)).astype(np.int32)


def _kept(chunk: Chunk, cover: list[np.ndarray]) -> Iterator[tuple]:
    for (a, b), marks in zip(chunk.slabs, cover, strict=True):
        gone = np.cumsum(marks[:-1]) > 0
        begin = 0
        for i in range(a, b):
            text = chunk.texts[i]
            own = gone[begin : begin + len(text)]
            begin += len(text)
            spans = int(own[:1].sum()) + int((own[1:] & ~own[:-1]).sum())
            kept = text if not spans else np.frombuffer(text, dtype=np.uint8)[~own].tobytes()
            yield int(chunk.ranks[i]), len(text), int(own.sum()), spans, hashlib.sha256(kept).hexdigest()


def _key_ranges(docs: DataFrame, rows: int, parts: int) -> np.ndarray:
    """The anchor strings at which the key ranges begin, from those of a bounded sample of rows, taken by rank and text."""

    def sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                blob = np.frombuffer(bytes(text), dtype=np.uint8)
                at = anchors(blob, np.zeros(len(blob), dtype=np.int64))[0]
                at = at[at + WINDOW <= len(blob)][:: max(1, len(at) // 16)]
                yield pd.DataFrame({"head": [blob[i : i + GRAM].tobytes() for i in at]})

    share = max(1, rows // SAMPLE_ROWS)
    some = docs.filter(F.pmod(F.xxhash64("rank", "text"), F.lit(share)) == 0)
    # Equal rows count once, however many there are.
    found = some.select("text").distinct().mapInPandas(sampled, "head binary").toPandas()["head"]
    heads = np.sort(np.array([bytes(h) for h in found], dtype=f"S{GRAM}"))
    if not len(heads) or parts < 2:
        return np.empty(0, dtype=f"S{GRAM}")
    return np.unique(heads[np.arange(1, parts) * len(heads) // parts])


def remove_repeats(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("rank"),
                       F.encode(whole_text(), "UTF-8").alias("text"))
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-size // chunk_bytes))
    cuts = _key_ranges(docs, rows, parts)
    chunk = F.pmod(F.xxhash64("rank", "text"), F.lit(parts)).alias("chunk")
    dealt = docs.select(chunk, "rank", "text").repartition(parts, "chunk")
    sent = dealt.groupBy("chunk").applyInPandas(
        _send_hashes(parts), "bucket long, chunk long, codes binary, several binary, contexts binary")
    masks = sent.groupBy("bucket").applyInPandas(_find_repeated(hot_contexts), "chunk long, part long, mask binary, hot binary")
    runs = dealt.groupBy("chunk").cogroup(masks.groupBy("chunk")).applyInPandas(
        _send_suffixes(parts, cuts), "range long, chunk long, piece long, shared binary, tails binary, least binary")
    merged = runs.groupBy("range").applyInPandas(_merge_range, ANSWER)
    answers = masks.unionByName(merged, allowMissingColumns=True)
    cut = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_cut_chunk(parts, cuts), RESULT)
    return cut.select(F.when(F.col("rank") != LAST, F.col("rank")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
