"""Secret scan with one combined deterministic automaton.

All rules run in a single pass over the bytes (``automaton.scan``), which tells
where matches end; a rule's reversed automaton walks back from each end to the
leftmost start that is not inside the rule's previous match.  Counted lengths
are tested afterwards, so a match that is too short still consumes its text.

Kinds ``assign``, ``access`` and ``hex`` are the base; the rules after them add
spans.  Offsets are code points, ends exclusive.  Defined cases: null text is
empty; a text without matches has zero counts, the digest of the empty string
and empty spans; equal rows get equal answers; very long texts are read whole;
columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigsight.llm.automaton import compile_rules, scan
from sigsight.llm.common import slabs, table, utf8


@dataclass(frozen=True)
class Rule:
    """``least``: bytes that must follow ``head`` (nothing: the start) inside a match."""

    kind: str
    pattern: bytes
    least: int = 0
    head: bytes = b""


# Fixed patterns of the base kinds; hex has its length in the pattern.
_ASSIGN = rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
BASE = (
    Rule("assign", _ASSIGN + rb"[A-Za-z0-9+/_.=-]+", 8, _ASSIGN),
    Rule("access", rb"AKIA[A-Z0-9]+", 16),
    Rule("hex", rb"[0-9a-f]{32,}"),
)
# Further token formats with a public prefix.
MORE = (
    Rule("forge", rb"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("chat", rb"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("maps", rb"AIza[A-Za-z0-9_-]+", 39),
    Rule("pem", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE
MARK = "[SECRET]"


@lru_cache(maxsize=4)
def _machines(rules: tuple[Rule, ...]):
    heads = {r.head for r in rules if r.head}
    return (
        compile_rules([r.pattern for r in rules]),
        [_walker(r.pattern, back=True) for r in rules],
        {h: _walker(h) for h in heads},
    )


def _walker(pattern: bytes, back: bool = False):
    m = compile_rules([pattern], anywhere=False, back=back)
    full = m.step[:, m.group].tolist()
    return full, (m.accept != 0).tolist(), m.dead.tolist()


def _longest(walker, text: bytes, positions: range) -> int:
    """Steps until the walker's last accepting state along the positions; 0: none."""
    step, accept, dead = walker
    state, best = 0, 0
    for n, p in enumerate(positions, 1):
        state = step[state][text[p]]
        if dead[state]:
            break
        if accept[state]:
            best = n
    return best


def find(texts: list[bytes], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """Per text its (start, rule, end) in code points, sorted."""
    machine, backward, heads = _machines(rules)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, b in slabs(texts, 1 << 22):
        blob = b"\n".join(texts[a:b]) + b"\n"
        where, which = scan(machine, np.frombuffer(blob, dtype=np.uint8))
        if not len(where):
            continue
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[a:b]])])
        for r, rule in enumerate(rules):
            own = where[(which >> r) & 1 == 1]
            if not len(own):
                continue
            ends = own[np.append(own[1:] != own[:-1] + 1, True)] + 1
            owner = np.searchsorted(begins, ends - 1, side="right") - 1
            last, before = 0, -1
            for end, doc in zip(ends.tolist(), owner.tolist(), strict=True):
                if doc != before:
                    last, before = int(begins[doc]), doc
                n = _longest(backward[r], blob, range(end - 1, last - 1, -1))
                if not n:
                    continue
                start, last = end - n, end
                counted = n - (_longest(heads[rule.head], blob, range(start, end)) if rule.head else 0)
                if counted >= rule.least:
                    out[a + doc].append((start - int(begins[doc]), r, end - int(begins[doc])))
    for i, spans in enumerate(out):
        if spans:
            if not texts[i].isascii():
                lead = (np.frombuffer(texts[i], dtype=np.uint8) & 0xC0) != 0x80
                points = np.concatenate([[0], np.cumsum(lead)])
                spans[:] = [(int(points[s]), r, int(points[e])) for s, r, e in spans]
            spans.sort()
    return out


def listed(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...] = RULES) -> str:
    return ",".join(f"{rules[r].kind}:{s}:{e}" for s, r, e in spans)


def scan_texts(text: pd.Series) -> pd.DataFrame:
    rows = []
    for spans in find(utf8(text)):
        base = [x for x in spans if x[1] < len(BASE)]
        counts = [sum(r == k for _, r, _ in base) for k in range(len(BASE))]
        rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
    return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def redacted(text: pd.Series) -> pd.Series:
    """The text with each found secret (overlapping ones together) replaced by MARK; null stays null."""
    out = []
    for t, spans in zip(text, find(utf8(text)), strict=True):
        if spans:
            parts, at = [], 0
            for s, _, e in spans:
                if s >= at:
                    parts += [t[at:s], MARK]
                at = max(at, e)
            t = "".join(parts) + t[at:]
        out.append(t)
    return pd.Series(out, dtype=object)


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of the secrets of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = F.pandas_udf(scan_texts, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return docs.withColumn("_found", found("text")).select("doc_id", "_found.*")
