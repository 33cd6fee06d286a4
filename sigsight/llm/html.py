"""Main-text extraction by a recurrent block labeller.

A page is parsed into leaf blocks in page order: runs of text between block
tags, each with the path of its tags.  A bidirectional LSTM in numpy reads the
whole sequence; a block's input is the mean of learned vectors of its hashed
path tokens (tags, classes, ids), the mean of those of its hashed words, and a
few shape figures.  Blocks labelled as content are joined by one space.

The labeller is trained here, on pages that ``sample_page`` composes with known
labels from common page layouts; training is deterministic and takes seconds.

Defined cases: null html is empty and gives the empty text; markup without text
gives the empty text; a page of one block is labelled by that block alone;
unclosed or crossing tags are closed as browsers do in the common cases; a quoted
value may hold any sign; a quote that is never closed is no quote; an unclosed
select, svg, object, canvas, math or template hides nothing; a link that is never
closed ends at the next one; equal pages get equal texts; texts are never cut.  A
block's path is all of its tags, however deep: paths share their beginnings, so
deep nesting costs no more than its length.  Columns other than page_id, url and
html are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigsight.llm.common import table

PATH_BUCKETS = 2048
WORD_BUCKETS = 2048
PATH_WIDTH = 24
WORD_WIDTH = 8
SHAPE_WIDTH = 6
HIDDEN = 20
TRAINING_PAGES = 4000
ROUNDS = 4
BATCH = 32

# Fixed tag sets of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike "
                   "strong sub sup time tt u var wbr".split())
SILENT = frozenset("script style template noscript textarea title iframe object svg math select canvas head".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav "
                     "ol p pre section table ul".split())
CLOSES_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"),
               "th": ("tr", "table"), "option": ("select",)}
# What browsers read as raw text up to the end tag, or to the end of the page; other silent tags need their end tag.
RAW = frozenset("script style title textarea iframe noscript".split())
# Attributes as browsers read them: a quote counts only behind "=", and only if it is closed.
_ATTRIBUTES = r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))?+)*+"""
# "<!-->" and "<!--->" are whole comments; "<![CDATA[" is one up to the next ">".
_TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|"
                  rf"<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})(?:>|\Z)", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[a-z]+")
_UNQUOTED_END = re.compile(r"""=\s*[^\s"'>][^\s>]*\Z""")


class Node:
    """An open tag's tokens, below those of the tags around it."""

    __slots__ = ("parent", "tokens", "depth")

    def __init__(self, parent: Node | None, tokens: tuple[int, ...]):
        self.parent, self.tokens, self.depth = parent, tokens, parent.depth + 1 if parent else 0


@dataclass
class Block:
    text: str
    path: Node
    linked: int


@lru_cache(maxsize=65536)
def _path_token(token: str) -> int:
    return zlib.crc32(token.encode()) % PATH_BUCKETS


@lru_cache(maxsize=200_000)
def _word_token(word: str) -> int:
    return zlib.crc32(word.lower().encode()) % WORD_BUCKETS


@lru_cache(maxsize=65536)
def _tokens(tag: str, attributes: str) -> tuple[int, ...]:
    named = " ".join(_NAMED.findall(attributes)).lower() if attributes else ""
    return (_path_token("<" + tag), *(_path_token(x) for x in dict.fromkeys(_PART.findall(named))))


def _closes_itself(attributes: str) -> bool:
    """Whether the tag ends in "/>"; a slash that ends an unquoted value is part of the value."""
    return attributes.endswith("/") and not _UNQUOTED_END.search(attributes)


def _raw_end(html: str, tag: str, at: int) -> int:
    """Behind the end tag of a raw element whose content begins at ``at``; -1 without one."""
    found = re.compile(f"</{re.escape(tag)}", re.I).search(html, at)
    return html.find(">", found.start()) + 1 or -1 if found else -1


def _silent_ends(html: str, at: int) -> dict[int, int]:
    """From ``at`` on, for the silent elements that are not raw: begin of the content -> end, where an end tag is theirs."""
    ends: dict[int, int] = {}
    begun: dict[str, list[int]] = {tag: [] for tag in SILENT - RAW - {"head"}}
    endless = set()
    while m := _TAG.search(html, at):
        at, tag = m.end(), (m[2] or "").lower()
        if tag in begun and m[1]:
            if begun[tag]:
                ends[begun[tag].pop()] = at
        elif tag in begun and not _closes_itself(m[3]):
            begun[tag].append(at)
        elif tag in RAW - endless and not m[1] and not _closes_itself(m[3]) and not begun["svg"] and not begun["math"]:
            end = _raw_end(html, tag, at)
            at = max(at, end)
            if end < 0:
                endless.add(tag)
    return ends


def blocks(html: str) -> list[Block]:
    """The page's leaf blocks in order."""
    out: list[Block] = []
    stack: list[list] = []  # name, tokens, and the node once a block has asked for it
    places: dict[str, list[int]] = {}  # where on the stack each name is open
    parts: list[str] = []
    linked, link = 0, -1
    at, n = 0, len(html)
    silent: dict[int, int] | None = None

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, path(), min(linked, len(text))))
        parts.clear()
        linked = 0

    def path() -> Node:
        known = len(stack)
        while known and stack[known - 1][2] is None:
            known -= 1
        node = stack[known - 1][2] if known else None
        for entry in stack[known:]:
            node = entry[2] = Node(node, entry[1])
        return node or Node(None, (_path_token("<body"),))

    def begin(tag: str, attributes: str) -> None:
        places.setdefault(tag, []).append(len(stack))
        stack.append([tag, _tokens(tag, attributes), None])

    def close(depth: int) -> None:
        nonlocal link
        for name, _, _ in reversed(stack[depth:]):
            places[name].pop()
        del stack[depth:]
        link = link if link < depth else -1

    def innermost(name: str, stops: tuple[str, ...] = ()) -> int:
        at = places.get(name)
        if not at or any(places.get(s) and places[s][-1] > at[-1] for s in stops):
            return -1
        return at[-1]

    while at < n:
        m = _TAG.search(html, at)
        piece = html[at : m.start() if m else n]
        if piece:
            piece = unescape(piece) if "&" in piece else piece
            parts.append(piece)
            linked += len(piece) if link >= 0 else 0
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, attributes = m[2].lower(), m[3]
        if m[1]:
            if tag not in INLINE:
                flush()
            i = innermost(tag)
            if i >= 0:
                close(i)
            continue
        if tag in SILENT:
            if tag in RAW and not _closes_itself(attributes):
                end = _raw_end(html, tag, at)
                at = end if end >= 0 else n
            elif tag != "head" and not _closes_itself(attributes):
                if silent is None:
                    silent = _silent_ends(html, m.start())
                at = silent.get(at, at)
            if tag not in INLINE:
                flush()
            continue
        if tag in INLINE:
            if tag not in VOID:
                link = len(stack) if tag == "a" else link
                begin(tag, attributes)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        flush()
        if tag in CLOSES_P:
            i = innermost("p", ("div", "article", "section", "td", "li", "main", "body"))
            if i >= 0:
                close(i)
        if tag in CLOSES_SAME:
            i = innermost(tag, CLOSES_SAME[tag])
            if i >= 0:
                close(i)
        if tag not in VOID:
            begin(tag, attributes)
    flush()
    return out


@dataclass
class Batch:
    """Pages as padded sequences: bags of tokens, shape figures, and which places hold blocks.

    Tags are a forest: ``path`` holds the tokens tag by tag, ``parent`` is -1 at a
    root, ``levels`` lists the tags of each depth and ``node`` the blocks' own.
    """

    path: np.ndarray
    path_at: np.ndarray
    parent: np.ndarray
    levels: list[np.ndarray]
    node: np.ndarray
    word: np.ndarray
    word_at: np.ndarray
    shape: np.ndarray
    place: np.ndarray
    mask: np.ndarray

    @classmethod
    def of(cls, pages: list[list[Block]]) -> Batch:
        steps, width = max(len(p) for p in pages), len(pages)
        mask = np.zeros((steps, width), dtype=np.float32)
        word, shape, place, node = [], [], [], []
        tags: list[Node] = []
        number: dict[int, int] = {}
        for b, page in enumerate(pages):
            mask[: len(page), b] = 1
            for t, block in enumerate(page):
                words = block.text.split(" ")
                new, tag = len(tags), block.path
                while tag is not None and id(tag) not in number:
                    number[id(tag)] = len(tags)
                    tags.append(tag)
                    tag = tag.parent
                node.append(number[id(block.path)] if len(tags) == new else new)
                word.append([_word_token(w) for w in words])
                size = len(block.text)
                ends = sum(block.text.count(c) for c in ".,;:!?")
                shape.append((np.log1p(size) / 8, block.linked / size, ends / len(words), min(len(words), 20) / 20,
                              t / len(page), block.text[-1] in ".!?\"'"))
                place.append(t * width + b)
        depth = np.array([tag.depth for tag in tags])
        parent = np.array([-1 if tag.parent is None else number[id(tag.parent)] for tag in tags])
        order = np.argsort(depth, kind="stable")
        levels = np.split(order, np.cumsum(np.bincount(depth))[:-1])
        return cls(np.array([t for tag in tags for t in tag.tokens]), np.cumsum([0, *(len(tag.tokens) for tag in tags)][:-1]),
                   parent, levels, np.array(node), np.concatenate(word),
                   np.cumsum([0, *map(len, word)][:-1]), np.array(shape, dtype=np.float32), np.array(place), mask)


    def path_sizes(self) -> np.ndarray:
        """Tokens on the whole path to each tag."""
        sizes = np.diff(np.append(self.path_at, len(self.path)))
        for level in self.levels[1:]:
            sizes[level] += sizes[self.parent[level]]
        return sizes

    def word_sizes(self) -> np.ndarray:
        return np.diff(np.append(self.word_at, len(self.word)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """The bidirectional LSTM; ``weights`` by name."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        wide = PATH_WIDTH + WORD_WIDTH + SHAPE_WIDTH

        def made(*size, scale):
            return (rng.standard_normal(size) * scale).astype(np.float32)

        self.weights = {"path": made(PATH_BUCKETS, PATH_WIDTH, scale=0.3), "word": made(WORD_BUCKETS, WORD_WIDTH, scale=0.1),
                        "out": made(2 * HIDDEN, scale=0.2), "bias": np.zeros(1, dtype=np.float32)}
        for d in ("ahead", "back"):
            self.weights[f"{d}_in"] = made(wide, 4 * HIDDEN, scale=wide**-0.5)
            self.weights[f"{d}_state"] = made(HIDDEN, 4 * HIDDEN, scale=HIDDEN**-0.5)
            self.weights[f"{d}_bias"] = np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)

    def _input(self, b: Batch) -> np.ndarray:
        w = self.weights
        sums = np.add.reduceat(w["path"][b.path], b.path_at)
        for level in b.levels[1:]:
            sums[level] += sums[b.parent[level]]
        rows = np.concatenate([sums[b.node] / b.path_sizes()[b.node][:, None],
                               np.add.reduceat(w["word"][b.word], b.word_at) / b.word_sizes()[:, None], b.shape], axis=1)
        x = np.zeros((b.mask.size, rows.shape[1]), dtype=np.float32)
        x[b.place] = rows
        return x.reshape(*b.mask.shape, -1)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, trace: list | None = None) -> np.ndarray:
        w = self.weights
        gates = x @ w[f"{d}_in"] + w[f"{d}_bias"]
        h = c = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
        out = np.zeros((*mask.shape, HIDDEN), dtype=np.float32)
        for t in range(len(x)) if d == "ahead" else range(len(x) - 1, -1, -1):
            z = gates[t] + h @ w[f"{d}_state"]
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c_new = f * c + i * g
            tanh = np.tanh(c_new)
            if trace is not None:
                trace.append((t, h, c, i, f, o, g, tanh))
            c = m * c_new + (1 - m) * c
            h = m * (o * tanh) + (1 - m) * h
            out[t] = h
        return out

    def chances(self, b: Batch) -> np.ndarray:
        """Chance of being content, (steps, pages)."""
        x = self._input(b)
        both = np.concatenate([self._run(x, b.mask, "ahead"), self._run(x, b.mask, "back")], axis=2)
        return _sigmoid(both @ self.weights["out"] + self.weights["bias"])

    def gradients(self, b: Batch, truth: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over the blocks."""
        w, traces = self.weights, {"ahead": [], "back": []}
        x = self._input(b)
        states = {d: self._run(x, b.mask, d, traces[d]) for d in traces}
        both = np.concatenate([states["ahead"], states["back"]], axis=2)
        miss = (_sigmoid(both @ w["out"] + w["bias"]) - truth) * b.mask / b.mask.sum()
        g = {"out": np.einsum("tb,tbh->h", miss, both), "bias": miss.sum(keepdims=True).reshape(1)}
        down = miss[:, :, None] * w["out"]
        to_x = np.zeros_like(x)
        for k, d in enumerate(traces):
            own = down[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            d_h = d_c = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
            z_all = np.zeros((*b.mask.shape, 4 * HIDDEN), dtype=np.float32)
            before = np.zeros((*b.mask.shape, HIDDEN), dtype=np.float32)
            for t, h, c, i, f, o, gg, tanh in reversed(traces[d]):
                m = b.mask[t][:, None]
                total = own[t] + d_h
                d_cell = m * (d_c + total * o * (1 - tanh**2))
                z = np.concatenate([d_cell * gg * i * (1 - i), d_cell * c * f * (1 - f), m * total * tanh * o * (1 - o),
                                    d_cell * i * (1 - gg**2)], axis=1)
                z_all[t], before[t] = z, h
                d_h = z @ w[f"{d}_state"].T + (1 - m) * total
                d_c = d_cell * f + (1 - m) * d_c
            flat = z_all.reshape(-1, 4 * HIDDEN)
            g[f"{d}_in"] = x.reshape(len(flat), -1).T @ flat
            g[f"{d}_state"] = before.reshape(len(flat), -1).T @ flat
            g[f"{d}_bias"] = flat.sum(axis=0)
            to_x += z_all @ w[f"{d}_in"].T
        rows = to_x.reshape(-1, x.shape[2])[b.place]
        to_tags = np.zeros((len(b.parent), PATH_WIDTH), dtype=rows.dtype)
        np.add.at(to_tags, b.node, rows[:, :PATH_WIDTH] / b.path_sizes()[b.node][:, None])
        for level in b.levels[:0:-1]:
            np.add.at(to_tags, b.parent[level], to_tags[level])
        to_words = rows[:, PATH_WIDTH : PATH_WIDTH + WORD_WIDTH] / b.word_sizes()[:, None]
        for name, tokens, each, part in (("path", b.path, np.diff(np.append(b.path_at, len(b.path))), to_tags),
                                         ("word", b.word, b.word_sizes(), to_words)):
            g[name] = np.zeros_like(w[name])
            np.add.at(g[name], tokens, np.repeat(part, each, axis=0))
        return g


def fit(pages: list[tuple[list[Block], list[int]]], rounds: int = ROUNDS, seed: int = 5) -> Labeller:
    """Train on pages of labelled blocks, with Adam."""
    model, rng = Labeller(), np.random.default_rng(seed)
    pages = sorted((p for p in pages if p[0]), key=lambda p: len(p[0]))
    batches = []
    for at in range(0, len(pages), BATCH):
        b = Batch.of([p for p, _ in pages[at : at + BATCH]])
        truth = np.zeros(b.mask.size, dtype=np.float32)
        truth[b.place] = np.concatenate([t for _, t in pages[at : at + BATCH]])
        batches.append((b, truth.reshape(b.mask.shape)))
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step = 0
    for _ in range(rounds):
        for k in rng.permutation(len(batches)):
            step += 1
            for name, g in model.gradients(*batches[k]).items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                rate = 0.01 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                model.weights[name] = model.weights[name] - rate * first[name] / (np.sqrt(second[name]) + 1e-7)
    return model


@lru_cache(maxsize=1)
def trained() -> Labeller:
    from sigsight.llm.html_samples import sample_pages

    return fit([labelled(html, kept) for html, kept in sample_pages(TRAINING_PAGES)])


def labelled(html: str, kept: set[str]) -> tuple[list[Block], list[int]]:
    """A composed page's blocks, 1 where the text is one of the article's."""
    found = blocks(html)
    return found, [int(b.text in kept) for b in found]


def extract(pages: list[str | None], model: Labeller) -> list[str]:
    """The main text of each page."""
    parsed = [blocks(p) if isinstance(p, str) else [] for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if parsed[i]), key=lambda i: len(parsed[i]))
    at = 0
    while at < len(order):
        # Pages of like length together; a page of very many blocks goes alone.
        take = max(1, min(128, 20_000 // len(parsed[order[min(at + 127, len(order) - 1)]])))
        group = order[at : at + take]
        at += take
        chances = model.chances(Batch.of([parsed[i] for i in group]))
        for b, i in enumerate(group):
            out[i] = " ".join(x.text for t, x in enumerate(parsed[i]) if chances[t, b] >= 0.5)
    return out


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    model = spark.sparkContext.broadcast(trained())

    @F.pandas_udf("string")
    def main_text(html: pd.Series) -> pd.Series:
        pages = list(html)
        return pd.Series([t for a in range(0, len(pages), 512) for t in extract(pages[a : a + 512], model.value)], dtype=object)

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return pages.select("page_id", "url", main_text("html").alias("text")) \
        .withColumn("n_chars", F.char_length("text").cast("long"))
