"""Substring dedup, ranked search and spelling variants against brute force on odd texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sigsight.llm import lexical, registry, spelling, substrings
from sigsight.llm.fm_index import FMIndex, WaveletMatrix
from tests.llm.test_texts import by_row, rows_of

DOC_SCHEMA = "doc_id long, text string"


def test_wavelet_matrix_ranks():
    rng = np.random.default_rng(3)
    symbols = rng.integers(0, 11, 300)
    matrix = WaveletMatrix(symbols, 4)
    start = matrix.descend(np.arange(11), np.zeros(11, dtype=np.int64))
    for place in (0, 1, 63, 64, 65, 128, 299, 300):
        got = matrix.descend(np.arange(11), np.full(11, place)) - start
        assert got.tolist() == [int((symbols[:place] == c).sum()) for c in range(11)]


def test_matching_statistics_against_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        seqs = list({tuple(rng.randint(1, rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 8))})
        weights = [rng.choice([1, 1, 2]) for _ in seqs]
        flat, lengths = np.array([x for s in seqs for x in s]), np.array([len(s) for s in seqs])
        got = FMIndex(flat, lengths, np.array(weights)).matching_statistics(flat, np.cumsum(lengths) - lengths, lengths, 2)
        times = Counter()
        for s, w in zip(seqs, weights, strict=True):
            for i in range(len(s)):
                for j in range(i + 1, len(s) + 1):
                    times[s[i:j]] += w
        want = [max((k for k in range(1, len(s) - i + 1) if times[s[i : i + k]] >= 2), default=0) for s in seqs for i in range(len(s))]
        assert got.tolist() == want


def brute_kept(docs, width=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    times = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    for (d, _), w in zip(docs, words, strict=True):
        gone = set()
        for i in range(len(w) - width + 1):
            if times[tuple(w[i : i + width])] > 1:
                gone |= set(range(i, i + width))
        kept = [x for i, x in enumerate(w) if i not in gone]
        yield {"doc_id": d, "n_words": len(w), "n_removed": len(gone), "kept": " ".join(kept)}


def passages(rng):
    """Documents that share passages of many lengths, within themselves too, and low-complexity ones."""
    pool = ["".join(rng.choice("abcdé日") for _ in range(rng.randint(1, 4))) for _ in range(40)]
    some = lambda n: [rng.choice(pool) for _ in range(n)]
    shared = [some(n) for n in (34, 35, 36, 60, 200)]
    docs = []
    for i in range(120):
        parts = [some(rng.randint(0, 30)), rng.choice(shared), some(rng.randint(0, 50)), rng.choice([[], rng.choice(shared)])]
        docs.append((i % 90, rng.choice([" ", "\n", " \t "]).join(w for p in parts for w in p)))
    docs += [(200, "the " * 500), (201, "the " * 34), (202, "a b " * 90), (203, " ".join(some(3000)))]
    return docs


@pytest.mark.parametrize(("chunk_bytes", "hot", "shard_words"), [(8 << 20, 4096, 1_000_000), (3000, 4096, 2000), (20_000, 3, 500)])
def test_substring_dedup(spark, odd_documents, chunk_bytes, hot, shard_words):
    docs = [(r[0], r[1]) for r in odd_documents] + passages(random.Random(5))
    got = rows_of(substrings.remove_repeats(spark.createDataFrame(docs, DOC_SCHEMA).repartition(3), chunk_bytes, hot, shard_words))
    for r in got:
        spans = r.pop("spans")
        assert sum(s["end"] - s["start"] for s in spans) == r["n_removed"]
        assert all(a["end"] < b["start"] for a, b in zip(spans, spans[1:], strict=False))
    assert by_row(got) == by_row(brute_kept(docs))
    assert sum(r["n_removed"] for r in got) > 1000


def test_hot_anchor_is_dealt_to_several_shards():
    """A passage in very many documents, each with its own surroundings: no shard gets all different segments.

    Equal segments, however many, do not make an anchor hot.
    """
    rng = random.Random(9)
    passage = [f"w{i}" for i in range(36)]
    texts = [" ".join([f"{rng.random()}" for _ in range(30)] + passage + [f"{rng.random()}" for _ in range(30)]).encode() for _ in range(600)]
    rows = lambda ts: pa.table({"chunk": pa.array([0] * len(ts)), "text": pa.array([t.decode() for t in ts])})
    marks = substrings._marks((pa.scalar(0),), rows(texts)).to_pandas()
    marks = marks[marks.n > 1]
    largest = {}
    for hot in (10_000, 100):
        _, known, _ = substrings._repeated(texts, marks.anchor.to_numpy(), marks.different.to_numpy(), hot)
        largest[hot] = max(Counter(key[:2] for key in known).values())
    assert largest[10_000] == marks.different.max() >= 300 and largest[100] < 150
    same = substrings._marks((pa.scalar(0),), rows(texts[:1] * 500)).to_pandas()
    assert set(same.n) == {500} and set(same.different) == {1}


def test_op11_of_odd_tables(spark, odd_tables, odd_documents):
    want = list(brute_kept([(r[0], r[1]) for r in odd_documents]))
    for r in want:
        r["kept_sha256"] = hashlib.sha256(r.pop("kept").encode()).hexdigest()
    assert by_row(rows_of(registry.QUERIES["op11_substring_dedup"](spark, odd_tables))) == by_row(want)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_ranking(docs, items, top):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, total = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    for i, text in dict.fromkeys(items):
        found = []
        for d, b in bags:
            m = 100 - 50 + (50 * b.total() * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 20 * m))
                        for t in set(terms(text)) if t in b)
            if score > 0:
                found.append((-score, d is None, d or 0))
        for rank, (score, none, d) in enumerate(sorted(found)[:top], 1):
            yield (i, rank, None if none else d, -score)


def test_op12_of_odd_tables(spark, odd_tables, odd_documents):
    items = [(r["item_id"], r["text"]) for r in rows_of(spark.read.parquet(f"{odd_tables}/benchmark.parquet"))]
    got = Counter(map(tuple, registry.QUERIES["op12_ranked_lexical_search"](spark, odd_tables).collect()))
    assert got == Counter(brute_ranking([(r[0], r[1]) for r in odd_documents], items, 50))
    assert len(got) > 50


def test_search_with_small_shards_and_blocks(spark, monkeypatch):
    """Many shards, blocks of few items, ties at the last rank, and accumulators that are no longer created."""
    rng = random.Random(2)
    pool = [f"t{int(rng.paretovariate(0.6)) % 400}" for _ in range(900)]
    docs = [(rng.randrange(400), " ".join(rng.choices(pool, k=rng.randint(1, 60)))) for _ in range(500)] + [(7, "t1 t2 t3")] * 30
    items = [(i, " ".join(rng.choices(pool, k=rng.randint(1, 25)))) for i in range(25)] + [(90, "t1 T2"), (91, "nowhere"), (92, None)]
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 800)
    table, asked = spark.createDataFrame(docs, DOC_SCHEMA).repartition(5), spark.createDataFrame(items, "item_id long, text string")
    for top in (3, 20):
        assert Counter(map(tuple, lexical.search(table, asked, top, 500).collect())) == Counter(brute_ranking(docs, items, top))


def test_accumulators_stop_before_the_common_terms():
    """The k-th partial score of the rare term is beyond what the common one can add."""
    n = np.full(1000, 20)
    doc = np.concatenate([np.arange(60), np.arange(1000)])
    term = np.concatenate([np.zeros(60, int), np.ones(1000, int)])
    plan = lexical.Plan([[0, 1]], [9000, 10], 1000, 20_000, 50)
    shard = lexical.Shard(np.arange(1000), n, doc, term, np.ones(1060, int), plan)
    best, score = shard.search([0, 1], plan.weights, 50)
    assert set(best) == set(range(50)) and (score == 9010 * shard.part[0]).all()
    assert len(shard.search([0, 1], plan.weights, 1000)[0]) == 1000


def brute_words(docs):
    n = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def brute_variants(docs):
    words = brute_words(docs)
    holed = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holed["replaced", i, w[:i], w[i + 1 :]].add(w)
            holed["shorter", w[:i] + w[i + 1 :]].add(w)
    near = {w: set(holed["shorter", w]) for w in words}
    for w in words:
        for i in range(len(w)):
            near[w] |= holed["replaced", i, w[:i], w[i + 1 :]] - {w}
            near[w] |= {w[:i] + w[i + 1 :]} & words.keys()
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        yield {"word": w, "form": form[w], "root": root, "n": n, "n_near": len(near[w]), "form_n": words.get(form[w])}


def misspelt(rng):
    """Words, their misspellings of different frequencies, chains of them, long and doubled letters."""
    pool = ["".join(rng.choice("abcdeéÿÀ×") for _ in range(rng.randint(5, 12))) for _ in range(40)] + ["aaaaaaaa", "b" * 70]
    tokens = []
    for w in pool:
        n = rng.choice([5, 30, 160])
        while n >= 5:
            tokens += [w] * n
            i, kind = rng.randrange(len(w)), rng.randrange(3)
            w = w[:i] + rng.choice("abéz") * (kind != 0) + w[i + (kind != 1) :]
            n //= rng.choice([1, 4, 5, 6])
            if rng.random() < 0.2:
                break
    rng.shuffle(tokens)
    return [(i, " ".join(rng.choice([t, t.upper() if t.isascii() else t]) for t in tokens[i::20])) for i in range(20)]


@pytest.mark.parametrize("block_words", [spelling.BLOCK_WORDS, 7])
def test_spelling_variants(spark, odd_documents, monkeypatch, block_words):
    monkeypatch.setattr(spelling, "TASK_WORDS", 50)
    docs = [(r[0], r[1]) for r in odd_documents] + misspelt(random.Random(7)) + [(None, "abcdéé " * 6 + "abcdée " * 40)]
    docs += [(900, "Chainlink " * 200 + "chainlinkx " * 30), (901, "chainlinkxy " * 5)]
    got = rows_of(spelling.variants(spark.createDataFrame(docs, DOC_SCHEMA), block_words))
    key = lambda r: r["word"]
    assert sorted(got, key=key) == sorted(brute_variants(docs), key=key)
    assert sum(r["form"] is not None for r in got) > 5 and any(r["root"] != r["form"] for r in got if r["form"])


def test_counts_handed_on_in_small_lots(monkeypatch):
    monkeypatch.setattr(spelling, "FLUSH_WORDS", 3)
    docs = misspelt(random.Random(8))
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([t for _, t in docs])], names=["doc_id", "text"])
    counted = Counter()
    for lot in spelling._counts(iter([batch])):
        counted.update(dict(zip(*(c.to_pylist() for c in lot.columns), strict=True)))
    assert {w: n for w, n in counted.items() if n >= 5} == brute_words(docs)


def test_edit_hashes_are_those_of_the_edited_words():
    words = sorted(brute_words(misspelt(random.Random(8))))
    for length, _, codes in spelling.by_length(words):
        h = spelling.hashes(codes)
        alphabet = np.array(sorted({ord(c) for w in words for c in w}), dtype=np.uint8)
        for at, rows, new, probes in spelling.replacements(codes, h, alphabet):
            changed = codes[rows].copy()
            changed[:, at] = new
            assert (spelling.hashes(changed) == probes).all() and (new > codes[rows, at]).all()
        for at, rows, probes in spelling.deletions(codes):
            assert length == 1 or (spelling.hashes(np.delete(codes[rows], at, axis=1)) == probes).all()


def test_filters_hold_every_word_and_few_others():
    rng = np.random.default_rng(4)
    codes = rng.integers(97, 123, (30_000, 9)).astype(np.uint8)
    h = spelling.hashes(codes)
    lanes = np.zeros(spelling.blocks_for(len(h)) * spelling.LANES, dtype=np.uint64)
    for lane in range(2):
        at, mask = spelling.slots(spelling.mixed(h), len(lanes) // spelling.LANES, lane)
        np.bitwise_or.at(lanes, at, mask)
    filters = spelling.Filters({(9, 0): lanes}, {9: 1})
    assert len(filters.holding(9, h)) == len(h)
    others = spelling.hashes(rng.integers(97, 123, (100_000, 9)).astype(np.uint8))
    assert len(filters.holding(9, others)) < 2000
    assert len(filters.holding(8, others)) == 0
