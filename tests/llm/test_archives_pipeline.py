"""WARC archives, the pipeline and the entry's guard."""

import hashlib
import random
import subprocess
import sys
from collections import Counter

import corpus_pipeline
from sigsight.llm import registry, secrets, warc
from tests.llm.test_texts import brute_components, brute_fingerprint, words_of


def test_revisits(spark, write_tables):
    long, other = "é" * 600 + "\r\n\r\nWARC/1.1\r\n", "b" * 1000
    pages = [(1, "http://a/", long), (2, "http://b/\r\nx", long), (3, None, long), (4, "u", "short"), (5, "u", "short"), (6, "u", None),
             (7, "u", ""), (8, "u", other), (9, "u", other[1:]), (10, "u", "x" * 200_000), (None, "n", other), (11, "u", "a\r\n\r\nb")]
    pages += [(20, "r", "r" * 2000)] * 3 + [(i, "many", "m" * 1500) for i in range(100, 160)]
    got = [tuple(r) for r in registry.QUERIES["op5_warc_revisits"](spark, write_tables(pages=pages)).collect()]
    top = {}
    for i, _, h in pages:
        if h and len(h.encode()) >= 1000:
            top[h] = max(top.get(h, -1), -1 if i is None else i)
    want, kept = [], set()
    for i, _, h in pages:
        data = (h or "").encode()
        first = len(data) < 1000 or (top[h] == i and h not in kept)
        if len(data) >= 1000 and first:
            kept.add(h)
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if first else "revisit", None if first else top[h]))
    assert Counter(got) == Counter(want)


def test_archives_are_wellformed(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "x" * 1200), (2, "http://b/", "x" * 1200)], "page_id long, url string, html string")
    warc.write_archives(warc.page_records(pages.coalesce(1)), str(tmp_path / "raw"), 2000)
    warc.deduplicate(spark, str(tmp_path / "raw"), str(tmp_path / "new"), 2000)
    records = [(f, b) for p in (tmp_path / "new").glob("*.gz") for _, f, b in warc.parse(warc._unzipped(p.read_bytes()))]
    kinds = {f["warc-record-id"]: (f, b) for f, b in records}
    fields, block = kinds["<urn:page:1>"]
    assert fields["warc-type"] == "revisit" and fields["warc-refers-to"] == "<urn:page:2>"
    assert fields["warc-refers-to-target-uri"] == "http://b/" and fields["warc-profile"] == warc.PROFILE
    assert block.endswith(b"Content-Length: 1200\r\n\r\n")
    assert kinds["<urn:page:2>"][1].endswith(b"x" * 1200)


def test_pipeline_against_brute_force(spark, odd_tables, odd_documents):
    items = [r.text for r in spark.read.parquet(f"{odd_tables}/benchmark.parquet").collect()]
    rows = [r for r in odd_documents if r[1] and any(c.isalpha() for c in r[1])]
    root = brute_components([brute_fingerprint(r[1]) for r in rows])
    keep = [min((rows[j] for j in range(len(rows)) if root[j] == k), key=lambda r: (r[0] is None, r[0] or 0)) for k in set(root)]
    windows = set()
    for t in items:
        w = words_of(t)
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1) if w}
    def clean(t):
        w = words_of(t)
        return not any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w)))
    want = Counter(r[0] for r in keep if clean(r[1]))
    assert want and any(r[0] is None for r in rows)

    docs = spark.read.parquet(f"{odd_tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, odd_tables)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    last = docs.collect()
    assert Counter(r.doc_id for r in last) == want
    assert all(r.n_chars == len(r.text) and not secrets.find([r.text.encode()])[0] for r in last)
    pieces = corpus_pipeline.run(spark, odd_tables).collect()
    assert {p["doc_id"] for p in pieces} == set(want)


def test_near_duplicate_stage_tells_rows_by_id_and_text(spark):
    rng = random.Random(3)
    some = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(200))
    one, other, third, fourth = some(), some(), some(), some()
    rows = [(7, one), (7, other), (7, one), (7, one), (None, third), (None, third + " "), (None, fourth), (3, other + " "), (9, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    third_kept = next(t for i, t in kept if t in (third, third + " "))
    assert kept == Counter([(7, one), (3, other + " "), (None, third_kept), (None, fourth), (9, None)])


def test_language_stage_has_one_rule_for_all_lengths(spark, monkeypatch):
    """Texts of no learned language go once their n-grams are many enough to be sure, short ones stay."""
    rng = random.Random(1)
    known = [" ".join(rng.choices(["hello", "world", "there", "where", "other"], k=60)) for _ in range(30)]
    strange = "".join(rng.choices("qxzjkvw", k=20_000))
    texts = [*known, *(strange[:n] for n in (1, 5, 39, 40, 41, 80, 300, 20_000)), "A.", "½", None]
    docs = spark.createDataFrame([(i, t, "en" if i < 30 else None, "s", 0) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert kept == {*range(36), 38} - {39, 40}


def test_pipeline_of_empty_tables(spark, empty_tables):
    assert corpus_pipeline.run(spark, empty_tables).count() == 0


def test_entry_without_this_subpackage():
    code = ("import sys\nfor m in ('sigsight.llm', 'corpus_pipeline'): sys.modules[m] = None\n"
            "import __spark_entry__ as e\nassert e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())")
    assert subprocess.run([sys.executable, "-c", code], capture_output=True).returncode == 0
    code = "import __spark_entry__ as e\nassert len([k for k in e.queries() if k.startswith('op') or k == 'pipeline']) == 14"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True).returncode == 0
