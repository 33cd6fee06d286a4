import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

#: Names that the operators use inside; tables may have columns so named.
CLASHING = ["score", "part", "at", "key", "fp", "row_hash", "_found", "_row", "rank", "chunk", "word", "n", "held_out", "guard"]
DOCS = [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]
PAGES = [("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())]
ITEMS = [("item_id", pa.int64()), ("text", pa.string())]
LABELS = [("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())]
SCHEMAS = {"documents": DOCS, "pages": PAGES, "benchmark": ITEMS, "labels": LABELS}


@pytest.fixture(scope="session")
def write_tables(tmp_path_factory):
    """write_tables(documents=rows, ...) writes the tables, with clashing columns, and returns their folder."""

    def write(**tables):
        folder = tmp_path_factory.mktemp("tables")
        for name, rows in tables.items():
            schema = SCHEMAS[name]
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            arrays = [pa.array(c, type=t) for c, (_, t) in zip(columns, schema, strict=True)]
            names = [n for n, _ in schema]
            for extra in CLASHING:
                arrays.append(pa.array(["x"] * len(rows), type=pa.string()))
                names.append(extra)
            pq.write_table(pa.Table.from_arrays(arrays, names=names), folder / f"{name}.parquet")
        return str(folder)

    return write


def prose(rng: random.Random, words: int, pool: list[str]) -> str:
    return " ".join(rng.choice(pool) for _ in range(words)).capitalize() + "."


@pytest.fixture(scope="session")
def odd_documents():
    """Null, empty, tiny, repeated, long and unusual texts, and near copies."""
    rng = random.Random(4)
    pool = ["".join(rng.choice("abcdeéßñ日") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    base = prose(rng, 120, pool)
    texts = [None, "", "A.", "A.", "12 34 !!", "\x00\x01 nul bytes \x00", base, base, base + " tail", base.replace("a", "b", 1),
             "x " + base[:400] + "\n" + base[200:], prose(rng, 30_000, pool), "the " * 5000, "😀 " * 40, "token = 'abcdefgh12345678'",
             base[:60] * 3]
    texts += [prose(rng, rng.randint(1, 80), pool) for _ in range(30)]
    rows = [(10 + 3 * i, t, ["en", "de", None][i % 3], "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], rows[0], (None, base, "en", None, 1), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd_tables(write_tables, odd_documents):
    texts = [r[1] for r in odd_documents]
    items = [(0, texts[6][40:200]), (1, "the the the"), (2, None), (3, ""), (4, texts[6][40:200]), (None, texts[20]), (0, texts[6][40:200])]
    labels = [(r[0], i % 2, 0) for i, r in enumerate(odd_documents)] + [(10, None, None), (None, 1, 0), (10, 1, 1)]
    return write_tables(documents=odd_documents, benchmark=items, labels=labels)


@pytest.fixture(scope="session")
def empty_tables(write_tables):
    return write_tables(documents=[], pages=[], benchmark=[], labels=[])
