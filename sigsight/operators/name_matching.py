"""Names in texts by Aho-Corasick automata, in one pass over each text.

The names are dealt by a hash into blocks of at most about ``BLOCK_BYTES``; a
block is broadcast and scans the texts once, and only texts that hold a name of
it leave the scan.  So what is broadcast does not grow with the registry, and
what is shuffled is at most one row a block and matched text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of names in one automaton, which takes some 60 times as many.
BLOCK_BYTES = 2 << 20
KINDS = ("norm", "raw")


def automaton(names: list[tuple[str, str, str]]) -> tuple[ahocorasick.Automaton | None, tuple[str, str] | None]:
    """The automaton of (form, ord, service), and the (ord, service) of the empty form, which every text holds."""
    found, empty = ahocorasick.Automaton(), None
    for form, ord_, service in names:
        if form:
            found.add_word(form, (ord_, service))
        else:
            empty = (ord_, service)
    if not len(found):
        return None, empty
    found.make_automaton()
    return found, empty


def first_in(text: str | None, matcher: tuple) -> tuple[str, str] | tuple[None, None]:
    """The smallest (ord, service) among the names that the text holds."""
    if text is None:
        return None, None
    found, empty = matcher
    best = min((value for _, value in found.iter(text)), default=None) if found is not None else None
    if empty is not None and (best is None or empty < best):
        best = empty
    return best or (None, None)


def _scan(shared, columns: list[str], ord_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = {kind: automaton(shared.value.get(kind, [])) for kind in KINDS}
        for batch in batches:
            found = [[first_in(t, matchers[kind]) for t in batch.column(kind).to_pylist()] for kind in KINDS]
            kept = [i for i, pair in enumerate(zip(*found, strict=True)) if any(p[1] is not None for p in pair)]
            arrays = [batch.column("_key").take(pa.array(kept, pa.int64()))]
            for matches in found:
                arrays += [pa.array([matches[i][j] for i in kept], t) for j, t in enumerate((ord_type, pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=columns)
    return run


def first_names(texts: DataFrame, forms: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(_key, norm_ord, norm_service, raw_ord, raw_service) of the texts that hold a name of either kind, once a block.

    ``texts`` is (_key, norm, raw), ``forms`` is (kind, form, ord, service) with each form of a kind once.
    """
    spark = texts.sparkSession
    forms = forms.select("kind", "form", "ord", "service")
    ord_type = forms.schema["ord"].dataType
    size = forms.agg(F.sum(F.octet_length("form") + 8)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    columns = ["_key", "norm_ord", "norm_service", "raw_ord", "raw_service"]
    types = [texts.schema["_key"].dataType.simpleString(), *[ord_type.simpleString(), "string"] * 2]
    schema = ", ".join(f"{c} {t}" for c, t in zip(columns, types, strict=True))
    found = []
    for block in range(blocks):
        names: dict[str, list[tuple[str, str, str]]] = {}
        for r in forms.where(F.pmod(F.xxhash64("form"), F.lit(blocks)) == block).collect():
            names.setdefault(r["kind"], []).append((r["form"], r["ord"], r["service"]))
        found.append(texts.select("_key", *KINDS).mapInArrow(_scan(spark.sparkContext.broadcast(names), columns, to_arrow_type(ord_type)), schema))
    return reduce(DataFrame.unionByName, found)
