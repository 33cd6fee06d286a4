"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A document is a weighted set: its lower-cased words (between white space), each
with its occurrences as weight.  A word of more than ``LONG`` characters, or of
more than ``LONG_UNSPACED`` with a letter of a script written without spaces,
stands for its strings of ``SHINGLE`` characters, each with its occurrences as
weight, in shares of a word such that one just beyond the bound weighs as much as
one at it.  So near copies of texts without spaces stay alike, and no address or
blob outweighs the words around it unless it is most of the text.  For each of ``SAMPLES`` samples a word draws, from hashes
of itself alone, two gamma variables and a uniform one; with its weight they give
a quantised weight step and a rank, and the word of least rank is the sample.
Two documents agree in a sample with the probability of their generalised
Jaccard similarity, sum of the lesser weights by sum of the greater ones.  The
fingerprint is the samples' 16-bit codes in hex.

Both versions of a document, as it is and edited, share the draws of a word.
Documents are dealt by ranges of doc_id that hold about ``RANGE_ROWS`` rows, so
that a document meets its successor and its words without another shuffle.

Defined cases: null text is empty; texts without words have the fingerprint of
the empty set (all codes zero), alike among themselves; rows are ordered by
doc_id descending, null last, equal ids by text; repeated rows are each other's
successors; a table of one row is its own successor; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigsight.llm.common import table, whole_text
from sigsight.session import cut_lineage

SAMPLES = 64
#: Samples drawn from one row of a word; the rows of a word cover all samples.
AT_ONCE = 8
RANGE_ROWS = 1024
#: Ranges whose guards are found by a broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Tasks at most; beyond it a task takes several ranges, one after the other.
MOST_TASKS = 100_000
#: Quantiles of doc_id; each range between two is divided evenly where it holds more than RANGE_ROWS.
QUANTILES = 256
#: Words longer than this are told by their strings of SHINGLE characters.
LONG = 32
LONG_UNSPACED = 8
SHINGLE = 5
#: Such strings are listed from pieces of a word that begin so many characters apart.
PIECE = 4096
_BITS = 25
_CODE = 0xFFFF
_GAPS = "[ \\t\\r\\n]+"
_UNSPACED = "[" + "".join(rf"\p{{Is{x}}}" for x in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")) + "]"
# A match moves on by what stands behind the group, which overlaps the next one.
_PIECES = f"(?s)(?=(.{{{SHINGLE},{PIECE + SHINGLE - 1}}})).{{1,{PIECE}}}"
_SHINGLES = f"(?s)(?=(.{{{SHINGLE}}}))."


def ranges(docs: DataFrame) -> tuple[Column, int]:
    """A number of the range of doc_id, increasing with it (null ids are in range -1), and about how many there are."""
    share = [i / QUANTILES for i in range(1, QUANTILES)]
    low, high, n, cuts = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id"),
                                  F.percentile_approx("doc_id", share, 10_000)).first()
    if not n:
        return F.lit(-1).cast("long"), 1
    bounds = sorted({low, *cuts}) + [high + 1]
    parts = max(1, -(-n // (RANGE_ROWS * (len(bounds) - 1)))) if n > RANGE_ROWS else 1
    if n <= RANGE_ROWS:
        bounds = [low, high + 1]
    elif n <= RANGE_ROWS * QUANTILES:
        step = max(1, (len(bounds) - 1) * RANGE_ROWS // n)
        bounds = bounds[:-1:step] + bounds[-1:]
    at = F.array(*[F.lit(int(b)).cast("long") for b in bounds])
    index = F.size(F.filter(at, lambda b: b <= F.col("doc_id")))
    left, right = F.element_at(at, index), F.element_at(at, index + 1)
    inside = F.floor((F.col("doc_id") - left) / (right - left) * F.lit(parts))
    number = F.when(F.col("doc_id").isNull(), F.lit(-1).cast("long")).otherwise((index * F.lit(parts) + inside).cast("long"))
    return number, (len(bounds) - 1) * parts


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (part, at, guard, doc_id, text, next_text), numbered within their range by ``at``.

    The row after a range's last one, the first of the range below (below the
    lowest: of the highest), is repeated at its end as a guard.
    """
    part, n = ranges(docs)
    parted = docs.select(part.alias("part"), "doc_id", whole_text().alias("text"))
    # One number a range: its largest id, which the range above needs as its guard.
    tops = parted.groupBy("part").agg(F.max("doc_id").alias("top"))
    down = Window.orderBy("part")
    seats = cut_lineage(tops.select("top", F.lead("part").over(down).alias("above"), F.first("part").over(down).alias("low")))
    seats = seats.select("top", F.coalesce("above", "low").alias("above"))
    if seats.count() <= BROADCAST_ROWS:
        seats = F.broadcast(seats)
    order = [F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text"]
    guards = parted.join(seats, F.col("doc_id").eqNullSafe(F.col("top"))) \
        .withColumn("_n", F.row_number().over(Window.partitionBy("above").orderBy(*order[1:]))).filter("_n = 1")
    rows = parted.withColumn("guard", F.lit(0)).unionByName(
        guards.select(F.col("above").alias("part"), "doc_id", "text", F.lit(1).alias("guard")))
    # About one range a task: its words are sorted and counted in memory.
    rows = rows.repartition(min(n, MOST_TASKS), "part")
    order = Window.partitionBy("part").orderBy("guard", *order)
    return rows.select("part", F.row_number().over(order).alias("at"), "guard", "doc_id", "text",
                       F.lead("text").over(order).alias("next_text"))


def edited() -> Column:
    """The text, its last third replaced by the next text's beginning of that length."""
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))


def _uniform(bits: Column, shift: int, width: int = _BITS) -> Column:
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1)) + 0.5) / float(1 << width)


def samples(words: DataFrame) -> DataFrame:
    """Each row of ``words`` (a ``word``, a hash, with a ``weight``, a logarithm or null) once per turn with ``AT_ONCE`` samples.

    A sample is the rank of the word, and below it the code of the word and its step: the least long of a document is
    its sample.
    """
    out = words.withColumn("turn", F.explode(F.array(*[F.lit(i) for i in range(SAMPLES // AT_ONCE)])))
    drawn = []
    for j in range(AT_ONCE):
        one = F.xxhash64("word", F.col("turn") * 2 * AT_ONCE + 2 * j)
        two = F.xxhash64("word", F.col("turn") * 2 * AT_ONCE + 2 * j + 1)
        r = -F.log(_uniform(one, 0) * _uniform(one, _BITS))
        c = F.log(-F.log(_uniform(two, 0) * _uniform(two, _BITS)))
        b = (F.shiftrightunsigned(one, 50) * 16384 + F.shiftrightunsigned(two, 50) + 0.5) / float(1 << 28)
        step = F.floor(F.col("weight") / r + b)
        rank = c - r * (step - b + 1)
        code = one.bitwiseXOR(step * 40503).bitwiseAND(F.lit(_CODE))
        drawn.append(F.shiftleft(((rank + 128) * float(1 << 31)).cast("long"), 16).bitwiseOR(code).alias(f"s{j}"))
    return out.select("*", *drawn)


def _hex(columns: list[str]) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(F.coalesce(F.col(c), F.lit(0).cast("long")).bitwiseAND(F.lit(_CODE)))), 4, "0")
                      for c in columns])


def likeness(one: str, other: str) -> Column:
    """Share of equal samples of two fingerprints."""
    codes = [F.regexp_extract_all(x, F.lit("...."), F.lit(0)) for x in (one, other)]
    same = F.zip_with(*codes, lambda a, b: (a == b).cast("int"))
    return F.aggregate(same, F.lit(0), lambda n, x: n + x) / float(SAMPLES)


def _share(word: str) -> Column:
    """What a string of a long word weighs; null for the other words, which weigh 1."""
    size = F.char_length(word)
    unspaced = (size > LONG_UNSPACED) & (F.octet_length(word) > size) & F.col(word).rlike(_UNSPACED)
    return F.when(unspaced, 1 / (LONG_UNSPACED - SHINGLE + 1)).when(size > LONG, 1 / (LONG - SHINGLE + 1))


def _parted(text: str, pattern: str) -> Column:
    """What the pattern finds in the text if it is of a long word, else the text."""
    return F.when(F.col("long"), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).otherwise(F.array(text))


def fingerprints(rows: DataFrame, key: list[str], texts: dict[str, str]) -> DataFrame:
    """``key`` with a fingerprint column, named by ``texts``, for each text column; rows lie by ``key[0]``."""
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(t).alias("t")) for i, t in enumerate(texts)]))
    # The empty word, which every wordless text has, gets no weight.
    words = rows.select(*key, sides.alias("s")).select(*key, "s.side", F.explode(F.split(F.lower("s.t"), _GAPS)).alias("w")) \
        .select(*key, "side", "w", _share("w").alias("share")).select("*", F.col("share").isNotNull().alias("long")) \
        .select(*key, "side", "share", "long", F.explode(_parted("w", _PIECES)).alias("w")) \
        .select(*key, "side", "share", "long", F.explode(_parted("w", _SHINGLES)).alias("w")) \
        .select(*key, "side", F.when(F.col("long"), F.xxhash64("w", F.lit(1))).otherwise(F.xxhash64("w")).alias("word"),
                F.when(F.char_length("w") == 0, 0.0)
                 .otherwise(F.coalesce("share", F.lit(1.0))).alias("size"))
    counts = words.groupBy(*key, "word", "size").agg(
        *[F.count(F.when(F.col("side") == i, 1)).alias(f"n{i}") for i in range(len(texts))])
    # One row for all texts of a document that hold the word equally often; ``sides`` has their bits.
    ns = [F.col(f"n{i}") for i in range(len(texts))]
    first = [n if not i else F.when(n.isin(ns[:i]), F.lit(0)).otherwise(n) for i, n in enumerate(ns)]
    sides = [F.when(n == F.col("n"), F.lit(1 << i)).otherwise(F.lit(0)) for i, n in enumerate(ns)]
    entries = counts.select("*", F.explode(F.array(*first)).alias("n")).filter("n > 0") \
        .select(*key, "word", "size", "n", sum(sides[1:], sides[0]).alias("sides"))
    # A word's samples at a weight serve all documents of the range that hold it so often. The groups are sorted by
    # the first column first, which must not be the range: it is the same in all rows of a task.
    holders = entries.groupBy("word", "n", "size", key[0]).agg(F.collect_list(F.struct(*key[1:], "sides")).alias("holders"))
    every = samples(holders.withColumn("weight", F.when(F.col("size") > 0, F.log(F.col("n") * F.col("size"))))) \
        .withColumn("held", F.explode("holders")).drop("holders").select("*", "held.*")
    least = every.groupBy(*key, "sides", "turn").agg(*[F.min(f"s{j}").alias(f"s{j}") for j in range(AT_ONCE)])
    drawn = least.groupBy(*key, "turn").agg(
        *[F.min(F.when(F.col("sides").bitwiseAND(F.lit(1 << i)) != 0, F.col(f"s{j}"))).alias(f"w{i}_{j}")
          for i in range(len(texts)) for j in range(AT_ONCE)])
    parts = drawn.select(*key, "turn", *[_hex([f"w{i}_{j}" for j in range(AT_ONCE)]).alias(f"f{i}") for i in range(len(texts))])
    ordered = parts.groupBy(*key).agg(
        *[F.array_sort(F.collect_list(F.struct("turn", f"f{i}"))).alias(f"f{i}") for i in range(len(texts))])
    return ordered.select(*key, *[F.array_join(F.col(f"f{i}")[f"f{i}"], "").alias(name)
                                  for i, name in enumerate(texts.values())])


def op1_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = with_next(docs).withColumn("edited", edited())
    prints = fingerprints(rows, ["part", "at"], {"text": "fingerprint", "edited": "edited_fingerprint"})
    after = F.lead("fingerprint").over(Window.partitionBy("part").orderBy("at"))
    prints = prints.withColumn("_next", after).select(
        "part", "at", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "_next").alias("near_next"))
    facts = rows.filter("guard = 0").select("part", "at", "doc_id", F.char_length("text").cast("long").alias("n_chars"),
                                            F.sha2("edited", 256).alias("edited_sha256"))
    return facts.join(prints, ["part", "at"]).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
