"""Vectorised top-k for the many-question search (Arrow batches + numpy), the one algorithm at every size.

Spark SQL has no vector functions, and a per-pair ``aggregate(zip_with(..))``
runs as interpreted lambdas, so similarities are computed a cell at a time.
Questions and events meet in a blocked theta-join:

* a date's events are dealt into parts of about ``CELL_EVENTS`` and the
  questions whose window touches the date into blocks of about
  ``CELL_QUESTIONS``; every (date, part, block) is a cell, an event goes to each
  block of its date and a question to each part of its dates.  A hot date is
  more cells, not a larger one;
* the cells are met in at most ``ROUNDS`` rounds of about ``ROUND_ROWS`` rows or more, by
  date, a large date in slices by hash: a round's shuffle files go before the next, and
  what is kept on disk is a part of the events, not all of them.  After a round a question
  with k hits asks only for rows that reach its k-th best (``floor``), so that hits do not
  grow with the cells.  The driver gets one row of bounds, the sum and a row a round;
* ``cogroup`` brings a cell's events and questions together; questions without a
  service filter meet all of its rows, those with one the rows of that service;
* a cell's rows are in the order of time, so a window is a run of them; unit vectors in
  single precision select, per question, the rows within the rounding errors of the
  k-th best (a superset);
* for those rows only the cosine is recomputed with the sequential
  left-to-right sums of the SQL expression (``vectors.dot``/``norm``), which
  gives bit-identical values, and the cell emits its k best, ties with the
  k-th in the order of the keys;
* the final ``row_number()`` over ``(cos desc, event_id, id)`` picks the k, and
  the payload is joined back for those rows, one payload row for each; a payload of
  keys alone needs no second scan, and ``meet`` fetches payloads of kept hits later.

A null vector, one of another length or of zero norm on either side has a null
similarity and ranks last.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigsight.functions.vectors import similarity_score
from sigsight.session import cut_lineage, free_shuffles

#: Questions multiplied at once, and values of a run whose best is looked at first.
Q_CHUNK = 128
BEST_OF = 32
#: Events and questions of a cell, about.
CELL_EVENTS = 262144
CELL_QUESTIONS = 65536
#: Event rows that a round shuffles, about (questions and hits counted as such), and the most rounds.
ROUND_ROWS = 1 << 22
ROUNDS = 16
# Hits of a cell that take as much as an event with its vector, about.
HITS_A_ROW = 4
# Values of a product of a chunk of questions and a run of rows, about.
CHUNK_VALUES = 1 << 22
# Rows made unit vectors at once.
UNIT_ROWS = 16384
# The winners are broadcast to the payload scan only up to this size, measured on the finished winners.
WINNER_BYTES = 64 * 1024 * 1024
# A winner's id in a broadcast, about.
ID_BYTES = 24

#: What tells a hit's event.
KEYS = ["id", "event_id", "event_date"]
_OUT_SCHEMA = "qid long, event_id string, id long, event_date date, cos double"


def _ntz_literal(at: dt.datetime):
    """A ``timestamp_ntz`` literal, independent of the session time zone."""
    return F.lit(at.isoformat()).cast("timestamp_ntz")


def _vectors(col: pa.Array, dim: int, single: bool = False) -> np.ndarray:
    """list<float> Arrow column → (n, dim) float64 (``single``: as stored, if floats); null rows and rows of another length are NaN."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    fits = pc.fill_null(pc.equal(pc.list_value_length(col), dim), False)
    kept = col.filter(fits).flatten().to_numpy(zero_copy_only=False)
    kept = kept.astype(np.float32 if single and kept.dtype == np.float32 else np.float64, copy=False)
    mask = fits.to_numpy(zero_copy_only=False)
    if mask.all():
        return kept.reshape(len(col), dim)
    out = np.full((len(col), dim), np.nan, dtype=kept.dtype)
    out[mask] = kept.reshape(int(mask.sum()), dim)
    return out


def _questions(q: DataFrame, qid: str, qvec: str, start: str, end: str, service: str,
               event_types: str | None) -> DataFrame:
    """The usable questions' narrow columns; computed once."""
    types = F.when(F.size(F.col(event_types)) > 0, F.col(event_types)) if event_types \
        else F.lit(None).cast("array<string>")
    side = q.where(F.coalesce(F.col(start) < F.col(end), F.lit(False))).select(
        F.col(qid).cast("long").alias("qid"), F.col(qvec).alias("qvec"),
        F.col(start).cast("timestamp_ntz").alias("start"), F.col(end).cast("timestamp_ntz").alias("end"),
        F.nullif(F.col(service), F.lit("")).alias("service"), types.alias("types"),
        F.greatest(F.coalesce(F.size(F.col(qvec)), F.lit(0)), F.lit(0)).alias("dim"))
    return cut_lineage(side)


def _side(t: pa.Table, dim: int) -> dict:
    """Questions with vectors of one length, as numpy arrays sorted by window start."""
    t = t.sort_by("start")
    mat = _vectors(t.column("qvec"), dim, single=True)
    norm = _seq_norm(mat)
    return {"qid": t.column("qid").to_numpy(), "mat": mat, "dim": dim, "norm": norm, "plain": _plain(norm), "unit": _unit(mat, norm),
            "floor": pc.fill_null(t.column("floor"), -np.inf).to_numpy() if "floor" in t.column_names else np.full(len(t), -np.inf),
            "start": t.column("start").cast(pa.int64()).to_numpy(), "end": t.column("end").cast(pa.int64()).to_numpy(),
            "service": t.column("service").to_pylist(), "types": t.column("types").to_pylist()}


def _seq_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise dot products summed left to right (the order of the SQL ``aggregate``)."""
    acc = np.zeros(a.shape[0])
    for i in range(a.shape[1]):
        acc = acc + a[:, i].astype(np.float64, copy=False) * b[:, i].astype(np.float64, copy=False)
    return acc


def _seq_norm(mat: np.ndarray) -> np.ndarray:
    """Row norms from left-to-right sums; NaN for rows of another length."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.sqrt(_seq_dot(mat, mat))


def _exact_cos(e: np.ndarray, e_norm: np.ndarray, q: np.ndarray, q_norm: np.ndarray) -> np.ndarray:
    """Cosine of row pairs, bit-identical to ``cosine_from_parts(dot, norm, norm)``; NaN for zero norms."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        denom = q_norm * e_norm
        return np.where(denom > 0, np.maximum(-1.0, np.minimum(1.0, _seq_dot(e, q) / denom)), np.nan)


def _plain(norm: np.ndarray) -> np.ndarray:
    """Norms whose products neither vanish nor overflow."""
    with np.errstate(invalid="ignore"):
        return (norm > 1e-100) & (norm < 1e100)


def _unit(mat: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Single-precision unit vectors; zero where the norm is not plain."""
    ok, out = _plain(norm), np.zeros(mat.shape, dtype=np.float32)
    for at in range(0, len(mat), UNIT_ROWS):
        some = slice(at, at + UNIT_ROWS)
        out[some] = np.where(ok[some, None], mat[some] / np.where(ok[some], norm[some], 1.0)[:, None], 0.0)
    return out


def _near_best(cos: np.ndarray, k: int, margin: float, floor: float = -np.inf) -> np.ndarray:
    """Places of the values within ``margin`` of the k-th best and of ``floor``; all of them when k or fewer."""
    if floor > -np.inf:
        above = np.flatnonzero(cos >= np.float32(floor - margin))
        return above if len(above) <= k else above[_near_best(cos[above], k, margin)]
    n = len(cos)
    if n <= k:
        return np.arange(n)
    some = np.arange(0)
    if n > 64 * BEST_OF:
        # k runs of values have their best at or above the k-th of the runs' bests, and so has the k-th value.
        runs = n // BEST_OF
        bests = cos[:runs * BEST_OF].reshape(runs, BEST_OF).max(axis=1)
        if runs > k:
            some = np.flatnonzero(cos >= np.partition(bests, runs - k)[runs - k] - margin)
    if not len(some):
        some = np.arange(n)
    kept = cos[some]
    kth = np.partition(kept, len(kept) - k)[len(kept) - k]
    return some[kept >= kth - margin]


def _best(side: dict, mine: np.ndarray, rows: np.ndarray, cell: dict, k: int):
    """(question, rows, exact cosines) of a question's k best rows of the cell.

    ``rows`` are in the order of time, so that a window is a run of them.  Of rows that tie
    with the k-th, or without a similarity, the first by key are enough; ``turn(nulls)`` tells
    the rows' order by key.
    """
    fine, odd = rows[cell["plain"][rows]], rows[~cell["plain"][rows]]
    ts, odd_ts = cell["ts"][fine], cell["ts"][odd]
    unit = cell["unit"][fine]
    at = np.searchsorted(ts, side["start"][mine], "left")
    to = np.searchsorted(ts, side["end"][mine], "right")
    odd_at = np.searchsorted(odd_ts, side["start"][mine], "left")
    odd_to = np.searchsorted(odd_ts, side["end"][mine], "right")
    # Of the odd rows those without a norm have no similarity.
    with np.errstate(invalid="ignore"):
        real = np.concatenate([[0], np.cumsum((cell["norm"][odd] > 0) & np.isfinite(cell["norm"][odd]))])
    met = np.flatnonzero((to > at) | (odd_to > odd_at))
    met = met[np.lexsort((to[met], at[met]))]
    step = max(8, min(Q_CHUNK, CHUNK_VALUES // max(1, len(fine))))
    for first in range(0, met.size, step):
        chunk = met[first:first + step]
        lo, hi = at[chunk].min(), max(to[chunk].max(), at[chunk].min())
        cos = side["unit"][mine[chunk]] @ unit[lo:hi].T
        picked = []
        for i, j in enumerate(chunk):
            a, b, c, d = at[j], max(to[j], at[j]), odd_at[j], odd_to[j]
            if not side["plain"][mine[j]]:
                picked.append(np.concatenate([fine[a:b], odd[c:d]]))
                continue
            one = fine[a + _near_best(cos[i, a - lo:b - lo], k, cell["margin"], side["floor"][mine[j]])]
            if c < d:
                others = odd[c:d]
                if b - a + real[d] - real[c] > k:
                    norm = cell["norm"][others]
                    others = others[(norm > 0) & np.isfinite(norm)]
                one = np.concatenate([one, others])
            picked.append(one)
        sizes = [len(p) for p in picked]
        row, q = np.concatenate(picked), np.repeat(mine[chunk], sizes)
        exact = _exact_cos(cell["emb"][row], cell["norm"][row], side["mat"][q], side["norm"][q])
        end = 0
        for j, size in zip(chunk, sizes):
            some, value = row[end:end + size], exact[end:end + size]
            end += size
            keep, floor = _leading(value, k), side["floor"][mine[j]]
            if floor > -np.inf:
                with np.errstate(invalid="ignore"):
                    keep &= value >= floor
            blank = np.flatnonzero(keep & np.isnan(value))
            if len(blank) > k:
                keep[blank[np.argsort(cell["turn"]("at_end")[some[blank]])[k:]]] = False
            elif keep.sum() - len(blank) > k:
                # Ties with the k-th, as the final ranking takes them: null keys first.
                places = np.flatnonzero(keep)
                keep[places[np.lexsort((cell["turn"]("at_start")[some[places]], -value[places]))[k:]]] = False
            yield side["qid"][mine[j]], some[keep], value[keep]


def _leading(cos: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k best values and ties with the k-th; all of them, nulls too, when k or fewer are real."""
    real = ~np.isnan(cos)
    if real.sum() <= k:
        return np.ones(len(cos), dtype=bool)
    kth = np.partition(cos[real], real.sum() - k)[real.sum() - k]
    with np.errstate(invalid="ignore"):
        return real & (cos >= kth)


def _cell(k: int):
    """The ``cogroup`` body: what may rank among the k best of a cell's questions."""
    def fn(events: pa.Table, questions: pa.Table) -> pa.Table:
        found = []
        events = events.combine_chunks()
        for dim in questions.column("dim").unique().to_pylist() if events.num_rows else []:
            found += _matches(events, _side(questions.filter(pc.equal(questions.column("dim"), dim)), dim), k)
        qids = np.concatenate([np.zeros(0, np.int64), *[np.full(len(r), one, dtype=np.int64) for one, r, _ in found]])
        idx = pa.array(np.concatenate([np.zeros(0, np.int64), *[r for _, r, _ in found]]))
        cos = np.concatenate([np.zeros(0), *[c for _, _, c in found]])
        return pa.table([pa.array(qids), events.column("event_id").take(idx), events.column("id").take(idx),
                         events.column("event_date").take(idx), pa.array(cos, mask=np.isnan(cos))],
                        names=["qid", "event_id", "id", "event_date", "cos"])
    return fn


def _matches(events: pa.Table, side: dict, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(question, rows, exact cosines) of the questions that meet some row."""
    n = events.num_rows
    ts = events.column("occurred_at").cast(pa.int64()).to_numpy()
    # Questions are sorted by start: those starting after the last event are skipped cheaply.
    upto = np.searchsorted(side["start"], ts.max(), side="right")
    cand = np.flatnonzero(side["end"][:upto] >= ts.min())
    if not cand.size:
        return []
    emb = _vectors(events.column("embedding"), side["dim"], single=True)
    norm = _seq_norm(emb)
    e_svc = np.array(events.column("service").to_pylist(), dtype=object)
    e_type = np.array(events.column("event_type").to_pylist(), dtype=object)

    @lru_cache(maxsize=2)
    def turn(nulls):
        keys = pa.table({"e": events.column("event_id"), "i": events.column("id")})
        out = np.empty(n, dtype=np.int64)
        out[pc.sort_indices(keys, sort_keys=[("e", "ascending"), ("i", "ascending")], null_placement=nulls).to_numpy()] = np.arange(n)
        return out

    # A sum of single-precision products errs by less than a rounding a term; both sides of a comparison may.
    cell = {"emb": emb, "norm": norm, "plain": _plain(norm), "unit": _unit(emb, norm), "ts": ts, "turn": turn,
            "margin": (side["dim"] + 8) * 2.0 ** -22}
    # A question meets the rows of its service and types only.
    groups: dict[tuple, list[int]] = {}
    for one in cand:
        groups.setdefault((side["service"][one] or "", tuple(sorted(set(side["types"][one] or ()), key=str))), []).append(one)
    order, found = np.argsort(ts, kind="stable"), []
    for (name, types), mine in groups.items():
        rows = order if name == "" else order[e_svc[order] == name]
        rows = rows[np.isin(e_type[rows], np.array(types, dtype=object))] if types else rows
        if rows.size:
            found += _best(side, np.array(mine), rows, cell, k)
    return found


def _in_bounds(events: DataFrame, lo: dt.datetime, hi: dt.datetime) -> DataFrame:
    """Static bounds: Parquet skips row groups and date partitions outside them."""
    return events.where(F.col("event_date").between(F.to_date(_ntz_literal(lo)), F.to_date(_ntz_literal(hi)))
                        & F.col("occurred_at").between(_ntz_literal(lo), _ntz_literal(hi)))


def _by_date(side: DataFrame, dates: DataFrame) -> DataFrame:
    """The questions by the dates of events that their windows touch."""
    reach = dates.agg(F.min("event_date").alias("_first"), F.max("event_date").alias("_last"))
    first, last = F.greatest(F.to_date("start"), F.col("_first")), F.least(F.to_date("end"), F.col("_last"))
    return side.join(F.broadcast(reach)).where(first <= last) \
        .select(*side.columns, F.explode(F.sequence(first, last)).alias("event_date"))


def _plan(side: DataFrame, narrow: DataFrame, k: int) -> tuple[DataFrame, DataFrame, list]:
    """The dates, how each is dealt (event_date, slice, slices, parts, blocks, round), and the rounds (first, last, cells)."""
    dates = cut_lineage(narrow.groupBy("event_date").agg(F.count(F.lit(1)).alias("n_events")))  # one row a date
    counted = _by_date(side, dates).groupBy("event_date").agg(F.count(F.lit(1)).alias("n_questions"))
    ceil = lambda n, of: F.ceil(F.col(n) / of).cast("int")
    sized = dates.join(counted, "event_date").withColumn("blocks", ceil("n_questions", CELL_QUESTIONS))
    sized = cut_lineage(sized.withColumn("rows", F.col("n_events") * F.col("blocks")
                                         + F.col("n_questions") * ceil("n_events", CELL_EVENTS) * (1 + k / HITS_A_ROW)))
    size = max(ROUND_ROWS, (sized.agg(F.sum("rows")).first()[0] or 0) / ROUNDS)
    before = Window.orderBy("event_date").rowsBetween(Window.unboundedPreceding, -1)  # one row a date
    sliced = sized.withColumn("_before", F.coalesce(F.sum("rows").over(before), F.lit(0.0))).withColumn("slices", ceil("rows", size)) \
        .withColumn("parts", F.ceil(F.col("n_events") / F.col("slices") / CELL_EVENTS).cast("int")) \
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    at = F.floor((F.col("_before") + F.col("slice") * F.col("rows") / F.col("slices")) / size)
    plan = cut_lineage(sliced.select("event_date", "slice", "slices", "parts", "blocks", at.alias("round")))
    rounds = plan.groupBy("round").agg(F.min("event_date").alias("first"), F.max("event_date").alias("last"),
                                       F.sum(F.col("parts") * F.col("blocks")).alias("cells")).orderBy("round").collect()
    return dates, plan, rounds


def _cells(asked: DataFrame, narrow: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions and events of one round, dealt to their cells (event_date, slice, part, block)."""
    plan = F.broadcast(plan)
    # Slices are in different rounds: a row's must be the same whenever it is read.  In a round
    # the partition tells rows with the same ids apart, so that they are dealt out too.
    mine = F.pmod(F.xxhash64("id", "event_id"), F.col("slices")) == F.col("slice")
    part = F.pmod(F.xxhash64("event_id", "id", F.spark_partition_id()), F.col("parts")).cast("int")
    block = F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int")
    whole = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    events = narrow.join(plan, "event_date").where(mine) \
        .withColumn("part", part).withColumn("block", whole("blocks")).drop("slices", "parts", "blocks", "round")
    questions = asked.join(plan, "event_date").withColumn("block", block).withColumn("part", whole("parts")) \
        .drop("slices", "parts", "blocks", "round")
    return questions, events


def _topk(side: DataFrame, narrow: DataFrame, k: int, few: bool) -> DataFrame:
    """The k best (qid, event_id, _id, event_date, cos) of each question, with ``sim_rank`` and ``_turn`` among equal rows; computed."""
    spark, top = narrow.sparkSession, None
    dates, plan, rounds = _plan(side, narrow, k)
    cell = ["event_date", "slice", "part", "block"]
    # Narrow: column by column, an event row is told by event_id, id and date; equal rows by their turn.
    w = Window.partitionBy("qid").orderBy(F.col("cos").desc_nulls_last(), "event_id", "id")
    turn = F.row_number().over(Window.partitionBy("qid", "event_id", "id", "event_date").orderBy("sim_rank"))
    for at in range(max(1, len(rounds))):
        asking, met, cells, dealt = side.withColumn("floor", F.lit(None).cast("double")), narrow, 0, plan
        if rounds:
            met, cells = narrow.where(F.col("event_date").between(F.lit(rounds[at]["first"]), F.lit(rounds[at]["last"]))), rounds[at]["cells"]
            dealt = plan.where(F.col("round") == rounds[at]["round"])
        if top is not None:
            floors = top.where((F.col("sim_rank") == k) & F.col("cos").isNotNull()).select("qid", F.col("cos").alias("floor"))
            asking = side.join(F.broadcast(floors) if few else floors, "qid", "left")
        free_shuffles(spark)
        asked, events = _cells(_by_date(asking, dates), met, dealt)
        # A fixed number: cells are little data and much work, which sizes would put together into too few tasks.
        # Several tasks a cell: as they are dealt by a hash, few then share a task while others have none.
        tasks = max(1, min(4 * cells, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism)))
        found = events.repartition(tasks, *cell).groupBy(*cell).cogroup(asked.repartition(tasks, *cell).groupBy(*cell)) \
            .applyInArrow(_cell(k), _OUT_SCHEMA)
        if top is not None:
            found = top.select(*found.columns).unionByName(found)
        top = found.withColumn("sim_rank", F.row_number().over(w)).where(F.col("sim_rank") <= k)
        top = cut_lineage(top if at + 1 < len(rounds) else top.withColumn("_turn", turn).withColumnRenamed("id", "_id"))
    free_shuffles(spark)
    return top


def search(q: DataFrame, events: DataFrame, k: int, qid: str, qvec: str, start: str, end: str,
           service: str, event_types: str | None, payload: list[str] | None,
           by_id: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Top-k per question: (qid, sim_rank, cos, similarity_score, *payload).

    ``by_id`` gives the events of a table of ids; for a view that joins several
    tables it can take them before its joins.  Without it the events are scanned again.
    A payload of ``KEYS`` alone is what the search holds, unless questions or events repeat their keys.
    None gives the hits with ``KEYS`` and their ``_turn`` among equal rows, for ``meet``.
    """
    side = _questions(q, qid, qvec, start, end, service, event_types)
    lo, hi, n = side.agg(F.min("start"), F.max("end"), F.count(F.lit(1))).first()
    if lo is None:
        lo = hi = dt.datetime(1970, 1, 1)
    narrow = _in_bounds(events.select("event_id", F.col("id").cast("long").alias("id"), "event_date", "occurred_at", "service",
                                      "event_type", "embedding"), lo, hi)
    top = _topk(side, narrow, k, n * ID_BYTES <= WINNER_BYTES)
    if payload is None or set(payload) <= set(KEYS) and top.where("_turn > 1").isEmpty():
        # A hit without an event_id has no event to be joined to.
        return top.where(F.col("event_id").isNotNull()).withColumnRenamed("_id", "id") \
            .withColumn("similarity_score", similarity_score(F.col("cos"))).withColumnRenamed("qid", qid)
    size, found = top.agg(F.sum(F.coalesce(F.octet_length("event_id"), F.lit(0)) + 96), F.count_distinct("_id")).first()
    ids, few = top.select("_id").distinct(), found * ID_BYTES <= WINNER_BYTES
    ids = F.broadcast(ids) if few else ids
    body = _in_bounds((by_id(ids) if by_id else events).select(*payload, "event_date"), lo, hi)
    if (size or 0) <= WINNER_BYTES:
        top = F.broadcast(top)
    elif few and not by_id:
        body = body.join(ids, F.col("id").cast("long").eqNullSafe(ids["_id"]), "left_semi")
    joined = body.join(top, ["event_id", "event_date"]).where(F.col("id").cast("long").eqNullSafe(F.col("_id")))
    seat = Window.partitionBy("qid", "sim_rank").orderBy(*[F.xxhash64(c) for c in payload])
    joined = joined.withColumn("_seat", F.row_number().over(seat)).where(F.col("_seat") == F.col("_turn"))
    return (joined.drop("_seat", "_turn", "_id").withColumn("similarity_score", similarity_score(F.col("cos")))
                  .withColumnRenamed("qid", qid))


def meet(hits: DataFrame, events: DataFrame, payload: list[str], with_hits: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``hits``, which hold ``KEYS``, with the payload of every event of their keys.

    ``with_hits`` gives a view's events inner-joined to a table (id, hit); a view of several
    tables takes it before its joins, so that hits go to the contents and contents stay.
    """
    told = hits.select(F.col("id").alias("_id"), F.struct(*[F.col(c) for c in hits.columns]).alias("_hit"))
    same = (F.col("event_id") == F.col("_hit.event_id")) & (F.col("event_date") == F.col("_hit.event_date"))
    if with_hits:
        rows = with_hits(told).where(same)
    else:
        first, last = hits.agg(F.min("event_date"), F.max("event_date")).first()
        rows = events.where(F.col("event_date").between(F.lit(first), F.lit(last))) \
            .join(told, same & F.col("id").cast("long").eqNullSafe(F.col("_id")))
    return rows.select(*[F.col(f"_hit.{c}").alias(c) for c in hits.columns], *[c for c in payload if c not in hits.columns])
