"""Views over the driver tables that stand in for the stored tables.

No fixture holds every column of the stored ``incident_events`` table, so the
test views derive them row by row from the driver tables (every row of every
input is used; the derivations only *map* values):

* ``signals``   – one event per ``events`` row; content is the whole text of
                  a ``documents`` row, the vector is an ``embeddings`` row.
* ``questions`` – one question per user turn of ``conversations``; the text is
                  a phrase chosen by the row (some phrases embed the whole
                  turn text), ``asked_at`` is the time of an ``events`` row.
* ``query_logs`` / ``feedback`` / ``judge_replies`` – from ``conversations``,
                  ``labels`` and ``events``.

Each has a DuckDB twin in ``sigsight.plans.oracle`` built by the same rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigsight import config as C
from sigsight.functions.hashing import KEY_CHARS, event_id_hash

#: Tables of numbers, such as vectors or their ids, are broadcast up to this size, measured.
SMALL_BYTES = 64 * 1024 * 1024
ROW_BYTES = 32

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    """``values[index]`` for a 0-based index column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def service_of(user_id: Column) -> Column:
    return _pick(C.STATIC_SERVICES, F.pmod(user_id, F.lit(len(C.STATIC_SERVICES))))


def event_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The service column of the event table, without its contents and vectors."""
    return table(spark, sf_dir, "events").select(service_of(F.col("user_id")).alias("service"))


def spread(ev: DataFrame, docs: DataFrame, n_docs: int) -> tuple[DataFrame, DataFrame]:
    """Events and documents by the key that joins them, each over the same fixed number of partitions.

    Both grow with the data, and the joined texts are many times the shuffled bytes,
    by which Spark would put them into too few tasks: into as many as the document
    file has splits if it broadcasts the events.
    """
    spark = ev.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return ev.repartition(tasks, F.pmod("event_id", F.lit(n_docs))), docs.repartition(tasks, "doc_id")


def if_small(df: DataFrame, rows: int, values: int = 0) -> DataFrame:
    """A table of so many rows of one or two numbers, and of so many values of vectors, to be broadcast if it is small.

    Spark takes it for as large as its files, whichever columns are read.
    """
    return F.broadcast(df) if rows * ROW_BYTES + values * 4 <= SMALL_BYTES else df


def signals(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None, vectors_last: bool = False,
            embedding: bool = True) -> DataFrame:
    """The incident-event table (stored schema + ``event_date`` partition column).

    The vectors are joined before the documents, so that no shuffle carries the joined
    texts; the event ids are made from the documents' heads, so that a reader of the
    ids without the contents moves the heads alone.  ``ids`` asks for the events of
    the ids in its first column only, told before any join; with further columns it is
    inner-joined, and these columns are kept.  ``vectors_last`` is for readers of vectors
    without contents: the vectors are joined after the documents.  Without ``embedding`` the
    same events come without their vectors.
    """
    ev = table(spark, sf_dir, "events")
    kept = [] if ids is None else ids.columns[1:]
    if ids is not None:
        ev = ev.join(ids.toDF("_id", *kept), ev.event_id.eqNullSafe(F.col("_id")), "inner" if kept else "left_semi")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.substring("text", 1, KEY_CHARS).alias("head"))
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", *(["embedding"] if embedding else []))
    n_docs = docs.count()
    if embedding and vectors_last:
        n_vecs, values = vecs.agg(F.count(F.lit(1)), F.sum(F.size("embedding"))).first()
        vecs = if_small(vecs, n_vecs, values or 0)
    else:
        n_vecs = vecs.count()
        vecs = vecs if embedding else if_small(vecs, n_vecs)
    if not vectors_last:
        ev = ev.join(vecs, F.pmod(ev.event_id, F.lit(n_vecs)) == vecs.vec_id)
    ev, docs = spread(ev, docs, n_docs)
    j = ev.join(docs, F.pmod(ev.event_id, F.lit(n_docs)) == docs.doc_id)
    et = F.col("event_type")
    event_type = (F.when(et == "signup", "deployment").when(et == "purchase", "alert")
                  .when(et == "view", "metadata").otherwise("log"))
    severity = (F.when((et == "error") & (F.col("value") >= 100), "critical")
                .when(et == "error", "error")
                .when((et == "signup") & (F.col("value") >= 100), "error")
                .when(et == "purchase", "warn")
                .when(et == "view", F.lit(None).cast("string"))
                .otherwise("info"))
    line = lambda text: F.concat(
        F.lit("["), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z] "), F.upper(F.coalesce(severity, F.lit("debug"))),
        F.lit(" pid="), F.col("user_id").cast("string"), F.lit(" "), F.col(text))
    service = service_of(F.col("user_id"))
    rows = j.select(
        F.col("event_id").alias("id"),
        event_id_hash(service, F.col("ts"), line("head")).alias("event_id"),
        event_type.alias("event_type"),
        service.alias("service"),
        severity.alias("severity"),
        F.col("ts").alias("occurred_at"),
        line("text").alias("content"),
        *(["embedding"] if embedding and not vectors_last else []),
        F.concat(F.lit("inc-"), F.date_format("ts", "yyyyMMdd"), F.lit("-"),
                 F.col("user_id").cast("string")).alias("correlation_id"),
        F.col("props").alias("metadata"),
        F.to_date("ts").alias("event_date"),
        *kept,
    )
    if vectors_last:
        rows = rows.join(vecs, F.pmod(rows.id, F.lit(n_vecs)) == vecs.vec_id).drop("vec_id")
    return rows


# Question phrases for the test question table (test inputs of this repo).
# {svc} = service name, {svc_sp} = service name with spaces, {text} = whole user turn.
QUESTION_PHRASES = [
    ("What happened to {svc} in the last 2 hours?", "temporal"),
    ("Why did {svc} fail yesterday?", "lookup"),
    ("{text}", "ambiguous"),
    ("Show me critical alerts from {svc} in the last 6 hours", "lookup"),
    ("What caused the outage today? {text}", "multi-hop"),
    ("Which service failed most in the last week?", "ambiguous"),
    ("{svc_sp} latency over the last 3 days", "temporal"),
    ("what happened in the last two hours", "no-answer"),
    ("timeout spikes in {svc} over the past month", "lookup"),
    ("How many errors in the last 24 hours?", "ambiguous"),
    ("recent deploys", "no-answer"),
    ("incident review for {svc_sp} last year", "multi-hop"),
    ("anything unusual", "no-answer"),
    ("last 12 hours of {svc} logs: {text}", "temporal"),
    ("What broke in the past hour?", "no-answer"),
    ("describe the last 2 months for {svc}", "multi-hop"),
]
# Phrases whose questions carry explicit start/end overrides (90 minutes back).
EXPLICIT_WINDOW_PHRASES = [0, 6, 14]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per user turn: (qid, question, category, asked_at, start_time?, end_time?, qvec_id, qvec)."""
    allconv = table(spark, sf_dir, "conversations")
    conv = allconv.where(F.col("role") == "user")
    reply = allconv.where(F.col("role") == "assistant").select(
        F.col("conv_id").alias("r_conv"), (F.col("turn") - 1).alias("r_turn"), F.col("text").alias("reply"))
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n_ev = ev.count()
    n_vecs = vecs.count()
    n = len(QUESTION_PHRASES)
    idx = F.pmod(F.col("conv_id") * 3 + F.col("turn"), F.lit(n))
    svc = service_of(F.col("conv_id"))
    phrase = _pick([p for p, _ in QUESTION_PHRASES], idx)
    text = F.replace(F.replace(F.replace(phrase, F.lit("{svc_sp}"), F.replace(svc, F.lit("-"), F.lit(" "))),
                               F.lit("{svc}"), svc), F.lit("{text}"), F.col("text"))
    q = conv.select(
        "conv_id", "turn",
        (F.col("conv_id") * 1000 + F.col("turn")).alias("qid"),
        text.alias("question"),
        _pick([c for _, c in QUESTION_PHRASES], idx).alias("category"),
        idx.alias("phrase_idx"),
        F.pmod(F.col("conv_id") * 7919 + F.col("turn") * 104729, F.lit(n_ev)).alias("ask_event"),
        F.pmod(F.col("conv_id") * 31 + F.col("turn"), F.lit(n_vecs)).alias("qvec_id"),
    )
    q = (q.join(ev, q.ask_event == ev.event_id).join(vecs, q.qvec_id == vecs.vec_id)
          .join(reply, (q.conv_id == reply.r_conv) & (q.turn == reply.r_turn), "left")
          .withColumnRenamed("ts", "asked_at").withColumnRenamed("embedding", "qvec"))
    explicit = F.col("phrase_idx").isin(EXPLICIT_WINDOW_PHRASES)
    return q.select(
        "qid", "question", "category", "asked_at",
        F.when(explicit, F.timestamp_add("MINUTE", F.lit(-90), F.col("asked_at"))).alias("start_time"),
        F.when(explicit, F.col("asked_at")).alias("end_time"),
        "qvec_id", "qvec",
        F.coalesce(F.col("reply"), F.lit("")).alias("llm_answer"),
        (F.col("value") * 37.3).alias("latency_ms"),
    )


def _turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    u = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("query"))
    a = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "turn"])


def query_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, query, answer, groundedness_score?, relevance_score?, latency, created_at)."""
    pairs = _turn_pairs(spark, sf_dir)
    labels = table(spark, sf_dir, "labels")
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    n_ev = ev.count()
    p = pairs.select("*", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
                     F.pmod(F.col("conv_id") * 101 + F.col("turn"), F.lit(n_ev)).alias("lat_event"))
    p = p.join(labels, p.id == labels.doc_id, "left").join(ev, p.lat_event == ev.event_id)
    g = F.when(F.col("quality") == 1, F.lit(0.9) - F.col("toxic") * 0.6).when(F.col("quality") == 0, F.lit(0.3))
    return p.select(
        "id", "query", "answer",
        g.alias("groundedness_score"),
        F.when(F.col("quality").isNotNull(), F.lit(1.0) - F.col("toxic") * 0.5).alias("relevance_score"),
        F.round(F.col("value") / 100.0, 3).alias("latency"),
        F.col("ts").alias("created_at"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, query, answer, rating, comment?, created_at) — one row per labelled document."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    ev = table(spark, sf_dir, "events").select("event_id", "ts")
    n_ev = ev.count()
    f = labels.join(docs, "doc_id").withColumn("ev", F.pmod(F.col("doc_id") * 13, F.lit(n_ev)))
    f = f.join(ev, f.ev == ev.event_id)
    return f.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("query"),
        F.col("text").alias("answer"),
        F.when(F.col("toxic") == 1, "bad").when(F.col("quality") == 1, "good").otherwise("meh").alias("rating"),
        F.when(F.col("toxic") == 1, F.lit("toxic")).alias("comment"),
        F.col("ts").alias("created_at"),
    )


def judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw judge replies (one per query log row) covering every parse branch.

    (id, raw, expected_answer?) where the reply shape is chosen by ``id``.
    """
    logs = query_logs(spark, sf_dir)
    kind = F.pmod(F.col("id"), F.lit(11))
    g = F.format_string("%.2f", F.coalesce(F.col("groundedness_score"), F.lit(0.45)))
    r = F.format_string("%.2f", F.coalesce(F.col("relevance_score"), F.lit(0.55)))
    n = F.length("answer").cast("string")
    raw = (F.when(kind == 0, F.concat(F.lit('{"groundedness": {"score": '), g, F.lit(', "explanation": "answer of '), n,
                                      F.lit(' chars"}, "relevance": {"score": '), r,
                                      F.lit(', "explanation": "on topic"}}')))
           .when(kind == 1, F.concat(F.lit('{"groundedness": {"score": "'), g, F.lit('"}, "relevance": {"score": "'),
                                     r, F.lit('", "explanation": "string scores"}}')))
           .when(kind == 2, F.concat(F.lit('{"groundedness": {"score": 1.7, "explanation": "high"}, '
                                           '"relevance": {"score": -0.25}}')))
           .when(kind == 3, F.concat(F.lit('{"groundedness": {"score": '), g, F.lit('}}')))
           .when(kind == 4, F.concat(F.lit('{"groundedness": {"score": '), g, F.lit(', "explan')))
           .when(kind == 5, F.concat(F.lit('  {"groundedness": {"score": '), g, F.lit(', "explanation": "ok"}, '
                                     '"relevance": {"score": '), r, F.lit(', "explanation": "ok"}, '
                                     '"correctness": {"score": 0.123456, "explanation": "close"}}  ')))
           .when(kind == 6, F.lit('{"groundedness": {"score": null}, "relevance": {"score": 0.5}}'))
           .when(kind == 7, F.concat(F.lit('{"groundedness": {"score": NaN, "explanation": "no number"}, "relevance": {"score": '),
                                     r, F.lit(', "explanation": null}}')))
           .when(kind == 8, F.concat(F.lit('{"groundedness": {"score": 0.10}, "relevance": {"score": '), r,
                                     F.lit('}, "groundedness": {"score": '), g, F.lit(', "explanation": "said again"}}')))
           .when(kind == 9, F.concat(F.lit('{"groundedness": {"score": '), g, F.lit(', "explanation": null}, "relevance": {"score": 2}}')))
           .otherwise(F.lit('{"groundedness": {"score": "high"}, "relevance": {"score": 0.5}}')))
    expected = F.when(F.pmod(F.col("id"), F.lit(3)) == 0, F.concat(F.lit("expected "), n))
    return logs.select("id", raw.alias("raw"), expected.alias("expected_answer"))
