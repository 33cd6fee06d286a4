"""Streaming ingest: signal-bundle files → cleaned, keyed, de-duplicated event table.

``readStream`` over a folder of bundle files (one JSON object with the three
item lists per file) → explode to raw items → ``foreachBatch`` running the
batch ingest (validate, key, dedup, anti-join against what is stored,
embed) and appending to the date-partitioned event table.

Exactly-once effect: Spark may re-run a micro-batch after a failure; the
check against the stored keys makes the re-run write nothing new, so the
uniqueness of ``event_id`` holds permanently (a bounded-state
``dropDuplicatesWithinWatermark`` alone could not promise that).

The query checkpoint lives under the session's ``spark.checkpoint.dir``
(shared storage on a cluster) unless a location is given.
"""

from __future__ import annotations

import hashlib
import os
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sigsight.operators.ingest import ingest
from sigsight.session import cut_lineage, ensure_checkpoint_dir
from sigsight.sources.bundle import BUNDLE, explode_bundle, rejects
from sigsight.sources.event_store import append_events, unseen
from sigsight.sources.event_store import stored_or_none as _stored_or_none


def ingest_batch_to(stored_path: str, encoder: Callable | None = None, counts_path: str | None = None,
                    rejects_path: str | None = None) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` body (also usable on a static DataFrame of bundles).

    Counts and rejects are written to a folder of the epoch, which a re-run of
    the epoch replaces; counts come before the events, so a crash in between
    leaves the right ones behind, and a re-run that finds the epoch's events
    stored keeps them.
    """
    def run(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        res = ingest(explode_bundle(batch), None, encoder=encoder, unseen=lambda rows: unseen(rows, stored_path))
        # New rows and counts read it: the batch runs once.
        new = cut_lineage(res["new"])
        if rejects_path:
            rejects(batch).write.mode("overwrite").parquet(f"{rejects_path}/epoch={epoch_id}")
        if counts_path and not (_done(spark, counts_path, epoch_id) and new.isEmpty()):
            res["counts_of"](new).write.mode("overwrite").parquet(f"{counts_path}/epoch={epoch_id}")
        append_events(new, stored_path)
    return run


def _done(spark: SparkSession, counts_path: str, epoch_id: int) -> bool:
    return _stored_or_none(spark, f"{counts_path}/epoch={epoch_id}") is not None


def start_stream_ingest(spark: SparkSession, bundle_dir: str, stored_path: str,
                        checkpoint_location: str | None = None, max_files_per_trigger: int = 100,
                        available_now: bool = True, encoder: Callable | None = None,
                        counts_path: str | None = None, rejects_path: str | None = None) -> StreamingQuery:
    raw = (spark.readStream.schema(BUNDLE).option("multiLine", True)
           .option("maxFilesPerTrigger", max_files_per_trigger).json(bundle_dir))
    # One checkpoint per source and target: a second stream must not resume the first one's state.
    name = hashlib.sha256(f"{bundle_dir}\n{stored_path}".encode()).hexdigest()[:16]
    ckpt = checkpoint_location or os.path.join(ensure_checkpoint_dir(spark), f"stream-ingest-{name}")
    writer = raw.writeStream.foreachBatch(ingest_batch_to(stored_path, encoder, counts_path, rejects_path)) \
        .option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
