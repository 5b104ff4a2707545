"""Delivery of outbox events by a stream over the outbox folder.

``drain`` forwards each micro-batch in key order.  ``dispatch`` keeps a box of open events, tries
each again until it is delivered or dead, and never lets a key's later event overtake an earlier
one.  Delivery is at least once; a receiver that keeps ids sees each event once, which ``FileSink``
does by writing a batch's id with it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.history import BATCH, Subscription, cloud_events, delivered, due

EVERY = "5 seconds"


def drain(
    spark: SparkSession,
    folder: str,
    schema,
    checkpoint: str,
    deliver: Callable[[DataFrame, int], None],
    source: str,
    subscription: Subscription | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Start the stream; ``once`` ends it when what is there has been delivered."""
    subscription = subscription or Subscription()
    events = spark.readStream.schema(schema).parquet(folder).filter("dispatched_at IS NULL AND NOT dead")

    def batch(rows: DataFrame, number: int) -> None:
        ordered = subscription.select(rows).repartition("aggregate", "key").sortWithinPartitions("aggregate", "key", "created_at", "id")
        deliver(cloud_events(ordered, source), number)

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=EVERY)).start()


def dispatch(
    spark: SparkSession,
    folder: str,
    schema,
    work: str,
    deliver: Callable[[DataFrame, int], DataFrame],
    source: str,
    subscription: Subscription | None = None,
    batch: int = BATCH,
    clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None),
    once: bool = False,
) -> StreamingQuery:
    """Start the dispatcher over the events of ``folder``, with its state in the shared folder ``work``.

    Each micro-batch adds new events to the box, hands the ``batch`` next due ones to ``deliver`` as
    envelopes, and takes (id, ok) back; failures wait longer each time and are dead after
    ``MOST_ATTEMPTS``.  Version n of the box, ``work/open/n``, comes from version n - 1 alone, so that a
    micro-batch that ran twice leaves one version.  What was delivered or died goes to ``work/closed``,
    so that a version is as large as the backlog.  A clock stream starts micro-batches when there are no
    new events; ``once`` runs one round over what is there, without it.  Events outside the subscription
    are left out.
    """
    subscription = subscription or Subscription()
    events = spark.readStream.schema(schema).parquet(folder).filter("dispatched_at IS NULL AND NOT dead")
    if not once:
        tick = spark.readStream.format("rate").load()
        events = events.unionByName(tick.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema]))

    def round_(rows: DataFrame, number: int) -> None:
        now = clock()
        box = subscription.select(rows.filter("id IS NOT NULL"))
        if "next_at" not in box.columns:
            box = box.withColumn("next_at", F.lit(None).cast("timestamp_ntz"))
        if number:
            box = box.unionByName(spark.read.schema(box.schema).parquet(f"{work}/open/{number - 1}"))
        box.write.mode("overwrite").parquet(f"{work}/asked/{number}")
        box = spark.read.schema(box.schema).parquet(f"{work}/asked/{number}")
        results = deliver(cloud_events(due(box, now, batch), source), number)
        after = delivered(box, results, now)
        after.write.mode("overwrite").parquet(f"{work}/tried/{number}")
        after = spark.read.schema(box.schema).parquet(f"{work}/tried/{number}")
        closed = F.col("dispatched_at").isNotNull() | F.col("dead")
        after.filter(closed).write.mode("overwrite").parquet(f"{work}/closed/batch={number}")
        after.filter(~closed).write.mode("overwrite").parquet(f"{work}/open/{number}")

    writer = events.writeStream.foreachBatch(round_).option("checkpointLocation", f"{work}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=EVERY)).start()


class FileSink:
    """Envelopes as Parquet, a folder a batch: a batch delivered again replaces itself."""

    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, envelopes: DataFrame, number: int) -> None:
        envelopes.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{self.folder}/batch={number}")
