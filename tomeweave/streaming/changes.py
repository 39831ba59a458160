"""The change feed: of many changes to one file in a batch only the latest is worked on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last change of each key; aggregated before it is shuffled, so a hot key costs one row per task."""
    rest = [c for c in changes.columns if c not in key and c not in order]
    picked = changes.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("_last"), F.count("*").alias("coalesced"))
    return picked.select(*key, "_last.*", "coalesced")


def follow(stream: DataFrame, key: list[str], order: list[str], apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Run apply(changes, batch_id) on each micro-batch's latest changes. apply must be idempotent by batch_id: a batch that failed is sent again."""
    writer = stream.writeStream.foreachBatch(lambda batch, number: apply(latest(batch, key, order), number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def cancelled(changes: DataFrame, key: str, prefix: str) -> DataFrame:
    """Changes less those whose key begins with a prefix."""
    return changes.where(~F.col(key).startswith(prefix))
