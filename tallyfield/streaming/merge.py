"""Incremental merge of a stream of games into a store partitioned by season."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyfield.functions import dates
from tallyfield.operators.merge import upsert_merge
from tallyfield.sources.store import read
from tallyfield.sources.tables import write_seasons


def merge_stream(games: DataFrame, store: str, checkpoint: str, key: str = "dedupe_key", order: str = "seq") -> StreamingQuery:
    """Merges all that is available and stops. Only seasons in the batch are read and rewritten.

    A batch that is replayed merges into the same rows, so restarts are harmless.
    """

    def apply(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("season", dates.season(F.col("date")))
        seasons = [r.season for r in rows.select("season").distinct().collect()]  # years: a few
        try:
            existing = read(spark, store).where(F.col("season").isin(seasons)).select(*batch.columns)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            existing = batch.limit(0)
        merged = upsert_merge(existing, batch, key, order)
        write_seasons(merged.withColumn("season", dates.season(F.col("date"))), store)

    return games.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(apply).start()
