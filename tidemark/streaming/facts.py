"""Facts that arrive as a stream of files, merged into the written fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.plans import marts


def arriving(spark: SparkSession, like: DataFrame, folder: str, files_a_batch: int = 64) -> DataFrame:
    """The Parquet files of a folder as a stream, new ones as they come; `like` gives the columns."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def follow(facts: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep the fact table at `path` up to date with a stream of facts: each micro-batch replaces its own keys.

    The first batch makes the table. The number of a batch is published together with its rows, so a batch that is run
    again, after a failure or a restart, changes nothing; late facts go to the months they belong to, and a fact whose
    date has moved leaves its old one. With `once` all that has arrived is merged and the query ends.
    """

    def merge(batch: DataFrame, number: int) -> None:
        marts.merge_facts(batch, path, checkpoint, number)

    writer = facts.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
