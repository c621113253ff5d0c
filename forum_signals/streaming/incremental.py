"""Flagging of texts as they arrive: the batch operators on a streaming read.

Cleaning and matching keep no state, so new answers can be flagged file by file and appended
to the flagged table; the reduction to questions stays a batch job over that table.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from forum_signals.operators import flags, model
from forum_signals.sources.schemas import POSTS


def flag_new_answers(spark: SparkSession, posts_folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Flag the answers in all Parquet files not seen before, then stop."""
    posts = spark.readStream.schema(POSTS.schema).parquet(posts_folder)
    flagged = flags.flag_answers(model.answers(posts))
    return (
        flagged.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(out)
    )
