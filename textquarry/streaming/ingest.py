"""Documents that arrive as a stream: tokens, statistics per window, and search results per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textquarry.functions.text import normalized_tokens
from textquarry.search.session import SearchSession


def windowed_term_counts(stream: DataFrame, time: str = "published_at", text: str = "text", window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(window, term, n) of a stream of documents; rows later than `late` behind the newest are dropped by the
    watermark, which bounds the state."""
    rows = stream.where(F.col(time).isNotNull()).withWatermark(time, late).select(F.col(time).alias("_time"), F.explode(normalized_tokens(F.col(text))).alias("term"))
    return rows.groupBy(F.window("_time", window), "term").agg(F.count(F.lit(1)).alias("n")).select("window", "term", "n")


def first_of_stream(stream: DataFrame, key: str, time: str, late: str = "7 days") -> DataFrame:
    """Rows whose key has not come within the watermark; the state holds the keys of that time alone."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def answer_stream(queries: DataFrame, session: SearchSession, sink: Callable[[DataFrame, int], None], checkpoint: str, k: int = 5) -> StreamingQuery:
    """Answers each batch of queries (query_id, text) as one search; sink gets the rows and the batch number, and
    should write by that number, as a batch may come again after a failure."""

    def answered(batch: DataFrame, number: int) -> None:
        sink(session.search(batch, k), number)

    return queries.writeStream.foreachBatch(answered).option("checkpointLocation", checkpoint).start()
