"""Route a stream of articles against a static route table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from signpost.operators.embed import DEFAULT_DIMS
from signpost.plans.router import classify


def route_stream(
    articles: DataFrame,
    routes: DataFrame,
    classes: Sequence[str],
    sink: str,
    checkpoint: str,
    id_col: str = "article_id",
    text_col: str = "text",
    dims: int = DEFAULT_DIMS,
    **trigger,
) -> StreamingQuery:
    """Write predictions of each micro-batch to ``sink/epoch=<n>``.

    Routing keeps no state, so every micro-batch runs the batch operator. An
    epoch replaces its own folder: a replayed epoch leaves one copy.
    """

    def write(frame: DataFrame, epoch: int) -> None:
        classify(frame, routes, classes, id_col, text_col, dims).drop(text_col).write.mode(
            "overwrite"
        ).parquet(f"{sink}/epoch={epoch}")

    return (
        articles.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
