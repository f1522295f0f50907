"""Feedback weights and uploads as streams (L1, S3)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from tessera.operators.learning import DOWN, HIGH, LOW, UP

OUTPUT = "key string, weight double, correct long, wrong long"


def streamed_weights(events: DataFrame) -> DataFrame:
    """The current weight of each key whenever it gets feedback: events have key, ts, seq, verdict. Within a batch, by ts and seq."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        weight, correct, wrong = state.get if state.exists else (1.0, 0, 0)
        for verdict in pd.concat(list(frames)).sort_values(["ts", "seq"])["verdict"]:
            if verdict == "correct":
                weight, correct = min(HIGH, weight + UP), correct + 1
            elif verdict == "wrong":
                weight, wrong = max(LOW, weight - DOWN), wrong + 1
        state.update((weight, correct, wrong))
        yield pd.DataFrame({"key": [key[0]], "weight": [round(weight, 6)], "correct": [correct], "wrong": [wrong]})

    return events.groupBy("key").applyInPandasWithState(update, OUTPUT, "weight double, correct long, wrong long", "update", "NoTimeout")


def each_batch(stream: DataFrame, index: Callable[[DataFrame], None], checkpoint: str) -> DataStreamWriter:
    """Run the same indexing for every batch of uploads."""
    return stream.writeStream.foreachBatch(lambda df, _: index(df)).option("checkpointLocation", checkpoint)
