"""Count-or-timeout batching of a keyed stream, and distinct callers in a recent span."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, batch long, n long, full boolean"


def batches(stream: DataFrame, key: str, period: int, wait_ms: int) -> DataFrame:
    """A row for each batch of a key: full after `period` rows, partial if none came for wait_ms. State
    is two numbers for each key."""

    def step(k: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, number = state.get if state.exists else (0, 0)
        out = []
        if state.hasTimedOut:
            if held:
                out.append((str(k[0]), number, held, False))
            held, number = 0, number + bool(held)
        else:
            held += sum(map(len, chunks))
            while held >= period:
                out.append((str(k[0]), number, period, True))
                held, number = held - period, number + 1
        state.update((held, number))
        if held:
            state.setTimeoutDuration(wait_ms)
        yield pd.DataFrame(out, columns=["key", "batch", "n", "full"])

    return stream.groupBy(key).applyInPandasWithState(step, OUT, "held long, number long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def count_batches(rows: DataFrame, key: str, order: str, period: int) -> DataFrame:
    """The batch form: full batches of each key by order, and what is left."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return rows.withColumn("batch", F.floor(n / period)).groupBy(key, "batch").agg(F.count(F.lit(1)).alias("n")).withColumn("full", F.col("n") == period)


def recent_callers(rows: DataFrame, key: str, caller: str, ts: str, span: int) -> DataFrame:
    """For each row the distinct callers of its key in the last `span` units of ts, it included."""
    w = Window.partitionBy(key).orderBy(ts).rangeBetween(-span, 0)
    return rows.withColumn("callers", F.size(F.collect_set(caller).over(w)))
