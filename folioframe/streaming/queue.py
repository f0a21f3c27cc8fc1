"""Pages in flight as streams: a queue with cancelling, and settings that are compared and updated.

Requests (img, page, kind, at) arrive as files; each batch is taken first in,
first out, without the pages that were cancelled after they were asked for.
Settings are a state by image: an update that names the version it saw is
applied, an older one is refused with the version that it should have seen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

UPDATES = "img long, seen long, value string"
RESULTS = "img long, seen long, value string, applied boolean, version long"


def taken(batch: DataFrame) -> DataFrame:
    """Requests of a batch (img, page, kind, at) that stand, each page once, with their place in its image's queue."""
    w = Window.partitionBy("img", "page")
    df = batch.withColumn("_off", F.max(F.when(F.col("kind") == "cancel", F.col("at"))).over(w))
    stand = df.where((F.col("kind") == "take") & (F.col("_off").isNull() | (F.col("at") > F.col("_off"))))
    first = stand.groupBy("img", "page").agg(F.min("at").alias("at"))
    return first.select("*", F.row_number().over(Window.partitionBy("img").orderBy("at", "page")).alias("place"))


def worked(requests: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """A query that hands each batch's standing requests to work; stopping it leaves the rest for the next start."""
    return requests.writeStream.foreachBatch(lambda df, k: work(taken(df), k)).option("checkpointLocation", checkpoint).start()


def _settle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    version, value = state.get if state.exists else (0, "")
    for f in frames:
        out = []
        for seen, new in zip(f["seen"], f["value"], strict=True):
            ok = int(seen) == version
            if ok:
                version, value = version + 1, new
            out.append((key[0], int(seen), new, ok, version))
        yield pd.DataFrame(out, columns=["img", "seen", "value", "applied", "version"])
    state.update((version, value))


def settled(updates: DataFrame) -> DataFrame:
    """What became of each update (img, seen, value): whether it was applied, and the version of its image then."""
    return updates.groupBy("img").applyInPandasWithState(_settle, RESULTS, "version long, value string", "append", GroupStateTimeout.NoTimeout)
