"""Throttling and expiry on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def throttle_stream(events: DataFrame, key: str, interval_ms: int = 200) -> DataFrame:
    """Leading-edge throttle per key over a stream of (key, id, ts).

    The state of a key is the time of the last event that passed.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        keep = []
        for t in rows["ts"].astype("int64") // 1000:
            keep.append(last is None or t - last >= interval_ms * 1000)
            last = int(t) if keep[-1] else last
        state.update((last,))
        yield rows[keep][["key", "id", "ts"]]

    rows = events.select(F.col(key).alias("key"), "id", "ts")
    return rows.groupBy("key").applyInPandasWithState(run, "key long, id long, ts timestamp_ntz", "last long", "append", GroupStateTimeout.NoTimeout)


def expired_stream(trash: DataFrame, now_column: str = "now") -> DataFrame:
    """Trashed rows of a stream that are past their retention."""
    return trash.where((F.col("status") == "trashed") & (F.col("expires_at") < F.col(now_column)))
