"""Switches between labels in a stream of events: the streaming form of ``timeline.switches``.

Each key keeps its last (time, label, ordinal). A later row with another label within the gap is a
crossing; a row with the same time and label as the kept one replaces it if its ordinal is higher. Rows older than
the kept one are late and ignored. With ``idle_ms`` a key's state is dropped once it has been idle for so long.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key long, from_label string, to_label string, from_ordinal long, to_ordinal long, gap long"
STATE = "time long, label string, ordinal long"


def switches(events: DataFrame, key: str, time: str, label: str, ordinal: str, most: int, idle_ms: int | None = None) -> DataFrame:
    """Crossings of a streaming ``events``; within a micro-batch rows go by time, then label."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["time", "label", "ordinal"]).drop_duplicates(["time", "label"], keep="last")
        found = []
        for t, lab, o in zip(rows["time"], rows["label"], rows["ordinal"], strict=True):
            if last is not None and t < last[0]:
                continue
            if last is not None and lab != last[1] and 0 <= t - last[0] <= most:
                found.append((group[0], last[1], lab, last[2], o, t - last[0]))
            if last is None or (t, lab) != (last[0], last[1]) or o > last[2]:
                last = (int(t), lab, int(o))
        if last is not None:
            state.update(last)
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(found, columns=["key", "from_label", "to_label", "from_ordinal", "to_ordinal", "gap"])

    named = events.select(F.col(key).cast("long").alias("key"), F.col(time).cast("long").alias("time"), F.col(label).alias("label"), F.col(ordinal).cast("long").alias("ordinal"))
    return named.dropna().groupBy("key").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
