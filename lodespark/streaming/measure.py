"""Measurements of requests while their deltas come in, over streams without an end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MEASURED = "req_id bigint, ttft double, latency double, num_tokens bigint, event string, message string"
STATE = "ttft double, latency double, said bigint, usage bigint"


def measured_stream(deltas: DataFrame, idle: int | None = None) -> DataFrame:
    """(req_id, ttft, latency, num_tokens, event, message), a row for each request as it ends: event is done, error, or lost.

    deltas: a stream of (req_id, t, delta, usage_tokens, error), as chat.streamer gives them, t being seconds since the
    request; the row without a delta ends it, wherever a batch is cut. What is kept of an open request is four
    numbers. Rows that come after the end begin nothing new while its state is kept; with ``idle`` a request, open or
    ended, is forgotten when nothing of it has come for so many milliseconds, and an open one counts as lost."""

    def end(key: tuple, state: tuple, event: str, message: str | None) -> pd.DataFrame:
        ttft, latency, said, usage = state
        return pd.DataFrame([(key[0], 0.0 if ttft < 0 else ttft, latency, said if usage < 0 else usage, event, message)], columns=["req_id", "ttft", "latency", "num_tokens", "event", "message"])

    def step(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = tuple(held.get) if held.exists else (-1.0, 0.0, 0, -1)
        if held.hasTimedOut:
            if state[2] >= 0:
                yield end(key, state, "lost", None)
            held.remove()
            return
        rows = pd.concat(list(parts))
        if state[2] >= 0:  # less than 0: ended already
            pieces = rows[rows["delta"].notna() & (rows["delta"] != "")]
            ttft, latency, said, usage = state
            first = float(pieces["t"].min()) if len(pieces) else -1.0
            ttft = first if ttft < 0 else min(ttft, first) if len(pieces) else ttft
            known = rows["usage_tokens"].dropna()
            state = ttft, max(latency, float(rows["t"].max())), said + len(pieces), max(usage, int(known.max()) if len(known) else -1)
            last = rows[rows["delta"].isna()]
            if len(last):
                wrong = last["error"].dropna()
                yield end(key, state, "error" if len(wrong) else "done", str(wrong.iloc[0]) if len(wrong) else None)
                state = (*state[:2], -1, state[3])
        held.update(state)
        if idle is not None:
            held.setTimeoutDuration(idle)

    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    return deltas.groupBy("req_id").applyInPandasWithState(step, MEASURED, STATE, "append", timeout)
