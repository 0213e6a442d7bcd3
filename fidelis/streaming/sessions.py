"""The stream twin of gap sessions: state per user, same rule as the batch window (start - end of the row before >= gap)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_sessions(events: DataFrame, user: str, event: str, start: str, gap: float) -> DataFrame:
    """user, event, session, session_pos of an event stream. start in seconds; events of a user arrive in order across batches and are sorted within one."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, session, pos = state.get if state.exists else (None, 0, -1)
        rows = pd.concat(list(batches)).sort_values([start, event], kind="stable")
        out = []
        for e, s in zip(rows[event], rows[start], strict=True):
            if last is not None and s - last >= gap:
                session, pos = session + 1, -1
            pos, last = pos + 1, float(s)
            out.append((key[0], e, session, pos))
        state.update((last, session, pos))
        yield pd.DataFrame(out, columns=[user, event, "session", "session_pos"])

    kinds = dict(events.dtypes)
    return events.select(user, event, start).groupBy(user).applyInPandasWithState(
        step, f"`{user}` {kinds[user]}, `{event}` {kinds[event]}, session long, session_pos long", "last double, session long, pos long", "append", GroupStateTimeout.NoTimeout
    )
