"""Session operators over streams of events.

Late events are bounded by a watermark on ``event_ts``; the fold that extracts
statements keeps, for each session, the digests of the snippets already seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import sessions as s


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "12 days") -> DataFrame:
    """(window, event_type, events): counts by time window; events later than ``late`` are left out."""
    return events.withWatermark("event_ts", late).groupBy(F.window("event_ts", width), "event_type").agg(F.count("*").alias("events"))


def gap_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "12 days") -> DataFrame:
    """(session_window, session_id, events): runs of events without a gap."""
    return events.withWatermark("event_ts", late).groupBy(F.session_window("event_ts", gap), "session_id").agg(F.count("*").alias("events"))


def suggestions(events: DataFrame, threshold: float = 0.70, idle_ms: int = 86_400_000, late: str = "12 days") -> DataFrame:
    """Statements worth saving, session by session, as they arrive; a session is forgotten when the watermark is ``idle_ms`` past its last event."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = set(state.get[0]) if state.exists else set()
        compiled = s._compiled()
        rows = pd.concat(list(batches)).sort_values(["event_ts", "event_id"], na_position="last")
        out = []
        for eid, t in zip(rows["event_id"], rows["content"]):
            for _, r, snippet in s.suggestions_in([t], seen, threshold, compiled):
                out.append((key[0], eid, r.destination, r.category, r.confidence, r.reason, list(r.tags), snippet))
        state.update((sorted(seen),))
        last = pd.to_datetime(rows["event_ts"]).max()
        now = max(0 if pd.isna(last) else int(last.timestamp() * 1000), state.getCurrentWatermarkMs())
        state.setTimeoutTimestamp(now + idle_ms)
        yield pd.DataFrame(out, columns=[x.split()[0] for x in s.SUGGESTION.split(", ")])

    rows = s.written_events(events.withWatermark("event_ts", late)).select("session_id", "event_id", "event_ts", "content")
    return rows.groupBy("session_id").applyInPandasWithState(fold, s.SUGGESTION, "seen array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def flush_batches(pending: DataFrame, write_ltm, write_kb, write_rejects, checkpoint: str):
    """Write pending items batch by batch: memories, knowledge and rejects each by a function of a frame."""

    def each(batch: DataFrame, _: int) -> None:
        ltm, kb, rejects = s.flushed(batch)
        write_ltm(ltm)
        write_kb(kb)
        write_rejects(rejects)

    return pending.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
