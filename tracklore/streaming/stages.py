"""Stages over unbounded event streams: state is kept by track and forgotten after a pause.

These are extensions: batch operators of the same meaning are in tracklore.operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.captions import MEMORY, _overlap

_EVENTS = "track_id long, seq long, start_s double, end_s double, text string"


def dedupe_rolling_stream(events: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """New words of each line as they come; the state of a track is its last words and end, forgotten after a pause of
    forget_ms if that is given (a query with such a timeout runs until it is stopped)."""
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, last = state.get if state.exists else ("", -1.0)
        words, out = seen.split(), []
        for r in pd.concat(list(parts)).sort_values("seq").itertuples(index=False):
            plain = (r.text or "").split()
            cur = [w.lower() for w in plain]
            n = _overlap(words, cur)
            words = (words + cur[n:])[-MEMORY:]
            if plain[n:]:
                start = r.start_s if last < 0 else max(r.start_s, last)
                out.append((key[0], r.seq, min(start, r.end_s - 0.05), r.end_s, " ".join(plain[n:])))
                last = r.end_s
        state.update((" ".join(words), last))
        if forget_ms:
            state.setTimeoutDuration(forget_ms)
        yield pd.DataFrame(out, columns=["track_id", "seq", "start_s", "end_s", "text"])

    return events.groupBy("track_id").applyInPandasWithState(step, _EVENTS, "words string, last_end double", "append", GroupStateTimeout.ProcessingTimeTimeout if forget_ms else GroupStateTimeout.NoTimeout)


def ema_stream(observed: DataFrame, share: float = 0.6) -> DataFrame:
    """The rate of each stage after every batch; observed(stage, ord, value)."""
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rate, n = state.get if state.exists else (0.0, 0)
        for v in pd.concat(list(parts)).sort_values("ord")["value"]:
            if v > 0:
                rate, n = (v if n == 0 else rate * share + v * (1 - share)), n + 1
        state.update((float(rate), int(n)))
        yield pd.DataFrame({"stage": [key[0]], "rate": [rate], "observations": [n]})

    return observed.groupBy("stage").applyInPandasWithState(step, "stage string, rate double, observations long", "rate double, n long", "update", GroupStateTimeout.NoTimeout)


def purchases_by_hour(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events in tumbling hours by type; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("hour"), "event_type", "n", "total")
