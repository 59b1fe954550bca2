"""Logs that still grow: states of trips as their points arrive, and sessions by gaps.

Both are Structured Streaming queries. What is kept between batches is one state a trip, whatever its length.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import smoothing
from ..operators.kalman import State

STATES = "trip_id string, idx long, x array<double>, p array<double>, rejected boolean"
KEPT = "last long, rejected boolean, held binary"


def forward_states(points: DataFrame, idle: str | None = None) -> DataFrame:
    """A stream of points (trip_id string, idx long, x, y, speed, acc_h, acc_v; null x is a gap) to their forward states.

    As smoothing.forward, but a row is put out as soon as its point has come: what came before a point that breaks the trip stays
    out, and from there on rows are marked as rejected. Points must come in the order of idx from batch to batch; one that is
    behind its trip's last is left out, as are gaps before the first position. idle: a trip that gets no point for so long
    (processing time, "1 hour") is forgotten, and a later point begins it anew; a query with this has always another batch to run,
    so don't combine it with a trigger that ends by itself. Write it in append mode.
    """
    ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0

    def run(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            return
        last, rejected, state = -1, False, None
        if kept.exists:
            last, rejected, held = kept.get
            state = State(*pickle.loads(held)) if held else None
        rows = pd.concat(list(batches)).sort_values("idx", kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            row = np.array([r.x, r.y, r.speed, r.acc_h, r.acc_v], float)
            if r.idx <= last or (state is None and np.isnan(row[0])):
                continue
            state = smoothing.initial(row) if state is None else state
            state, error = smoothing.advance(state, row)
            rejected, last = bool(rejected or error > smoothing.MAX_ERROR), int(r.idx)
            out.append((key[0], last, state.x.tolist(), state.p.ravel().tolist(), rejected))
        kept.update((last, rejected, pickle.dumps((state.x, state.p)) if state else b""))
        if ms:
            kept.setTimeoutDuration(ms)
        yield pd.DataFrame(out, columns=["trip_id", "idx", "x", "p", "rejected"])

    columns = points.select("trip_id", "idx", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "speed", "acc_h", "acc_v")])
    return columns.groupBy("trip_id").applyInPandasWithState(run, STATES, KEPT, "append", GroupStateTimeout.ProcessingTimeTimeout if ms else GroupStateTimeout.NoTimeout)


def sessions(points: DataFrame, key: str, time: str, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """A stream of points to sessions (key, started, ended, n): a new one begins after a gap of so long. A session is put out once the
    watermark has passed its end; points later than late are left out, as of a state that is bounded."""
    stream = points.withWatermark(time, late)
    out = stream.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.min(time).alias("started"), F.max(time).alias("ended"), F.count("*").alias("n"))
    return out.select(key, "started", "ended", "n")
