"""Smoothed trajectories of trips, and the stops within them, as grouped functions over long tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F_

from .kalman import State

F = np.eye(4) + np.eye(4, k=2)
NOISE = np.diag([2.0, 2.0, 2.0, 2.0])
POSITION, VELOCITY = np.eye(2, 4), np.eye(2, 4, 2)
# Acceptance and trimming limits.
MAX_ERROR, MAX_LOG_DET, STILL = 50.0**2, 4.0, 1.04
LEAVE, STAY, LEAST_SAMPLES = 2.33, 0.05, 20


def _observed(s: State) -> np.ndarray:
    return np.array([s[0], s[1], math.hypot(s[2], s[3])])


def initial(row: np.ndarray) -> State:
    """The state that a trip begins with, from its first position."""
    return State([row[0], row[1], 0, 0], 10 * np.eye(4))


def advance(state: State, row: np.ndarray) -> tuple[State, float]:
    """(the state a second later, fused with (x, y, speed, sigma x, sigma y) unless it is a gap; the error of the position)."""
    x, y, speed, sx, sy = row
    state, error = state.copy(), 0.0
    state.predict(F, NOISE)
    if not math.isnan(x):
        if speed >= 0:
            error = state.measure_unscented([x, y, speed], _observed, np.diag([sx * sx, sy * sy, 1.0]))
        else:
            error = state.measure([x, y], POSITION, np.diag([sx * sx, sy * sy]))
    return state, error


def forward(rows: np.ndarray) -> list[State] | None:
    """States of (x, y, speed, sigma x, sigma y) rows, NaN positions being gaps; None for a trip that is rejected. Gaps before the
    first position have no state."""
    seen = np.flatnonzero(~np.isnan(rows[:, 0]))
    if len(rows) < 2 or not len(seen):
        return None
    state, out, worst = initial(rows[seen[0]]), [], 0.0
    for row in rows[seen[0] :]:
        state, error = advance(state, row)
        worst = max(worst, error)
        out.append(state)
    return out if worst <= MAX_ERROR and len(out) >= 2 else None


def backward(states: list[State]) -> list[State] | None:
    """The smoothed states; None if any is too vague."""
    out = [states[-1].copy()]
    for s in reversed(states[:-1]):
        s = s.copy()
        s.smooth(out[-1], F, NOISE)
        out.append(s)
    out.reverse()
    for s in out:
        sign, logdet = np.linalg.slogdet(s.p)
        if sign > 0 and logdet / math.log(10) > 4 * MAX_LOG_DET:
            return None
    return out


def _trim_start(states: list[State], noise: np.ndarray, compat: bool) -> list[State]:
    """Fuses the states at the start that agree with standing still: a state without velocity is held, its position drifting by the
    noise, until one comes that is too far from it in place and velocity. Without a departure the trip becomes its two ends."""
    if len(states) < 2:
        return states
    hold, p = (noise, noise) if compat else (noise.copy(), noise.copy())
    hold[2:, 2:] = 0
    p[:2, :2] += states[0].p[:2, :2]
    still = State([*states[0].x[:2], 0, 0], p)
    for i, here in enumerate(states[1:], 1):  # noqa: B007
        still.predict(np.eye(4), hold)
        if still.measure_distance(here.x, np.eye(4), here.p) > STILL:
            break
        still.measure(here.x[:2], POSITION, here.p[:2, :2])
    return [still, *states[i:]] if i > 1 else states


def trim(states: list[State], compat: bool = False) -> tuple[list[State], np.ndarray]:
    """(trimmed states, noise of the transition). compat shares one noise matrix among all uses, as the first form of the method
    did: its velocity block goes, the covariances of both ends are added to it, and the held state starts without doubt in velocity."""
    noise = NOISE.copy()
    out = _trim_start(states, noise, compat)
    return _trim_start(out[::-1], noise, compat)[::-1], noise


def spread(df: DataFrame, key: str = "trip_id") -> DataFrame:
    """df by key over as many tasks as a shuffle has: few bytes a trip are much work, and Spark would put them into a task or two."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _turned(p: np.ndarray) -> np.ndarray:
    return p.swapaxes(-1, -2)


def _solved(s: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """cross @ inverse(s)."""
    return _turned(np.linalg.solve(s, _turned(cross)))


def _measure(x: np.ndarray, p: np.ndarray, innovation: np.ndarray, s: np.ndarray, cross: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States and errors after measurements, as State has them."""
    gain = _solved(s, cross)
    error = (innovation * np.linalg.solve(s, innovation[..., None])[..., 0]).sum(-1) / 2
    return x + (gain @ innovation[..., None])[..., 0], p - gain @ s @ _turned(gain), error


def _diagonals(*columns: np.ndarray) -> np.ndarray:
    return np.stack(columns, -1)[:, None, :] * np.eye(len(columns))


def _advance_all(x: np.ndarray, p: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """advance for the states of many trips, one row each."""
    x, p, error = x @ F.T, F @ p @ F.T + NOISE, np.zeros(len(x))
    seen, fast = ~np.isnan(rows[:, 0]), rows[:, 2] >= 0
    if len(at := np.flatnonzero(seen & fast)):
        r, own = rows[at], p[at]
        values, vectors = np.linalg.eigh(4 * (own + _turned(own)) / 2)
        root = vectors * np.sqrt(np.maximum(values, 0))[:, None] @ _turned(vectors)
        points = np.concatenate([x[at][..., None] + root, x[at][..., None] - root], -1)
        z = np.stack([points[:, 0], points[:, 1], np.hypot(points[:, 2], points[:, 3])], 1)
        mean, middle = z.mean(-1), points.mean(-1, keepdims=True)
        off = z - mean[..., None]
        s = off @ _turned(off) / 8 + _diagonals(r[:, 3] ** 2, r[:, 4] ** 2, np.ones(len(at)))
        x[at], p[at], error[at] = _measure(x[at], own, r[:, :3] - mean, s, (points - middle) @ _turned(off) / 8)
    if len(at := np.flatnonzero(seen & ~fast)):
        r, own = rows[at], p[at]
        s = own[:, :2, :2] + _diagonals(r[:, 3] ** 2, r[:, 4] ** 2)
        x[at], p[at], error[at] = _measure(x[at], own, r[:, :2] - x[at][:, :2], s, own[:, :, :2])
    return x, p, error


def _trim_all(x: np.ndarray, p: np.ndarray, first: np.ndarray, length: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """_trim_start for many trips, whose states are from first on in steps of step; the fused states are put in their place. Gives
    (first, length) of what is left."""
    hold, apart = NOISE.copy(), np.zeros((4, 4))
    hold[2:, 2:] = 0
    apart[:2, :2] = 1
    sx, sp = x[first] * [1, 1, 0, 0], NOISE + p[first] * apart
    gone, open_ = np.maximum(length - 1, 0), np.flatnonzero(length > 1)
    for i in range(1, int(length.max(initial=0))):
        open_ = open_[length[open_] > i]
        if not len(open_):
            break
        sp[open_] += hold
        here = first[open_] + i * step
        gap = x[here] - sx[open_]
        far = (gap * np.linalg.solve(sp[open_] + p[here], gap[..., None])[..., 0]).sum(-1) / 2 > STILL
        gone[open_[far]] = i
        open_, here, gap = open_[~far], here[~far], gap[~far]
        own = sp[open_]
        sx[open_], sp[open_], _ = _measure(sx[open_], own, gap[:, :2], own[:, :2, :2] + p[here][:, :2, :2], own[:, :, :2])
    fused = np.flatnonzero(gone > 1)
    first, length = first.copy(), length.copy()
    first[fused] += (gone[fused] - 1) * step
    length[fused] -= gone[fused] - 1
    x[first[fused]], p[first[fused]] = sx[fused], sp[fused]
    return first, length


def smooth_all(rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(x, p, first, length): forward, backward and trim of many trips at once, whose rows follow each other; the states of a trip are
    length from first on, none if it is rejected. A step is one product or solution for all trips that are long enough."""
    n, first = len(rows), np.concatenate([[0], np.cumsum(length)[:-1]]).astype(int)
    trip = np.repeat(np.arange(len(length)), length)
    start = np.full(len(length), n)
    np.minimum.at(start, trip[seen := ~np.isnan(rows[:, 0])], np.flatnonzero(seen))
    left = np.where((length >= 2) & (start < n), first + length - start, 0)
    x, p, worst = np.zeros((n, 4)), np.zeros((n, 4, 4)), np.zeros(len(length))
    order = np.argsort(-left, kind="stable")
    sizes = -left[order]

    def longer(t: int) -> np.ndarray:
        """The trips with more than t states."""
        return order[: np.searchsorted(sizes, -t)]

    on = longer(0)
    hx, hp = np.zeros((len(length), 4)), np.tile(10 * np.eye(4), (len(length), 1, 1))
    hx[on, :2] = rows[start[on], :2]
    for t in range(int(left.max(initial=0))):
        on = longer(t)
        hx[on], hp[on], error = _advance_all(hx[on], hp[on], rows[start[on] + t])
        x[start[on] + t], p[start[on] + t] = hx[on], hp[on]
        worst[on] = np.where(error > worst[on], error, worst[on])
    bad = (left < 2) | ~(worst <= MAX_ERROR)
    for t in range(int(left.max(initial=0)) - 2, -1, -1):
        at = start[longer(t + 1)] + t
        ahead = F @ p[at] @ F.T + NOISE
        gain = _solved(ahead, p[at] @ F.T)
        x[at] += (gain @ (x[at + 1] - x[at] @ F.T)[..., None])[..., 0]
        p[at] += gain @ (p[at + 1] - ahead) @ _turned(gain)
    kept = np.flatnonzero(np.arange(n) >= start[trip])
    sign, logdet = np.linalg.slogdet(p[kept])
    bad[trip[kept[(sign > 0) & (logdet / math.log(10) > 4 * MAX_LOG_DET)]]] = True
    first, length = np.minimum(start, max(n - 1, 0)), np.where(bad, 0, left)
    first, length = _trim_all(x, p, first, length, 1)
    last, length = _trim_all(x, p, np.where(length > 0, first + length - 1, first), length, -1)
    return x, p, np.where(length > 0, last - length + 1, first), np.where(length >= 2, length, 0)


#: So many rows are smoothed at once, and whole trips always.
ROWS_AT_ONCE = 50_000
STATES = "trip_id string, idx long, x array<double>, p array<double>"


def _whole_trips(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, lengths of trips) from batches sorted by trip."""
    held, n = [], 0

    def cut(table: pa.Table, last: bool):
        ids = table.column(0).to_numpy()
        ends = np.concatenate([np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)] if last else []]).astype(int)
        return ends, np.diff(ends, prepend=0)

    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= ROWS_AT_ONCE:
            table = pa.Table.from_batches(held)
            ends, lengths = cut(table, False)
            if len(ends):
                yield table.slice(0, ends[-1]), lengths
                held = table.slice(ends[-1]).combine_chunks().to_batches()
            n = sum(b.num_rows for b in held) if len(ends) else 0  # a trip longer than that goes on for as many rows again
    if held and sum(b.num_rows for b in held):
        table = pa.Table.from_batches(held)
        yield table, cut(table, True)[1]


def _smoothed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, lengths in _whole_trips(batches):
        rows = np.stack([table.column(c).to_numpy().astype(float) for c in ("x", "y", "speed", "acc_h", "acc_v")], 1)
        x, p, first, length = smooth_all(rows, lengths)
        idx = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        at = np.repeat(first, length) + idx
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * k, pa.int32()), pa.array(v.reshape(-1))) for v, k in ((x[at], 4), (p[at], 16))]
        yield pa.RecordBatch.from_arrays([table.column(0).take(pa.array(at)).combine_chunks(), pa.array(idx, pa.int64()), *lists], names=["trip_id", "idx", "x", "p"])


def smooth_trips(points: DataFrame, compat: bool = False) -> DataFrame:
    """points (trip_id string, idx long, x, y, speed, acc_h, acc_v double; null x is a gap) to smoothed states; rejected trips have no rows.

    idx counts the states that are left from 0: gaps before the first position have none, and states that trimming fused are one.
    A trip is held as a whole: its rows are bounded by its length in seconds. Many are smoothed at once; compat goes trip by trip.
    """
    points = points.select(F_.col("trip_id").cast("string").alias("trip_id"), "idx", *[F_.col(c).cast("double").alias(c) for c in ("x", "y", "speed", "acc_h", "acc_v")])
    if not compat:
        return spread(points).sortWithinPartitions("trip_id", "idx").mapInArrow(_smoothed, STATES)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        states = forward(pdf[["x", "y", "speed", "acc_h", "acc_v"]].astype(float).to_numpy())
        states = backward(states) if states else None
        states = trim(states, compat)[0] if states else []
        rows = [(pdf.trip_id.iloc[0], k, s.x.tolist(), s.p.ravel().tolist()) for k, s in enumerate(states)] if len(states) >= 2 else []
        return pd.DataFrame(rows, columns=["trip_id", "idx", "x", "p"])

    return points.groupBy("trip_id").applyInPandas(run, STATES)


def stops(states: list[State]) -> list[tuple[int, State]]:
    """(index, state) of the stops: the state held at a place when the trip leaves it after LEAST_SAMPLES there, and the last state.

    A trip begins at a place where it has been long enough. While it stops, the held state is moved on and fused with every sample,
    read as standing still; the step that is too far from that is the departure. A moving trip stops at a state that agrees with
    no velocity.
    """
    if not states:
        return []
    out, stopped, held, count = [], True, states[0], LEAST_SAMPLES
    for k, here in enumerate(states):
        last = here
        if stopped:
            last = held.copy()
            last.predict(F, NOISE)
            at = np.zeros((4, 4))
            at[:2, :2] = here.p[:2, :2]
            if last.measure([here.x[0], here.x[1], 0, 0], np.eye(4), at) > LEAVE:
                if count >= LEAST_SAMPLES:
                    out.append((max(k - 1, 0), held))
                stopped = False
            held, count = last, count + 1
        elif here.constraint_distance([0, 0], VELOCITY) < STAY:
            stopped, held, count = True, here, 0
    return [*out, (len(states) - 1, last)]


def stops_of(states: DataFrame) -> DataFrame:
    """STATES rows to (trip_id, idx, px, py) of the stops: idx is the last sample there, px and py where the held state is."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        trail = [State(x, np.reshape(p, (4, 4))) for x, p in zip(pdf.x, pdf.p, strict=True)]
        return pd.DataFrame([(pdf.trip_id.iloc[0], int(pdf.idx.iloc[k]), float(s.x[0]), float(s.x[1])) for k, s in stops(trail)], columns=["trip_id", "idx", "px", "py"])

    return spread(states).groupBy("trip_id").applyInPandas(run, "trip_id string, idx long, px double, py double")


def affinity_propagation(points: np.ndarray, preference: float = -100_000.0, damping: float = 0.5, rounds: int = 200, settled: int = 15, weights: np.ndarray | None = None) -> np.ndarray:
    """The index of each point's exemplar, by message passing over squared distances. Takes n^2 memory: meant for stop points, a few thousand.
    weights: how often a point is there; its distances count as often, which is what its copies would pay."""
    n = len(points)
    if n < 2:
        return np.zeros(n, int)
    s = -((points[:, None] - points[None]) ** 2).sum(-1)
    if weights is not None:
        s *= np.asarray(weights, float)[:, None]
    np.fill_diagonal(s, preference)
    s += 1e-12 * np.abs(s) * np.random.default_rng(0).standard_normal((n, n))
    r, a, rows, same, last = np.zeros((n, n)), np.zeros((n, n)), np.arange(n), 0, None
    for _ in range(rounds):
        both = a + s
        top = both.argmax(1)
        best = both[rows, top]
        both[rows, top] = -np.inf
        new = s - best[:, None]
        new[rows, top] = s[rows, top] - both.max(1)
        r = damping * r + (1 - damping) * new
        pos = np.maximum(r, 0)
        pos[rows, rows] = r[rows, rows]
        new = pos.sum(0)[None] - pos
        diagonal = new[rows, rows].copy()
        new = np.minimum(new, 0)
        new[rows, rows] = diagonal
        a = damping * a + (1 - damping) * new
        chosen = (a + r)[rows, rows] > 0
        same = same + 1 if last is not None and (chosen == last).all() else 0
        last = chosen
        if same >= settled and chosen.any():
            break
    centers = np.flatnonzero(last)
    if not len(centers):
        return np.zeros(n, int)
    label = centers[s[:, centers].argmax(1)]
    label[centers] = centers
    return label
