"""State processors: small per-key state, vectorised over each key's new rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EARTH_RADIUS_KM, CLIMB_WEIGHT = 6371.0, 0.1  # fixed values

SEGMENT_SCHEMA = "user_id bigint, ts timestamp, x0 double, y0 double, x1 double, y1 double"
RUNNING_SCHEMA = "track_id bigint, seq int, km double, climb_m double, effort double"
LATEST_SCHEMA = "task_id bigint, status string, us bigint"
#: Stands for a missing time, before all others.
NO_TIME = -(2**63)


def steps_km(lng: np.ndarray, lat: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat[:-1]), np.radians(lat[1:])
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(np.diff(lng)) / 2) ** 2
    return 2 * EARTH_RADIUS_KM * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def frac_tiles(lng: np.ndarray, lat: np.ndarray, z: int) -> tuple[np.ndarray, np.ndarray]:
    n, r = float(1 << z), np.radians(lat)
    return (lng + 180.0) / 360.0 * n, (1.0 - np.log(np.tan(r) + 1.0 / np.cos(r)) / np.pi) / 2.0 * n


def _ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of one micro-batch in track order."""
    parts = list(rows)
    return pd.concat(parts).sort_values("seq", kind="stable") if parts else pd.DataFrame()


class TrackSegments(StatefulProcessor):
    """Last point of a track; a batch's points become segments in fractional tile space.

    A track that is silent for ``forget_ms`` of event time is forgotten; points after that start a new line.
    """

    def __init__(self, z: int, forget_ms: int):
        self.z, self.forget_ms = z, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms bigint, seq int, x double, y double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = list(rows)
        if not parts:
            return
        pdf = pd.concat(parts).sort_values(["ts", "seq"], kind="stable")
        ms, seq = pdf.ts.astype("datetime64[ms]").astype("int64").to_numpy(), pdf.seq.to_numpy()
        x, y = frac_tiles(pdf.lng.to_numpy(), pdf.lat.to_numpy(), self.z)
        ts = pdf.ts.to_numpy()
        before = self.last.get()
        if before is not None:
            later = (ms > before[0]) | ((ms == before[0]) & (seq > before[1]))
            ms, seq, x, y, ts = ms[later], seq[later], x[later], y[later], ts[later]
        if not len(ms):
            return
        start = (x[0], y[0]) if before is None else (before[2], before[3])
        self.last.update((int(ms[-1]), int(seq[-1]), float(x[-1]), float(y[-1])))
        move_timer(self.handle, None if before is None else before[0] + self.forget_ms, int(ms[-1]) + self.forget_ms)
        yield pd.DataFrame({"user_id": key[0], "ts": ts, "x0": np.r_[start[0], x[:-1]], "y0": np.r_[start[1], y[:-1]], "x1": x, "y1": y})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def move_timer(handle: StatefulProcessorHandle, old_ms: int | None, ms: int) -> None:
    """Put off a key's only timer; the state tells when it was due, so that timers need not be listed."""
    if old_ms is not None:
        handle.deleteTimer(old_ms)
    handle.registerTimer(ms)


class RunningEffort(StatefulProcessor):
    """Last point and the sums so far, per track; forgotten when the track is silent for ``forget_ms`` of event time."""

    def __init__(self, forget_ms: int):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "seq int, lng double, lat double, ele double, km double, climb double, due bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = _ordered(rows)
        seq, lng, lat, ele = (pdf[c].to_numpy() for c in ("seq", "lng", "lat", "ele"))
        km = climb = 0.0
        s = self.sums.get()
        if s is not None:
            keep = seq > s[0]
            seq, lng, lat, ele = seq[keep], lng[keep], lat[keep], ele[keep]
            lng, lat, ele = np.r_[s[1], lng], np.r_[s[2], lat], np.r_[s[3], ele]
            km, climb = s[4], s[5]
        if not len(seq):
            return
        km += float(steps_km(lng, lat).sum())
        climb += float(np.maximum(np.diff(ele), 0).sum())
        due = int(pdf.ts.max().value // 1_000_000) + self.forget_ms
        move_timer(self.handle, None if s is None else s[6], due)
        self.sums.update((int(seq[-1]), float(lng[-1]), float(lat[-1]), float(ele[-1]), km, climb, due))
        row = (key[0], int(seq[-1]), km, climb, km + CLIMB_WEIGHT * climb)
        yield pd.DataFrame([row], columns=["track_id", "seq", "km", "climb_m", "effort"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.sums.clear()
        return iter(())

    def close(self) -> None:
        pass


class LatestTask(StatefulProcessor):
    """Latest status per task with an event-time timer for silence; tasks that have ended are forgotten after a while.

    Takes plain rows: a task has few in a micro-batch. The time of a task's timer follows from its state, so a batch
    costs one read, one write and a change of timer per task.
    """

    def __init__(self, timeout_s: int, forget_ms: int):
        self.timeout_ms, self.forget_ms = timeout_s * 1000, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "status string, us bigint")

    def due_ms(self, status: str, us: int) -> int:
        """When the timer of a task in that state goes off."""
        wait = {"RUNNING": self.timeout_ms, "STALE": self.timeout_ms + self.forget_ms}.get(status, self.forget_ms)
        return us // 1000 + wait

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        status, us = None, NO_TIME
        for row in rows:
            at = NO_TIME if row.us is None else row.us
            if at >= us:
                status, us = row.status, at
        before = self.latest.get()
        if before is not None:
            if before[1] // 1000 > us // 1000:
                return
            self.handle.deleteTimer(self.due_ms(*before))
        self.latest.update((status, us))
        self.handle.registerTimer(self.due_ms(status, us))
        yield Row(task_id=key[0], status=status, us=us)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        status, us = self.latest.get()
        if status != "RUNNING":
            self.latest.clear()
        else:
            self.latest.update(("STALE", us))
            self.handle.registerTimer(self.due_ms("STALE", us))
            yield Row(task_id=key[0], status="STALE", us=us // 1000 * 1000)

    def close(self) -> None:
        pass
