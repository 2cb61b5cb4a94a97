"""Keyed state of the streamed agents: one value and up to three event-time timers an agent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def agent_timers(key: str, ready: tuple[str, ...], warn_ms: int, fail_ms: int, expire_ms: int) -> StatefulProcessor:
    """The processor of ``stream_agent_state``; times are milliseconds of event time."""

    class AgentTimers(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.known = handle.getValueState("known", "status string, t long, k long, flag string")

        def _row(self, name, status, t, idle_ms, flag, gone) -> pd.DataFrame:
            return pd.DataFrame({key: [name], "status": [status], "t": [t], "idle_ms": [idle_ms], "flag": [flag], "gone": [gone]})

        def _flag(self, status, idle_ms) -> str:
            if status not in ready:
                return ""
            return "IDLE TOO LONG" if idle_ms > fail_ms else "elevated wait" if idle_ms > warn_ms else ""

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            best = None
            for frame in rows:
                for t, k, status in zip(frame["t"], frame["k"], frame["status"]):
                    found = (int(t), -1 if pd.isna(k) else int(k), None if pd.isna(status) else status)
                    if best is None or found[:2] > best[:2]:
                        best = found
            old = self.known.get() if self.known.exists() else None
            if best is None or old is not None and (old[1], old[2]) >= best[:2]:
                return
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            t, k, status = best
            last = t // 1000
            for wait in ([warn_ms, fail_ms] if status in ready else []) + [expire_ms]:
                self.handle.registerTimer(last + wait + 1)  # over the threshold
            idle = max(0, timerValues.getCurrentWatermarkInMs() - last)
            flag = self._flag(status, idle)
            self.known.update((status, t, k, flag))
            yield self._row(key[0], status, t, idle, flag, False)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            if not self.known.exists():
                return
            status, t, k, flag = self.known.get()
            idle = timerValues.getCurrentWatermarkInMs() - t // 1000
            if idle > expire_ms:
                self.known.clear()
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                yield self._row(key[0], status, t, idle, self._flag(status, idle), True)
            elif (now := self._flag(status, idle)) != flag:
                self.known.update((status, t, k, now))
                yield self._row(key[0], status, t, idle, now, False)

        def close(self) -> None:
            pass

    return AgentTimers()
