"""Scheduled maintenance: one run after another for each registry, at an interval."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from .manager import PartitionManager


@dataclass
class Settings:
    interval: float = 3600.0
    maintenance_wait: float = 0.0
    analyze: bool = False
    jobmon: bool = True
    role: str = "spark"


class Maintainer:
    """Runs maintenance of several managers in turn; a failure of one doesn't stop the others."""

    def __init__(self, managers: Iterable[PartitionManager], settings: Settings | None = None, report: Callable[[str], None] = print):
        self.managers, self.settings, self.report = list(managers), settings or Settings(), report
        self._stop = threading.Event()

    def run_once(self) -> list[int | Exception]:
        out: list[int | Exception] = []
        for m in self.managers:
            try:
                out.append(m.run_maintenance_proc(self.settings.maintenance_wait, self.settings.analyze, self.settings.jobmon))
            except Exception as e:  # noqa: BLE001  whatever fails, of Spark or of the store, the next run goes on
                self.report(f"{m.root}: {e}")
                out.append(e)
        return out

    def run(self, times: int | None = None) -> None:
        done = 0
        while not self._stop.is_set() and (times is None or done < times):
            self.run_once()
            done += 1
            if times is None or done < times:
                self._stop.wait(self.settings.interval)

    def stop(self) -> None:
        self._stop.set()
