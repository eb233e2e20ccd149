"""Fetching a capped export by windows of days: halve a window while its answer is full, within a budget of requests."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Iterator


class ExportFull(RuntimeError):
    """A single day's answer reaches the cap, so rows may be missing."""


class BudgetSpent(RuntimeError):
    """More requests would be needed than allowed."""


def windows(start: dt.date, end: dt.date, days: int = 10) -> Iterator[tuple[dt.date, dt.date]]:
    """[start, end] in stretches of ``days`` days, both ends inclusive."""
    while start <= end:
        stop = min(start + dt.timedelta(days=days - 1), end)
        yield start, stop
        start = stop + dt.timedelta(days=1)


class WindowFetcher:
    """``fetch(start, end)`` gives the rows of a window of days. ``range`` gives all rows in order of day; ``log`` tells each request.

    What is still to be asked for lies on a stack of windows, the earliest on top. An answer that reaches ``cap`` may be cut, so
    its window goes back as two.
    """

    def __init__(self, fetch: Callable[[dt.date, dt.date], list], cap: int = 1000, budget: int = 20, pause: float = 0.0, days: int = 10) -> None:
        self.fetch, self.cap, self.budget, self.pause, self.days = fetch, cap, budget, pause, days
        self.log: list[tuple[dt.date, dt.date, int]] = []

    def _ask(self, window: tuple[dt.date, dt.date]) -> list:
        if len(self.log) == self.budget:
            raise BudgetSpent(f"{self.budget} requests made; {window[0]} to {window[1]} is open")
        time.sleep(self.pause if self.log else 0)
        rows = self.fetch(*window)
        self.log.append((*window, len(rows)))
        return rows

    def range(self, start: dt.date, end: dt.date) -> list:
        todo, got = list(windows(start, end, self.days))[::-1], []
        while todo:
            first, last = window = todo.pop()
            rows = self._ask(window)
            if len(rows) < self.cap:
                got += rows
            elif first == last:
                raise ExportFull(f"{first}: {len(rows)} rows reach the cap of {self.cap}")
            else:
                todo += list(windows(first, last, ((last - first).days + 2) // 2))[::-1]
        return got
