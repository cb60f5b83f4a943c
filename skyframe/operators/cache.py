"""Results kept for another use, the oldest leaving first."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Hashable

from pyspark import StorageLevel
from pyspark.sql import DataFrame


class Kept:
    """Persisted tables by key, at most ``most``; using one makes it the newest, and what leaves is let go."""

    def __init__(self, most: int = 1000, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> None:
        self._rows: OrderedDict[Hashable, DataFrame] = OrderedDict()
        self._most, self._level = most, level
        self.hits = self.misses = 0

    def get(self, key: Hashable, make: Callable[[], DataFrame]) -> DataFrame:
        if key in self._rows:
            self.hits += 1
            self._rows.move_to_end(key)
            return self._rows[key]
        self.misses += 1
        out = self._rows[key] = make().persist(self._level)
        while len(self._rows) > self._most:
            self._rows.popitem(last=False)[1].unpersist()
        return out

    def __len__(self) -> int:
        return len(self._rows)

    def clear(self) -> None:
        while self._rows:
            self._rows.popitem()[1].unpersist()
