"""A result cache on the driver: least recently used goes first, entries expire, writes invalidate.

Keys are hashes of a canonical plan and its parameters, values are collected results of bounded size (top-k rows).
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
from collections import OrderedDict
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame


def key(kind: str, **params: Any) -> str:
    """A key over everything that determines a result, fusion settings included."""
    return hashlib.sha256(json.dumps([kind, params], sort_keys=True, default=str).encode()).hexdigest()


def plan_key(df: DataFrame) -> str:
    """A key of a query as it was analysed: queries with equal keys are compared before a result is used."""
    return str(df.semanticHash())


class ResultCache:
    """capacity 0 keeps nothing; ttl 0 never expires."""

    def __init__(self, capacity: int = 1000, ttl: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.capacity, self.ttl, self.clock = capacity, ttl, clock
        self.hits = self.misses = self.evictions = 0
        self._entries: OrderedDict[str, tuple[float, str, Any]] = OrderedDict()
        self._lock = threading.Lock()

    def get(self, k: str) -> Any | None:
        with self._lock:
            entry = self._entries.get(k)
            if entry is not None and (not self.ttl or self.clock() - entry[0] < self.ttl):
                self._entries.move_to_end(k)
                self.hits += 1
                return entry[2]
            self._entries.pop(k, None)
            self.misses += 1
            return None

    def put(self, k: str, value: Any, namespace: str = "") -> None:
        with self._lock:
            self._entries[k] = (self.clock(), namespace, value)
            self._entries.move_to_end(k)
            while len(self._entries) > self.capacity:
                self._entries.popitem(last=False)
                self.evictions += 1

    def invalidate(self, namespace: str | None = None) -> int:
        """Drop what a write to a namespace (None: any write) makes stale; the number dropped."""
        with self._lock:
            stale = [k for k, (_, ns, _) in self._entries.items() if namespace is None or ns == namespace]
            for k in stale:
                del self._entries[k]
            return len(stale)

    def collect(self, df: DataFrame, namespace: str = "") -> list:
        """The rows of a bounded query, from the cache if the same query was asked before."""
        k = plan_key(df)
        found = self.get(k)
        if found is None or not found[0].sameSemantics(df):  # hashes of plans may collide
            found = (df, df.collect())
            self.put(k, found, namespace)
        return list(found[1])

    def stats(self) -> dict[str, float]:
        asked = self.hits + self.misses
        return {"size": len(self._entries), "hits": self.hits, "misses": self.misses, "evictions": self.evictions, "hit_rate": self.hits / asked if asked else 0.0}
