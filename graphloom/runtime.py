"""Driver-side helpers: configuration, cached tables, circuit breaker, error handling, progress, catalogues."""

from __future__ import annotations

import functools
import os
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, fields
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession

from graphloom.errors import CircuitOpenError, ConfigurationError
from graphloom.schema import ELEMENT_TYPES, SECURITY_RULES


@dataclass(frozen=True)
class Config:
    """Settings with defaults; ``from_env`` reads GRAPHLOOM_<NAME>."""

    max_file_bytes: int = 10 * 1024 * 1024
    max_depth: int = 5
    shuffle_partitions: int = 8
    cache_seconds: int = 1800

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Config:
        env = os.environ if env is None else env
        found = {}
        for f in fields(cls):
            if (value := env.get(f"GRAPHLOOM_{f.name.upper()}")) is not None:
                try:
                    found[f.name] = int(value)
                except ValueError:
                    raise ConfigurationError(f"{f.name} must be a whole number, not {value!r}") from None
        return cls(**found)


class TableCache:
    """Persisted frames by key, with a time to live; counts hits and misses."""

    def __init__(self, clock: Callable[[], float] = time.time):
        self.clock, self.counts = clock, Counter()
        self._frames: dict[str, tuple[DataFrame, float]] = {}

    def set(self, key: str, df: DataFrame, seconds: float = 1800) -> DataFrame:
        self.delete(key)
        self._frames[key] = df.persist(), self.clock() + seconds
        self.counts["sets"] += 1
        return self._frames[key][0]

    def get(self, key: str) -> DataFrame | None:
        df, until = self._frames.get(key, (None, 0.0))
        if df is not None and self.clock() >= until:
            self.delete(key)
            df = None
        self.counts["misses" if df is None else "hits"] += 1
        return df

    def exists(self, key: str) -> bool:
        return key in self._frames and self.clock() < self._frames[key][1]

    def delete(self, key: str) -> bool:
        if key not in self._frames:
            return False
        self._frames.pop(key)[0].unpersist()
        self.counts["deletes"] += 1
        return True

    def delete_matching(self, pattern: str) -> int:
        """Drop all keys that match a shell pattern, as after a change of a graph: ``graph:g1:*``."""
        return sum(self.delete(k) for k in [k for k in self._frames if fnmatch(k, pattern)])

    def statistics(self) -> dict:
        asked = self.counts["hits"] + self.counts["misses"]
        return {"keys": len(self._frames), **{k: self.counts[k] for k in ("hits", "misses", "sets", "deletes")}, "hit_rate": self.counts["hits"] / asked if asked else 0.0}


class CircuitBreaker:
    """Closed until ``threshold`` failures in a row; then open for ``seconds``; then one trial decides."""

    def __init__(self, threshold: int = 5, seconds: float = 60, clock: Callable[[], float] = time.monotonic):
        self.threshold, self.seconds, self.clock = threshold, seconds, clock
        self.failures, self.opened = 0, None

    @property
    def state(self) -> str:
        if self.opened is None:
            return "closed"
        return "half_open" if self.clock() - self.opened >= self.seconds else "open"

    def call(self, f: Callable, *args, **kw):
        if self.state == "open":
            raise CircuitOpenError("the circuit is open")
        trial = self.state == "half_open"
        try:
            out = f(*args, **kw)
        except Exception:
            self.failures += 1
            if trial or self.failures >= self.threshold:
                self.opened = self.clock()
            raise
        self.failures, self.opened = 0, None
        return out


def handled(component: str, record: list | None = None, recover: dict[type, Callable] | None = None, fallback: Callable | None = None):
    """Decorator: an error is recorded, handed to the recovery for its kind, then to the fallback, and raised again if
    neither is there."""

    def wrap(f):
        @functools.wraps(f)
        def run(*args, **kw):
            try:
                return f(*args, **kw)
            except Exception as x:
                if record is not None:
                    record.append({"component": component, "kind": type(x).__name__, "message": str(x)})
                for kind, how in (recover or {}).items():
                    if isinstance(x, kind):
                        return how(x, *args, **kw)
                if fallback is not None:
                    return fallback(*args, **kw)
                raise

        return run

    return wrap


def progress(spark: SparkSession) -> list[dict]:
    """Active stages with their tasks, done and failed ones."""
    t = spark.sparkContext.statusTracker()
    found = [t.getStageInfo(i) for i in t.getActiveStageIds()]
    return [{"stage": x.stageId, "name": x.name, "tasks": x.numTasks, "done": x.numCompletedTasks, "failed": x.numFailedTasks} for x in found if x]


#: Names that clients choose from.
CATALOGUES = {
    "layouts": ("ring", "rows", "circle", "tree"),
    "themes": ("light", "dark"),
    "languages": ("python", "java", "javascript", "csharp"),
    "element_types": ELEMENT_TYPES,
    "security_rules": tuple(n for n, _, _ in SECURITY_RULES),
    "documents": ("module", "class", "html"),
    "questions": ("function_call", "inheritance", "dependency", "implementation", "structure", "location"),
}


def catalogue(spark: SparkSession) -> DataFrame:
    """All catalogues as rows: kind, name, position."""
    return spark.createDataFrame([(k, n, i) for k, names in CATALOGUES.items() for i, n in enumerate(names)], "kind string, name string, position int")
