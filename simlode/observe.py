"""Metrics and structured logs of running queries.

Counts are taken by Spark while a query runs (``DataFrame.observe``), so they
cost no second pass. Counters, histograms and gauges are kept in a
:class:`Registry` on the driver and shown in the usual text exposition format.
"""

from __future__ import annotations

import json
import logging
import threading
import time
from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 300.0)


class JsonFormatter(logging.Formatter):
    """One JSON object a line: time, level, logger, message, and what was given as ``extra={"fields": {...}}``."""

    def format(self, record: logging.LogRecord) -> str:
        line = {"timestamp": time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(record.created)) + f".{int(record.msecs):03d}Z", "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        line.update(getattr(record, "fields", {}))
        if record.exc_info:
            line["exception"] = self.formatException(record.exc_info)
        return json.dumps(line, default=str)


def json_logger(name: str = "simlode", stream=None, level: int = logging.INFO) -> logging.Logger:
    """A logger that writes JSON lines; asked for again, the same one with one handler."""
    logger = logging.getLogger(name)
    for handler in list(logger.handlers):
        if isinstance(handler.formatter, JsonFormatter):
            logger.removeHandler(handler)
    handler = logging.StreamHandler(stream)
    handler.setFormatter(JsonFormatter())
    logger.addHandler(handler)
    logger.setLevel(level)
    logger.propagate = False
    return logger


class Registry:
    """Counters, histograms and gauges by name and labels; safe to use from several threads."""

    def __init__(self):
        self._lock = threading.Lock()
        self._kinds: dict[str, str] = {}
        self._values: dict[tuple[str, tuple], float] = {}
        self._counts: dict[tuple[str, tuple], list[float]] = {}

    def _key(self, name: str, kind: str, labels: dict) -> tuple[str, tuple]:
        if self._kinds.setdefault(name, kind) != kind:
            raise ValueError(f"{name} is a {self._kinds[name]}")
        return name, tuple(sorted((k, str(v)) for k, v in labels.items()))

    def count(self, name: str, by: float = 1, **labels) -> None:
        if by < 0:
            raise ValueError("a counter does not go down")
        with self._lock:
            key = self._key(name, "counter", labels)
            self._values[key] = self._values.get(key, 0) + by

    def gauge(self, name: str, value: float, **labels) -> None:
        with self._lock:
            self._values[self._key(name, "gauge", labels)] = value

    def observe(self, name: str, value: float, **labels) -> None:
        """Into a histogram of seconds."""
        with self._lock:
            held = self._counts.setdefault(self._key(name, "histogram", labels), [0.0] * (len(BUCKETS) + 2))
            held[bisect_left(BUCKETS, value)] += 1
            held[-1] += value

    def value(self, name: str, **labels) -> float:
        """Of a counter or gauge; of a histogram the number of values."""
        key = (name, tuple(sorted((k, str(v)) for k, v in labels.items())))
        return sum(self._counts[key][:-1]) if key in self._counts else self._values.get(key, 0)

    @contextmanager
    def timed(self, name: str, **labels) -> Iterator[None]:
        """Time a block, and count it by its outcome."""
        began, status = time.perf_counter(), "ok"
        try:
            yield
        except BaseException:
            status = "error"
            raise
        finally:
            self.observe(f"{name}_seconds", time.perf_counter() - began, **labels)
            self.count(f"{name}_total", status=status, **labels)

    def text(self) -> str:
        """All metrics in the text exposition format."""
        shown = lambda labels, *more: "{" + ",".join(f'{k}="{v}"' for k, v in (*labels, *more)) + "}" if labels or more else ""
        lines = []
        with self._lock:
            for name, kind in sorted(self._kinds.items()):
                lines.append(f"# TYPE {name} {kind}")
                for (n, labels), value in sorted(self._values.items()):
                    if n == name:
                        lines.append(f"{name}{shown(labels)} {value:g}")
                for (n, labels), held in sorted(self._counts.items()):
                    if n == name:
                        total = 0.0
                        for edge, count in zip([*BUCKETS, "+Inf"], held):
                            total += count
                            lines.append(f"{name}_bucket{shown(labels, ('le', edge))} {total:g}")
                        lines += [f"{name}_sum{shown(labels)} {held[-1]:g}", f"{name}_count{shown(labels)} {total:g}"]
        return "\n".join(lines) + "\n"


def stages(spark: SparkSession, last: int = 50) -> list[dict]:
    """What the newest stages cost: tasks, run and CPU seconds, GC, peak execution memory, bytes read, shuffled and spilled."""
    jvm = spark.sparkContext._jvm
    empty = jvm.java.util.ArrayList()
    numbers = spark.sparkContext._gateway.new_array(jvm.double, 0)
    seen = spark.sparkContext._jsc.sc().statusStore().stageList(empty, False, False, numbers, empty)
    rows = []
    for i in range(min(seen.size(), last)):
        s = seen.apply(i)
        rows.append({
            "stage": s.stageId(), "tasks": s.numCompleteTasks(), "failed": s.numFailedTasks(), "run_s": s.executorRunTime() / 1e3, "cpu_s": s.executorCpuTime() / 1e9, "gc_s": s.jvmGcTime() / 1e3,
            "peak_memory": s.peakExecutionMemory(), "read": s.inputBytes(), "shuffle_read": s.shuffleReadBytes(), "shuffle_write": s.shuffleWriteBytes(), "spilled": s.diskBytesSpilled(),
        })
    return rows


class Observed:
    """A query whose rows are counted as they pass."""

    def __init__(self, rows: DataFrame, name: str, registry: Registry, measures: dict[str, Column] | None = None):
        self._seen, self._name, self._registry = Observation(name), name, registry
        self.rows = rows.observe(self._seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in (measures or {}).items()])

    def record(self) -> dict:
        """After an action: what was seen, also put into the registry (rows as a counter, the rest as gauges)."""
        got = self._seen.get
        for k, v in got.items():
            if k == "rows":
                self._registry.count(f"{self._name}_rows_total", v)
            elif v is not None:
                self._registry.gauge(f"{self._name}_{k}", float(v))
        return got
