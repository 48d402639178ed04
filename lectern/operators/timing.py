"""Stages timed and counted as they run, and results within a budget of time."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.util import InheritableThread

from lectern.sources import scratch


def time_call(fn: Callable, *args, **kwargs) -> tuple[float, Any]:
    """Seconds that a call took, and its result."""
    start = time.perf_counter()
    result = fn(*args, **kwargs)
    return time.perf_counter() - start, result


@dataclass
class Timings:
    """What stages took: (label, ms, rows) of each, gathered as they run.

    Rows are counted by an observation on the stage's own job, so nothing is
    run again to count them.
    """

    spark: SparkSession
    taken: list[tuple[str, float, int]] = field(default_factory=list)

    def stage(self, label: str, df: DataFrame) -> DataFrame:
        """Write a stage to the shared folder, note its time and rows, and read it back."""
        seen = Observation()
        path = scratch.place(self.spark, "stage")
        seconds, _ = time_call(df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet, path)
        self.taken.append((label, seconds * 1000, seen.get["n"]))
        return self.spark.read.schema(df.schema).parquet(path)

    def call(self, label: str, fn: Callable, *args, **kwargs) -> Any:
        """Note the time of a call on the driver; its rows are not known."""
        seconds, result = time_call(fn, *args, **kwargs)
        self.taken.append((label, seconds * 1000, None))
        return result

    def rows(self) -> DataFrame:
        """A row for each stage that ran, for :func:`lectern.operators.metrics.latency`."""
        return self.spark.createDataFrame(self.taken, "label string, ms double, n long")


def within(spark: SparkSession, seconds: float, full: Callable[[], DataFrame], quick: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """``full``'s rows if they are there in time, else ``quick``'s; and whether it was cut short.

    ``full`` is run and written by a thread whose jobs bear a tag; when time is
    up they are cancelled, so nothing goes on behind the answer. A failure of
    ``full`` within its time is raised. A budget of zero runs ``quick`` alone.
    """
    if seconds <= 0:
        return quick(), True
    tag = f"within-{uuid.uuid4().hex}"
    path = scratch.place(spark, "report")
    box: dict[str, Any] = {}

    def work() -> None:
        spark.sparkContext.addJobTag(tag)
        try:
            df = full()
            if "late" not in box:
                df.write.parquet(path)
                box["schema"] = df.schema
        except Exception as e:  # handed to the caller, unless it has left
            box["error"] = e

    thread = InheritableThread(target=work, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        box["late"] = True
        threading.Thread(target=_cancel, args=(spark, tag, thread), daemon=True).start()
        return quick(), True
    if "error" in box:
        raise box["error"]
    return spark.read.schema(box["schema"]).parquet(path), False


def _cancel(spark: SparkSession, tag: str, thread: threading.Thread) -> None:
    """Cancel a thread's jobs until it has ended: it may submit others while the first are being cancelled."""
    while thread.is_alive():
        spark.sparkContext.cancelJobsWithTag(tag)
        thread.join(0.2)
