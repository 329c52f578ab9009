"""Independent jobs run side by side: fits over folds, parameter sets and left-out markets.

A fit is a chain of small jobs, so one alone leaves most of a cluster idle. Every task here is a
driver thread that inherits the session's job properties and submits to a scheduler pool of its
own; with ``spark.scheduler.mode=FAIR`` the pools share the executors evenly.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

T = TypeVar("T")
WIDTH = 4
# Nested calls run in their caller's thread: threads are bounded by WIDTH, whatever is nested.
_inside = threading.local()


def side_by_side(spark: SparkSession, tasks: Sequence[Callable[[], T]], width: int = WIDTH) -> list[T]:
    """Results of the tasks in their order; the first error stops what has not begun and is raised."""
    tasks = list(tasks)
    if width <= 1 or len(tasks) <= 1 or getattr(_inside, "yes", False):
        return [task() for task in tasks]
    run = uuid.uuid4().hex[:8]

    def one(task: Callable[[], T], number: int) -> T:
        _inside.yes = True
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fits-{run}-{number}")
        try:
            return task()
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
            _inside.yes = False

    with ThreadPoolExecutor(width) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(one), task, n) for n, task in enumerate(tasks)]
        try:
            return [f.result() for f in started]
        except BaseException:
            for f in started:
                f.cancel()
            raise
