"""Progress of jobs with effects: counts that tasks add to and the driver reads."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from treeline.operators.aggregate import rates


class Progress:
    """Items and bytes done so far. A task that runs twice counts twice, so it is for display only.

    As a context manager it calls ``show`` with the figures every ``seconds`` and once at the end.
    """

    def __init__(self, spark: SparkSession, show: Callable[[dict], None] | None = None, seconds: float = 10.0) -> None:
        self.items, self.bytes = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
        self.show, self.seconds, self.began = show, seconds, time.monotonic()
        self._over = threading.Event()
        self._thread: threading.Thread | None = None

    def counted(self, act: Callable) -> Callable:
        """``act`` on a row, with the row counted; what it returns, if a number, is counted as bytes."""
        items, size = self.items, self.bytes

        def run(row) -> None:
            done = act(row)
            items.add(1)
            size.add(done if isinstance(done, int) else 0)

        return run

    def now(self) -> dict:
        return {"items": self.items.value, "bytes": self.bytes.value, **rates(self.items.value, self.bytes.value, time.monotonic() - self.began)}

    def __enter__(self) -> Progress:
        if self.show:

            def tell() -> None:
                while not self._over.wait(self.seconds):
                    self.show(self.now())

            self._thread = threading.Thread(target=tell, daemon=True)
            self._thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self._over.set()
        if self._thread:
            self._thread.join()
        if self.show:
            self.show(self.now())
