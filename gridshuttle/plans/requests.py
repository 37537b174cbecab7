"""Exchanges that run beside the caller.

A request's jobs run in a thread of their own that inherits the caller's
settings and carries a job tag. Its result is written to the shared folder,
so a lost executor costs no more than a read, and nothing is held in memory.
"""

from __future__ import annotations

import time
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame

from .. import store
from ..errors import ErrorCode, GridError

_POOL = ThreadPoolExecutor(8, thread_name_prefix="gridshuttle")


class Request:
    """A started exchange; an int names it."""

    _next = 0

    def __init__(self, kind: str, df: DataFrame):
        Request._next += 1
        self.handle, self.kind, self.cancelled = Request._next, kind, False
        self._spark = df.sparkSession
        self.tag = f"gridshuttle-{kind}-{self.handle}"
        self.path = store.new_path(self._spark, kind)
        sc = self._spark.sparkContext

        def run() -> DataFrame:
            sc.addJobTag(self.tag)
            try:
                if self.cancelled:
                    raise GridError(ErrorCode.INVALID_REQUEST, "cancelled")
                return store.written(df, self.path)
            finally:
                sc.removeJobTag(self.tag)

        self._future: Future = _POOL.submit(inheritable_thread_target(self._spark)(run))

    def __int__(self) -> int:
        return self.handle

    def __repr__(self) -> str:
        return f"Request(handle={self.handle}, kind={self.kind!r}, done={self.done})"

    @property
    def done(self) -> bool:
        return self._future.done()

    def result(self) -> DataFrame:
        """Waits; a failed request raises what it failed with."""
        return self._future.result()

    def cancel(self) -> None:
        """Ends the request's jobs and returns when none is left."""
        self.cancelled = True
        while not self._future.done() and not self._future.cancel():
            self._spark.sparkContext.cancelJobsWithTag(self.tag)  # again for one that starts just now
            time.sleep(0.05)
        self.free()

    def free(self) -> None:
        store.delete(self._spark, self.path)
