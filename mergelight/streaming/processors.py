"""State kept per key by streams: the newest status of a job, the age of a repository's profile.

The module is pickled by value, so workers need no copy of the package.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Times are microseconds here: state and rows must not differ by a time zone.
STATUS_OUT = "job_id STRING, status STRING, result STRING, at BIGINT"
REFRESH_OUT = "repo STRING, learned BIGINT"


def _order(*values: object) -> tuple:
    """Compares like a struct: a null is less than any value."""
    return tuple((value is not None, value) if value is not None else (False,) for value in values)


class NewestStatus(StatefulProcessor):
    """The newest (time, status) of a job; a row goes out when it changes, a late one changes nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "at BIGINT, status STRING, result STRING")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        held = self.newest.get() if self.newest.exists() else None
        best = held
        for row in rows:
            if best is None or _order(row.at, row.status) > _order(*best[:2]):
                best = (row.at, row.status, row.result)
        if best is not held:
            self.newest.update(best)
            yield Row(job_id=key[0], status=best[1], result=best[2], at=best[0])

    def close(self) -> None:
        pass


class ProfileAge(StatefulProcessor):
    """When the newest profile of a repository was learned; a timer tells when it is too old.

    Time is that of the profiles, so a stream that is run again tells the same.
    """

    def __init__(self, seconds: int) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.learned = handle.getValueState("learned", "learned BIGINT")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        held = self.learned.get()[0] if self.learned.exists() else None
        newest = max((row.learned for row in rows if row.learned is not None), default=None)
        if newest is not None and (held is None or newest > held):
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.learned.update((newest,))
            self.handle.registerTimer(newest // 1000 + self.seconds * 1000)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        learned = self.learned.get()[0]
        self.learned.clear()
        yield Row(repo=key[0], learned=learned)

    def close(self) -> None:
        pass


cloudpickle.register_pickle_by_value(sys.modules[__name__])
