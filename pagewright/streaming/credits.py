"""The law of page credits, as pure functions and over tables.

A document has a window of W credits.  A page is scheduled for one credit;
released credits come back, but never beyond W.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Credits:
    window: int
    available: int
    next_page: int = 1

    @classmethod
    def fresh(cls, window: int) -> Credits:
        return cls(window, window)

    def schedule(self, total_pages: int, room: int | None = None) -> tuple[Credits, list[int]]:
        """The pages that can start now, limited by the credits and by the room of the queue."""
        n = min(self.available, total_pages - self.next_page + 1)
        n = max(0, n if room is None else min(n, room))
        return replace(self, available=self.available - n, next_page=self.next_page + n), list(range(self.next_page, self.next_page + n))

    def release(self, n: int) -> Credits:
        return replace(self, available=min(self.window, self.available + n))


@dataclass
class Admission:
    """Active documents up to a limit, then a bounded queue, then refusal."""

    active_limit: int
    queue_limit: int
    active: int = 0
    queued: int = 0

    def submit(self) -> str:
        if self.active < self.active_limit:
            self.active += 1
            return "active"
        if self.queued < self.queue_limit:
            self.queued += 1
            return "queued"
        return "saturated"

    def finish(self) -> None:
        if self.queued:
            self.queued -= 1
        elif self.active:
            self.active -= 1


def earliest_starts(pages: DataFrame, window: int) -> DataFrame:
    """``pages`` (doc_id, page_no, released) with ``start``: when a page's credit is there, 0 for the first ``window`` pages.

    Pages start in order, so page n waits for the (n - window)-th release of its document.
    """
    order = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list("released")).alias("__times"))
    start = F.when(F.col("page_no") <= window, 0).otherwise(F.get("__times", F.col("page_no").cast("int") - window - 1))
    return pages.join(order, "doc_id").withColumn("start", start.cast("bigint")).drop("__times")


def within_limits(docs: DataFrame, most_bytes: int = 50 << 20, most_pages: int | None = None) -> DataFrame:
    """``docs`` (n_bytes, n_pages) with ``code``: null, or RESOURCE_EXHAUSTED for what is over a limit."""
    over = F.col("n_bytes") > most_bytes
    if most_pages is not None:
        over = over | (F.col("n_pages") > most_pages)
    return docs.withColumn("code", F.when(over, "RESOURCE_EXHAUSTED"))
