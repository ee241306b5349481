"""Ordered page events of each document, with offsets that run across pages.

Pages arrive in any order; page n waits for 1 to n - 1.  Control rows end a
document: ``part_done`` for each finished part, ``failed`` with an error,
``cancel``.  A document gets exactly one terminal event: ``complete`` if any part
succeeded, ``error`` with the first failure if none did, ``cancelled``; a
document that buffers more than its window ends with RESOURCE_EXHAUSTED.  A page that was released or waits already is
passed over.  Pages that still wait when a document completes are not released,
and the terminal event names the gap.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENT = "doc_id bigint, seq bigint, event string, page_no int, texts array<string>, utf_start array<bigint>, utf_end array<bigint>, first_ref bigint, error string"
EVENT_ROW = Row(*(c.split()[0] for c in EVENT.split(", ")))
SLOW = "client did not consume page events within the bounded stream buffer"


class PageRelease(StatefulProcessor):
    """List of waiting pages; one row of cursor, counts and the end.

    Rows of one trigger are worked through in memory: the state is read and written once, and a page only becomes state
    if it still waits when they end.  Neither is ever scanned: a scan passes over what other documents have removed.
    """

    def __init__(self, window: int = 64, parts: int = 1):
        self.window, self.parts = window, parts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "page_no int, texts array<string>")
        self.cursor = handle.getValueState("cursor", "next_page int, offset bigint, items bigint, seq bigint, held int, pending int, good int, failure string, ended boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        state = self.cursor.get() or (1, 0, 0, 0, 0, self.parts, 0, None, False)
        next_page, offset, items, seq, held, pending, good, failure, ended = state
        kept = held > 0
        waiting: dict[int, list[str]] = {p: list(texts) for p, texts in self.waiting.get()} if kept else {}
        fresh: list[tuple] = []
        out: list[Row] = []

        def say(event, page=None, texts=None, starts=None, ends=None, ref=None, error=None):
            nonlocal seq
            out.append(EVENT_ROW(key[0], seq, event, page, texts, starts, ends, ref, error))
            seq += 1

        for r in sorted(rows, key=lambda r: (r.arrival is None, r.arrival or 0)):
            if ended:
                continue
            if r.kind == "page":
                if r.page_no < next_page or r.page_no in waiting:
                    continue
                if len(waiting) >= self.window:
                    ended = True
                    say("error", error=f"RESOURCE_EXHAUSTED: {SLOW}")
                    continue
                waiting[r.page_no] = list(r.texts)
                fresh.append((r.page_no, waiting[r.page_no]))
                while next_page in waiting:
                    texts = waiting.pop(next_page)
                    starts, ends, first = [], [], items
                    for t in texts:
                        offset += 1 if items else 0
                        starts.append(offset)
                        offset += len(t)
                        ends.append(offset)
                        items += 1
                    say("page", next_page, texts, starts, ends, first)
                    next_page += 1
            elif r.kind == "cancel":
                ended = True
                say("cancelled")
            else:
                if r.kind == "failed":
                    failure = failure or r.error
                else:
                    good += 1
                pending -= 1
                if pending <= 0:
                    ended = True
                    if waiting:
                        waits = sorted(waiting)
                        gap = f"DATA_LOSS: page {next_page} is missing, {len(waits)} later pages from {waits[0]} on are not released"
                        failure = f"{failure}; {gap}" if failure else gap
                    say("complete", error=failure) if good else say("error", error=failure or "INTERNAL: every collector failed")
        if ended:
            waiting = {}
        if kept and not waiting:
            self.waiting.clear()
        elif kept and next_page == state[0]:  # nothing was released: the new ones join those that wait
            if fresh:
                self.waiting.appendList(fresh)
        elif waiting:
            self.waiting.put(list(waiting.items()))
        now = (next_page, offset, items, seq, len(waiting), pending, good, failure, ended)
        if now != tuple(state):
            self.cursor.update(now)
        yield from out

    def close(self) -> None:
        pass


def released(arrivals: DataFrame, window: int = 64, parts: int = 1) -> DataFrame:
    """Events of a stream of arrivals: doc_id, arrival, kind, page_no, texts, error."""
    return arrivals.groupBy("doc_id").transformWithState(PageRelease(window, parts), EVENT, "Append", "None")
