"""Benchmark decontamination with a generalised suffix automaton.

All items of the benchmark, as word sequences, go into one suffix automaton.  A
document is streamed through it word by word; the automaton gives the length of
the longest suffix of the words so far that occurs in some item.  Where that
length reaches the window, the last words lie in occurring windows.  An item
shorter than the window counts as one window, found where its end state is on
the suffix-link path of the current state.

One automaton of at most ``MAX_WORDS`` words is shipped to the tasks at a time.
A larger benchmark is cut, between items, into several: the documents are
streamed through one after another, the hits of each pass, few rows, go to the
shared checkpoint folder, and its automaton is given up before the next is made.
"""

from __future__ import annotations

from hashlib import sha256
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import WORD_TABLE, alnum_words, map_batches, saved, texts_of

WINDOW = 10
MAX_WORDS = 100_000


class Automaton:
    """Generalised suffix automaton over word numbers.

    ``items`` are (item id, words); items without words are left out.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.up, self.length = [-1], [0]
        self.of_window: dict[tuple[int, ...], list[str]] = {}
        self.shortest = window
        whole: list[tuple[int, int]] = []
        for item, words in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            if not ids:
                continue
            last = 0
            for c in ids:
                last = self._extend(last, c)
            n = min(len(ids), window)
            for at in range(len(ids) - n + 1):
                names = self.of_window.setdefault(tuple(ids[at : at + n]), [])
                if item not in names:
                    names.append(item)
            if len(ids) < window:
                whole.append((len(ids), last))
                self.shortest = min(self.shortest, len(ids))
        # lengths of the short items that end where a state's strings end, longest first
        self.short: list[tuple[int, ...]] = [()] * len(self.up)
        if whole:
            own: dict[int, set[int]] = {}
            for n, state in whole:
                own.setdefault(self._state_of(state, n), set()).add(n)
            for state in sorted(range(len(self.up)), key=self.length.__getitem__):
                above = self.short[self.up[state]] if self.up[state] >= 0 else ()
                self.short[state] = tuple(sorted({*above, *own.get(state, ())}, reverse=True))

    def _state_of(self, state: int, n: int) -> int:
        """The state on the link path of ``state`` that holds its suffix of length n."""
        while self.length[self.up[state]] >= n:
            state = self.up[state]
        return state

    def _new(self, length: int, up: int, step: dict[int, int]) -> int:
        self.length.append(length)
        self.up.append(up)
        self.step.append(step)
        return len(self.up) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._new(self.length[p] + 1, self.up[q], dict(self.step[q]))
        self.up[q] = copy
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = copy
            p = self.up[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.step[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.up[p]
        if p >= 0:
            q = self.step[p][c]
            self.up[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged (start, end) runs of hit words, end exclusive, and the items with an occurring window."""
        ids = list(map(self.vocab.get, words))
        runs: list[tuple[int, int]] = []
        items: set[str] = set()
        step, up, length, short, window, least = self.step, self.up, self.length, self.short, self.window, self.shortest
        state = matched = 0
        start, n = 0, len(ids)
        while start < n:
            # an unknown word ends every match: only stretches of known words are streamed
            try:
                end = ids.index(None, start)
            except ValueError:
                end = n
            if end - start >= least:
                state = matched = 0
                for i in range(start, end):
                    c = ids[i]
                    to = step[state].get(c)
                    if to is None:
                        while to is None:
                            state = up[state]
                            if state < 0:
                                break
                            to = step[state].get(c)
                        if state < 0:
                            state = matched = 0
                            continue
                        matched = length[state]
                    state = to
                    matched += 1
                    if matched >= window:
                        self._note(ids, i + 1, window, runs, items)
                    if short[state]:
                        self._note_short(ids, i + 1, state, matched, runs, items)
            start = end + 1
        return runs, items

    def _note_short(self, ids, end, state, matched, runs, items):
        # the state also stands for shorter matches; a link away are the shorter ones still
        while self.length[self.up[state]] >= matched:
            state = self.up[state]
        for n in self.short[state]:
            if n <= matched:
                self._note(ids, end, n, runs, items)

    def _note(self, ids, end, n, runs, items):
        items.update(self.of_window.get(tuple(ids[end - n : end]), ()))
        begin = end - n
        while runs and runs[-1][1] >= begin:
            begin = min(begin, runs.pop()[0])
        runs.append((begin, end))


def _merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _automata(benchmark: DataFrame, window: int, max_words: int):
    """The automata of a benchmark, of about ``max_words`` words each; items without an id have numbers as ids."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("id"), "text").filter("text is not null")
    shard: list[tuple[str | int, list[bytes]]] = []
    words = 0
    for k, r in enumerate(rows.toLocalIterator()):  # one partition of the benchmark at a time
        w = alnum_words(r.text.encode())
        if shard and words + len(w) > max_words:
            yield Automaton(shard, window)
            shard, words = [], 0
        shard.append((k if r.id is None else r.id, w))
        words += len(w)
    if shard:
        yield Automaton(shard, window)


_HITS = "__row bigint, starts array<int>, ends array<int>, items array<string>, unnamed array<int>"


def _passes(docs: DataFrame, automata, id_col: str) -> DataFrame:
    """(__row, __hits): the hits of every row in which one of several automata finds any, by a hash of id and text."""
    sc, found = docs.sparkSession.sparkContext, None
    rows = docs.select(F.xxhash64(id_col, "text").alias("__row"), "text")
    for automaton in automata:
        held = sc.broadcast(automaton)

        def run(batch: pa.RecordBatch, held=held) -> pa.RecordBatch:
            out = []
            for row, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                runs, items = held.value.hits(alnum_words(t)) if t else ([], set())
                if runs:
                    out.append((row, [s for s, _ in runs], [e for _, e in runs], [x for x in items if isinstance(x, str)], [x for x in items if not isinstance(x, str)]))
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["__row", "starts", "ends", "items", "unnamed"])

        part = saved(map_batches(rows, run, _HITS).dropDuplicates(["__row"]))
        held.destroy()
        found = part if found is None else found.unionByName(part)
    return found.groupBy("__row").agg(F.collect_list(F.struct("starts", "ends", "items", "unnamed")).alias("__hits"))


def scanned(docs: DataFrame, benchmark: DataFrame, window: int, max_words: int, id_col: str, use, schema) -> DataFrame:
    """``use`` over every batch of ``docs``; it gets the batch and a function from its texts to (words, runs, items)."""
    automata = _automata(benchmark, window, max_words)
    first, second = next(automata, None), next(automata, None)
    at = docs.columns.index("text")
    if second is None:
        one = docs.sparkSession.sparkContext.broadcast(first)

        def scan(batch):
            for t in texts_of(batch.column(at)):  # the words of one text at a time
                words = alnum_words(t) if t else []
                yield len(words), *(one.value.hits(words) if one.value and words else ([], set()))

        return map_batches(docs, lambda batch: use(batch, scan(batch)), schema)
    hits = _passes(docs, chain([first, second], automata), id_col)

    def scan_hits(batch):
        for t, got in zip(texts_of(batch.column(at)), batch.column(len(batch.columns) - 1).to_pylist(), strict=True):
            runs, items = [], set()
            for h in got or ():
                runs = _merge(runs, list(zip(h["starts"], h["ends"], strict=True)))
                items.update(h["items"], h["unnamed"])
            yield len(alnum_words(t)) if t else 0, runs, items

    # each row meets at most one row of hits, so the join changes no count
    rows = docs.withColumn("__row", F.xxhash64(id_col, "text")).join(hits, "__row", "left").select(*docs.columns, "__hits")
    return map_batches(rows, lambda batch: use(batch.select(list(range(len(batch.columns) - 1))), scan_hits(batch)), schema)


REPORT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """One row per document: its words, hit words and the items found in it.

    Null and empty texts have no words and no hits; repeated rows stay repeated;
    items with a null text or without words find nothing; items with a null id
    hit and count like others, but cannot stand in ``items_sha256``; an empty
    benchmark leaves every document clean.  Other columns of either table are
    ignored.
    """

    def run(batch: pa.RecordBatch, found) -> pa.RecordBatch:
        n, hit, count, digest = [], [], [], []
        for words, runs, items in found:
            n.append(words)
            hit.append(sum(e - s for s, e in runs))
            count.append(len(items))
            digest.append(sha256(",".join(sorted(x for x in items if isinstance(x, str))).encode()).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())],
            names=[id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    return scanned(docs.select(id_col, "text"), benchmark, window, max_words, id_col, run, f"`{id_col}` {kind}, {REPORT}")


def cut(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The text without the words of the runs and what stands between them."""
    spaced = text.translate(WORD_TABLE)
    bounds, at = [], 0
    for w in spaced.split():
        at = spaced.index(w, at)
        bounds.append((at, at + len(w)))
        at += len(w)
    out, done = [], 0
    for s, e in runs:
        out.append(text[done : bounds[s][0]])
        done = bounds[e - 1][1]
    return b"".join([*out, text[done:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", window: int = WINDOW, max_run: int = WINDOW - 1, max_coverage: float = 0.5, max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` with the benchmark's passages removed; same columns.

    A document of which hit words, those of short items too, are more than
    ``max_coverage`` is removed.  In the others, hit runs longer than ``max_run``
    words are cut out of the text; short items that stand alone stay.
    ``n_chars``, if there, is counted anew for changed texts.  Null and empty
    texts stay as they are.
    """
    names = docs.columns
    at = names.index("text")

    def run(batch: pa.RecordBatch, found) -> pa.RecordBatch:
        texts = texts_of(batch.column(at))
        keep, changed = [], {}
        for i, (words, runs, _) in enumerate(found):
            long = [(s, e) for s, e in runs if e - s > max_run]
            keep.append(sum(e - s for s, e in runs) <= max_coverage * words)
            if keep[-1] and long:
                changed[i] = cut(texts[i], long)
        if changed:
            for i, t in changed.items():
                texts[i] = t
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.binary()).cast(batch.schema.field(at).type))
            if "n_chars" in names:
                k = names.index("n_chars")
                counts = batch.column(k).to_pylist()
                for i, t in changed.items():
                    counts[i] = len(t.decode())
                batch = batch.set_column(k, batch.schema.field(k), pa.array(counts, batch.schema.field(k).type))
        return batch.filter(pa.array(keep, pa.bool_()))

    return scanned(docs, benchmark, window, max_words, id_col, run, docs.schema)


#: The rows of ``report`` with its defaults in DuckDB SQL, over the views ``documents`` and ``benchmark``: windows as texts, joined.
SQL = r"""
with words as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
item_words as (select item_id::varchar as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
sized as (select item, w, least(len(w), 10) as n from item_words where len(w) > 0),
windows as (select distinct item, n, array_to_string(w[i + 1 : i + n], ' ') as win from (select item, w, n, unnest(range(len(w) - n + 1)) as i from sized)),
lengths as (select distinct n from windows),
places as (select r, n, i, array_to_string(w[i + 1 : i + n], ' ') as win from (select r, w, n, unnest(range(len(w) - n + 1)) as i from words, lengths where len(w) >= n)),
hits as (select distinct r, i, p.n, item from places p join windows x on p.n = x.n and p.win = x.win),
covered as (select r, count(distinct k) as n_hit from (select r, unnest(range(i, i + n)) as k from hits) group by r),
items as (select r, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct r, item from hits) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join covered using (r) left join items using (r)
"""
