"""License scans: an exact set-similarity join of text blocks with templates.

A template is the words of a license notice, as a set.  A text block is a window
of consecutive words of the whole text, so long as the template is in words with
``SLACK`` for words in between; line breaks, comment signs and other marks do not
cut it.  A pair joins if the block holds at least ``threshold`` of the template's
words; overlapping blocks that join with one template are one find.  Words are
ordered by how many documents of the whole corpus hold them, rarest first, and
three filters leave few blocks to count:

* prefix: with k = ceil(threshold * |template|) words to find, a block that
  joins holds one of the template's |template| - k + 1 rarest words, so only
  the surroundings of these are looked at;
* length: words of the template stand at k places there at least;
* positional: the rarest word of the template that stands there has place p of
  the template, so at most |template| - p words can be shared.

The templates are a fixed list of bounded size, so they travel with the tasks;
the corpus is not shuffled.
"""

from __future__ import annotations

from bisect import bisect_left
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import alnum_words, bound_batches, map_batches, texts_of

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Templates: label and notice.  Common public license notices.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
THRESHOLD = 0.8
#: A block has so many times the words of its template.
SLACK = 1.25


def template_sets(templates=TEMPLATES) -> list[tuple[str, frozenset[bytes]]]:
    return [(label, frozenset(alnum_words(text.encode()))) for label, text in templates]


def frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """Number of documents that hold each word of the templates, over all documents."""
    vocab = sorted(frozenset().union(*(s for _, s in template_sets(templates))))

    def run(batches):
        count = dict.fromkeys(vocab, 0)
        names = frozenset(vocab)
        for b in batches:
            for t in texts_of(b.column(0)):
                if t:
                    for w in names.intersection(alnum_words(t)):
                        count[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    bound_batches(docs.sparkSession)
    rows = docs.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return dict.fromkeys(vocab, 0) | {bytes(r.word): r.n for r in rows}


class Join:
    """Templates prepared for the join: words by rarity, prefixes by word."""

    def __init__(self, order: dict[bytes, int], templates=TEMPLATES, threshold: float = THRESHOLD):
        self.templates = []
        self.at: dict[bytes, list[int]] = {}
        for (label, words), (_, text) in zip(template_sets(templates), templates, strict=True):
            ranked = sorted(words, key=lambda w: (order[w], w))
            need = max(1, ceil(threshold * len(ranked) - 1e-9))
            for w in ranked[: len(ranked) - need + 1]:
                self.at.setdefault(w, []).append(len(self.templates))
            self.templates.append((label, ranked, need, ceil(SLACK * len(alnum_words(text.encode())))))
        self.prefix = frozenset(self.at)
        self.vocab = frozenset(w for _, ranked, _, _ in self.templates for w in ranked)

    def find(self, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(template, first word, end, containment) of every find, the containment being that of its best block."""
        if self.prefix.isdisjoint(words):
            return []
        places: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.vocab:
                places.setdefault(w, []).append(i)
        out = []
        for t in sorted({t for w in self.prefix.intersection(places) for t in self.at[w]}):
            _, ranked, need, size = self.templates[t]
            rarest = sorted(p for w in ranked[: len(ranked) - need + 1] for p in places.get(w, ()))
            at = sorted((p, k) for k, w in enumerate(ranked) for p in places.get(w, ()))
            first = 0
            while first < len(rarest):  # surroundings that overlap are one stretch
                last = first
                while last + 1 < len(rarest) and rarest[last + 1] - rarest[last] < 2 * size:
                    last += 1
                lo, hi = bisect_left(at, (rarest[first] - size + 1,)), bisect_left(at, (rarest[last] + size,))
                if hi - lo >= need and len(ranked) - min(k for _, k in at[lo:hi]) >= need:
                    out += [(t, *x) for x in _finds(at[lo:hi], need, size, len(ranked))]
                first = last + 1
        return out


def _finds(at: list[tuple[int, int]], need: int, size: int, of: int):
    """(first word, end, containment) of the finds among the places ``at`` (word, rank) of a template's words."""
    held: dict[int, int] = {}
    left, found = 0, None
    for p, k in at:
        held[k] = held.get(k, 0) + 1
        while at[left][0] <= p - size:
            old = at[left][1]
            held[old] -= 1
            if not held[old]:
                del held[old]
            left += 1
        if len(held) >= need:
            if found and at[left][0] < found[1]:
                found = (found[0], p + 1, max(found[2], len(held) / of))
            else:
                if found:
                    yield found
                found = (at[left][0], p + 1, len(held) / of)
    if found:
        yield found


def places(words: list[bytes], phrases: list[tuple[bytes, str]]) -> list[tuple[int, str]]:
    """(start, label) of every place where a phrase's words stand consecutively."""
    joined = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in phrases:
        at, seen, word = joined.find(phrase), 0, 0
        while at >= 0:
            word, seen = word + joined.count(b" ", seen, at), at
            out.append((word, label))
            at = joined.find(phrase, at + 1)
    return out


def matches(docs: DataFrame, id_col: str = "doc_id", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, first_word, end_word, label, containment): every find of every document, in words from 0, the end not included."""
    join = Join(frequencies(docs, templates), templates, threshold)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, found = [], []
        for i, t in enumerate(texts_of(batch.column(1))):
            got = join.find(alnum_words(t)) if t else []
            row += [i] * len(got)
            found += got
        columns = [pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array([join.templates[f[0]][0] for f in found], pa.string()), pa.array([f[3] for f in found], pa.float64())]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *columns], names=[id_col, "first_word", "end_word", "label", "containment"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, "text"), run, f"`{id_col}` {kind}, first_word bigint, end_word bigint, label string, containment double")


REPORT = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def report(docs: DataFrame, id_col: str = "doc_id", templates=TEMPLATES, threshold: float = THRESHOLD, phrases=PHRASES) -> DataFrame:
    """One row per document: places of the base phrases, labels of both kinds, and the best containment.

    The score is 1 where a base phrase stands, else the largest containment of a
    joined template, else 0.  Null and empty texts have no words, no places and
    no labels (empty strings); repeated rows stay repeated; other columns are
    ignored; an empty table gives an empty result.
    """
    join = Join(frequencies(docs, templates), templates, threshold)
    wanted = [(b" " + b" ".join(alnum_words(p.encode())) + b" ", label) for p, label in phrases.items()]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(7)]
        for t in texts_of(batch.column(1)):
            words = alnum_words(t) if t else []
            found = places(words, wanted)
            labels, score = {label for _, label in found}, 1.0 if found else 0.0
            base = ",".join(sorted(labels))
            for k, _, _, s in join.find(words):
                labels.add(join.templates[k][0])
                score = max(score, s)
            starts = [s for s, _ in found]
            for column, v in zip(out, (len(words), len(found), min(starts, default=None), max(starts, default=None), base, ",".join(sorted(labels)), score), strict=True):
                column.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=[id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, "text"), run, f"`{id_col}` {kind}, {REPORT}")


def sql(templates=TEMPLATES, threshold: float = THRESHOLD, phrases=PHRASES) -> str:
    """The rows of ``report`` in DuckDB SQL, over the view ``documents``: every window of every template is counted, without any filter."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    words = lambda text: [w.decode() for w in alnum_words(text.encode())]
    rows, held = [], []
    for t, ((label, own), (_, text)) in enumerate(zip(template_sets(templates), templates, strict=True)):
        rows.append(f"({t}, {quoted(label)}, {len(own)}, {max(1, ceil(threshold * len(own) - 1e-9))}, {ceil(SLACK * len(words(text)))})")
        held += [f"({t}, {quoted(w.decode())})" for w in sorted(own)]
    said = [f"({quoted(label)}, [{', '.join(map(quoted, words(phrase)))}])" for phrase, label in phrases.items()]
    return rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
template(t, label, size, need, span) as (values {", ".join(rows)}),
word(t, w) as (values {", ".join(held)}),
phrase(label, p) as (values {", ".join(said)}),
each as (select r, unnest(w) as w, unnest(range(len(w))) as k from d),
seen as (select r, t, k, e.w from each e join word using (w)),
windows as (select a.r, a.t, a.k, count(distinct b.w) as shared from seen a join template using (t) join seen b on a.r = b.r and a.t = b.t and b.k > a.k - span and b.k <= a.k group by a.r, a.t, a.k),
found as (select r, label, shared / size as share from windows join template using (t) where shared >= need),
base as (select r, label, k from d, phrase, unnest(range(len(w) - len(p) + 1)) x(k) where w[k + 1 : k + len(p)] = p),
based as (select r, count(*) as n, min(k) as first_word, max(k) as last_word, string_agg(distinct label, ',' order by label) as labels from base group by r),
labels as (select r, string_agg(distinct label, ',' order by label) as labels from (select r, label from base union all select r, label from found) group by r),
best as (select r, max(share) as share from found group by r)
select doc_id, len(w)::bigint as n_words, coalesce(b.n, 0)::bigint as n_base, b.first_word::bigint as first_word, b.last_word::bigint as last_word, coalesce(b.labels, '') as base_labels, coalesce(l.labels, '') as labels, case when b.n > 0 then 1.0 else coalesce(share, 0) end::double as score
from d left join based b using (r) left join labels l using (r) left join best using (r)
"""
