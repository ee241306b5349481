"""Language identification with language-bitmask n-gram filters.

One Bloom filter a language, stored bit-sliced: row r of the filter is a bitmask
with bit L set if language L's filter has bit r.  Looking up an n-gram means
and-ing the k rows of its hashes, which gives the bitmask of all languages that
contain it at once.  A text's counts per language are popcounts of these masks;
they are corrected for the filters' false positives,

    found_L = (hits_L - n * f_L) / (1 - f_L),     f_L = (set bits_L / rows)^k,

and divided by the share of its own n-grams that a language's filter holds.  The
largest share decides.

A language's filter holds its most frequent n-grams, as many as make up
``COVER`` of all occurrences in its training texts.  N-grams are bytes of the
text with A-Z and the Latin-1 capitals lower-cased and everything but letters a
space; those with two spaces in a row are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import map_batches, saved, texts_of

SIZES = (3, 4)
COVER = 0.9
ROWS_LOG2 = 18
HASHES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Training texts of a language: all, or about this many chosen by a hash of their id.
SAMPLE = 2000
#: Languages and their counts travel with the tasks up to this many, beyond they are joined.
BROADCAST_LANGUAGES = 100_000

LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
ASCII_LETTER = re.compile(rb"[A-Za-z]")
CHUNK = 1 << 20


def has_letter(text: bytes) -> bool:
    return ASCII_LETTER.search(text) is not None or (not text.isascii() and any(map(str.isalpha, text.decode())))


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all texts, a space around each, and where each starts (with its space)."""
    buffer = np.frombuffer((b" " + b" ".join(texts) + b"    ").translate(LETTERS), dtype=np.uint8)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1, out=starts[1:])
    capital = (buffer[:-1] == 0xC3) & (buffer[1:] >= 0x80) & (buffer[1:] <= 0x9E) & (buffer[1:] != 0x97)
    if capital.any():
        buffer = buffer.copy()
        buffer[1:][capital] += 0x20
    return buffer, starts


def _grams(buffer: np.ndarray, first: int, last: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams that start in [first, last), and which of them count."""
    part = buffer[first : last + size - 1].astype(np.uint64)
    n = len(part) - size + 1
    code = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        code = (code << np.uint64(8)) | part[i : i + n]
    space = part == 32
    double = space[:-1] & space[1:]
    valid = np.ones(n, dtype=bool)
    for i in range(size - 1):
        valid &= ~double[i : i + n]
    return code, valid


def _pieces(starts: np.ndarray):
    """(first, last, documents) of pieces of the buffer, each of bounded size whatever the texts' lengths."""
    end = int(starts[-1])
    for first in range(0, end, CHUNK):
        last = min(first + CHUNK, end)
        yield first, last, range(int(np.searchsorted(starts, first, side="right")) - 1, int(np.searchsorted(starts, last, side="left")))


@dataclass
class Model:
    languages: list[str]
    planes: np.ndarray  # (ceil(languages / 8), rows) bytes
    false: np.ndarray  # false positive rate of each language
    cover: np.ndarray  # share of a language's own n-grams that its filter holds
    usual: int  # the most frequent language

    def shares(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): corrected share of the text's n-grams that each language contains."""
        n_lang, n_planes = len(self.languages), len(self.planes)
        hits = np.zeros((len(texts), n_planes * 8))
        total = np.zeros(len(texts))
        buffer, starts = _joined(texts)
        bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
        for size in SIZES:
            for first, last, docs in _pieces(starts):
                code, valid = _grams(buffer, first, last, size)
                rows = [(code * np.uint64(h)) >> np.uint64(64 - ROWS_LOG2) for h in HASHES]
                masks = []
                for plane in self.planes:
                    m = plane[rows[0]]
                    for r in rows[1:]:
                        m &= plane[r]
                    m[~valid] = 0
                    masks.append(m)
                for d in docs:
                    a, b = max(int(starts[d]), first) - first, min(int(starts[d + 1]), last) - first
                    total[d] += np.count_nonzero(valid[a:b])
                    for p, m in enumerate(masks):
                        hits[d, 8 * p : 8 * p + 8] += np.bincount(m[a:b], minlength=256) @ bits
        n = np.maximum(total, 1)[:, None]
        found = (hits[:, :n_lang] - n * self.false) / (1 - self.false)
        return np.clip(found / n / self.cover, 0, None)

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and best share of each text."""
        share = self.shares([t or b"" for t in texts])
        best = share.argmax(axis=1)
        top = share[np.arange(len(texts)), best]
        score = np.divide(top, share.sum(axis=1), out=np.zeros(len(texts)), where=top > 0)
        best[top <= 0] = self.usual
        lettered = [t is not None and has_letter(t) for t in texts]
        names = [self.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
        score[~np.array(lettered, dtype=bool)] = 0
        return names, score, np.minimum(top, 1)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def _filter(gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """(one byte a row of a language's Bloom filter, share of its n-grams that the filter holds)."""
    order, kept = np.lexsort((gram, -n)), []
    for s in SIZES:  # each length to the same share of its own occurrences; the code begins with the length
        of = order[(gram[order] >> np.uint64(8 * s)) == s]
        upto = np.searchsorted(np.cumsum(n[of]), COVER * n[of].sum()) + 1
        kept.append(of[:upto])
    kept = np.concatenate(kept)
    plane = np.zeros(1 << ROWS_LOG2, dtype=np.uint8)
    for h in HASHES:
        plane[(gram[kept] * np.uint64(h)) >> np.uint64(64 - ROWS_LOG2)] = 1
    return plane, float(n[kept].sum() / n.sum())


def fit(docs: DataFrame, id_col: str = "doc_id", sample: int = SAMPLE) -> Model | None:
    """Filters learned from text and non-null ``lang`` of the rows that are not held out; None without any.

    Every value of ``lang`` that has a text with an n-gram is learned.  N-grams are counted and filters made in the tasks, one
    language's at a time; 32 kB a language come to the driver.
    """
    rows = docs.select(id_col, "lang", "text").filter(F.col("lang").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    sizes = saved(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")))
    n_lang, spread = sizes.count(), 1 << 30
    if not n_lang:
        return None
    bound = F.least(F.lit(spread), F.floor(F.lit(spread * sample) / F.col("rows")))
    known = rows.join(F.broadcast(sizes) if n_lang <= BROADCAST_LANGUAGES else sizes, "lang")
    chosen = known.filter(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(3)), F.lit(spread)) < bound).filter("text is not null")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        by: dict[str, list[bytes]] = {}
        for lang, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            by.setdefault(lang, []).append(t)
        langs, grams, n = [], [], []
        for lang, texts in by.items():
            buffer, starts = _joined(texts)
            for size in SIZES:
                for first, last, _ in _pieces(starts):
                    code, valid = _grams(buffer, first, last, size)
                    code, count = np.unique(code[valid], return_counts=True)
                    langs.append(pa.repeat(pa.scalar(lang), len(code)))
                    grams.append(code.astype(np.int64))
                    n.append(count)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(langs), pa.array(np.concatenate(grams)), pa.array(np.concatenate(n).astype(np.int64))], names=["lang", "gram", "n"])

    def learn(table: pa.Table) -> pa.Table:
        plane, cover = _filter(table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy())
        return pa.table({"lang": table.column("lang")[:1], "plane": pa.array([np.packbits(plane).tobytes()], pa.binary()), "cover": [cover]})

    counts = map_batches(chosen.select("lang", "text"), run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    filters = counts.groupBy("lang").applyInArrow(learn, "lang string, plane binary, cover double").join(sizes, "lang")
    found = sorted(filters.collect(), key=lambda r: r.lang)
    if not found:
        return None
    planes = np.zeros(((len(found) + 7) // 8, 1 << ROWS_LOG2), dtype=np.uint8)
    false, cover = np.zeros(len(found)), np.array([r.cover for r in found])
    for i, r in enumerate(found):
        plane = np.unpackbits(np.frombuffer(r.plane, dtype=np.uint8))
        planes[i // 8] |= plane << np.uint8(i % 8)
        false[i] = (np.count_nonzero(plane) / (1 << ROWS_LOG2)) ** len(HASHES)
    usual = max(range(len(found)), key=lambda i: (found[i].rows, -i))
    return Model([r.lang for r in found], planes, false, cover, usual)


def identify(docs: DataFrame, id_col: str = "doc_id", model: Model | None = None, sample: int = SAMPLE) -> DataFrame:
    """(id_col, held_out, lang_pred, score, share) for every row.

    ``share`` is the corrected share of the text's n-grams that the chosen
    language contains, ``score`` that share among those of all languages.  Null
    texts and texts without a letter get ``und`` and 0; a text with letters but
    without any known n-gram gets the most frequent language and 0; without
    training rows all get ``und``.  A null id is not held out.  Repeated rows
    stay repeated; other columns are ignored; ties go to the first language by
    name.
    """
    model = model or fit(docs, id_col, sample)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column(2))
        names, score, share = model.predict(texts) if model else (["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score), pa.array(share)], names=[id_col, "held_out", "lang_pred", "score", "share"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, held_out(id_col).alias("held_out"), "text"), run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, share double")


#: A text of which a smaller share of n-grams belongs to the chosen language is in none of them.
MIN_SHARE = 0.1


def keep_identified(docs: DataFrame, id_col: str = "doc_id", min_share: float = MIN_SHARE, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` with a text in some learned language; same columns.

    Rows without text or letters and rows of which less than ``min_share`` of
    the n-grams belongs to any language are rejected.  A null ``lang`` is filled
    with the predicted one.  Where no row is labelled, nothing speaks against a
    text with letters and all of these stay.
    """
    model = fit(docs, id_col, sample)
    names = docs.columns
    at, lang = names.index("text"), names.index("lang")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column(at))
        if model is None:
            return batch.filter(pa.array([t is not None and has_letter(t) for t in texts], pa.bool_()))
        pred, _, share = model.predict(texts)
        known = batch.column(lang).to_pylist()
        filled = pa.array([k if k is not None else p for k, p in zip(known, pred, strict=True)], batch.schema.field(lang).type)
        keep = [p != "und" and s >= min_share for p, s in zip(pred, share, strict=True)]
        return batch.set_column(lang, batch.schema.field(lang), filled).filter(pa.array(keep, pa.bool_()))

    return map_batches(docs, run, docs.schema)
