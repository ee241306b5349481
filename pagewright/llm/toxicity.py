"""Toxicity by cumulative-link ordinal regression.

Severity grades 0 < 1 < ... < K - 1 share one weight vector; only the thresholds
differ:

    P(grade > k) = sigmoid(w . x - theta_k),     theta_0 < theta_1 < ...

x is sparse: for each known word or word beginning, 1 + ln(occurrences).  The result is the
expected severity, sum over k of P(grade > k).

Learned from a bounded sample of labelled rows (``SAMPLE``, chosen by a hash of
the id).  The words are the ``WORDS`` that tell the labels apart best in the
sample: ``MIN_GAIN`` standard errors between the shares of toxic and other rows
that hold them, and shares that differ ``MIN_ODDS`` times at least.  Labels say toxic or not; grades are made from them: 0 if not toxic, else
1 to ``GRADES`` - 1 by how often the text uses words typical of toxic rows, cut
at equal shares of the toxic rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import alnum_words, bound_batches, map_batches, saved, texts_of

SAMPLE = 20_000
WORDS = 1024
MIN_GAIN = 3.0
MIN_ODDS = 3.0
GRADES = 4
#: Lengths of word beginnings, in bytes.
STEMS = (4, 5, 6, 7, 8)
L2 = 2.0
ROUNDS = 400


def _sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * z))


@dataclass
class Ordinal:
    """A fitted cumulative-link model over numbered sparse features."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """(rows, K - 1): P(grade > k)."""
        return _sigmoid(np.asarray(score)[:, None] - self.thresholds)

    def expected(self, score: np.ndarray) -> np.ndarray:
        return self.above(score).sum(axis=1)


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, grades: np.ndarray, n_cols: int, l2: float = L2, rounds: int = ROUNDS) -> Ordinal:
    """Maximum likelihood with an L2 penalty, by accelerated gradient steps of adaptive size.

    (rows, cols, vals) is the sparse matrix.  Thresholds are theta_0 and
    logarithms of the gaps, so they stay in order.
    """
    n, k = len(grades), int(grades.max()) + 1
    w, t = np.zeros(n_cols), np.zeros(k - 1)
    share = np.array([(grades > j).mean() for j in range(k - 1)]).clip(1e-6, 1 - 1e-6)
    start = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(k - 1))
    t[0], t[1:] = start[0], np.log(np.maximum(np.diff(start), 1e-3))
    moment, square = np.zeros(n_cols + k - 1), np.zeros(n_cols + k - 1)
    low, high = grades - 1, grades  # P(grade) = above(low) - above(high)
    for step in range(1, rounds + 1):
        theta = np.r_[t[0], t[0] + np.cumsum(np.exp(t[1:]))]
        z = np.bincount(rows, weights=vals * w[cols], minlength=n)
        p = np.c_[np.ones(n), _sigmoid(z[:, None] - theta), np.zeros(n)]  # above(-1) = 1, above(K - 1) = 0
        at = np.arange(n)
        up, down = p[at, low + 1], p[at, high + 1]
        like = np.maximum(up - down, 1e-12)
        d_up, d_down = up * (1 - up) / like, down * (1 - down) / like
        slope = d_up - d_down  # of the log likelihood by z
        g_w = np.bincount(cols, weights=vals * slope[rows], minlength=n_cols) - l2 * w
        g_theta = np.bincount(high[high < k - 1], weights=d_down[high < k - 1], minlength=k - 1) - np.bincount(low[low >= 0], weights=d_up[low >= 0], minlength=k - 1)
        later = np.cumsum(g_theta[::-1])[::-1]
        g = np.r_[g_w, later[0], later[1:] * np.exp(t[1:])] / n
        moment = 0.9 * moment + 0.1 * g
        square = 0.99 * square + 0.01 * g * g
        move = 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8) * min(1.0, 4 * (1 - step / (rounds + 1)))
        w += move[:n_cols]
        t += move[n_cols:]
    return Ordinal(w, np.r_[t[0], t[0] + np.cumsum(np.exp(t[1:]))])


def features(text: bytes) -> Counter:
    """Occurrences of each word, and of each beginning of longer words (ending in ``*``)."""
    out = Counter(alnum_words(text))
    for w, c in list(out.items()):
        for n in STEMS:
            if len(w) <= n:
                break
            out[w[:n] + b"*"] += c
    return out


@dataclass
class Model:
    words: dict[bytes, int]
    ordinal: Ordinal

    def __post_init__(self):
        self.whole = frozenset(w for w in self.words if not w.endswith(b"*"))
        self.stems = {n: frozenset(w[:-1] for w in self.words if w.endswith(b"*") and len(w) == n + 1) for n in STEMS}

    def known(self, text: bytes) -> Counter:
        """``features`` of the text that the model has."""
        words = alnum_words(text)
        distinct = set(words)
        keep = self.whole & distinct
        stems = [(n, s, {w for w in distinct if w[:n] in s and len(w) > n}) for n, s in self.stems.items() if s]
        wanted = keep.union(*(w for _, _, w in stems))
        out: Counter = Counter()
        for w, c in Counter(filter(wanted.__contains__, words)).items() if wanted else ():
            if w in keep:
                out[w] += c
            for n, _, own in stems:
                if w in own:
                    out[w[:n] + b"*"] += c
        return out

    def score(self, text: bytes | None) -> float:
        """w . x of a text."""
        if not text:
            return 0.0
        w = self.ordinal.weights
        return float(sum(w[self.words[x]] * (1 + log(c)) for x, c in self.known(text).items()))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", sample: int = SAMPLE, n_words: int = WORDS, grades: int = GRADES) -> Model | None:
    """A model from the labelled rows of ``docs``; None if they hold only one class."""
    chosen = labels.select(F.col(id_col).alias("__id"), F.col("toxic").cast("int").alias("toxic")).filter("__id is not null and toxic is not null")
    # one label an id: toxic if any says so; the sample is bounded, so the tasks may hold it
    picked = {r["__id"]: int(r.toxic > 0) for r in chosen.groupBy("__id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("__id", F.lit(5)), "__id").limit(sample).collect()}
    size = [sum(v == k for v in picked.values()) for k in (0, 1)]
    if not all(size):
        return None
    # a join of bounded size: only the sample's texts reach Python, read from the corpus once; of the texts of one id, the least counts
    ids = docs.sparkSession.createDataFrame([(i,) for i in picked], f"`{id_col}` {labels.schema[id_col].dataType.simpleString()}")
    texts = saved(docs.select(id_col, "text").join(F.broadcast(ids), id_col, "left_semi").groupBy(id_col).agg(F.min("text").alias("text")))

    def count(batches):
        held: list[Counter] = [Counter(), Counter()]

        def counts():
            names = list(held[0].keys() | held[1].keys())
            out = [pa.array(names, pa.binary()), pa.array([held[1][x] for x in names], pa.int64()), pa.array([held[0][x] for x in names], pa.int64())]
            held[0].clear(), held[1].clear()
            return pa.RecordBatch.from_arrays(out, names=["word", "a", "b"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                if t and i in picked:
                    held[picked[i]].update(features(t).keys())
                    if len(held[0]) + len(held[1]) > 200_000:
                        yield counts()
        yield counts()

    bound_batches(docs.sparkSession)
    seen = texts.mapInArrow(count, "word binary, a bigint, b bigint").groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter(F.col("a") + F.col("b") >= 3)
    share_a, share_b = (F.col("a") + 0.5) / (size[1] + 1.0), (F.col("b") + 0.5) / (size[0] + 1.0)
    gain = F.abs(share_a - share_b) / F.sqrt(share_a * (1 - share_a) / (size[1] + 1.0) + share_b * (1 - share_b) / (size[0] + 1.0))
    told = seen.select("word", gain.alias("gain"), (F.log(share_a) - F.log(share_b)).alias("odds"))
    top = told.filter((F.col("gain") >= MIN_GAIN) & (F.abs("odds") >= log(MIN_ODDS))).orderBy(F.desc("gain"), "word").limit(n_words).collect()
    words = {bytes(r.word): i for i, r in enumerate(top)}
    typical = np.array([r.odds > 0 for r in top], dtype=bool)
    finder = Model(words, Ordinal(np.zeros(len(words)), np.zeros(1)))

    def matrix(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, word, n = [], [], []
        for i, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            if t and i in picked:
                for x, c in finder.known(t).items():
                    row.append(i), word.append(words[x]), n.append(c)
        return pa.RecordBatch.from_arrays([pa.array(row, batch.column(0).type), pa.array(word, pa.int32()), pa.array(n, pa.int64())], names=["id", "word", "n"])

    table = map_batches(texts, matrix, f"id {docs.schema[id_col].dataType.simpleString()}, word int, n bigint").toArrow()
    number = {i: k for k, i in enumerate(picked)}  # rows without a known word count as well
    rows = np.fromiter((number[i] for i in table.column("id").to_pylist()), dtype=np.int64, count=table.num_rows)
    cols, n = table.column("word").to_numpy().astype(np.int64), table.column("n").to_numpy().astype(np.float64)
    toxic = np.fromiter(picked.values(), dtype=np.int64, count=len(picked))
    marked = np.bincount(rows, weights=n * typical[cols], minlength=len(picked)) if len(cols) else np.zeros(len(picked))
    own = np.flatnonzero(toxic)
    cuts = np.quantile(marked[own], [i / (grades - 1) for i in range(1, grades - 1)]) if grades > 2 else np.empty(0)
    level = toxic.copy()
    level[own] = 1 + (marked[own][:, None] > cuts).sum(axis=1)
    _, level = np.unique(level, return_inverse=True)  # grades that no row has are left out
    return Model(words, fit_ordinal(rows, cols, 1 + np.log(n), level, len(words)))


def severity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", model: Model | None = None, sample: int = SAMPLE) -> DataFrame:
    """(id_col, severity, p_toxic, toxic) for every row.

    ``severity`` is the expected grade, ``p_toxic`` the probability of any grade
    over 0, ``toxic`` whether that is over one half.  Null and empty texts have
    no known word and get the base rate; without labelled rows of both classes
    all get 0 and false.  Repeated rows stay repeated; other columns are ignored;
    an empty table gives an empty result.
    """
    model = model or fit(docs, labels, id_col, sample)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if model is None:
            above = np.zeros((batch.num_rows, 1))
        else:
            above = model.ordinal.above(np.array([model.score(t) for t in texts_of(batch.column(1))]))
        p = above[:, 0]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(above.sum(axis=1)), pa.array(p), pa.array(p > 0.5)], names=[id_col, "severity", "p_toxic", "toxic"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, "text"), run, f"`{id_col}` {kind}, severity double, p_toxic double, toxic boolean")
