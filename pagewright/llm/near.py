"""Near copies: SimHash finds them, their shingle sets decide.

Two texts are linked if their sets of word shingles have a Jaccard similarity of
``NUM / DEN`` at least; links make classes.

1. Texts with equal sets are one set.  Each set has a fingerprint of ``BITS``
   bits, bit i being set in over half of its shingles' hashes.  Sets of the
   bounding similarity agree in a bit with a known probability p, which gives a
   radius that such pairs all but never pass.
2. Fingerprints meet in tables: the key of a table is some of the bits.  With n
   sets, b bits leave about ``COMPARE`` sets in a bucket, and so many tables are
   made that a pair of the bounding similarity shares a bucket with probability
   ``RECALL``; nearer pairs, and classes with several links, are missed far more
   rarely.  b and the number of tables follow n by one rule at every size.
   Buckets are compared by the bit-sliced counters of ``simhash``; only stars,
   not pairs, leave them.
3. Sets joined so far are loose classes, mostly none.  Only for these the texts
   are read again and their whole sets brought together, large classes as pairs
   of chunks of bounded size.  There the bit-sliced comparison lists the pairs
   within the radius; a pair already in one class is passed over, a sketch that
   bounds the difference of the sets from below ends most others, and what is
   left is decided on the sets.  A bucket gives a forest of verified links.

No link that is kept has a similarity under the bound, but for collisions of
64-bit hashes.
"""

from __future__ import annotations

from math import acos, ceil, log, log2, pi, sqrt
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from pagewright.llm.common import map_batches, saved, space_words, texts_of
from pagewright.llm.components import FILES, ROWS_A_FILE, connected_components
from pagewright.llm.simhash import BUCKET_ROWS, SEED, deal, pairs_within, settled, shingle_digests, star_links

NUM, DEN = 4, 5
WORDS_64 = 2
BITS = 64 * WORDS_64
RECALL, COMPARE = 0.99, 512
#: A chunk of a loose class: so many sets, of so many shingles on average.
CHUNK_ROWS, CHUNK_SHINGLES = 2048, 1024
#: Whole sets are kept in files of about so many.
SETS_A_FILE = 4096
#: Texts of loose classes are found by a broadcast of their hashes up to this many.
BROADCAST_HASHES = 500_000

#: Probability that sets of the bounding similarity agree in a bit: their angle over pi.
AGREE = 1 - acos(2 * NUM / (NUM + DEN)) / pi
RADIUS = int(BITS * (1 - AGREE) + 3.7 * sqrt(BITS * AGREE * (1 - AGREE)))


def shingle_set(text: bytes | None, words: int = 5) -> np.ndarray:
    """Ascending 64-bit hashes of the text's shingles, each once; a text of fewer words is one shingle."""
    w = space_words(text) if text else ()
    return np.unique(np.frombuffer(shingle_digests(w, words), dtype=">u8").astype(np.uint64)) if w else np.empty(0, np.uint64)


def set_name(s: np.ndarray) -> int:
    """Signed 64-bit name of a set; 0 of the empty one."""
    x = xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0
    return x - (1 << 64) if x >> 63 else x


def _mixed(x: np.ndarray) -> np.ndarray:
    """Other 64-bit hashes for the same shingles: the finisher of a splittable random generator."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def set_fingerprint(s: np.ndarray) -> np.ndarray:
    """``WORDS_64`` signed words: bit i is set in over half of the shingles' hashes."""
    out, h = np.zeros(WORDS_64, dtype=np.int64), s
    for k in range(WORDS_64 if len(s) else 0):
        h = _mixed(h) if k else h
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(h), 65536):
            ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
        out[k] = np.packbits(2 * ones > len(s)).view(np.int64)[0]
    return out


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending sets reach the similarity."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return (NUM + DEN) * shared >= NUM * (len(a) + len(b))


def tables_for(n: int, recall: float = RECALL, compare: int = COMPARE) -> tuple[int, int]:
    """(bits of a key, number of tables) for n sets."""
    bits = max(0, ceil(log2(max(1, n) / compare)))
    return bits, max(1, ceil(log(1 - recall) / log(1 - AGREE**bits))) if bits else 1


def _table_keys(bits: int, tables: int) -> list:
    """Column expressions of the tables' keys over the fingerprint's words; the choice of bits is fixed."""
    rng, out = Random(SEED), []
    for t in range(tables):
        mask = sum(1 << i for i in rng.sample(range(BITS), bits))
        parts = [(mask >> 64 * k) & ((1 << 64) - 1) for k in range(WORDS_64)]
        out.append(F.xxhash64(F.lit(t), *(F.col(f"w{k}").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for k, m in enumerate(parts))))
    return out


class Sketches:
    """Parities of the shingles by hash, four bits a shingle: two sketches differ in no more bits than the sets in shingles.

    Sketches are powers of two long, and a longer one is folded to a shorter one's length.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.bits = np.array([1 << max(6, (4 * len(s) - 1).bit_length()) for s in sets], dtype=np.int64)
        self.rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for bits in np.unique(self.bits).tolist():
            own = np.flatnonzero((self.bits == bits) | (self.bits == 2 * bits))
            at = np.zeros(len(sets), dtype=np.int64)
            at[own] = np.arange(len(own))
            table = np.empty((len(own), bits // 64), dtype=np.uint64)
            for k, i in enumerate(own.tolist()):
                odd = np.bincount((sets[i] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
                table[k] = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)
            self.rows[bits] = (at, table)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits in which the sketches of rows a and b differ; their sizes are within the bound."""
        out = np.zeros(len(a), dtype=np.int64)
        length = np.minimum(self.bits[a], self.bits[b])
        for bits in np.unique(length).tolist():
            at, table = self.rows[bits]
            these = np.flatnonzero(length == bits)
            step = max(1, (1 << 22) // table.shape[1])
            for k in range(0, len(these), step):
                some = these[k : k + step]
                out[some] = np.bitwise_count(table[at[a[some]]] ^ table[at[b[some]]]).sum(axis=1, dtype=np.int64)
        return out


def forest(key: np.ndarray, name: np.ndarray, words: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Verified links (name, name) that join the rows of each bucket as all verified links within the radius would."""
    label, n = np.arange(len(key)), np.array([len(s) for s in sets], dtype=np.int64)
    sketches, out = Sketches(sets), []

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = x = label[label[x]]
        return x

    for a, b in pairs_within(key, words, RADIUS):
        small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        some = (label[a] != label[b]) & (DEN * small >= NUM * large)
        a, b, both = a[some], b[some], (small + large)[some]
        some = sketches.apart(a, b) <= both - 2 * -(-NUM * both // (NUM + DEN))
        for x, y in zip(a[some].tolist(), b[some].tolist(), strict=True):
            p, q = root(x), root(y)
            if p != q and linked(sets[x], sets[y]):
                label[max(p, q)] = min(p, q)
                out.append((int(name[x]), int(name[y])))
        while not np.array_equal(up := label[label], label):
            label = up
    return out


def _verified(members: DataFrame, chunk_rows: int) -> DataFrame:
    """(a, b): verified links of the loose classes, ``members`` (key, name, n, words, set)."""
    words = [f"w{k}" for k in range(WORDS_64)]

    def links(t: pa.Table) -> pa.RecordBatch:
        key, name, *w = (c.to_numpy() for c in t.columns[:-1])
        found = forest(key, name, np.stack(w, axis=1).view(np.uint64), [np.frombuffer(x, np.uint64) for x in t.columns[-1].to_pylist()])
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            key = held.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last bucket may go on
            if cut:
                yield links(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield links(held)

    weight = F.lit(1) + F.floor(F.col("n") / CHUNK_SHINGLES)
    rows = deal(members, chunk_rows, "name", weight).select("key", "name", *words, "set")
    return rows.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint").distinct()


def _described(docs: DataFrame, id_col: str, words: int) -> DataFrame:
    """(id_col, row, h, name, words) of every row: hashes of row and text, the set's name and fingerprint."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, prints = [], []
        for t in texts_of(batch.column(3)):
            s = shingle_set(t, words)
            names.append(set_name(s)), prints.append(set_fingerprint(s))
        prints = np.array(prints, dtype=np.int64).reshape(-1, WORDS_64)
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(names, pa.int64()), *(pa.array(prints[:, k]) for k in range(WORDS_64))], names=[id_col, "row", "h", "name", *(f"w{k}" for k in range(WORDS_64))])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, F.xxhash64(id_col, "text").alias("row"), F.xxhash64("text").alias("h"), "text")
    return map_batches(rows, run, f"`{id_col}` {kind}, row bigint, h bigint, name bigint" + "".join(f", w{k} bigint" for k in range(WORDS_64)))


def _members(docs: DataFrame, sets: DataFrame, roots: DataFrame, n: int, words: int) -> DataFrame:
    """(key, name, n, words, set) of the ``n`` sets in loose classes, from one text of each."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_set(t, words) for t in texts_of(batch.column(0))]
        prints = np.array([set_fingerprint(s) for s in found], dtype=np.int64).reshape(-1, WORDS_64)
        columns = [pa.array([set_name(s) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int64()), *(pa.array(prints[:, k]) for k in range(WORDS_64)), pa.array([s.tobytes() for s in found], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["name", "n", *(f"w{k}" for k in range(WORDS_64)), "set"])

    need = saved(sets.join(roots, sets["name"] == roots["node"]).select("h").distinct().coalesce(max(FILES, n // ROWS_A_FILE)))
    need = F.broadcast(need) if need.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES else need
    texts = docs.select("text", F.xxhash64("text").alias("h")).join(need, "h", "left_semi").select("text")
    whole = map_batches(texts, run, "name bigint, n bigint" + "".join(f", w{k} bigint" for k in range(WORDS_64)) + ", set binary").dropDuplicates(["name"])
    return whole.join(roots.select(F.col("node").alias("name"), F.col("root").alias("key")), "name")


def set_links(docs: DataFrame, sets: DataFrame, words: int = 5, bucket_rows: int = BUCKET_ROWS, chunk_rows: int = CHUNK_ROWS, recall: float = RECALL, compare: int = COMPARE) -> DataFrame:
    """(a, b): verified links between the names of ``sets`` (name, h, words), whose texts are in ``docs``."""
    prints = [f"w{k}" for k in range(WORDS_64)]
    keys = _table_keys(*tables_for(sets.count(), recall, compare))
    rows = deal(sets.select("name", *prints, F.explode(F.array(*keys)).alias("key")), bucket_rows, "name")
    roots = connected_components(star_links(rows.select("key", "name", *prints), RADIUS))
    n = roots.count()
    # loose classes are mostly few: no thousands of empty files for them
    members = saved(_members(docs, sets, roots, n, words).coalesce(max(FILES, n // SETS_A_FILE)))
    return saved(_verified(members, chunk_rows).coalesce(max(FILES, n // ROWS_A_FILE)))


def _settled(docs: DataFrame, id_col: str, words: int, bounds: dict) -> tuple[DataFrame, DataFrame]:
    """(id_col, name) of every row; (fp, component) of every set, the component being the class's first (nil, id, row)."""
    full = saved(_described(docs, id_col, words))
    first = F.min(F.struct(F.col(id_col).isNull().alias("nil"), F.col(id_col).alias("id"), "row")).alias("least")
    sets = saved(full.groupBy("name").agg(first, F.min("h").alias("h"), *(F.first(f"w{k}").alias(f"w{k}") for k in range(WORDS_64))))
    return full.select(id_col, "name"), settled(sets.select(F.col("name").alias("fp"), "least"), set_links(docs, sets, words, **bounds))


def near_copies(docs: DataFrame, id_col: str = "doc_id", words: int = 5, **bounds) -> DataFrame:
    """(id_col, fp, component_id): the class of every row of ``docs``.

    ``fp`` names the row's shingle set; ``component_id`` is the least id among
    all rows linked with this one, directly or through others.  Null, empty and
    wordless texts have the empty set and are one class; repeated rows stay
    repeated; a class without any id has a null ``component_id``; an empty table
    gives an empty result.  Other columns of ``docs`` are ignored.
    """
    each, classes = _settled(docs.select(id_col, "text"), id_col, words, bounds)
    return each.withColumnRenamed("name", "fp").join(classes, "fp").select(id_col, "fp", F.col("component.id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", words: int = 5, **bounds) -> DataFrame:
    """One row of ``docs`` for each class, with all its columns: that of the least id, rows without id last.

    Of several texts with that id one stays, always the same; of rows with equal id and text one stays.  An empty table stays empty.
    """
    _, classes = _settled(docs.select(id_col, "text"), id_col, words, bounds)
    chosen = classes.select(F.col("component.row").alias("__row")).distinct()
    # repeats go before the shuffle, and the join needs no other one
    rows = docs.withColumn("__row", F.xxhash64(id_col, "text")).dropDuplicates(["__row"])
    return rows.join(chosen, "__row", "left_semi").drop("__row")
