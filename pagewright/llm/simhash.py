"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint has bit i set if over half of the text's shingle hashes have it.
Texts whose fingerprints differ in at most ``radius`` bits are linked; links
make components.

Only distinct fingerprints are compared.  ``radius + s`` slices of the 64 bits
leave at least s slices untouched by ``radius`` changes, so two linked
fingerprints agree on some s slices: each choice of s slices is a table whose
key is those bits.  Members of a bucket are compared by bit planes: 64
fingerprints make one block of 64 words, word b holding bit b of all of them;
the distances from one fingerprint to a block are kept in carry-save counters,
64 distances to a word, and a block is given up as soon as every distance in it
is over the radius.  A bucket of more than ``bucket_rows`` is dealt into chunks
and each pair of chunks is a task of bounded size.  The choice of s follows the
number of fingerprints; it changes the cost and never the links.
"""

from __future__ import annotations

from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from pagewright.llm.common import map_batches, saved, space_words, texts_of
from pagewright.llm.components import FILES, ROWS_A_FILE, connected_components

SEED = 42
BUCKET_ROWS = 4096
SALTS = 64
#: Keys of hot buckets are broadcast up to this many.
BROADCAST_KEYS = 50_000


def shingle_digests(w: list[bytes], words: int) -> bytes:
    """Eight bytes for each shingle; fewer words than a shingle has are one."""
    if len(w) <= words:
        return xxh64_digest(b" ".join(w), SEED)
    return b"".join(map(xxh64_digest, map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)), repeat(SEED)))


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """Signed 64-bit fingerprint of a text; 0 if it has no word."""
    w = space_words(text) if text else ()
    if not w:
        return 0
    rows = np.frombuffer(shingle_digests(w, words), dtype=np.uint8).reshape(-1, 8)
    n, ones = len(rows), np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65536):
        ones += np.unpackbits(rows[at : at + 65536], axis=1).sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", words: int = 3) -> DataFrame:
    """(id_col, fp) for every row; null and wordless texts get 0."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((fingerprint(t, words) for t in texts_of(batch.column(1))), dtype=np.int64, count=batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, "text"), run, f"`{id_col}` {kind}, fp bigint")


def slices_for(n: int, radius: int) -> int:
    """Number of slices that makes tables and comparisons cheapest for n fingerprints."""

    def cost(k: int) -> float:
        # a row in a table costs about as much as a dozen comparisons with a block
        return comb(k, radius) * (12 + n / 2.0 ** (64 * (k - radius) / k) / 64)

    return min(range(radius + 1, radius + 6), key=cost)


def _masks(radius: int, slices: int) -> list[int]:
    cuts = [64 * i // slices for i in range(slices + 1)]
    parts = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(slices)]
    return [sum(c) for c in combinations(parts, slices - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pairs_within(keys: np.ndarray, fps: np.ndarray, radius: int):
    """Yields (rows, rows): every pair of rows of one group within ``radius`` bits, each once.

    ``keys`` is sorted; a group is a run of equal keys.  ``fps`` holds one word of 64 bits a row, or a row of several.
    """
    n, words = len(fps), fps.reshape(len(fps), -1)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if n else np.empty(0, np.int64)
    sizes = np.diff(np.r_[starts, n])
    starts, sizes = starts[sizes > 1], sizes[sizes > 1]
    if not len(starts):
        return
    # groups of one are gone; the others lie in blocks of 64 lanes
    members = np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
    rank = members - np.repeat(starts, sizes)
    n_blocks = (sizes + 63) // 64
    base = np.repeat(np.r_[0, np.cumsum(n_blocks)[:-1]], sizes)
    block, lane = base + rank // 64, rank % 64
    total = int(n_blocks.sum())
    row_at = np.full((total, 64), -1, dtype=np.int64)
    row_at[block, lane] = members
    valid = np.packbits(row_at >= 0, axis=1, bitorder="little").view(np.uint64).ravel()
    planes = np.empty((64 * words.shape[1], total), dtype=np.uint64)
    for k in range(words.shape[1]):
        lanes = np.zeros((total, 64), dtype=np.uint64)
        lanes[block, lane] = words[members, k]
        for at in range(0, total, 512):
            bits = np.unpackbits(lanes[at : at + 512].view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
            planes[64 * k : 64 * k + 64, at : at + 512] = np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view(np.uint64)[:, :, 0]
    # one item: a row against a block of its group, from its own block on
    per = np.repeat(n_blocks, sizes) - rank // 64
    ends = np.cumsum(per)
    first = 0
    while first < len(members):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + 65536, side="right")))
        cnt = per[first:last]
        who = np.repeat(np.arange(first, last), cnt)
        at = block[who] + np.arange(len(who)) - np.repeat(np.cumsum(cnt) - cnt, cnt)
        a, b = _within(planes, valid, words[members[who]], at, who, block, lane, radius)
        yield members[a], row_at.ravel()[b]
        first = last


def link_groups(keys: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """Label of each row: the least row index that its links inside its group reach."""
    label = np.arange(len(fps))
    for a, b in pairs_within(keys, fps, radius):
        _unite(label, a, b)
    return label


def _within(planes, valid, fp, at, who, block, lane, radius):
    """(row number, flat lane) of every pair within the radius; own and earlier lanes left out."""
    width = max(1, radius.bit_length())
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    own = at == block[who]
    dead = ~valid[at]
    dead[own] |= (np.uint64(2) << lane[who[own]].astype(np.uint64)) - np.uint64(1)
    count = [np.zeros(len(at), dtype=np.uint64) for _ in range(width)]

    def add(word, place):
        for i in range(place, width):
            count[i], word = count[i] ^ word, count[i] & word
        np.bitwise_or(dead, word, out=dead)

    def differ(i):
        return planes[i][at] ^ (np.uint64(0) - ((fp[:, i >> 6] >> np.uint64(i & 63)) & np.uint64(1)))

    for i in range(0, len(planes), 3):
        if i + 2 >= len(planes):
            for j in range(i, len(planes)):
                add(differ(j), 0)
        else:  # a full adder makes one word of weight 1 and one of weight 2 from three planes
            x, y, z = differ(i), differ(i + 1), differ(i + 2)
            xy = x ^ y
            add(xy ^ z, 0)
            if width > 1:
                add((x & y) | (xy & z), 1)
            else:
                dead |= (x & y) | (xy & z)
        if i % 12 == 9 and i > radius:
            live = dead != full
            if not live.all():
                at, fp, who, dead = at[live], fp[live], who[live], dead[live]
                count = [c[live] for c in count]
                if not len(at):
                    break
    over, equal = np.zeros_like(dead), np.full_like(dead, full)
    for i in reversed(range(width)):
        if radius >> i & 1:
            equal &= count[i]
        else:
            over |= equal & count[i]
            equal &= ~count[i]
    good = ~(dead | over)
    some = good != 0
    hit, bit = np.nonzero(np.unpackbits(good[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return who[some][hit], at[some][hit] * 64 + bit


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges the labels of linked rows, in place; labels stay roots of themselves."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def deal(rows: DataFrame, bucket_rows: int = BUCKET_ROWS, node: str = "fp", weight=None) -> DataFrame:
    """``rows`` (node, key, ...) with the keys of buckets of over ``bucket_rows`` rows, or more in weight, replaced by those of pairs of chunks, so that each two rows of a bucket still meet."""
    # buckets over the bound are few, mostly none; their rows go to every pair of chunks that holds their own
    hot = saved(rows.groupBy("key").agg(F.sum(F.lit(1) if weight is None else weight).alias("count")).filter(F.col("count") > bucket_rows).select("key", F.ceil(F.col("count") / bucket_rows).cast("int").alias("chunks")).coalesce(FILES))
    n_hot = hot.limit(BROADCAST_KEYS + 1).count()
    if n_hot:
        own = F.pmod(F.xxhash64(node, F.lit(7)), F.col("chunks"))
        pairs = F.transform(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1), lambda c: F.xxhash64("key", F.least(own, c), F.greatest(own, c)))
        if n_hot <= BROADCAST_KEYS:
            marked = rows.join(F.broadcast(hot), "key", "left")
        else:  # a hot key's rows meet it in SALTS parts
            parts = hot.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            marked = rows.withColumn("__salt", F.pmod(F.xxhash64(node, F.lit(17)), F.lit(SALTS)).cast("int")).join(parts, ["key", "__salt"], "left").drop("__salt")
        rows = marked.select(*(c for c in rows.columns if c != "key"), F.explode(F.when(F.col("chunks").isNull(), F.array("key")).otherwise(pairs)).alias("key"))
    return rows


def star_links(rows: DataFrame, radius: int) -> DataFrame:
    """(a, b): in each bucket of ``rows`` (key, node, word, ...), a star over every set of nodes that links within ``radius`` bits join."""

    def run(batches):
        kept: list[np.ndarray] = []

        def stars(key, node, *words):
            label = link_groups(key, np.stack(words, axis=1).view(np.uint64), radius)
            moved = node[label] != node
            if moved.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label][moved])], names=["a", "b"])

        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            kept = [np.concatenate(x) for x in zip(kept, new, strict=True)] if kept else new
            cut = int(np.searchsorted(kept[0], kept[0][-1])) if len(kept[0]) else 0  # the last bucket may go on
            if cut:
                yield from stars(*(x[:cut] for x in kept))
                kept = [x[cut:] for x in kept]
        if kept:
            yield from stars(*kept)

    return rows.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint").distinct()


def link(fps: DataFrame, radius: int = 3, bucket_rows: int = BUCKET_ROWS, slices: int | None = None) -> DataFrame:
    """(a, b): links that join the distinct fingerprints of ``fps`` as all links would."""
    slices = slices or slices_for(fps.count(), radius)
    tables = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(_masks(radius, slices))]
    rows = deal(fps.select("fp", F.explode(F.array(*tables)).alias("key")), bucket_rows)
    return star_links(rows.select("key", "fp", F.col("fp").alias("word")), radius)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", words: int = 3, radius: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id_col, fp, component_id): the class of every row of ``docs``.

    ``component_id`` is the least id among all rows linked with this one,
    directly or through others.  Null, empty and wordless texts have fingerprint
    0 and are linked like any other; copies share a fingerprint and so a class;
    repeated rows stay repeated; an empty table gives an empty result.  Other
    columns of ``docs`` are ignored.
    """
    each = saved(fingerprints(docs, id_col, words))
    least = saved(each.groupBy("fp").agg(F.min(id_col).alias("least")))
    return classes_of(each, least, link(least.select("fp"), radius, bucket_rows), id_col)


def classes_of(each: DataFrame, least: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    """(id_col, fp, component_id) of ``each`` (id_col, fp), by the least ids (fp, least) and the links (a, b) of fingerprints."""
    return each.join(settled(least, links), "fp").select(id_col, "fp", F.col("component").alias("component_id"))


def settled(least: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, component): the least of the values ``least`` (fp, least) in each fingerprint's class."""
    roots = connected_components(links)
    # a class may hold very many fingerprints: its rows meet their least id in SALTS parts
    linked = least.join(roots, F.col("fp") == F.col("node")).select("fp", "least", "root", F.pmod(F.xxhash64("fp", F.lit(13)), F.lit(SALTS)).cast("int").alias("salt"))
    linked = saved(linked.coalesce(max(FILES, roots.count() // ROWS_A_FILE)))
    smallest = linked.groupBy("root").agg(F.min("least").alias("component")).select("root", "component", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = linked.join(smallest, ["root", "salt"]).select("fp", "component")
    # fingerprints without a link are their own class
    return least.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component")).unionByName(joined)
