"""Near-duplicate texts with small edits, found through a Gray-order hierarchical index of fingerprints.

1. One pass over the whole texts computes for each its word-sequence hash (exact copies collapse to one
   representative) and 128 minimum hashes of its word shingles. Their low bits form a 128-bit fingerprint, in which
   texts of Jaccard similarity J differ in about (1 - J) / 2 of the bits.
2. The index is partitioned: a text enters one partition cell per band of minimum hashes, so texts of
   similarity J share a cell with probability 1 - (1 - J^rows)^bands. Cells with one member are dropped by a count before the
   shuffle of fingerprints. Cells over ``HOT_CELL`` members are split into blocks; every pair of blocks is its own task key.
3. Inside a cell the fingerprints are sorted by Gray rank, so neighbours share long bit patterns. Runs of sorted
   fingerprints become nodes that keep the shared pattern as a mask and a value, and runs of nodes become upper nodes.
   A query walks down from the root, adds up its differences on the masked bits, and whole nodes are pruned as soon
   as the differences exceed the bound.
4. Candidates are verified exactly on the shingle sets of their texts.

The bound on differing bits is the expected number at the threshold plus 4 standard deviations. Recall is measured
against brute force in the tests."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.runtime import cut, lookup_join, release

#: Minimum hashes per band and bands; together the bits of a fingerprint.
ROWS, BANDS = 4, 32
#: Bytes of a cell number: a shared number of different cells only means a few more candidates, which the index prunes.
CELL_BYTES = 5
#: Members of a node of the index, members of a cell from which on it is split into blocks of that size.
FAN_OUT, HOT_CELL = 8, 4000
#: Rows of sorted cells a task holds at once (about 40 bytes each, and one cell's block pair more), copies of a text paired in a task.
HELD_ROWS, COPY_BLOCK = 200_000, 2000

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_hashes(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document numbers, 64-bit shingle hashes, word-sequence hash per document) of an Arrow string array. The shingles
    are distinct per document; a text with fewer than k words has one shingle of all its words, one without words none."""
    import xxhash

    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), pattern="[^a-z0-9]+")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = pc.dictionary_encode(lists.values.slice(offsets[0], offsets[-1] - offsets[0]))
    words = np.array([0 if w == "" else xxhash.xxh64_intdigest(w) | 1 for w in coded.dictionary.to_pylist()] or [0], dtype=_U)
    h = words[coded.indices.to_numpy()] if len(coded) else np.zeros(0, _U)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keep = h != 0  # the empty pieces before the first and after the last word
    h, doc = h[keep], doc[keep]
    n_docs = len(offsets) - 1
    counts = np.bincount(doc, minlength=n_docs)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    with np.errstate(over="ignore"):
        place = (np.arange(len(h)) - starts[doc]).astype(_U)
        seq = np.zeros(n_docs, _U)
        np.add.at(seq, doc, _mix(h + place * _U(0x9E3779B97F4A7C15)))
        seq = _mix(seq + counts.astype(_U))
        g = np.zeros(len(h), _U)
        size = np.minimum(k, counts)[doc]
        for j in range(k):
            inside = j < size
            shifted = np.concatenate([h[j:], np.zeros(min(j, len(h)), _U)])[: len(h)]
            g = np.where(inside, _mix(g * _U(0x9E3779B97F4A7C15) + shifted), g)
    first = (np.arange(len(h)) - starts[doc]) <= (counts - np.minimum(k, counts))[doc]
    g, doc = g[first], doc[first]
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], g[new], seq


def minhashes(doc: np.ndarray, g: np.ndarray, n_docs: int, n: int = ROWS * BANDS) -> tuple[np.ndarray, np.ndarray]:
    """(documents with shingles, their n minimum hashes as uint32 columns)."""
    present, starts = np.unique(doc, return_index=True)
    rng = np.random.default_rng(20)
    out = np.empty((len(present), n), np.uint32)
    if len(present):
        low = (g >> _U(32)).astype(np.uint32)
        for j in range(n):
            a, b = np.uint32(rng.integers(1, 2**31) * 2 + 1), np.uint32(rng.integers(0, 2**32))
            x = (low ^ b) * a
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            x ^= x >> np.uint32(13)
            out[:, j] = np.minimum.reduceat(x, starts)
    return present, out


def fingerprints(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(key, seq, hi, lo, bands): word-sequence hash, 128-bit fingerprint and the cell numbers of all bands in one packed
    value; texts without words are left out. One narrow pass in Arrow batches."""
    rows, bands = ROWS, BANDS
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            doc, g, seq = shingle_hashes(b.column(1), k)
            with np.errstate(over="ignore"):
                present, m = minhashes(doc, g, b.num_rows)
                if not len(present):
                    continue
                bits = np.packbits((m & 1).astype(np.uint8), axis=1).view(">u8").astype(_U).reshape(len(m), -1)
                acc = np.zeros((len(m), bands), _U)
                for r in range(rows):
                    acc = _mix(acc * _U(0x9E3779B97F4A7C15) + m[:, r * bands : (r + 1) * bands].astype(_U) + _U(1))
                acc = _mix(acc + np.arange(bands, dtype=_U) * _U(0xD6E8FEB86659FD93))
            packed = np.ascontiguousarray(acc).view(np.uint8).reshape(len(m), bands, 8)[:, :, :CELL_BYTES].tobytes()
            width = bands * CELL_BYTES
            cells = pa.array([packed[i * width : (i + 1) * width] for i in range(len(m))], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(present)), pa.array(seq[present].view(np.int64)), pa.array(bits[:, 0].copy().view(np.int64)), pa.array(bits[:, 1].copy().view(np.int64)), cells],
                names=["key", "seq", "hi", "lo", "bands"],
            )

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"key {key_type}, seq bigint, hi bigint, lo bigint, bands binary")


def cell_entries(prints: DataFrame) -> DataFrame:
    """(id, cell): one row per band of prints(id, bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, CELL_BYTES)
            full = np.zeros((len(raw), 8), np.uint8)
            full[:, :CELL_BYTES] = raw
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), BANDS)), pa.array(full.reshape(-1).view(np.int64))], names=["id", "cell"])

    return prints.select("id", "bands").mapInArrow(run, "id bigint, cell bigint")


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Rank in the Gray sequence of 128-bit codes given as two uint64 columns (the prefix XOR of the bits)."""
    out = code.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> _U(s)
    odd = (out[:, 0] & _U(1)).astype(bool)  # parity of the upper half carries into the lower one
    out[odd, 1] = ~out[odd, 1]
    return out


class GrayIndex:
    """Hierarchical index over codes of many groups at once; ``group`` must be sorted, members of a group are
    then ordered by Gray rank. Levels: 0 are the codes, each further level joins ``FAN_OUT`` neighbours of a group
    into a node with mask (bits all members share) and value, relative to the node's parent pattern."""

    def __init__(self, group: np.ndarray, code: np.ndarray):
        rank = gray_rank(code)
        self.order = np.lexsort((rank[:, 1], rank[:, 0], group))
        g, value = group[self.order], code[self.order]
        mask = np.full_like(value, ~_U(0))
        self.levels = [(mask, value)]
        self.child: list[np.ndarray] = []  # first child of each node, with an end mark
        self.group = g
        while len(g) and (g[1:] == g[:-1]).any():
            start = np.concatenate([[True], g[1:] != g[:-1]])
            pos = np.arange(len(g)) - np.maximum.accumulate(np.where(start, np.arange(len(g)), 0))
            head = np.flatnonzero(start | (pos % FAN_OUT == 0))
            ones = np.bitwise_and.reduceat(mask & value, head, axis=0)
            zeros = np.bitwise_and.reduceat(mask & ~value, head, axis=0)
            self.child.append(np.append(head, len(g)))
            g, mask, value = g[head], ones | zeros, ones
            self.levels.append((mask, value))
        self.roots = g

    def pairs(self, bound: int, chunk: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Input positions (i, j) of all pairs of a group within ``bound`` differing bits, each pair once."""
        code, n = self.levels[0][1], len(self.group)
        root_of = np.searchsorted(self.roots, self.group)
        last = [np.arange(n)]  # last code under each node: pairs are looked for to the right of the query only
        for child in self.child:
            last.append(last[-1][child[1:] - 1])
        top = len(self.levels) - 1
        for a in range(0, n, chunk):
            q = np.arange(a, min(a + chunk, n))
            node = root_of[q]
            seen = np.zeros((len(q), 2), _U)  # bits already compared above
            diff = np.zeros(len(q), np.int32)
            for level in range(top, -1, -1):
                mask, value = self.levels[level]
                ok = last[level][node] > q
                q, node, seen, diff = q[ok], node[ok], seen[ok], diff[ok]
                fresh = mask[node] & ~seen
                diff = diff + np.bitwise_count((code[q] ^ value[node]) & fresh).sum(axis=1).astype(np.int32)
                ok = diff <= bound
                q, node, diff = q[ok], node[ok], diff[ok]
                if level == 0:
                    break
                seen = mask[node]
                head = self.child[level - 1]
                width = head[node + 1] - head[node]
                at = np.repeat(np.cumsum(width) - width, width)
                node = np.repeat(head[node], width) + (np.arange(width.sum()) - at)
                q, seen, diff = np.repeat(q, width), np.repeat(seen, width, axis=0), np.repeat(diff, width)
            keep = node > q
            if keep.any():
                yield self.order[q[keep]], self.order[node[keep]]


def bit_bound(threshold: float) -> int:
    p = (1 - threshold) / 2
    return math.ceil(128 * p + 4 * math.sqrt(128 * p * (1 - p)))


def candidate_pairs(prints: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: distinct pairs of ids of prints(id, hi, lo, bands) within the bound in some cell."""
    entries = cell_entries(prints)
    counts = entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut(entries.join(counts, "cell"))
    release(prints.sparkSession)
    blocks = F.ceil(F.col("n") / HOT_CELL).cast("int")
    spread = shared.withColumn("nb", blocks).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    spread = spread.select("id", F.xxhash64("cell", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"))
    spread = spread.join(prints.select("id", "hi", "lo"), "id")
    bound = bit_bound(threshold)

    def search(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, cell = table["id"].to_numpy(), table["cell"].to_numpy()
        code = np.stack([table["hi"].to_numpy().view(_U), table["lo"].to_numpy().view(_U)], axis=1)
        for i, j in GrayIndex(cell, code).pairs(bound):
            both = np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], axis=1)
            both = np.unique(both[both[:, 0] != both[:, 1]], axis=0)
            if len(both):
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells stream by in order; whole cells are searched as soon as enough rows are held."""
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= HELD_ROWS:
                table = pa.Table.from_batches(held).combine_chunks()
                cell = table["cell"].to_numpy()
                whole = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
                yield from search(table.slice(0, whole))
                held = table.slice(whole).to_batches()
                n -= whole
        if held:
            yield from search(pa.Table.from_batches(held))

    return spread.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a bigint, b bigint").distinct()


def verified_pairs(docs: DataFrame, key: str, text: str, k: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(pairs(a, b, similarity) between class representatives, classes(key, rep)): rep is the smallest key with the same
    word sequence. Null keys and texts without words are left out; repeated keys count once."""
    docs = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    prints = cut(fingerprints(docs, "key", "text", k))
    reps = prints.groupBy("seq").agg(F.min("key").alias("rep"), F.first("hi").alias("hi"), F.first("lo").alias("lo"), F.first("bands").alias("bands"))
    reps = cut(reps.withColumn("id", F.monotonically_increasing_id()))
    release(docs.sparkSession)  # each step's shuffles are of no use once its result is written
    classes = prints.select("key", "seq").distinct().join(reps.select("seq", "rep"), "seq").select("key", "rep")
    pairs = cut(candidate_pairs(reps, threshold))
    release(docs.sparkSession)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(reps.select("id", "rep"), "id")
    wanted = cut(wanted.select("id", F.col("rep").alias("key")))
    # texts of repeated keys are the same: one of them is enough
    own = lookup_join(docs, wanted, ["key"], "inner").groupBy("id").agg(F.min("text").alias("t"))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, g, _ = shingle_hashes(b.column(1), k)
            counts = np.bincount(doc, minlength=b.num_rows)
            cuts = np.concatenate([[0], np.cumsum(counts)])
            data = g.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([data[8 * cuts[i] : 8 * cuts[i + 1]] for i in range(b.num_rows)], pa.binary())], names=["id", "s"])

    sets = cut(own.mapInArrow(shingles, "id bigint, s binary"))
    release(docs.sparkSession)
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), strict=True):
                u, v = np.frombuffer(x, _U), np.frombuffer(y, _U)
                same = len(np.intersect1d(u, v, assume_unique=True))
                out.append(same / max(1, len(u) + len(v) - same))
            s = np.array(out)
            ok = pa.array(np.flatnonzero(s >= threshold - 1e-12))
            yield pa.RecordBatch.from_arrays([b.column("a").take(ok), b.column("b").take(ok), pa.array(s).take(ok)], names=["a", "b", "similarity"])

    good = both.mapInArrow(verify, "a bigint, b bigint, similarity double")
    names = reps.select("id", "rep")
    good = good.join(names.select(F.col("id").alias("a"), F.col("rep").alias("ra")), "a").join(names.select(F.col("id").alias("b"), F.col("rep").alias("rb")), "b")
    good = cut(good.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "similarity"))
    classes = cut(classes)
    release(docs.sparkSession)
    return good, classes


def components(pairs: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component of pairs(a, b); star contraction, a written table per round, until
    nothing moves. Labels only fall, so it ends; pointer jumping makes the rounds few."""
    edges = cut(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        step = cut(step.join(jump, "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("label"), "old"))
        moved = step.where("label <> old").limit(1).count()
        labels = step.select("node", "label")
        if not moved:
            return labels


def near_duplicate_classes(docs: DataFrame, key: str, text: str, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per distinct key whose text has words: (key, group, copies_group, links). group is the smallest key of the
    connected near-duplicate class, copies_group the smallest key with the same words, links the number of other
    different texts at or above the threshold."""
    pairs, classes = verified_pairs(docs, key, text, k, threshold)
    groups = components(pairs)
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    out = classes.join(groups.select(F.col("node").alias("rep"), "label"), "rep", "left").join(links, "rep", "left")
    return out.select(F.col("key").alias(key), F.coalesce("label", "rep").alias("group"), F.col("rep").alias("copies_group"), F.coalesce("links", F.lit(0)).alias("links"))


def near_duplicate_pairs(docs: DataFrame, key: str, text: str, k: int, threshold: float) -> DataFrame:
    """(a, b), a < b: all pairs of different keys at or above the threshold, copies included. The size of the result is
    that of the pairs asked for; use ``near_duplicate_classes`` where groups of copies are large."""
    pairs, classes = verified_pairs(docs, key, text, k, threshold)
    ca, cb = classes.select(F.col("key").alias("x"), F.col("rep").alias("a")), classes.select(F.col("key").alias("y"), F.col("rep").alias("b"))
    across = pairs.select("a", "b").join(ca, "a").join(cb, "b")
    # copies: the pairs of a large class are spread over pairs of blocks
    sizes = cut(classes.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("nb", F.ceil(F.col("n") / COPY_BLOCK).cast("int")))
    copies = lookup_join(classes, sizes.select("rep", "nb"), ["rep"], "inner").withColumn("xb", F.pmod(F.xxhash64("key"), F.col("nb")).cast("int"))
    blocks = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    left = copies.select(F.col("key").alias("x"), "rep", "xb", blocks.alias("yb"))
    right = copies.select(F.col("key").alias("y"), "rep", F.col("xb").alias("yb"), blocks.alias("xb"))
    inside = left.join(right, ["rep", "xb", "yb"]).where("x < y")
    return across.select("x", "y").unionByName(inside.select("x", "y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
