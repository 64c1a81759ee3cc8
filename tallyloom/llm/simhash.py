"""SimHash near-duplicates by anchor-point covering.

Fingerprints within t bits of each other differ by at most t // n bits in one of n blocks. Over each block a covering
code gives anchors: a Hamming code of radius 1 on some of its bits, every word on the rest. A fingerprint's home is the
anchor of its block, at distance 1 or less; it visits every anchor within radius plus threshold; so for any two linked
fingerprints one visits the other's home in some block, and comparing homes with visitors at each anchor misses no link.

Equal fingerprints are one. Counts by anchor come first; an anchor with more than TILE homes or visitors is dealt out as
a grid of tiles, so no group meets whole in a task. A tile gives each linked fingerprint the least fingerprint of its
group in the tile, never pairs; components follow from those links. Work grows with rows times fingerprints by anchor:
choose_blocks takes fewer and wider blocks (more anchors, more visits) as the number of fingerprints grows.

Defined cases: null and empty texts have no words and fingerprint zero, linked like any other; fewer words than a
shingle make one shingle; repeated rows share a component; an empty table gives an empty result; null ids are ignored
as component names unless all ids of a component are null.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import components, cut, give_back, partitions, small, table

WORDS, BITS = 4, 4
TILE = 4096
SEED = 42
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """The hash of every run of so many words, repeats included."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    runs = zip(*(parts[i:] for i in range(words)), strict=False) if len(parts) > words else [parts]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.fromiter((digest(join(r), SEED) for r in runs), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; unsigned."""
    if len(hashes) < 2:
        return int(hashes[0]) if len(hashes) else 0
    sums = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        h = hashes[at : at + (1 << 16)].astype(">u8")
        sums += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * sums > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, words: int = WORDS) -> int:
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit integer."""

    def run(batches):
        for batch in small(batches):
            fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, fp long")


class Block:
    """A span of the fingerprint and its code: a Hamming code on the lowest 2^r - 1 bits, the others free."""

    def __init__(self, shift: int, width: int, radius_bits: int, threshold: int):
        self.shift, self.width, self.threshold = shift, width, threshold
        self.checks = radius_bits
        self.coded = (1 << radius_bits) - 1 if radius_bits else 0
        self.free = width - self.coded
        #: a bit number is its parity-check column, so a word's syndrome is the xor of the numbers of its set bits
        # by syndrome: patterns of coded bits of weight up to 1 + threshold
        self.patterns = self._patterns(1 + threshold) if self.coded else {}
        self.flips = [(m, bin(m).count("1")) for m in self._subsets(self.free, threshold)]

    @staticmethod
    def _subsets(n: int, most: int) -> list[int]:
        out, last = [0], [0]
        for _ in range(most):
            last = sorted({m | 1 << i for m in last for i in range(n) if not m >> i & 1})
            out += last
        return out

    def _patterns(self, most: int) -> dict[int, list[tuple[int, int]]]:
        by: dict[int, list[tuple[int, int]]] = {s: [] for s in range(1 << self.checks)}
        for m in self._subsets(self.coded, most):
            s = 0
            for i in range(self.coded):
                if m >> i & 1:
                    s ^= i + 1
            by[s].append((m, bin(m).count("1")))
        return by

    def bits(self, fps: np.ndarray) -> np.ndarray:
        return (fps >> np.uint64(self.shift)) & np.uint64((1 << self.width) - 1)

    def syndromes(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), dtype=np.uint64)
        for i in range(self.coded):
            out ^= np.where((words >> np.uint64(i)) & np.uint64(1), np.uint64(i + 1), np.uint64(0))
        return out

    def homes(self, fps: np.ndarray) -> np.ndarray:
        words = self.bits(fps)
        if not self.coded:
            return words
        s = self.syndromes(words)
        return words ^ np.where(s > 0, np.uint64(1) << (np.maximum(s, np.uint64(1)) - np.uint64(1)), np.uint64(0))

    def visits(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the fingerprint, anchor) for every anchor within radius plus threshold, the free bits' share of
        the distance counted against the threshold alone."""
        words = self.bits(fps)
        groups = {0: np.arange(len(words))} if not self.coded else {s: np.flatnonzero(found) for s in range(1 << self.checks) if (found := self.syndromes(words) == s).any()}
        numbers, anchors = [], []
        for s, rows in groups.items():
            near = self.patterns[s] if self.coded else [(0, 0)]
            for flip, cost in self.flips:
                for m, weight in near:
                    if weight <= (1 if self.coded else 0) + self.threshold - cost:
                        numbers.append(rows)
                        anchors.append(words[rows] ^ np.uint64(m | flip << self.coded))
        return np.concatenate(numbers) if numbers else np.zeros(0, np.int64), np.concatenate(anchors) if anchors else np.zeros(0, np.uint64)

    def cost(self) -> tuple[float, float]:
        """Visits a fingerprint, and anchors."""
        near = np.mean([sum(1 for flip, c in self.flips for m, w in p if w <= 1 + self.threshold - c) for p in self.patterns.values()]) if self.coded else len(self.flips)
        return float(near), 2.0 ** (self.width - self.checks)


@cache
def blocks(bits: int, n: int) -> tuple[Block, ...]:
    """n blocks for links of so many bits, each with the longest Hamming code that fits and leaves free bits few."""
    widths = [64 // n + (i < 64 % n) for i in range(n)]
    out, shift = [], 0
    for w in widths:
        r = max(r for r in (0, 2, 3, 4, 5) if (1 << r) - 1 <= w)
        out.append(Block(shift, w, r, bits // n))
        shift += w
    return tuple(out)


#: A visit is a row that is shuffled, about so many times dearer than a comparison.
ROW_COST = 500.0


def choose_blocks(bits: int, fingerprints: int) -> int:
    """The number of blocks with the least estimated cost; each number gives the same links."""

    def price(n: int) -> float:
        rows = compared = 0.0
        for b in blocks(bits, n):
            visits, anchors = b.cost()
            rows += visits + 1
            compared += visits * fingerprints / anchors
        return fingerprints * (rows * ROW_COST + compared)

    return min((n for n in (2, 3, 4, 6) if 1 <= bits // n <= 3), key=price) if bits > 1 else 2


def linked_in_tile(homes: np.ndarray, visitors: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, least fingerprint of its group here) of all that have a link in the tile."""
    both = np.concatenate([homes, visitors])
    n, step, joins = len(homes), max(1, (1 << 20) // max(1, len(visitors))), []
    for a in range(0, n, step):
        block = homes[a : a + step, None]
        near = (np.bitwise_count(block ^ visitors[None, :]) <= bits) & (block != visitors[None, :])
        left = near.any(axis=1)
        while left.any():  # a group of the block at a time, grown from its first home
            rows = np.zeros(len(near), bool)
            rows[int(left.argmax())] = True
            while True:
                cols = near[rows].any(axis=0)
                grown = near[:, cols].any(axis=1)
                if (grown == rows).all():
                    break
                rows = grown
            members = np.concatenate([np.flatnonzero(rows) + a, np.flatnonzero(cols) + n])
            joins.append((members, np.full(len(members), members[0])))
            left &= ~rows
    if not joins:
        return both[:0], both[:0]
    i, j = (np.concatenate(x) for x in zip(*joins, strict=True))
    same = np.unique(both, return_inverse=True)[1]  # a fingerprint is often home and visitor
    i, j = same[i], same[j]
    root = np.arange(int(same.max()) + 1)  # values are in order, so the least number is the least fingerprint
    while True:
        new = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    some = np.unique(np.concatenate([i, j]))
    values = np.unique(both)
    return values[some], values[root[some]]


def linked_in_groups(edges: np.ndarray, home: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """linked_in_tile for each group of rows between two edges, homes first. Groups of few comparisons are tried
    together, and only those with a link are looked at one by one."""
    starts, sizes = edges[:-1], np.diff(edges)
    h = np.add.reduceat(home.astype(np.int64), starts) if len(starts) else sizes
    v = sizes - h
    work = h * v
    small = np.flatnonzero((work > 1) & (work <= 4096))
    linked = np.flatnonzero(work > 4096).tolist()
    cuts = np.searchsorted(np.cumsum(work[small]), np.arange(0, int(work[small].sum()) + (1 << 20), 1 << 20)[1:])
    for some in np.split(small, cuts):
        if len(some):
            group = np.repeat(some, work[some])
            local = np.arange(len(group)) - np.repeat(np.cumsum(work[some]) - work[some], work[some])
            x = fp[starts[group] + local // v[group]]
            y = fp[starts[group] + h[group] + local % v[group]]
            linked += np.unique(group[(np.bitwise_count(x ^ y) <= bits) & (x != y)]).tolist()
    out = [linked_in_tile(fp[starts[g] : starts[g] + h[g]], fp[starts[g] + h[g] : edges[g + 1]], bits) for g in linked]
    return (np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])) if out else (fp[:0], fp[:0])


def links(fps: DataFrame, bits: int = BITS, n_blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """(a, b) edges that connect all fingerprints within so many bits; fps has a column fp of distinct values."""
    spark = fps.sparkSession
    n_blocks = n_blocks or choose_blocks(bits, fps.count())

    def spread(batches):
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(values), 2000):
                some = values[at : at + 2000]
                for k, block in enumerate(blocks(bits, n_blocks)):
                    numbers, anchors = block.visits(some)
                    tag = np.uint64(k) << np.uint64(56)
                    keys = np.concatenate([block.homes(some), anchors]) | tag
                    home = np.concatenate([np.ones(len(some), bool), np.zeros(len(anchors), bool)])
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(home), pa.array(np.concatenate([some, some[numbers]]).view(np.int64))], names=["anchor", "home", "fp"])

    rows = fps.select("fp").mapInArrow(spread, "anchor long, home boolean, fp long")
    sizes = rows.groupBy("anchor").agg(F.sum(F.col("home").cast("long")).alias("h"), F.sum((~F.col("home")).cast("long")).alias("v"))
    large = sizes.where((F.col("h") > 0) & (F.col("v") > 1) & ((F.col("h") > tile) | (F.col("v") > tile)))
    large = cut(large.select("anchor", F.ceil(F.col("h") / tile).cast("int").alias("hs"), F.ceil(F.col("v") / tile).cast("int").alias("vs")), "hot-anchors")
    # of hot anchors there are at most rows / tile: joined by size, as the optimiser sees fit
    marked = rows.join(large, "anchor", "left")
    own = F.when(F.col("home"), F.coalesce("hs", F.lit(1))).otherwise(F.coalesce("vs", F.lit(1)))
    other = F.when(F.col("home"), F.coalesce("vs", F.lit(1))).otherwise(F.coalesce("hs", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), own).cast("int")
    tiled = marked.select("anchor", "home", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), other - 1)).alias("theirs"))
    tiled = tiled.select("anchor", "home", "fp", F.when(F.col("home"), F.col("mine")).otherwise(F.col("theirs")).alias("i"), F.when(F.col("home"), F.col("theirs")).otherwise(F.col("mine")).alias("j"))
    dealt = tiled.repartition(partitions(spark), "anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", F.desc("home"))

    def compare(batches):
        rest = None  # rows of the group that the last batch may not have ended
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("anchor", "i", "j", "home", "fp")]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            if not len(cols[0]):
                continue
            change = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])) + 1
            edges = np.concatenate([[0], change])
            rest = [c[edges[-1] :] for c in cols]
            if len(edges) > 1:
                yield pairs(*linked_in_groups(edges, cols[3], cols[4].view(np.uint64), bits))
        if rest is not None:
            yield pairs(*linked_in_groups(np.array([0, len(rest[0])]), rest[3], rest[4].view(np.uint64), bits))
            rest = None
        give_back()

    def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long").where("a <> b")


def classes(docs: DataFrame, words: int = WORDS, bits: int = BITS, n_blocks: int | None = None, tile: int = TILE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the least doc_id of the linked fingerprints' rows."""
    hashed = cut(fingerprints(docs, words, key, text), "fingerprints")
    distinct = cut(hashed.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct, bits, n_blocks, tile), "simhash")
    named = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # a component that holds many fingerprints is summed before it is dealt out; as a table of its own its join with
    # them is between plain exchanges, which AQE can split
    least = cut(named.groupBy("root").agg(F.min("least").alias("component_id")), "components-least")
    by_fp = named.join(least, "root").select("fp", "component_id")
    return hashed.join(by_fp, "fp")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
