"""Near copies by SimHash, confirmed by exact Jaccard similarity of word shingles, with no pair lost that SimHash misses.

Candidates are sets whose fingerprints the SimHash operator links by its anchors. At a similarity of 0.8 fingerprints
differ by 9 to 10 bits of 64 on average, so that only the closest pairs are met that way; the others come from min-hashes:
BANDS keys of ROWS values each, so that two sets of similarity s share a key with probability 1 - (1 - s^ROWS)^BANDS,
about 0.99999 at 0.8. Candidates are joined to cells, and within a cell all pairs are decided by the shingles themselves:
prefixes of the rarest shingles, lengths, then the exact intersection. Only pairs at the least similarity or more are
links, and components follow from the links alone.

Equal sets are one. A cell with more than TILE shingles is dealt out as a grid of tiles, so none meets whole in a task;
texts move only for sets that lie in a cell, once a tile: up to MOST_BROADCAST such sets are broadcast to the texts,
more meet them by row.

Defined cases: null and empty texts have no shingles and are alike; fewer words than a shingle make one shingle; repeated
rows share a component; null ids are ignored as component names unless all ids of a component are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import components, cut, give_back, partitions, small
from tallyloom.llm.simhash import BITS, SEED, majority, shingle_hashes
from tallyloom.llm.simhash import links as simhash_links

WORDS, LEAST = 5, 0.8
BANDS, ROWS = 48, 7
#: Shingles of a side of a tile.
TILE = 1 << 18
#: Sets in cells that are broadcast, 32 bytes each.
MOST_BROADCAST = 1_000_000
#: So many keys are remembered by a task, to write the text of copies once.
SEEN = 100_000

_RNG = np.random.default_rng(SEED)
FLIP = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
TIMES = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The different hashes of all runs of so many words, in order."""
    return np.unique(shingle_hashes(text, words))


def band_keys(some: np.ndarray) -> np.ndarray:
    """A key a band, equal where all its min-hashes are."""
    if not len(some):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    short = some.astype(np.uint32)
    for at in range(0, len(short), 512):
        h = short[at : at + 512, None] ^ FLIP
        h *= TIMES
        np.minimum(low, h.min(axis=0), out=low)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in low.reshape(BANDS, ROWS).T:
        key = (key ^ column) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def linked(sets: list[np.ndarray], side: np.ndarray, least: float = LEAST) -> np.ndarray:
    """For each set the number of the least set it is connected with by pairs of that similarity; where there are two
    sides, pairs are of both."""
    n = len(sets)
    label = np.arange(n)
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    values, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    owner = np.repeat(np.arange(n), sizes)
    cross = bool(side.any() and not side.all())
    # in each set the rarest shingles first: of its prefix another set so alike must hold one in its own
    order = np.lexsort((values, df[values], owner))
    values = values[order]
    prefix = sizes - np.ceil(least * sizes - 1e-9).astype(np.int64) + 1
    in_prefix = np.arange(len(values)) - np.repeat(ends - sizes, sizes) < np.repeat(prefix, sizes)
    by_value = np.argsort(values, kind="stable")
    all_posts, all_ends = owner[by_value], np.cumsum(df)
    held = by_value[in_prefix[by_value]]
    posts = owner[held]
    post_ends = np.cumsum(np.bincount(values[held], minlength=len(df)))
    for a in range(n):
        mine = values[ends[a] - sizes[a] : ends[a]]
        near = [posts[post_ends[v - 1] if v else 0 : post_ends[v]] for v in mine[: prefix[a]]]
        some = np.unique(np.concatenate(near))
        some = some[(some > a) & (label[some] != label[a])]
        some = some[np.minimum(sizes[some], sizes[a]) >= least * np.maximum(sizes[some], sizes[a]) - 1e-9]
        if cross:
            some = some[side[some] != side[a]]
        if not len(some):
            continue
        if int(df[mine].sum()) < 8 * int(sizes[some].sum()):
            both = np.bincount(np.concatenate([all_posts[all_ends[v] - df[v] : all_ends[v]] for v in mine]), minlength=n)[some]
        else:
            both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for b in some])
        for b in some[both >= least * (sizes[a] + sizes[some] - both) - 1e-9]:
            x, y = label[a], label[b]
            if x != y:
                label[label == max(x, y)] = min(x, y)
    return label


def candidates(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b) edges that connect all sets whose fingerprints SimHash links or that share a min-hash key."""
    same = distinct.groupBy("fp").agg(F.min("key").alias("first"))
    near = simhash_links(distinct.select("fp").distinct(), bits).select(F.col("a").alias("fp"), F.col("b").alias("other"))
    far = same.select(F.col("fp").alias("other"), F.col("first").alias("head"))
    by_print = near.join(same, "fp").join(far, "other").select(F.col("first").alias("a"), F.col("head").alias("b"))
    by_print = by_print.unionByName(distinct.join(same, "fp").select(F.col("first").alias("a"), F.col("key").alias("b")))
    rows = distinct.select("key", F.explode("bands").alias("band"))
    heads = rows.groupBy("band").agg(F.min("key").alias("head"), F.count("*").alias("k")).where("k > 1").select("band", "head")
    # a set has a head a band at most; the least of them stands for all, so sets of like heads have like edges
    mine = rows.join(heads, "band").where("key <> head").groupBy("key").agg(F.collect_set("head").alias("heads")).withColumn("lead", F.array_min("heads"))
    by_band = mine.select("lead", F.explode(F.array_append("heads", F.col("key"))).alias("b")).select(F.col("lead").alias("a"), "b")
    return by_print.unionByName(by_band).where("a <> b").distinct()


def links(held: DataFrame, distinct: DataFrame, words: int, least: float, tile: int, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(a, b) edges that connect all candidate sets of that similarity."""
    spark = held.sparkSession
    cells = cut(components(candidates(distinct), "near-cells").select(F.col("node").alias("key"), "root").join(distinct.select("key", "n", "at"), "key"), "near-cells")
    sides = cells.groupBy("root").agg(F.ceil(F.sum("n") / tile).cast("int").alias("g"))
    placed = cut(cells.join(sides, "root").select("key", "at", "root", "g"), "near-placed")
    held_texts = held.where("at IS NOT NULL").select("at", "text")
    texts = held_texts.join(F.broadcast(placed) if placed.count() <= most_broadcast else placed.hint("merge"), "at").select("key", "root", "g", "text")

    def cut_up(batches):
        for batch in small(batches):
            sets = pa.array([shingles(t, words).tobytes() for t in batch.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], sets], names=["key", "root", "g", "shingles"])

    sets = texts.mapInArrow(cut_up, "key long, root long, g int, shingles binary")
    mine = F.pmod(F.xxhash64("key"), F.col("g")).cast("int")
    tiled = sets.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    tiled = tiled.select("root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).alias("side"), "key", "shingles")
    dealt = tiled.repartition(partitions(spark), "root", "i", "j").sortWithinPartitions("root", "i", "j")

    def compare(batches):
        at, group = None, []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(6)]
            done = []
            for root, i, j, side, key, some in zip(*cols, strict=True):
                if (root, i, j) != at:
                    done += pairs(group)
                    at, group = (root, i, j), []
                group.append((key, side, some))
            yield made(done)
        yield made(pairs(group))
        group.clear()
        give_back()

    def pairs(group):
        if len(group) < 2:
            return []
        label = linked([np.frombuffer(some, np.uint64) for _, _, some in group], np.array([side for _, side, _ in group]), least)
        return [(group[a][0], group[b][0]) for a, b in enumerate(label.tolist()) if a != b]

    def made(found):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long")


def classes(docs: DataFrame, words: int = WORDS, least: float = LEAST, tile: int = TILE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, mark, key, root, component_id) of every row; root names its class, component_id is the least doc_id of the linked sets' rows, mark the
    text's hash."""

    def run(batches):
        seen: set[int] = set()
        row = TaskContext.get().partitionId() << 40  # names the row whose text stands for its set
        for batch in small(batches):
            keys, texts, sizes, bands, ats, prints = [], [], [], [], [], []
            for t in batch.column(1).to_pylist():
                every = shingle_hashes(t, words)
                some = np.unique(every)
                k = xxhash.xxh3_64_intdigest(some.tobytes(), SEED) if len(some) else 0
                keys.append(k - (1 << 64) if k >> 63 else k)
                new = k not in seen
                texts.append(t if new else None)
                bands.append(band_keys(some) if new else None)
                ats.append(row if new else None)
                prints.append(majority(every) if new else 0)
                row += 1
                sizes.append(len(some))
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(k)
            cols = [batch.column(0), batch.column(2), pa.array(keys, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(ats, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "mark", "key", "fp", "n", "bands", "at", "text"])

    held = cut(docs.select(F.col(key).cast("long"), F.col(text), F.xxhash64(text)).mapInArrow(run, "doc_id long, mark long, key long, fp long, n long, bands array<long>, at long, text string"), "shingle-sets")
    named = held.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"))
    marks = held.where("at IS NOT NULL").select("key", "fp", "at", "bands").dropDuplicates(["key"])
    distinct = cut(named.join(marks, "key"), "distinct-sets")
    roots = components(links(held, distinct, words, least, tile), "near-copies")
    rooted = distinct.select("key", "least").join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    first = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "near-least")
    return held.select("doc_id", "mark", "key").join(rooted.join(first, "root").select("key", "root", "component_id"), "key")


def survivors(docs: DataFrame, words: int = WORDS, least: float = LEAST, most_broadcast: int = MOST_BROADCAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of every class the row of least key (and then least hash of its text) stays, once where the row is repeated. Rows
    without a key cannot be told apart and stay. Only keys and hashes of the rows concerned are dealt out; the rows meet
    them where they are if those are few."""
    rows = classes(docs, words, least, key=key, text=text).where("doc_id IS NOT NULL").groupBy("root", "doc_id", "mark").agg(F.count("*").alias("n"))
    first = rows.groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    told = rows.join(first, "root").select(F.col("doc_id").alias("_nc_id"), F.col("mark").alias("_nc_mark"), (F.struct("doc_id", "mark") != F.col("first")).alias("_nc_goes"), "n")
    told = cut(told.where("_nc_goes OR n > 1").drop("n"), "near-told")
    small = told.count() <= most_broadcast
    on = (F.col(key).cast("long") == F.col("_nc_id")) & (F.xxhash64(text) == F.col("_nc_mark"))
    found = docs.join(F.broadcast(told) if small else told, on, "left")
    alone = found.where("_nc_goes IS NULL").select(*docs.columns)
    return alone.unionByName(found.where("NOT _nc_goes").dropDuplicates(["_nc_id", "_nc_mark"]).select(*docs.columns))
