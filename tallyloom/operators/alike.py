"""Pairs of sets that are alike, without all pairs that share a rare member: what a pair differs by at most is held
against its places and against parities of its members before anything is written of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Of the members' common order: so many of the commonest go to all tasks, by their counts; rarer ones come before them, by hash.
COMMON = 1 << 18
#: Sets a part of the members' prefixes, whose sets a task holds; pairs looked at at once.
SETS, PAIRS = 15_000, 1 << 18
#: Bits of parities by the sets' sizes: (up to so many members, bits). A set's longer parity folds into a shorter one.
LEVELS = ((64, 64), (128, 128), (256, 256), (512, 512), (1024, 1024), (2048, 2048), (1 << 31, 8192))
#: Words of parities that are held against each other at once.
WORDS = 1 << 19


def _needed(least: float, both: np.ndarray) -> np.ndarray:
    """The members that two sets of so many in all must share to be at Jaccard `least`."""
    return np.ceil(least / (1 + least) * both - 1e-9).astype(np.int64)


def _level(k: np.ndarray) -> np.ndarray:
    return np.searchsorted([most for most, _ in LEVELS], k)


def _bytes(x: pa.Array) -> np.ndarray:
    """The bytes of all values of a binary array, as words."""
    ends = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1] if len(x) else np.zeros(1, np.int32)
    return np.frombuffer(x.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint64) if len(x) else np.zeros(0, np.uint64)


def _parities(raw: pa.Array, level: np.ndarray) -> list[np.ndarray]:
    """By level: the parities of the sets of that level and of larger ones, folded; in the sets' order."""
    own = [_bytes(raw.filter(pa.array(level == i))).reshape(-1, bits // 64) for i, (_, bits) in enumerate(LEVELS)]
    tables = [own[-1]]
    for i in reversed(range(len(LEVELS) - 1)):
        there, words = level[level >= i], LEVELS[i][1] // 64
        table = np.empty((len(there), words), np.uint64)
        table[there == i] = own[i]
        table[there > i] = np.bitwise_xor.reduce(tables[0].reshape(len(tables[0]), tables[0].shape[1] // words, words), axis=1)
        tables.insert(0, table)
    return tables


def _odd(table: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bits of the parities of x and y differ: as many members at least are in one set alone."""
    step = max(1, WORDS // table.shape[1])
    return np.concatenate([np.bitwise_count(table[x[i : i + step]] ^ table[y[i : i + step]]).sum(axis=1, dtype=np.int64) for i in range(0, len(x), step)] or [np.zeros(0, np.int64)])


def _prefixes(batches: Iterator[pa.RecordBatch], common: np.ndarray, rank: np.ndarray, parts: int, least: float) -> Iterator[pa.RecordBatch]:
    """(part, id, k, parity, m, r): the rarest members m of each set, dealt out in parts by themselves, with their places r;
    of sets so alike one of these is the first that both have. A set gives a row for each part that has some."""
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            lists = batch.column("m")
            k = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            members = lists.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(k)), k)
            level = _level(k)
            parity = np.empty(len(k), dtype=object)
            for i, (_, bits) in enumerate(LEVELS):
                of = np.flatnonzero(level == i)
                mine, to = level[owner] == i, np.cumsum(level == i) - 1
                odd = np.bincount(to[owner[mine]] * bits + (members[mine] >> 20 & bits - 1), minlength=len(of) * bits) & 1
                parity[of] = [x.tobytes() for x in np.packbits(odd.astype(np.uint8).reshape(len(of), bits), axis=1)]
            place = np.minimum(np.searchsorted(common, members), max(0, len(common) - 1))
            known = common[place] == members if len(common) else np.zeros(len(members), bool)
            order = np.lexsort((members, np.where(known, rank[place] if len(rank) else 0, -1), owner))
            start = np.cumsum(k) - k
            r = np.arange(len(members)) - np.repeat(start, k) + 1
            kept = r <= np.repeat(k - np.ceil(least * k - 1e-9).astype(np.int64) + 1, k)
            members, owner, r = members[order][kept], owner[order][kept], r[kept]
            part = (members & 0x7FFFFFFF) % parts
            order = np.lexsort((r, part, owner))
            members, owner, r, part = members[order], owner[order], r[order], part[order]
            first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])]) if len(owner) else np.zeros(0, np.int64)
            ends = pa.array(np.r_[first, len(owner)].astype(np.int32))
            of = owner[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[first].astype(np.int32)), batch.column("id").take(pa.array(of)), pa.array(k[of].astype(np.int32)), pa.array(parity[of], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(members)), pa.ListArray.from_arrays(ends, pa.array(r.astype(np.int32)))],
                ["part", "id", "k", "parity", "m", "r"],
            )


def _met(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(a, b), a < b, of a part's sets that share a member of their prefixes and may be so alike."""
    parts = [(b["id"].to_numpy(), b["k"].to_numpy(), pc.list_value_length(b["m"]).to_numpy(), b["m"].flatten().to_numpy(), b["r"].flatten().to_numpy(), b["parity"]) for b in batches if b.num_rows]
    if not parts:
        return
    ids, k, n, m, r, raw = (list(x) for x in zip(*parts, strict=True))
    ids, k, n, m, r, raw, parts = np.concatenate(ids), np.concatenate(k).astype(np.int64), np.concatenate(n), np.concatenate(m), np.concatenate(r), pa.concat_arrays(raw), None
    level = _level(k)
    tables = _parities(raw, level)
    row = [np.cumsum(level >= i) - 1 for i in range(len(LEVELS))]
    owner = np.repeat(np.arange(len(k)), n)
    order = np.lexsort((-k[owner], m))
    m, r, owner, raw = m[order], r[order], owner[order], None
    size = k[owner]
    # a member's sets by falling size: each meets those after it, down to the least size that may be so alike
    group = np.cumsum(np.r_[0, m[1:] != m[:-1]])
    span = int(size.max()) + 1
    fall = group * span + (span - 1 - size)
    end = np.searchsorted(fall, group * span + (span - 1 - np.ceil(least * size - 1e-9).astype(np.int64)), side="right")
    mates = np.maximum(end - np.arange(len(m)) - 1, 0)
    upto = np.cumsum(mates)
    at = 0
    while at < len(m):
        base = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, base + PAIRS, side="right")))
        x = np.repeat(np.arange(at, to), mates[at:to])
        y = x + 1 + np.arange(len(x)) - np.repeat(upto[at:to] - mates[at:to] - base, mates[at:to])
        both = size[x] + size[y]
        need = _needed(least, both)
        near = 1 + np.minimum(size[x] - r[x], size[y] - r[y]) >= need
        x, y, most = owner[x[near]], owner[y[near]], (both - 2 * need)[near]
        for i, table in enumerate(tables):
            told = np.flatnonzero(np.minimum(level[x], level[y]) >= i)
            far = np.zeros(len(x), bool)
            far[told] = _odd(table, row[i][x[told]], row[i][y[told]]) > most[told]
            x, y, most = x[~far], y[~far], most[~far]
        pair = np.unique(x * len(k) + y)
        a, b = ids[pair // len(k)], ids[pair % len(k)]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
        at = to


def candidates(sets: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b, of sets (id long, m array<long>, hashes of each member once): all at Jaccard `least` or more, and few others.
    Two sets so alike share one of each other's rarest members; the first that both have stands early enough in both for
    the rest to be shared, and no more members than may differ are odd in one of them."""
    spark = sets.sparkSession
    counts = sets.select(F.explode("m").alias("m")).groupBy("m").agg(F.count("*").alias("n")).where("n > 1")
    top = counts.orderBy(F.desc("n"), "m").limit(COMMON).toPandas()
    known = np.argsort(top["m"].to_numpy(np.int64))
    common, rank = top["m"].to_numpy(np.int64)[known], (len(top) - np.arange(len(top)))[known]
    parts = max(8, -(-sets.count() // SETS))
    given = spark.sparkContext.broadcast((common, rank))
    rare = sets.mapInArrow(lambda b: _prefixes(b, *given.value, parts, least), "part int, id long, k int, parity binary, m array<long>, r array<int>")
    return rare.repartition(parts, "part").mapInArrow(lambda b: _met(b, least), "a long, b long").distinct()
