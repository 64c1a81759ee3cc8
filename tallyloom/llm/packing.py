"""Packing by cutting-stock column generation.

Documents are cut into pieces of the sequence length and a remainder. A linear program over the histogram of piece
lengths says how often to use each filling pattern; a knapsack dynamic program prices new patterns; rounded-down
patterns and an exact fill of what they leave become sequences; pieces, ranked inside their length class, take the
patterns' places by rank. Only the histogram (a row per length class) and the ranges' totals reach the driver.

Where the patterns leave much room, as where most remainders are just over half a sequence, pieces of the wasteful
patterns are cut again: heads as long as the room that the others leave, and a tail, which are classes of their own in
the next program. Cut pieces get their checksums from their texts, encoded once more; without cuts there is no such pass.

Classes are one token wide up to FINE tokens and twice as wide each time the length doubles, so rounding to the upper
end, which patterns count and which makes their pieces fit, costs under 1 in FINE of a piece and nothing of a short one.

Defined cases: a null text is empty and has the end id alone; null ids come first; repeated rows are packed each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import cut, partitions, small, table
from tallyloom.llm.tokens import AT_ONCE, encoder, slices, vocabulary

END = 1
LENGTH = 2048
#: Up to so many tokens each length is a class of its own; a power of two.
FINE = 64
#: The widest class.
WIDEST = 16
#: The linear program ends when its value is within this share of its lower bound.
GAP = 2e-3
#: The share of the best prices so far in the prices that patterns are sought with.
PULL = 0.8
#: Pieces are cut again while sequences are over this share more than tokens fill, at most so many times; the shortest head.
SLACK, CUT_ROUNDS, SHORTEST = 0.02, 6, 16
Pattern = tuple[tuple[int, int], ...]  # (class, pieces), by class


def upper_end(n, length: int = LENGTH, fine: int = FINE, widest: int = WIDEST) -> F.Column:
    """The upper end of the class that a piece of n tokens is in."""
    out = n
    for width in (1 << k for k in range(1, widest.bit_length())):
        out = F.when(n > fine * width // 2, F.ceil(n / width) * width).otherwise(out)
    return F.least(out, F.lit(length)).cast("int")


def fillings(value: np.ndarray, sizes: np.ndarray, room: int, block: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """By room, the worth of its most valuable filling, each item any number of times, and an item of it (-1: as in the
    room one smaller).

    Rooms are settled a block at a time: items of a block or more look back at settled rooms, all at once; smaller ones
    follow room by room."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    big, small = np.flatnonzero(sizes >= block), [(int(s), float(value[i]), int(i)) for i, s in enumerate(sizes.tolist()) if s < block]
    for lo in range(1, room + 1, block):
        w = np.arange(lo, min(lo + block, room + 1))
        if len(big):
            before = w[:, None] - sizes[big][None, :]
            got = np.where(before >= 0, best[np.maximum(before, 0)] + value[big][None, :], 0.0)
            k = got.argmax(axis=1)
            top = got[np.arange(len(w)), k]
            best[w], pick[w] = top, np.where(top > 0, big[k], -1)
        held = best[max(0, lo - block) : lo + len(w)].tolist()
        shift = max(0, lo - block)
        for x in w.tolist():
            now, item = held[x - shift], -2
            if held[x - 1 - shift] > now:
                now, item = held[x - 1 - shift], -1
            for s, v, i in small:
                if s <= x and held[x - s - shift] + v > now + 1e-12:
                    now, item = held[x - s - shift] + v, i
            held[x - shift] = now
            if item > -2:
                pick[x] = item
        best[w] = held[lo - shift :]
    return best, pick


def filling(pick: np.ndarray, sizes: np.ndarray, room: int) -> dict[int, int]:
    counts: dict[int, int] = {}
    while room > 0:
        if (i := int(pick[room])) < 0:
            room -= 1
        else:
            counts[i] = counts.get(i, 0) + 1
            room -= int(sizes[i])
    return counts


def knapsack(value: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, dict[int, int]]:
    """The most valuable filling of room, each item any number of times, and its counts by item."""
    best, pick = fillings(value, sizes, room)
    return float(best[room]), filling(pick, sizes, room)


def against(inverse: np.ndarray, column: dict[int, int]) -> np.ndarray:
    """A pattern in terms of the basis."""
    return inverse[:, list(column)] @ np.array(list(column.values()), dtype=float)


def replace(inverse: np.ndarray, columns: list[dict[int, int]], out: int, column: dict[int, int]) -> None:
    """Puts a pattern in the place of one of the basis."""
    step = against(inverse, column)
    row = inverse[out] / step[out]
    inverse -= np.outer(step, row)
    inverse[out] = row
    columns[out] = column


def linear_program(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP, rounds: int = 600, per_round: int = 40) -> list[tuple[dict[int, int], float]]:
    """Patterns (item -> count) and how often to use them, so that demand is met with about the fewest patterns."""
    n = len(sizes)
    # to start with, sequences filled with the largest that fits, as often as the first of their classes lasts: a class
    # used up is in no later pattern, so these patterns are a basis
    columns = [{i: int(room // sizes[i])} for i in range(n)]
    inverse = np.diag(1.0 / np.array([c[i] for i, c in enumerate(columns)]))
    left = demand.astype(float)
    while (left > 0).any():
        free, column = room, {}
        for i in range(n - 1, -1, -1):
            if left[i] > 0 and (k := free // int(sizes[i])):
                column[i] = k
                free -= k * int(sizes[i])
        times, first = min((left[i] / k, i) for i, k in column.items())
        for i, k in column.items():
            left[i] = max(0.0, left[i] - times * k)
        left[first] = 0.0
        replace(inverse, columns, first, column)
    x = np.maximum(inverse @ demand, 0.0)
    least = float(sizes @ demand) / room  # what fills all sequences to the end
    bound, centre, pull = 0.0, np.zeros(n), PULL
    for _ in range(rounds):
        now = np.maximum(inverse.sum(axis=0), 0.0)
        prices = pull * centre + (1 - pull) * now  # prices that swing less settle sooner
        best, pick = fillings(prices, sizes, room)
        if (low := float(prices @ demand) / best[room]) > bound:  # prices / worth are feasible in the dual
            bound, centre = low, prices / best[room]
        if best[room] <= 1 + 1e-9 and not pull or x.sum() <= (1 + gap) * max(bound, least):
            break
        moved = False
        # the best filling, and the best ones that hold each item, while they still pay at the prices of the moment
        worth = prices + best[room - sizes]
        for i in np.argsort(-worth, kind="stable")[:per_round].tolist():
            column = filling(pick, sizes, room - int(sizes[i]))
            column[i] = column.get(i, 0) + 1
            step = against(inverse, column)
            up = step > 1e-9
            if step.sum() <= 1 + 1e-9 or not up.any():
                continue
            ratio = np.where(up, x / np.where(up, step, 1), np.inf)
            out = int(ratio.argmin())
            x = x - ratio[out] * step
            x[out] = ratio[out] = max(0.0, float(ratio[out]))
            replace(inverse, columns, out, column)
            moved = True
        pull = PULL if moved else 0.0
    return [(c, float(v)) for c, v in zip(columns, x, strict=True) if v > 1e-9]


def fill_rest(sizes: np.ndarray, left: np.ndarray, room: int) -> list[tuple[dict[int, int], int]]:
    """Patterns for what rounding leaves: largest first, each next the largest that still fits."""
    out, left = [], left.astype(np.int64).copy()
    order = np.argsort(-sizes, kind="stable")
    while left.any():
        free, counts = room, {}
        for i in order:
            if (k := min(int(left[i]), free // int(sizes[i]))) > 0:
                counts[int(i)] = k
                free -= k * int(sizes[i])
        times = min(int(left[i]) // k for i, k in counts.items())
        out.append((counts, times))
        for i, k in counts.items():
            left[i] -= times * k
    return out


def plan(histogram: dict[int, int], room: int) -> list[tuple[Pattern, int]]:
    """Patterns over size classes and how many sequences each makes; together they have a place for every piece."""
    sizes = np.array(sorted(histogram), dtype=np.int64)
    if not len(sizes):
        return []
    demand = np.array([histogram[s] for s in sizes.tolist()], dtype=np.int64)
    whole, left = [], demand.copy()
    for column, times in linear_program(sizes, demand.astype(float), room):
        if (k := int(min([times + 1e-6, *(left[i] / c for i, c in column.items())]))) > 0:
            whole.append((column, k))
            for i, c in column.items():
                left[i] -= k * c
    return [(tuple(sorted((int(sizes[i]), c) for i, c in column.items())), k) for column, k in whole + fill_rest(sizes, left, room)]


def recut(left: dict[int, int], patterns: list[tuple[Pattern, int]], room: int) -> list[tuple[int, int, tuple[int, ...]]]:
    """(size, pieces, parts): of each pattern that leaves room, a share of its sequences gives up its largest pieces that
    are not cut yet, and these are cut into heads that fill what the rest of its sequences leave."""
    out, left = [], dict(left)
    for pattern, times in sorted(patterns, key=lambda p: -p[1] * (room - sum(s * c for s, c in p[0]))):
        free = room - sum(s * c for s, c in pattern)
        whole = [(s, c) for s, c in pattern if left.get(s) and s > free]
        if free < SHORTEST or not whole:
            continue
        size, held = whole[-1]
        heads = size // free
        n = min(left[size], round(held * times / (1 + held * heads)))
        if n:
            out.append((size, n, (free,) * heads + ((size - heads * free,) if size % free else ())))
            left[size] -= n
    return out


def plan_with_cuts(histogram: dict[int, int], room: int) -> tuple[list[tuple[Pattern, int]], list[tuple[int, int, tuple[int, ...]]]]:
    """Patterns, and which pieces to cut again into which parts."""
    best, cuts = plan(histogram, room), []
    count, uncut = dict(histogram), dict(histogram)
    least = -(-sum(s * n for s, n in histogram.items()) // room)
    for _ in range(CUT_ROUNDS):
        used = sum(times for _, times in best)
        if used <= least * (1 + SLACK):
            break
        more = recut(uncut, best, room)
        tried, still = dict(count), dict(uncut)
        for size, n, parts in more:
            tried[size] -= n
            still[size] -= n
            for x in parts:
                tried[x] = tried.get(x, 0) + n
        new = plan({s: n for s, n in tried.items() if n}, room) if more else best
        if sum(times for _, times in new) >= used:
            break
        best, cuts, count, uncut = new, [*cuts, *more], tried, still
    return best, cuts


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, mark) of every piece: full ones, then the remainder. mark is a hash
    of the text."""
    tail = np.array([end], dtype="<u4").tobytes()
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "mark")

    def cut_up(batches):
        for batch in small(batches):
            keys, texts, marks = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()], batch.column(2).to_pylist()
            for a, b in slices(texts, AT_ONCE):
                rows = []
                for k, m, ids in zip(keys[a:b], marks[a:b], encoder(path).ids(texts[a:b]), strict=True):
                    ids += tail
                    n = len(ids) // 4
                    rows += [(k, s, min(length, n - s), zlib.crc32(ids[4 * s : 4 * (s + length)]), n, m) for s in range(0, n, length)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=list(names))

    return docs.select(F.col(key).cast("long"), F.col(text), F.xxhash64(text).alias("mark")).mapInArrow(cut_up, ", ".join(f"{n} long" for n in names))


def checksums(docs: DataFrame, parts: DataFrame, path: str, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """parts (doc_id, mark, start, length, ...) with ids_crc32, from the texts that they are of."""
    tail = np.array([end], dtype="<u4").tobytes()
    same = lambda a, b: a["mark"].eqNullSafe(b["mark"]) & a["doc_id"].eqNullSafe(b["doc_id"])
    wanted = parts.select("doc_id", "mark", "start", "length").distinct()
    known = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))
    held = known.join(wanted.select("doc_id", "mark").distinct(), same(known, wanted), "left_semi").dropDuplicates(["doc_id", "mark"])

    def run(batches):
        for batch in small(batches):
            texts = [t or "" for t in batch.column(4).to_pylist()]
            starts, lengths = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            crc = []
            for a, b in slices(texts, AT_ONCE):
                crc += [zlib.crc32((ids + tail)[4 * s : 4 * (s + n)]) for ids, s, n in zip(encoder(path).ids(texts[a:b]), starts[a:b], lengths[a:b], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64())], names=["doc_id", "mark", "start", "length", "crc"])

    met = wanted.join(held.select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m"), "text"), F.col("mark").eqNullSafe(F.col("_m")) & F.col("doc_id").eqNullSafe(F.col("_d"))).select("doc_id", "mark", "start", "length", "text")
    found = cut(met.mapInArrow(run, "doc_id long, mark long, start long, length long, crc long"), "part-sums").toDF("_d", "_m", "_s", "_l", "crc")
    on = F.col("mark").eqNullSafe(F.col("_m")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("start") == F.col("_s")) & (F.col("length") == F.col("_l"))
    return parts.join(found, on).withColumn("ids_crc32", F.col("crc")).select(*parts.columns)


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, fine: int = FINE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces with sequence_id and offset; offsets in a sequence run from 0 without gaps."""
    spark = docs.sparkSession
    order = ["size", "doc_id", "start", "ids_crc32"]
    sized = pieces(docs, path, length, end, key, text).withColumn("size", upper_end(F.col("length"), length, fine))
    ranged = cut(cut(sized, "pieces").repartitionByRange(partitions(spark), *order).withColumn("_part", F.spark_partition_id()), "ranked-pieces")
    histogram: dict[int, int] = {}
    bases = []
    # ranges are in order of size: at most a row for each range and one for each class
    for part, size, n in sorted(map(tuple, ranged.groupBy("_part", "size").agg(F.count("*")).collect())):
        bases.append((part, size, histogram.get(size, 0)))
        histogram[size] = histogram.get(size, 0) + n
    patterns, cuts = plan_with_cuts(histogram, length)
    places: dict[int, list[tuple[int, int, int, int]]] = {}  # class -> (first rank, pieces a sequence, first sequence, place of the first)
    sequence = 0
    for pattern, times in patterns:
        at = 0
        for size, count in pattern:
            had = places.setdefault(size, [])
            rank = had[-1][0] + had[-1][4] if had else 0
            had.append((rank, count, sequence, at, count * times))
            at += count
        sequence += times
    tables = {size: tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) for size, rows in places.items()}
    # the last pieces of a class are the cut ones; parts come after the whole pieces of their class
    kept = {s: n - sum(k for size, k, _ in cuts if size == s) for s, n in histogram.items()}
    next_cut, next_rank = dict(kept), dict(kept)
    groups: dict[int, list[tuple[int, int, list[tuple[int, int, int]]]]] = {}  # class -> (first rank, pieces, (offset, size, rank of the first) of each part)
    for size, n, parts in cuts:
        made, at = [], 0
        for x in parts:
            made.append((at, x, next_rank.get(x, 0)))
            next_rank[x] = next_rank.get(x, 0) + n
            at += x
        groups.setdefault(size, []).append((next_cut[size], n, made))
        next_cut[size] += n
    base = spark.createDataFrame(bases or [(0, 0, 0)], "_part int, size int, _base long")
    ranked = ranged.join(F.broadcast(base), ["_part", "size"]).withColumn("rank", F.col("_base") + F.row_number().over(Window.partitionBy("_part", "size").orderBy(*order[1:])) - 1)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "mark"]

    def placed_at(size: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, count, start, at, _ = tables[size]
        k = np.searchsorted(first, rank, side="right") - 1
        within = rank - first[k]
        return start[k] + within // count[k], at[k] + within % count[k]

    def assign(batches):
        for batch in batches:
            size, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("size", "rank"))
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in names}

            def rows(at, sequence_id, place, columns=columns, **other):
                new = {c: pa.array(v) for c, v in other.items()}
                return pa.RecordBatch.from_arrays([*(new.get(c, columns[c].take(pa.array(at))) for c in names), pa.array(sequence_id), pa.array(place), pa.array(np.full(len(at), bool(other)))], names=[*names, "sequence_id", "place", "part"])

            for s in np.unique(size).tolist():
                of = np.flatnonzero(size == s)
                whole = of[rank[of] < kept[s]]
                if len(whole):
                    yield rows(whole, *placed_at(s, rank[whole]))
                for low, n, parts in groups.get(s, ()):
                    some = of[(rank[of] >= low) & (rank[of] < low + n)]
                    starts, lengths = (columns[c].take(pa.array(some)).to_numpy() for c in ("start", "length"))
                    for at, x, first in parts:
                        here = np.minimum(x, lengths - at)  # a class holds pieces a little shorter than its name
                        there = here > 0
                        if there.any():
                            to = placed_at(x, first + rank[some[there]] - low)
                            yield rows(some[there], *to, start=starts[there] + at, length=here[there])

    placed = ranked.mapInArrow(assign, ", ".join(f"{n} long" for n in [*names, "sequence_id", "place"]) + ", part boolean")
    if cuts:
        placed = cut(placed, "placed")
        placed = placed.where(~F.col("part")).unionByName(checksums(docs, placed.where("part"), path, end, key, text))
    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("place", "mark", "part")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary())
