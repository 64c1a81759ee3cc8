"""Benchmark decontamination by pigeonhole edit matching.

A passage within k edits of an item keeps one of the item's k + 1 pieces whole. Pieces are looked up by the hash of their
first PIECE letters, computed at every place of a text at once; whoever is there is compared letter by letter; each hit
says where the item would lie, and Myers' bit-parallel distance decides. Texts and items are compared in lower case with
marks and white space as single spaces, and one space at either end: an item inside a longer word is not itself.

The benchmark is taken in blocks of at most BLOCK_BYTES of text, so what is broadcast has a bound whatever its size;
all rows meet all blocks, a scan of the texts for each.

Defined cases: null and empty texts and items match nothing; repeated items and rows are reported each; an item too
short for the budget's pieces (PIECE letters) has a smaller budget, and one of fewer than PIECE letters with its spaces
is not judged: too_short lists those; tables may be empty; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import small, table

#: Edits as a share of the item's length, and the least letters of a piece.
BUDGET, PIECE = 0.06, 8
BLOCK_BYTES = 32 << 20
#: Places of a text that are hashed at once, and bits of the first, coarse table.
STRETCH, COARSE = 1 << 18, 22
ODD = np.uint64(0x100000001B3)
MIX = np.uint64(0x9E3779B97F4A7C15)
GAPS = re.compile(r"[\W_]+")
PLAIN = {i: " " for i in range(128) if not chr(i).isalnum()}


def normal(text: str | None) -> str:
    """Lower case; whatever is neither letter nor digit, in a run, is one space, as are both ends; empty if that is all."""
    low = (text or "").lower()
    words = low.translate(PLAIN).split() if low.isascii() else GAPS.sub(" ", low).split()
    return f" {' '.join(words)} " if words else ""


def budget(item: str, share: float = BUDGET) -> int:
    return max(0, min(int(len(item) * share), len(item) // PIECE - 1))


def cut_item(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of about equal length, with their places."""
    at = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(at, at[1:], strict=False)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """The least edit distance of pattern to a part of text, and the end of the first such part."""
    m = len(pattern)
    if not m:
        return 0, 0
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def heads(text: str) -> np.ndarray:
    """At every place the hash of the PIECE letters from there on."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    h = np.zeros(max(0, len(x) - PIECE + 1), np.uint64)
    for i in range(PIECE):
        h = h * ODD + x[i : i + len(h)] + np.uint64(1)
    return (h ^ (h >> np.uint64(29))) * MIX


class Pieces:
    """The pieces of a block of items by the hash of their head: a bit for each coarse hash, then a sorted table."""

    def __init__(self, items: tuple[tuple[int, str], ...], share: float):
        self.items, self.budgets = items, [budget(item, share) for _, item in items]
        where = [(n, at, len(piece)) for n, (_, item) in enumerate(items) for at, piece in cut_item(item, self.budgets[n])]
        table = np.array(where, np.int32).reshape(-1, 3)
        first = np.cumsum([0, *(len(item) for _, item in items)])
        h = heads("".join(item for _, item in items))[first[table[:, 0]] + table[:, 1]]  # pieces are as long as a head or longer
        order = np.argsort(h, kind="stable")
        self.hashes, self.where = h[order], table[order]
        self.coarse = np.zeros(1 << COARSE, bool)
        self.coarse[(self.hashes >> np.uint64(64 - COARSE)).astype(np.int64)] = True

    def starts(self, text: str) -> dict[int, list[int]]:
        """By number of an item the places where it would start if a piece found is its own, in order."""
        out: dict[int, set[int]] = {}
        for base in range(0, max(1, len(text) - PIECE + 1), STRETCH):
            h = heads(text[base : base + STRETCH + PIECE - 1])
            maybe = np.flatnonzero(self.coarse[(h >> np.uint64(64 - COARSE)).astype(np.int64)])
            lo, hi = np.searchsorted(self.hashes, h[maybe], "left"), np.searchsorted(self.hashes, h[maybe], "right")
            for k in np.flatnonzero(hi > lo).tolist():
                place = base + int(maybe[k])
                for n, at, size in self.where[lo[k] : hi[k]].tolist():
                    if text.startswith(self.items[n][1][at : at + size], place):
                        out.setdefault(n, set()).add(place - at)
        return {n: sorted(x) for n, x in out.items()}


@lru_cache(maxsize=1)
def pieces(items: tuple[tuple[int, str], ...], share: float) -> Pieces:
    return Pieces(items, share)


def matches(text: str, made: Pieces) -> list[tuple[int, int, int]]:
    """(item number, distance, end in the normal text) of each item that lies in a normal text within its budget: its
    least distance, and the end of the first part at that distance."""
    found = []
    for n, starts in sorted(made.starts(text).items()):
        item, k = made.items[n][1], made.budgets[n]
        if (at := text.find(item)) >= 0:
            found.append((n, 0, at + len(item)))
            continue
        best, lo, hi = (k + 1, 0), None, None
        for s in [*starts, None]:  # stretches that overlap are one
            if lo is not None and (s is None or s - k > hi):
                distance, stop = myers(item, text[lo:hi])
                best = min(best, (distance, lo + stop))
                lo = None
            if s is not None:
                lo, hi = max(0, s - k) if lo is None else lo, s + len(item) + 2 * k
        if best[0] <= k:
            found.append((n, *best))
    return found


def too_short(items: DataFrame, item_key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, text) of the items that are not judged."""

    def run(batches):
        for batch in small(batches):
            yield batch.filter(pa.array([0 < len(normal(t)) < PIECE for t in batch.column(1).to_pylist()], pa.bool_()))

    return items.select(F.col(item_key).cast("long").alias("item_id"), F.col(text).alias("text")).mapInArrow(run, "item_id long, text string")


def blocks(items: DataFrame, item_key: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES):
    """The benchmark's normal items in blocks of bounded size, one after the other."""
    held: list[tuple[int, str]] = []
    size = 0
    for row in items.select(F.col(item_key).alias("k"), F.col(text).alias("t")).toLocalIterator():
        item = normal(row.t)
        if len(item) >= PIECE:
            held.append((row.k, item))
            size += len(item)
            if size >= block_bytes:
                yield tuple(held)
                held, size = [], 0
    if held:
        yield tuple(held)


def find(docs: DataFrame, items: DataFrame, share: float = BUDGET, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, distance, end) for each item that lies in a row's text; end counts the normal text's letters."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, distance int, end long"
    held = docs.select(F.col(key).cast("long"), F.col(text))

    def scan(block):
        sent = spark.sparkContext.broadcast(block)

        def run(batches):
            made = pieces(sent.value, share)
            for batch in small(batches):
                out = [(k, sent.value[n][0], d, e) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for n, d, e in matches(normal(t), made)]
                cols = list(zip(*out, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(np.array(cols[2], np.int32)), pa.array(cols[3], pa.int64())], names=["doc_id", "item_id", "distance", "end"])

        return held.mapInArrow(run, schema)

    found = None
    for block in blocks(items, item_key, item_text, block_bytes):
        found = scan(block) if found is None else found.unionByName(scan(block))
    return found if found is not None else spark.createDataFrame([], schema)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
