"""Token links between two tokenizers, and how many documents hold each linked pair of ids.

A text and a space before it is encoded by a byte-level vocabulary (A) and by a piece vocabulary (B, which adds the space
itself). Byte offsets where tokens of both end cut a text into groups; tokens whose byte ranges overlap are linked.

Texts are cut before a single space or line break that stands between two visible characters: neither vocabulary has a
token across such a place (checked when B is read), so a chunk's tokens do not depend on what is around it, and a bounded
table of chunks already seen does most of the work. New chunks are encoded in rows and aligned in NumPy: ends by
cumsum, common cuts by intersect1d, group numbers by searchsorted, links by repeat. A document with a chunk whose bytes
do not come back is encoded again as a whole, and has no tokens if its bytes do not come back either.

Documents, with their distinct pairs, are written once. Pairs are summed in each task, then by pair and salt, then by
pair. The commonest pairs, at most HOT_PAIRS of them, go to all tasks; links of rarer pairs, none of which is in many
documents, meet their counts in a join. Best counts are a row for each id of A at most.

Defined cases: null and empty texts, and texts that do not come back, have zeros and no groups; repeated rows count as
documents of their own; null ids are kept; an empty table gives an empty result; other columns are ignored. A chunk is
encoded in one piece however long it is.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import cut, small, table
from tallyloom.llm.tokens import seldom_collect, slices, vocabulary

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A pair of ids is a * 2^B_BITS + b.
B_BITS = 15
#: Bytes of known chunks in a worker before it drops the rarer half.
TABLE_BYTES = 128 << 20
#: Chunks that are encoded in a row, and letters of the longest of them.
ROW, LONG = 1000, 200
#: Pairs whose counts go to every task, at most; 12 bytes each.
HOT_PAIRS = 1 << 20
#: Distinct pairs a task holds before it passes its sums on.
HELD_PAIRS = 1 << 20
SALTS = 16
PLACE = re.compile(r"(?<=\S)(?=[ \n]\S)")
COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def chunks_of(text: str) -> list[str]:
    """The text, which begins with a space; each chunk but the first has the space or line break before it."""
    words = text.split()
    n = text.count(" ") + text.count("\n")
    # white space is single spaces and line breaks, each before a word
    if n == len(words) and n + sum(map(len, words)) == len(text) and "\0" not in text:
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")[1:]
    return PLACE.split(text)


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        # the byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 up, in order
        alphabet = set(pre_tokenizers.ByteLevel.alphabet())
        own = {ord(c): ord(c) for c in alphabet if ord(c) < 256}
        own |= {ord(c): b for c, b in zip(sorted(c for c in alphabet if ord(c) > 255), (b for b in range(256) if chr(b) not in alphabet), strict=True)}
        self.bytes_a = [bytes(own.get(ord(c), 0) for c in self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁|\n", p) for p in pieces) or len(pieces) > 1 << B_BITS:
            raise ValueError("pieces may lie across words, or are too many")
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in of], dtype=np.int64) for of in (self.bytes_a, self.bytes_b))
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[bytes | None] = []  # None: the bytes do not come back
        self.counts = np.zeros((0, 4), dtype=np.int64)  # tokens of A, of B, groups, links
        self.used = np.zeros(0, dtype=np.int64)  # documents that had it
        self.first = np.zeros(1, dtype=np.int64)  # of each chunk's links
        self.links = np.zeros(0, dtype=np.int32)
        self.held = 0

    def encode(self, chunks: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each chunk by A and by B."""
        a = [np.array(e.ids, dtype=np.int64) for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        b = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        return a, [np.array(x if c[0] == " " else x[1:], dtype=np.int64) for x, c in zip(b, chunks, strict=True)]

    def joined(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of A and of B over the chunks in a row, their ends in bytes, and the chunks' ends; None where bytes do not
        come back or a token lies across a chunk's end, so that the chunks have to be looked at one by one."""
        text = "".join(chunks)
        (a,), (b,) = self.encode([text])
        raw = text.encode()
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != raw or b"".join(map(self.bytes_b.__getitem__, b.tolist())) != raw:
            return None
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.cumsum([len(c) for c in chunks] if len(raw) == len(text) else [len(c.encode()) for c in chunks])
        return (a, b, ends_a, ends_b, ends) if np.isin(ends, ends_a, kind="sort").all() and np.isin(ends, ends_b, kind="sort").all() else None

    def align(self, chunks: list[str]) -> tuple[list[bytes | None], np.ndarray, np.ndarray, np.ndarray]:
        """For each chunk its groups as bytes and its counts, then where its links end, and all links as pairs."""
        if (found := self.joined(chunks)) is None:
            if len(chunks) == 1:
                return [None], np.zeros((1, 4), dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int32)
            half = len(chunks) // 2
            one, two = self.align(chunks[:half]), self.align(chunks[half:])
            return one[0] + two[0], np.concatenate([one[1], two[1]]), np.concatenate([one[2], len(one[3]) + two[2]]), np.concatenate([one[3], two[3]])
        ids_a, ids_b, ends_a, ends_b, ends = found
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        starts_a, starts_b = ends_a - self.size_a[ids_a], ends_b - self.size_b[ids_b]
        low, high = np.searchsorted(ends_b, starts_a, side="right"), np.searchsorted(starts_b, ends_a, side="left")
        n = high - low  # tokens of B that each token of A overlaps
        link_b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        links = (np.repeat(ids_a, n) << B_BITS | ids_b[link_b]).astype(np.int32)
        of_a, of_b, of_cut = (np.searchsorted(ends, x) for x in (ends_a, ends_b, cuts))
        count = lambda of, weights=None: np.bincount(of, weights=weights, minlength=len(chunks)).astype(np.int64)
        n_groups, n_links = count(of_cut), count(of_a, n)
        at_a, at_b = (np.searchsorted(g, np.arange(len(cuts) + 1)).tolist() for g in (group_a, group_b))
        text_a, text_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        said = [f"{text_a[i] if j == i + 1 else ','.join(text_a[i:j])}|{text_b[k] if m == k + 1 else ','.join(text_b[k:m])}" for i, j, k, m in zip(at_a, at_a[1:], at_b, at_b[1:], strict=False)]
        at = np.concatenate([[0], np.cumsum(n_groups)]).tolist()
        groups = [";".join(said[i:j]).encode() for i, j in zip(at, at[1:], strict=False)]
        return groups, np.stack([count(of_a), count(of_b), n_groups, n_links], axis=1), np.cumsum(n_links), links

    def learn(self, chunks: list[str]) -> None:
        """Chunks that are a space or a line break and visible characters are encoded in a row, others one by one."""
        even = [c for c in chunks if len(c) <= LONG and len(c[1:].split(None, 1)) == 1 and not c[1].isspace() and not c[-1].isspace()]
        odd = set(chunks).difference(even)
        made = [self.align(even[k : k + ROW]) for k in range(0, len(even), ROW)] + [self.align([c]) for c in odd]
        self.known |= {c: k for k, c in enumerate([*even, *odd], len(self.groups))}
        links, at = [self.links], len(self.links)
        first = [self.first]
        for groups, _, ends, new in made:
            self.groups += groups
            first.append(at + ends)
            links.append(new)
            at += len(new)
        self.counts = np.concatenate([self.counts, *(m[1] for m in made)])
        self.used = np.concatenate([self.used, np.zeros(len(chunks), dtype=np.int64)])
        self.first, self.links = np.concatenate(first), np.concatenate(links)
        self.held += sum(map(len, chunks)) + sum(len(g or b"") for m in made for g in m[0]) + 4 * sum(len(m[3]) for m in made) + 350 * len(chunks)

    def shrink(self) -> None:
        """Keeps the half of the chunks that most documents had."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[: len(self.used) // 2])
        names = list(self.known)
        n = self.first[keep + 1] - self.first[keep]
        self.links = self.links[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[keep], n)]
        self.first = np.concatenate([[0], np.cumsum(n)])
        self.counts, self.used = self.counts[keep], self.used[keep] // 2
        self.groups = [self.groups[k] for k in keep.tolist()]
        self.known = {names[k]: i for i, k in enumerate(keep.tolist())}
        self.held = sum(map(len, self.known)) + sum(len(g or b"") for g in self.groups) + 4 * len(self.links) + 350 * len(keep)

    def document(self, chunks: list[str]) -> tuple:
        """n_a, n_b, n_groups, n_links, hash of the groups, distinct pairs and how often each is linked."""
        of = list(map(self.known.__getitem__, chunks))
        groups = [self.groups[k] for k in of]
        if None not in groups:
            distinct, times = np.unique(np.array(of), return_counts=True)
            self.used[distinct] += 1
            counts = times @ self.counts[distinct]
            n = self.first[distinct + 1] - self.first[distinct]
            links = self.links[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[distinct], n)]
            each = np.repeat(times, n)
        else:
            groups, counts, _, links = self.align(["".join(chunks)])
            counts, each = counts[0], np.ones(len(links), dtype=np.int64)
            if groups[0] is None:
                return NOTHING
        order = np.argsort(links, kind="stable")
        links = links[order]
        starts = np.flatnonzero(np.concatenate([[True], links[1:] != links[:-1]]))
        sums = np.add.reduceat(each[order], starts)
        return *counts.tolist(), hashlib.sha256(b";".join(groups)).hexdigest(), links[starts].astype("<i4").tobytes(), sums.astype("<i8").tobytes()

    def documents(self, texts: list[str]) -> list[tuple]:
        split = [chunks_of(" " + t) if t else [] for t in texts]
        while self.held > TABLE_BYTES and self.groups:
            self.shrink()
        if new := set().union(*split).difference(self.known):
            self.learn(list(new))
        return [self.document(s) if s else NOTHING for s in split]


NOTHING = (0, 0, 0, 0, "", b"", b"")


@cache
def aligner(path_a: str, path_b: str) -> Aligner:
    seldom_collect()
    return Aligner(path_a, path_b)


def alignments(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: counts, hash of its groups, and its distinct pairs with how often each is linked."""

    def run(batches):
        made = aligner(path_a, path_b)
        for batch in small(batches):
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in slices(texts, 500_000):
                rows = list(zip(*made.documents(texts[lo:hi]), strict=True))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([keys[lo:hi], *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))], names=[c.split()[0] for c in COLUMNS.split(", ")])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, COLUMNS)


def pair_counts(aligned: DataFrame, salts: int = SALTS) -> DataFrame:
    """(pair, n): in how many documents a pair is linked."""

    def run(batches):
        held, sums, waiting, size = np.zeros(0, np.int32), np.zeros(0, np.int64), [], 0

        def merge():
            both = np.concatenate([held, *waiting])
            weights = np.concatenate([sums, np.ones(len(both) - len(held), np.int64)])
            keys, of = np.unique(both, return_inverse=True)
            return keys, np.bincount(of, weights=weights, minlength=len(keys)).astype(np.int64)

        for batch in batches:
            for raw in batch.column(0):
                waiting.append(np.frombuffer(raw.as_buffer(), "<i4"))
                size += len(waiting[-1])
                if size >= HELD_PAIRS:
                    held, sums = merge()
                    waiting, size = [], 0
                    if len(held) >= HELD_PAIRS:
                        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums)], names=["pair", "n"])
                        held, sums = held[:0], sums[:0]
        held, sums = merge()
        for lo in range(0, len(held), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(held[lo : lo + (1 << 16)]), pa.array(sums[lo : lo + (1 << 16)])], names=["pair", "n"])

    summed = aligned.select("pairs").mapInArrow(run, "pair int, n long")
    salted = summed.withColumn("salt", F.spark_partition_id() % salts).groupBy("pair", "salt").agg(F.sum("n").alias("n"))
    return salted.groupBy("pair").agg(F.sum("n").alias("n"))


def least_hot(pairs: DataFrame, room: int = HOT_PAIRS) -> int:
    """The least count n so that at most room pairs have n or more; counts are told apart by an eighth of a doubling."""
    step = F.floor(F.log2("n") * 8)
    rows = sorted(pairs.groupBy(step.alias("step")).agg(F.count("*").alias("rows"), F.min("n").alias("least")).collect(), key=lambda r: -r.step)
    least, held = 1 << 62, 0
    for r in rows:
        held += r.rows
        if held > room:
            break
        least = r.least
    return least


def linked(docs: DataFrame, path_a: str, path_b: str, room: int = HOT_PAIRS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with its counts, n_best and count_sum."""
    spark = docs.sparkSession
    aligned = cut(alignments(docs, path_a, path_b, key, text).withColumn("row", F.monotonically_increasing_id()), "aligned")
    pairs = cut(pair_counts(aligned), "pairs")
    best = pairs.groupBy(F.shiftright("pair", B_BITS).alias("a")).agg(F.max("n").alias("best"))  # a row for each id of A at most
    least = least_hot(pairs, room)
    top, hot = best.toArrow(), pairs.where(F.col("n") >= least).orderBy("pair").toArrow()
    most = np.zeros(1 << 31 - B_BITS, dtype=np.int64)
    most[top["a"].to_numpy()] = top["best"].to_numpy()
    sent = spark.sparkContext.broadcast((most, hot["pair"].to_numpy(), hot["n"].to_numpy()))

    def known(raw_pairs, raw_times):
        most, keys, counts = sent.value
        pairs, times = np.frombuffer(raw_pairs.as_buffer(), "<i4"), np.frombuffer(raw_times.as_buffer(), "<i8")
        at = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
        hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), dtype=bool)
        return pairs, times, hit, np.where(hit, counts[at], 0) if len(keys) else np.zeros(len(pairs), np.int64), most[pairs >> B_BITS]

    def total(batches):
        for batch in batches:
            got = []
            for raw in zip(batch.column(6), batch.column(7), strict=True):
                _, times, hit, n, top = known(*raw)
                got.append((int(times[hit & (n == top)].sum()), int((times * n).sum())))
            sums = list(zip(*got, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], batch.column(8), *(pa.array(c, pa.int64()) for c in sums)], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "row", "n_best", "count_sum"])

    def others(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                pairs, times, hit, _, _ = known(batch.column(6)[k], batch.column(7)[k])
                rare = ~hit
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rare.sum(), batch.column(8)[k].as_py())), pa.array(pairs[rare]), pa.array(times[rare])], names=["row", "pair", "times"])

    first = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, row long, n_best long, count_sum long"
    out = aligned.mapInArrow(total, first)
    rare = pairs.where(F.col("n") < least)
    if not rare.isEmpty():
        met = aligned.mapInArrow(others, "row long, pair int, times long").join(rare, "pair").join(F.broadcast(best), F.shiftright("pair", B_BITS) == F.col("a"))
        more = met.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
        out = out.join(more, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE), vocabulary(PIECE_BPE))
