"""Toxicity by a subsequence string kernel.

The kernel compares words, with a mark at either end, by their common four-letter subsequences within a span of SPAN
letters, each occurrence weighted DECAY to the letters it spans, so an insult with letters inserted or doubled stays near
the insult. Before that letters are folded (case, accents, digits that stand for letters), marks inside words are taken
out, and letters that stand alone in a row are joined. Words have two letters or more.

Training rows are the distinct sentences of labelled documents; a sentence has its document's label, and one that is also
in a clean document is clean. Kernel values against landmarks (at most LANDMARKS words of toxic and of clean sentences),
whitened (Nyström), feed a squared-hinge support vector machine; a sentence enters it through its most toxic word, as a
toxic sentence has one such word at least and a clean one has none. At first these are words that toxic sentences hold far
more often than clean ones; ROUNDS more fits take the words that the last one rates highest, and leave out sentences of
toxic documents in which it finds nothing. A document is rated by its two most toxic words, through a logistic fit.

As subsequences of four letters are few, landmarks and machine fold into one table of CLASSES^4 weights: a text of any
length is scored by look-ups, in Arrow batches, with no more than a block of it unpacked at once.

Defined cases: null and empty texts have no words and the least score; without two labelled classes every score is 0;
null labels and labels of unknown ids are ignored; repeated rows are scored each. Only the text is an input of a score.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tallyloom.llm.common import small, table
from tallyloom.llm.tokens import slices

SPAN, DECAY = 6, 0.6
LANDMARKS, ROUNDS, PENALTY = 320, 2, 3e-4
#: Labelled rows that are fitted on, at most, and the bytes of the longest.
SAMPLE, SAMPLE_BYTES = 6_000, 16_384
#: Sentences of either label are fitted on through so many different words, at most; the highest rated come first.
MOST_WORDS = 6_000
#: A first positive is this many times as likely in toxic as in clean contexts; the log-likelihood ratio of that beats
#: the number of units tried by so much.
LEAST_RATIO, SURE = 10.0, 4.0
THRESHOLD = 0.5

#: 0 white space, 1..26 letters, 27..30 other letters by code point, 31 either end of a word.
CLASSES = 32
MARK, EDGE = 255, 31
#: Digits and signs read as letters.
READ_AS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


def _classes() -> np.ndarray:
    out = np.full(0x250, MARK, dtype=np.uint8)
    for i in range(0x250):
        c = chr(i)
        base = READ_AS.get(c) or unicodedata.normalize("NFKD", c)[0].lower()
        if c.isspace():
            out[i] = 0
        elif "a" <= base <= "z":
            out[i] = ord(base) - 96
        elif c.isalnum():
            out[i] = 27 + i % 4
    return out


LOW = _classes()


def letters(text: str) -> np.ndarray:
    """Classes of a text's letters, the ends of its words and gaps, starting and ending with a gap; words of one letter go."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = LOW[np.minimum(points, 0x24F)]
    if (high := points >= 0x250).any():
        out = out.copy()
        for i in np.unique(points[high]).tolist():
            c = chr(i)
            out[points == i] = 0 if c.isspace() else 27 + i % 4 if c.isalpha() else MARK
    out = np.concatenate([np.zeros(1, np.uint8), out[out != MARK], np.zeros(1, np.uint8)])
    # single letters in a row: the gaps between them go
    gap = out == 0
    lone = np.zeros(len(out), dtype=bool)
    if len(out) > 2:
        lone[1:-1] = ~gap[1:-1] & gap[:-2] & gap[2:]
        drop = np.zeros(len(out), dtype=bool)
        drop[1:-1] = gap[1:-1] & lone[:-2] & lone[2:]
        out = out[~drop]
    starts, ends = word_bounds(out)
    alone = ends - starts < 2
    keep = np.ones(len(out), dtype=bool)
    keep[starts[alone]] = False
    at = np.concatenate([starts[~alone], ends[~alone]])
    shift = np.cumsum(keep) - keep  # places before each in what is kept
    return np.insert(out[keep], shift[at], np.uint8(EDGE))


GAPS = [(a, b, c) for c in range(3, SPAN) for b in range(2, c) for a in range(1, b)]


def subsequences(seq: np.ndarray):
    """(positions, codes, weight) for each triple of offsets; what touches a gap is left to the caller."""
    x = seq.astype(np.int32)
    first, second, third = x << 15, x << 10, x << 5
    for a, b, c in GAPS:
        n = len(x) - c
        if n > 0:
            yield n, first[:n] + second[a : a + n] + third[b : b + n] + x[c : c + n], DECAY ** (c + 1)


def word_bounds(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff((seq != 0).astype(np.int8))
    return np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1


def norms(sizes: np.ndarray) -> np.ndarray:
    """Norm of a word's features by its letters and ends, as if no subsequence came twice."""
    return np.sqrt(sum(np.maximum(0, sizes - c) * DECAY ** (2 * (c + 1)) for *_, c in GAPS) + 1e-12)


NO_WORD = -4.0


def word_scores(seq: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """The machine's value for every word; subsequences that would cross a gap are cut off."""
    starts, ends = word_bounds(seq)
    if not len(starts):
        return np.zeros(0)
    end_of = np.zeros(len(seq), dtype=np.int64)
    end_of[seq != 0] = np.repeat(ends, ends - starts)
    total = np.zeros(len(seq), dtype=np.float32)
    for n, codes, weight in subsequences(seq):
        b = len(seq) - n
        part = weights[codes] * np.float32(weight)
        part[np.arange(b, b + n) >= end_of[:n]] = 0
        total[:n] += part
    sums = np.add.reduceat(total, starts) if len(starts) else np.zeros(0)
    return sums / norms(ends - starts) + bias


def two_most(values: np.ndarray) -> tuple[float, float]:
    if len(values) == 0:
        return NO_WORD, NO_WORD
    if len(values) == 1:
        return float(max(values[0], NO_WORD)), NO_WORD
    top = np.partition(values, len(values) - 2)[-2:]
    return float(max(top[1], NO_WORD)), float(max(top[0], NO_WORD))


#: Letters that are unpacked at once, and where a text may be cut behind the white space.
BLOCK = 1 << 18
SEAM = re.compile(r"[^\W_]{2}\s(?=[^\W_]{2})")


def rate(text: str, weights: np.ndarray, bias: float) -> tuple[float, float]:
    """The values of a whole text's two most toxic words. Long texts go in blocks cut at white space between words of two
    letters or digits or more; where a block has none, it goes on to the next."""
    best: list[float] = []
    at = 0
    while at < len(text):
        end = len(text)
        if at + BLOCK < end and (m := SEAM.search(text, at + BLOCK)):
            end = m.start() + 3
        best += two_most(word_scores(letters(text[at:end]), weights, bias))
        at = end
    return two_most(np.array(best))


def parts(words: list[str]):
    """(word numbers, codes, normed weights) of the subsequences of words as plain_words gives them; numbers ascend."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    seq = np.frombuffer("\0".join(words).encode("latin-1"), dtype=np.uint8)
    owner = np.repeat(np.arange(len(words)), size + 1)[: len(seq)]
    seq = np.where(seq > 0, seq - 96, 0).astype(np.uint8)
    norm = norms(size)
    for n, codes, weight in subsequences(seq):
        b = len(seq) - n
        ok = np.flatnonzero((owner[:n] == owner[b:]) & (seq[:n] != 0) & (seq[b:] != 0))
        yield owner[ok], codes[ok], (weight / norm[owner[ok]]).astype(np.float32)


def plain_words(sentence: str) -> list[str]:
    """The words of a sentence as strings of classes, in the same folding as the scorer's."""
    seq = letters(sentence)
    starts, ends = word_bounds(seq)
    return ["".join(map(chr, (seq[a:b] + 96).tolist())) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def machine(kernel: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine in the primal, by Newton steps over the rows inside the margin."""
    x = np.hstack([kernel, np.ones((len(kernel), 1))])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-8
    w = np.zeros(x.shape[1])
    value = lambda w: (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum() / 2 + (ridge * w * w).sum() / 2
    for _ in range(40):
        inside = 1 - y * (x @ w) > 0
        xi, wi = x[inside], weight[inside]
        h = (xi * wi[:, None]).T @ xi + np.diag(ridge)
        full = np.linalg.solve(h, (xi * wi[:, None]).T @ y[inside])
        step, now = 1.0, value(w)
        while step > 1e-6 and value(w + step * (full - w)) > now:
            step /= 2
        moved = step * (full - w)
        w = w + moved
        if np.abs(moved).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def nystrom(positive: Counter, negative: Counter, landmarks: list[str]) -> tuple[np.ndarray, float]:
    """Kernel values against the landmarks, whitened, through the machine, and folded into weights of subsequences. A word
    weighs as the root of the sentences it stands for, so none stands for all."""
    cells, rows_of, weight = (np.concatenate(c) for c in zip(*((c, r, w) for r, c, w in parts(landmarks)), strict=True))
    used, cells = np.unique(cells, return_inverse=True)
    dense = np.zeros((len(used) + 1, len(landmarks)), np.float32)  # the last row is for subsequences of no landmark
    np.add.at(dense, (cells, rows_of), weight)
    values, vectors = np.linalg.eigh(dense.T @ dense)
    keep = values > 1e-5 * values[-1]
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    find = np.full(CLASSES**4, len(used), dtype=np.int32)
    find[used] = np.arange(len(used))

    def against(words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(landmarks)), np.float32)
        for at in range(0, len(words), 2000):
            for rows_of, codes, weight in parts(words[at : at + 2000]):
                cells = find[codes]
                ok = cells < len(used)
                rows_of, cells, weight = rows_of[ok], cells[ok], weight[ok]
                if len(cells):
                    firsts = np.flatnonzero(np.diff(rows_of, prepend=-1))
                    out[at + rows_of[firsts]] += np.add.reduceat(dense[cells] * weight[:, None], firsts)
        return out @ whiten

    k = np.vstack([against(list(positive)), against(list(negative))]).astype(np.float64)
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    share = [np.sqrt(np.array(list(c.values()), float)) for c in (positive, negative)]
    w, bias = machine(k, y, np.concatenate([0.5 * x / max(1e-9, x.sum()) for x in share]))
    weights = np.zeros(CLASSES**4, np.float32)
    weights[used] = dense[:-1] @ (whiten @ w)
    return weights, bias


def scores_of(words: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(words), bias)
    for at in range(0, len(words), 20_000):
        for rows_of, codes, weight in parts(words[at : at + 20_000]):
            np.add.at(out, at + rows_of, weights[codes] * weight)
    return out


def units(word: str) -> set[str]:
    """What may carry a word's meaning: the word, and its runs of 4 and 5 letters."""
    return {f" {word} ", *(word[i : i + n] for n in (4, 5) for i in range(len(word) - n + 1))}


def enriched(clean: Counter, toxic: Counter) -> list[str]:
    """Toxic words with a unit whose share of toxic sentences chance does not explain, most frequent first."""
    in_clean, in_toxic = Counter(), Counter()
    for words, into in ((clean, in_clean), (toxic, in_toxic)):
        for w, k in words.items():
            for u in units(w):
                into[u] += k
    n0, n1 = sum(clean.values()), sum(toxic.values())
    least = np.log(len(in_toxic)) + SURE
    good = {}
    for u, k in in_toxic.items():
        c = in_clean[u]
        if (k / n1) >= LEAST_RATIO * ((c + 0.5) / n0):
            both = (k + c) / (n0 + n1)
            gain = k * np.log(k / n1 / both) + (c * np.log(c / n0 / both) if c else 0)
            if gain > least:
                good[u] = gain
    return sorted((w for w in toxic if any(u in good for u in units(w)) and toxic[w] / n1 >= LEAST_RATIO * clean[w] / n0), key=lambda w: (-toxic[w], w))


def sentences(rows: list[tuple[str, int]]) -> tuple[list[list[str]], list[list[str]]]:
    """The words of the distinct clean and of the distinct toxic sentences."""
    out: tuple[list, list] = ([], [])
    seen: set[str] = set()
    one: dict[str, str] = {}  # a word is held once
    for label in (0, 1):  # a sentence that is in a clean document is clean
        for text, mark in rows:
            if mark == label:
                for s in re.split(r"[.!?\n]+", text):
                    if s not in seen:
                        seen.add(s)
                        if found := plain_words(s):
                            out[label].append([one.setdefault(w, w) for w in found])
    return out


def chosen(bags: list[list[str]], value: dict[str, float], least: float = -np.inf) -> Counter:
    """The highest rated word of each sentence that has one above least, with the sentences it stands for."""
    best = (max(bag, key=lambda w: (value[w], w)) for bag in bags)
    found = Counter(w for w in best if value[w] > least)
    return Counter(dict(sorted(found.items(), key=lambda x: (-value[x[0]], x[0]))[:MOST_WORDS]))


def fit(rows: list[tuple[str, int]]) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights of subsequences, bias, and the logistic fit over (1, most, second) of a document, on (text, label)."""
    none = np.zeros(CLASSES**4, np.float32), 0.0, np.array([-40.0, 0.0, 0.0])
    clean, toxic = sentences(rows)
    if not clean or not toxic:
        return none
    held = [Counter(w for bag in bags for w in set(bag)) for bags in (clean, toxic)]
    sure = enriched(*held)
    if not sure:
        return none
    by_hash = lambda w: zlib.crc32(w.encode())
    every = sorted({*held[0], *held[1]}, key=by_hash)
    value = dict.fromkeys(every, 0.0) | dict.fromkeys(sure, 1.0)
    rest = [w for w in every if held[0][w] and value[w] == 0]
    hard = rest[: LANDMARKS // 2]
    for _ in range(ROUNDS + 1):
        positive, negative = chosen(toxic, value, 0.5), chosen(clean, value)
        negative |= Counter({w: held[0][w] for w in rest[: MOST_WORDS // 2]})  # and words of clean sentences as they come
        marks = [w for w, _ in sorted(positive.items(), key=lambda x: (-x[1], x[0]))[: LANDMARKS // 2]]
        weights, bias = nystrom(positive, negative, list(dict.fromkeys(marks + hard)))
        value = dict(zip(every, scores_of(every, weights, bias).tolist(), strict=True))
        # clean words that look most toxic are landmarks of the next fit
        hard = [w for w in chosen(clean, value) if w not in positive][: LANDMARKS // 2]
    x = np.array([(1.0, *rate(t, weights, bias)) for t, _ in rows])
    y = np.array([m for _, m in rows], dtype=float)
    b = np.zeros(3)
    for _ in range(30):  # logistic regression with a light ridge, by Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (p - y) + 0.01 * b
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(3)
        d = np.linalg.solve(h, g)
        b = b - d / max(1.0, np.abs(d).max() / 2)
        if np.abs(d).max() < 1e-8:
            break
    return weights, bias, b


def held_out(key) -> F.Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, key: str = "doc_id", text: str = "text"):
    """Fits on the labelled rows of least hash that are not held out; toxic rows come first."""
    marked = labels.select(F.col(key).alias("_k"), F.col("toxic").alias("_y")).where(F.col("toxic").isin(0, 1) & ~held_out(F.col(key)))
    order = [F.xxhash64("_k"), F.col("_k"), F.col("_y")]
    # of either class so many rows: the rarer one would else be thin
    picked = marked.where("_y = 1").orderBy(*order).limit(sample // 3).unionByName(marked.where("_y = 0").orderBy(*order).limit(sample - sample // 3))
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where(F.octet_length("_t") <= sample_bytes).join(F.broadcast(picked), "_k").select("_t", "_y").collect()
    return fit(sorted((r._t, r._y) for r in rows))


def score(docs: DataFrame, model, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with score and predicted; columns of those names are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = StructType([*docs.select(*kept).schema, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    at = kept.index(text)

    def run(batches):
        weights, bias, b = sent.value
        for batch in small(batches):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            x = np.array([(1.0, *rate(t, weights, bias)) for t in texts]).reshape(-1, 3)
            p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return docs.select(*kept).mapInArrow(run, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rated = score(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return rated.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
