"""Quality by hashed n-grams: a calibrated logistic regression over word and character n-grams.

Features are shares: of a text's words and word pairs, and of its character (code point) 3-, 4- and 5-grams, in BUCKETS
hash buckets a kind. A score is a bias and, for each kind, the mean weight of the text's n-grams, so an Arrow batch is scored by table
look-ups and sums by text. The regression is fitted on a bounded sample of labelled rows (SAMPLE rows of at most
SAMPLE_BYTES bytes each, least by hash of id); a part of it, HELD of ten, only calibrates the probability.

Long texts are read in stretches, so a worker holds a few arrays of a stretch beside the text.

Defined cases: a null text has no words and fails the base rules; without two labelled classes every text has
probability 1/2 and passes; labels that are null or for unknown ids are ignored; repeated label rows count once each.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import small, table
from tallyloom.llm.tokens import slices

BUCKETS = 1 << 14
SAMPLE, SAMPLE_BYTES, HELD = 1500, 8_192, 3
#: A text is kept at this probability of good quality or more.
THRESHOLD = 0.5
CHAR_GRAMS = (3, 4, 5)
KINDS = 2 + len(CHAR_GRAMS)
MIX = np.uint64(0x9E3779B97F4A7C15)
ODD = np.uint64(0x100000001B3)
INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))
SYMBOLS = b"#*$%&|<>"
#: A text of more characters than this is read in stretches of so many.
STRETCH = 1_000_000


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    if len(text) > STRETCH:
        return _long_counts(text)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # at the six ASCII white-space bytes
    n = len(words)
    gaps = len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        edges = np.zeros(n + 1, dtype=np.int64)
        hit = np.array([often[w] > 1 for w in windows])
        at = np.flatnonzero(hit)
        np.add.at(edges, at, 1)
        np.add.at(edges, at + 5, -1)
        repeated = int((np.cumsum(edges)[:n] > 0).sum())
    return n, len(text) - gaps, symbols, len(lines) - len(set(lines)), repeated


def _long_counts(text: str) -> tuple[int, int, int, int, int]:
    """As base_counts: words are numbers, and windows of five are numbered by way of pairs and fours."""
    numbers: dict[bytes, int] = {}
    parts, letters, symbols, lines, filled, rest = [], 0, 0, set(), 0, b""
    for at in range(0, len(text), STRETCH):
        raw = rest + text[at : at + STRETCH].encode("utf-8", "surrogatepass")
        end = len(raw) if at + STRETCH >= len(text) else 1 + max(raw.rfind(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
        raw, rest = raw[:end], raw[end:]
        symbols += len(raw) - len(raw.translate(None, SYMBOLS))
        words = raw.split()
        letters += sum(len(w) - sum(128 <= b < 192 for b in w) for w in words) if not raw.isascii() else sum(map(len, words))
        parts.append(np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64))
    at = 0
    while at <= len(text):
        end = text.find("\n", at)
        line = text[at : end if end >= 0 else len(text)]
        if line.strip(" \t\n\x0b\x0c\r"):
            filled += 1
            lines.add(line)
        if end < 0:
            break
        at = end + 1
    ids = np.concatenate(parts)
    n = len(ids)
    repeated = 0
    if n >= 5:
        join = lambda a, b: np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]
        two = join(ids[:-1], ids[1:])
        four = join(two[:-2], two[2:])
        _, five, often = np.unique(four[: n - 4] * (int(ids.max()) + 1) + ids[4:], return_inverse=True, return_counts=True)
        at = np.flatnonzero(often[five] > 1)
        edges = np.zeros(n + 1, dtype=np.int64)
        np.add.at(edges, at, 1)
        np.add.at(edges, at + 5, -1)
        repeated = int((np.cumsum(edges)[:n] > 0).sum())
    return n, letters, symbols, filled - len(lines), repeated


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * MIX
    return (h >> np.uint64(50)).astype(np.int32)


def hashed(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram its bucket at every position, and the number of the text at each position."""
    data = np.frombuffer("".join(f"{t}\n" for t in texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    out = []
    space = (data == 32) | ((data >= 9) & (data <= 13))
    # words: polynomial hashes from running sums, brought to power 0 by the inverse of the odd base
    power = np.cumprod(np.full(len(data) + 1, ODD, dtype=np.uint64)) * INVERSE
    back = np.cumprod(np.full(len(data) + 1, INVERSE, dtype=np.uint64)) * ODD
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * power[:-1])])
    edge = np.diff(np.concatenate([[0], (~space).astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    words = (sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64)
    of = owner[starts] if len(starts) else np.zeros(0, np.int32)
    out.append((_bucket(words), of))
    pair = of[1:] == of[:-1]
    out.append((_bucket(words[:-1] * MIX + words[1:])[pair], of[1:][pair]))
    h = data + np.uint64(1)
    for n in range(2, max(CHAR_GRAMS) + 1):
        h = h[:-1] * ODD + data[n - 1 :] + np.uint64(1)
        if n in CHAR_GRAMS:
            inside = owner[n - 1 :] == owner[: len(owner) - n + 1]
            out.append((_bucket(h)[inside], owner[: len(owner) - n + 1][inside]))
    return out


def _long_logit(text: str, weights: np.ndarray, bias: float) -> float:
    """As logit, a stretch at a time: n-grams look a few characters ahead, and a word or pair goes on in the next stretch."""
    sums, counts = np.zeros(KINDS), np.zeros(KINDS)
    last: np.ndarray = np.zeros(0, np.uint64)  # the word before
    held, size = np.uint64(0), 0  # what is known of a word that is not over

    def take(kind: int, h: np.ndarray) -> None:
        sums[kind] += weights[kind][_bucket(h)].sum(dtype=np.float64)
        counts[kind] += len(h)

    for at in range(0, len(text), STRETCH):
        end = min(len(text), at + STRETCH)
        final = end == len(text)
        ahead = end + max(CHAR_GRAMS) - 1
        piece = text[at:ahead] + ("\n" if ahead > len(text) else "")  # a text ends in a line break
        data = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        h = data + np.uint64(1)
        for n in range(2, max(CHAR_GRAMS) + 1):
            h = h[:-1] * ODD + data[n - 1 :] + np.uint64(1)
            if n in CHAR_GRAMS:
                take(2 + CHAR_GRAMS.index(n), h if final else h[: end - at])
        data = data[: end - at]
        space = (data == 32) | ((data >= 9) & (data <= 13))
        power = np.cumprod(np.full(len(data) + 1, ODD, dtype=np.uint64)) * INVERSE
        back = np.cumprod(np.full(len(data) + 1, INVERSE, dtype=np.uint64)) * ODD
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * power[:-1])])
        edge = np.diff(np.concatenate([[0], (~space).astype(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        raw, sizes = (running[ends] - running[starts]) * back[starts], (ends - starts).astype(np.uint64)
        if size and len(starts) and starts[0] == 0:
            raw[0] = held + np.uint64(pow(int(ODD), size, 1 << 64)) * raw[0]
            sizes[0] += np.uint64(size)
        elif size:
            raw, sizes = np.concatenate([[held], raw]), np.concatenate([np.array([size], np.uint64), sizes])
        held, size = np.uint64(0), 0
        if not final and len(raw) and not space[-1]:
            held, size = raw[-1], int(sizes[-1])
            raw, sizes = raw[:-1], sizes[:-1]
        words = raw + sizes
        take(0, words)
        both = np.concatenate([last, words])
        take(1, both[:-1] * MIX + both[1:])
        last = both[-1:]
    return bias + float((sums / np.maximum(counts, 1)).sum())


def logit(texts: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """bias plus, for each kind, the mean weight of the text's n-grams."""
    if any(len(t) > STRETCH for t in texts):
        return np.array([_long_logit(t, weights, bias) if len(t) > STRETCH else logit([t], weights, bias)[0] for t in texts])
    z = np.full(len(texts), bias)
    for kind, (bucket, owner) in enumerate(hashed(texts)):
        n = np.bincount(owner, minlength=len(texts))
        z += np.bincount(owner, weights=weights[kind][bucket], minlength=len(texts)) / np.maximum(n, 1)
    return z


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its feature numbers and values."""
    kinds = hashed(texts)
    out = []
    for i in range(len(texts)):
        where, what = [], []
        for kind, (bucket, owner) in enumerate(kinds):
            lo, hi = np.searchsorted(owner, [i, i + 1])
            cells, n = np.unique(bucket[lo:hi], return_counts=True)
            where.append(cells.astype(np.int32) + kind * BUCKETS)
            what.append((n / max(1, hi - lo)).astype(np.float32))
        out.append((np.concatenate(where), np.concatenate(what)))
    return out


def descend(loss, x: np.ndarray, rounds: int = 60, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking; loss gives value and gradient."""
    value, slope = loss(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, marks = -slope, []
        for s, y in reversed(past):
            a = s @ d / (s @ y)
            marks.append(a)
            d = d - a * y
        if past:
            s, y = past[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(marks), strict=True):
            d = d + s * (a - y @ d / (s @ y))
        step = 1.0 if past else 1.0 / max(1e-12, float(np.abs(slope).sum()))
        while step > 1e-10:
            new, new_slope = loss(x + step * d)
            if new <= value + 1e-4 * step * (slope @ d):
                break
            step /= 2
        else:
            break
        s, y = step * d, new_slope - slope
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        done = value - new < 1e-7 * max(1.0, abs(value))
        x, value, slope = x + s, new, new_slope
        if done:
            break
    return x


def fit(rows: list[tuple[np.ndarray, np.ndarray, int, bool]], penalty: float = 2e-5) -> tuple[np.ndarray, float]:
    """Weights by kind and bucket, and bias, on rows (feature numbers, values, label, calibrates only)."""
    weights = np.zeros((KINDS, BUCKETS))
    train, held = [r for r in rows if not r[3]], [r for r in rows if r[3]]
    if len({r[2] for r in train}) < 2:
        return weights, 0.0
    cols = np.concatenate([r[0] for r in train])
    vals = np.concatenate([r[1] for r in train])
    row = np.repeat(np.arange(len(train), dtype=np.int32), [len(r[0]) for r in train])
    y = np.array([r[2] for r in train], dtype=float)
    scale = 1.0 / np.sqrt(np.bincount(cols, weights=vals * vals, minlength=KINDS * BUCKETS) / len(train) + 1e-7)  # kinds of rare buckets weigh as common ones
    vals *= scale[cols].astype(np.float32)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))

    def loss(x):
        z = np.bincount(row, weights=vals * x[:-1][cols], minlength=len(y)) + x[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        r = balance * (p - y)
        value = (balance * (np.logaddexp(0, z) - y * z)).mean() + penalty * (x[:-1] @ x[:-1]) / 2
        return value, np.append(np.bincount(cols, weights=vals * r[row], minlength=len(x) - 1) / len(y) + penalty * x[:-1], r.mean())

    x = descend(loss, np.zeros(KINDS * BUCKETS + 1), 40)
    w, bias = x[:-1] * scale, float(x[-1])
    if len({r[2] for r in held}) == 2:  # Platt scaling
        z = np.array([r[1] @ w[r[0]] + bias for r in held])
        t = np.array([r[2] for r in held], dtype=float)
        goal = np.where(t == 1, (t.sum() + 1) / (t.sum() + 2), 1 / (len(t) - t.sum() + 2))
        spread = float(z.std()) or 1.0

        def scaled(ab):
            v = ab[0] * z / spread + ab[1]
            r = 1 / (1 + np.exp(-np.clip(v, -40, 40))) - goal
            return (np.logaddexp(0, v) - goal * v).mean(), np.array([(r * z).mean() / spread, r.mean()])

        a, b = descend(scaled, np.array([spread, 0.0]), 200)
        if a > 0:
            w, bias = w * a / spread, float(bias * a / spread + b)
    return w.reshape(KINDS, BUCKETS), bias


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, key: str = "doc_id", text: str = "text") -> tuple[np.ndarray, float]:
    """Fits on the labelled rows of least hash. Tasks hash the texts; a bounded sample's features reach the driver."""
    marked = labels.select(F.col(key).alias("_k"), F.col(label).alias("_label")).where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    picked = marked.orderBy(F.xxhash64("_k"), "_k", "_label").limit(2 * sample)  # some of them are too long
    short = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where(F.octet_length("_t") <= sample_bytes)
    chosen = short.join(F.broadcast(picked), "_k").orderBy(F.xxhash64("_k"), "_k", "_label").limit(sample).select("_t", "_label", (F.pmod(F.xxhash64("_k", F.lit(1)), F.lit(10)) < HELD).alias("_held"))

    def hash_them(batches):
        for batch in batches:
            texts, rest = batch.column(0).to_pylist(), batch.columns[1:]
            for a in range(0, len(texts), 200):
                f = features(texts[a : a + 200])
                yield pa.RecordBatch.from_arrays([pa.array([x[0].tobytes() for x in f], pa.binary()), pa.array([x[1].tobytes() for x in f], pa.binary()), *[c.slice(a, 200) for c in rest]], names=["cols", "vals", "label", "held"])

    rows = chosen.repartition(partitions_for(docs.sparkSession), "_t").mapInArrow(hash_them, "cols binary, vals binary, label int, held boolean").collect()
    return fit([(np.frombuffer(r.cols, np.int32), np.frombuffer(r.vals, np.float32), r.label, r.held) for r in sorted(rows, key=lambda r: (r.label, r.held, bytes(r.cols)))])


def partitions_for(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base counts, base_failed, probability, kept) for every row."""
    held = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"]

    def rate(batches):
        weights, bias = held.value
        for batch in small(batches):
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts, 1_000_000):
                base = np.array([base_counts(t) for t in texts[a:b]], dtype=np.int64).reshape(-1, 5)
                p = 1 / (1 + np.exp(-np.clip(logit(texts[a:b], weights, bias), -40, 40)))
                failed = (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), *[pa.array(c) for c in base.T], pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))], names=names)

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(rate, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).drop("probability")
