"""Language by error-correcting output codes.

Each language has a codeword; a binary classifier over letter n-grams predicts each bit of it. N-grams of 1 to 4 letters
(other characters are a space) are counted by language over all rows to learn from, in BUCKETS hash buckets a length; a
bit's weights are log ratios of the mean smoothed shares of its languages of 1 and of 0. A text's margin for a bit is the
mean weight of its n-grams. A bounded sample of labelled rows, left out of the counts, scales margins to log odds and
measures how often each bit is right for each language. Decoding is loss-weighted: the codeword with the least logistic
loss, bits weighted by that rate, wins; where the next one is nearly as close the text is marked ambiguous.

Up to seven languages have the exhaustive code of 2^(n-1) - 1 bits; more have the best of many random codes.

Whole texts are used: stretches of STRETCH letters, cut after a space where there is one, are counted on their own.

Defined cases: a null text, and one without a letter, is `und` with score 0 and never taught; null languages and null ids
teach nothing; without a language to learn all texts are `und`; with one, it is the answer at score 1; repeated rows
count each; an empty table gives an empty result; other columns are ignored. Over MOST languages are an error.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import small, table

GRAMS = (1, 2, 3, 4)
BUCKETS = 1 << 14
CELLS = len(GRAMS) * BUCKETS
STRETCH, BLOCK = 100_000, 200_000
#: Rows of a language that scale and weigh bits: at most SAMPLE, and at most one in ten, of at most SAMPLE_BYTES bytes.
SAMPLE, SAMPLE_BYTES = 300, 16_384
MOST = 1000
#: Added to each count; n-grams added to a text's number, so that few n-grams give small margins.
SMOOTH, FEW = 0.5, 10
#: A text is ambiguous if the next codeword's loss is less than this above the winner's.
CLOSE = 0.1
UNKNOWN = "und"
ODD = np.uint64(0x9E3779B97F4A7C15)
LETTER = np.array([chr(i).isalpha() for i in range(0x10000)])


def stretches(text: str) -> list[str]:
    out, at = [], 0
    while len(text) - at > STRETCH:
        end = text.rfind(" ", at, at + STRETCH) + 1
        end = end if end > at else at + STRETCH
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def blocks(texts: list[str]):
    """(texts' numbers, stretches) of about BLOCK characters in all."""
    of, held, size = [], [], 0
    for i, t in enumerate(texts):
        for s in stretches(t):
            of.append(i)
            held.append(s)
            size += len(s)
            if size >= BLOCK:
                yield of, held
                of, held, size = [], [], 0
    if of:
        yield of, held


def grams(parts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length the buckets of all n-grams with a letter, and the number of the part each is of, ascending."""
    lowered = [f" {p.lower()} " for p in parts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(x) for x in lowered])
    letter = np.where(codes < 0x10000, LETTER[np.minimum(codes, 0xFFFF)], codes >= 0x10000)
    for i in np.flatnonzero(codes >= 0x10000).tolist():
        letter[i] = chr(codes[i]).isalpha()
    data = np.where(letter, codes, 32).astype(np.uint64)
    # a space after a space starts no n-gram that another does not hold
    if len(data):
        keep = np.concatenate([[True], letter[1:] | letter[:-1] | (owner[1:] != owner[:-1])])
        data, owner, letter = data[keep], owner[keep], letter[keep]
    before = np.concatenate([[0], np.cumsum(letter)])
    out, h = [], np.zeros(len(data), dtype=np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h = (h[: len(data) - n + 1] if n > 1 else h) * ODD + data[n - 1 :] + np.uint64(n)
        if n in GRAMS:
            m = len(data) - n + 1
            good = (owner[n - 1 :] == owner[:m]) & (before[n:] > before[:m]) if m > 0 else np.zeros(0, bool)
            mixed = (h ^ (h >> np.uint64(31))) * ODD
            cells = (mixed >> np.uint64(50)).astype(np.int32) + np.int32(GRAMS.index(n) * BUCKETS)
            out.append((cells[good], owner[: max(0, m)][good]))
    return out


def codewords(n: int, seed: int = 5, draws: int = 200) -> np.ndarray:
    """A row of -1 and 1 for each of n languages: every way to part them in two, or a random code of far rows."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 7:
        bits = [[1 if k >> i & 1 == 0 else -1 for i in range(n)] for k in range(1, 1 << n) if not k & 1]
        return np.array(bits, dtype=float).T
    rng, best, apart = np.random.default_rng(seed), None, -1.0
    width = math.ceil(10 * math.log2(n))
    for _ in range(draws):
        code = np.sign(rng.random((n, width)) - 0.5)
        code[0, np.abs(code.sum(axis=0)) == n] *= -1  # no bit is the same for all
        alike = code @ code.T - np.eye(n) * width
        if -alike.max() > apart or best is None:
            best, apart = code, -alike.max()
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # cells x bits
    scale: np.ndarray  # bits x 2: log odds are scale * margin + shift
    trust: np.ndarray  # languages x bits, rows sum to 1

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's mean weights, and its number of n-grams."""
        sums, count = np.zeros((len(texts), self.weights.shape[1])), np.zeros(len(texts))
        for of, parts in blocks(texts):
            of = np.array(of)
            for cells, owner in grams(parts):
                if len(cells):
                    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                    np.add.at(sums, of[owner[starts]], np.add.reduceat(self.weights[cells], starts, axis=0, dtype=np.float64))
                    np.add.at(count, of[owner[starts]], np.diff(np.append(starts, len(cells))))
        return sums / (count + FEW)[:, None], count

    def losses(self, margins: np.ndarray) -> np.ndarray:
        odds = margins * self.scale[:, 0] + self.scale[:, 1]
        return np.stack([(np.logaddexp(0, -odds * word) * trust).sum(axis=1) for word, trust in zip(self.code, self.trust, strict=True)], axis=1)

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        """Language, score and whether it is ambiguous."""
        if not self.langs:
            return [(UNKNOWN, 0.0, False)] * len(texts)
        margins, count = self.margins(texts)
        losses = self.losses(margins)
        order = np.argsort(losses, axis=1, kind="stable")
        least = np.take_along_axis(losses, order, axis=1)
        share = np.exp(-(losses - least[:, :1]) * max(1, self.code.shape[1]))
        score = 1 / share.sum(axis=1)
        close = least[:, 1] - least[:, 0] < CLOSE if len(self.langs) > 1 else np.zeros(len(texts), bool)
        return [(self.langs[k], float(s), bool(c)) if n else (UNKNOWN, 0.0, False) for k, s, c, n in zip(order[:, 0].tolist(), score, close, count, strict=True)]


def held_out(doc_id: F.Column) -> F.Column:
    """Never taught: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, cell, n) over rows of (lang, text)."""

    def run(batches):
        held: dict[str, np.ndarray] = {}

        def told():
            for lang, n in held.items():
                cells = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells), pa.string()), pa.array(cells.astype(np.int32)), pa.array(n[cells])], names=["lang", "cell", "n"])
            held.clear()

        for batch in small(batches):
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                n = held.setdefault(lang, np.zeros(CELLS, dtype=np.int64))
                for _, parts in blocks(texts):
                    for cells, _ in grams(parts):
                        n += np.bincount(cells, minlength=CELLS)
                if len(held) > 40:
                    yield from told()
        yield from told()

    return rows.select("lang", "text").mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def fit_line(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic model of y (0 or 1) in x, drawn a little to scale 1 over the spread of x and shift 0."""
    start = 4 / max(1e-6, float(np.abs(x).mean())) if len(x) else 1.0
    a, b, pull = start, 0.0, 1e-2
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        w = weight * p * (1 - p)
        slope = np.array([(weight * (p - y) * x).sum() + pull * (a - start) / start**2, (weight * (p - y)).sum() + pull * b])
        bend = np.array([[(w * x * x).sum() + pull / start**2, (w * x).sum()], [(w * x).sum(), w.sum() + pull]])
        step = np.linalg.solve(bend, slope)
        step *= min(1.0, 0.5 * start / max(1e-12, abs(step[0])))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, start / 100)), float(b)


def train(docs: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("string").alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(~held_out(F.col("id")))
    draw = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) / (1 << 30)
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST + 1).collect()}
    if len(sizes) > MOST:
        raise ValueError(f"over {MOST} languages")
    langs = sorted(sizes)
    rates = spark.createDataFrame([(k, min(0.1, 3 * sample / n)) for k, n in sizes.items()] or [("", 0.0)], "lang string, rate double")
    rated = rows.join(F.broadcast(rates), "lang").withColumn("draw", draw)
    chosen = (F.col("draw") < F.col("rate")) & (F.octet_length("text") <= SAMPLE_BYTES)
    counts = np.zeros((len(langs), CELLS), dtype=np.float32)
    got = gram_counts(rated.where(~chosen)).toArrow()
    number = {k: i for i, k in enumerate(langs)}
    counts[[number[x] for x in got["lang"].to_pylist()], got["cell"].to_numpy()] = got["n"].to_numpy()
    code = codewords(len(langs))
    shares = counts.reshape(len(langs), len(GRAMS), BUCKETS) + np.float32(SMOOTH)
    shares /= shares.sum(axis=2, keepdims=True)
    shares = shares.reshape(len(langs), CELLS)
    weights = np.empty((CELLS, code.shape[1]), dtype=np.float32)
    for k, bit in enumerate(code.T):
        weights[:, k] = np.log(shares[bit > 0].mean(axis=0)) - np.log(shares[bit < 0].mean(axis=0))
    raw = Model(langs, code, weights, np.ones((code.shape[1], 2)), np.full(code.shape, 1 / max(1, code.shape[1])))
    if len(langs) < 2:
        return raw

    sent = spark.sparkContext.broadcast(raw)

    def measure(batches):
        for batch in small(batches):
            margins, n = sent.value.margins(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(margins), pa.list_(pa.float64())), pa.array(n)], names=["lang", "margins", "n"])

    first = Window.partitionBy("lang").orderBy("draw", "id")
    picked = rated.where(chosen).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= sample).select("lang", "text")
    measured = picked.mapInArrow(measure, "lang string, margins array<double>, n double").where("n > 0").collect()
    x, of = np.array([r.margins for r in measured]).reshape(-1, code.shape[1]), np.array([number[r.lang] for r in measured], dtype=int)
    size = np.bincount(of, minlength=len(langs))
    weight = 1 / np.maximum(1, size[of])  # every language counts alike
    weight = weight * len(of) / max(1e-9, weight.sum())
    for k in range(code.shape[1]):
        raw.scale[k] = fit_line(x[:, k], (code[of, k] > 0).astype(float), weight) if len(of) else (20.0, 0.0)
    right = ((x * raw.scale[:, 0] + raw.scale[:, 1]) * code[of] > 0).astype(float)
    rate = np.stack([(right[of == i].sum(axis=0) + 1) / (size[i] + 2) for i in range(len(langs))])
    raw.trust = rate / rate.sum(axis=1, keepdims=True)
    return raw


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"

    def run(batches):
        for batch in small(batches):
            rows = sent.value.predict([t or "" for t in batch.column(2).to_pylist()])
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.bool_())], names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col(key).cast("long").alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("text")).mapInArrow(run, schema)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))
