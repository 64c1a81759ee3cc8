"""Secret scan: fixed patterns, and password guess cost in credential contexts.

A value that stands where a credential would is split, by a dynamic program over its characters, into words, dates,
repeats, keyboard walks and brute-force spans so that the guesses for all parts, in bits, are least; a value that costs
THRESHOLD bits or more is a secret, whatever its letters and its length. Words are those of WORDS, then the commonest of
the corpus itself (the words of most texts, outside credential contexts), by rank: so what such a place often holds in
prose ("the secret ingredient", "token counts") is cheap and stays. A value may itself be a context word ("secret
password ..."): the search goes on at the start of each value.

A value in quotes goes to its own closing quote, if no white space is before it; else it goes to white space, without
brackets and stops at its end. Of an unquoted value with a comma, quote or the like inside, the part before that is
judged where a letter and a digit are not in one part (prose), else the whole.

Only places that are reached below the threshold are gone on from, so a long value costs no more than its cheap part;
where all of a value is cheap, the costs of its ends are kept for the values that begin inside it. Parts have sizes of
their own: words up to the longest of the dictionary, units of repeats and keyboard walks up to UNIT characters (a longer
walk is several, a longer unit is spelt), repeats of any length. Words of the corpus have 3 to LONGEST letters: shorter
ones are hardly cheaper than their letters, longer ones are two words or no word of prose. They count only where they
stand in different company, so that a secret in copies of a text is not learnt. Seven characters of any kind cost 35.4
bits at most, under the threshold, so shorter values than SHORTEST need no cost.

Defined cases: null and empty texts have no spans; positions are code points of the whole text; repeated rows are
scanned each; an empty corpus leaves the fixed words.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import cut, small, table

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more is a match of [0-9a-f]+ and no shorter run is kept
#: A context up to the first character of its value; the group is the quote that opens it.
CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|bearer)["']?(?:[\x20\t]*(?:[:=]{1,2}|=>|is)[\x20\t]*|[\x20\t]+)(["'`]?)(?=[^\s"'`,;<>])""",
    re.IGNORECASE | re.ASCII,
)
SPACE, INSIDE = re.compile(r"\s|\Z"), re.compile("[\"'`,;<>]")
#: Where markup begins, a value ends. Names of elements that stand in text.
MARKUP = re.compile(r"</?(?:a|b|br|code|dd|div|dl|dt|em|font|form|h[1-6]|hr|i|img|input|kbd|li|ol|p|pre|samp|script|small|span|strong|sub|sup|table|td|th|tr|tt|u|ul|var)\b", re.IGNORECASE)
PART = re.compile(r"[^\s\"'`,;<>]+")
#: What closes a sentence or a bracket is not of the value before it.
AFTER = ".)]}:,;'\"`>"
#: Every match of ASSIGN or CONTEXT holds one of these, in lower case.
NAMES = ("passw", "passp", "passc", "pwd", "secret", "token", "credential", "bearer", *(a + b + "key" for a in ("api", "access", "private") for b in ("", "_", "-")))
#: By byte: "x" for what a match of HEX is made of; lower-case letters for letters.
HEX_BYTES = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
LETTERS = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalpha() else 32 for b in range(256))
#: Bits of guesses from which a value counts as a secret, and its least length.
THRESHOLD, SHORTEST = 36.0, 8
#: Characters of a repeated unit or a walk, at most.
UNIT = 64
#: Words of the corpus that guessers know, at most, and the texts that such a word is in, at least.
DICTIONARY, LEAST_TEXTS = 20_000, 2
#: Letters of such a word, at most.
LONGEST = 24
#: Different words that a task counts before it hands its counts over.
HELD_WORDS = 100_000
#: Values whose cost a worker remembers, and letters of the longest of them.
REMEMBERED, SHORT = 20_000, 200
#: Characters of a value that are looked at first for repeats, and of one that is looked at whole after the second look.
WINDOW, WHOLE = 256, 1 << 18
#: A repeat of over MANY times is ended at one of the last LAST times only: to end sooner leaves more to spell than the
#: logarithm of its times can save.
MANY, LAST = 1024, 256

#: Words that guessers try first, most common first.
WORDS = """password pass admin login welcome letmein monkey dragon master qwerty abc test user root guest default changeme
secret token key access private public example sample demo hello world love money summer winter spring autumn football
baseball soccer hockey computer internet system server database backup service account change update temporary temp
null none true false undefined required string value here your the and for with from this that not are was have
""".split()
READ_AS = str.maketrans("013457@$!", "oieastasi")
#: Rows of a keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
NEXT = {(a, b) for row in ROWS for a, b in zip(row, row[1:], strict=False)}
NEXT |= {(b, a) for a, b in NEXT} | {(a, b) for up, low in zip(ROWS, ROWS[1:], strict=False) for i, b in enumerate(low) for a in up[i : i + 2]}
DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)")


def brute(c: str) -> float:
    """Bits to guess a character of its kind."""
    return math.log2(10 if c.isdigit() else 26 if c.isalpha() else 33)


def runs(value: str, unit: int = UNIT) -> list[tuple[int, int, int]]:
    """(start, end, period) of every part of two periods or more that no letter on either side continues; the period is
    the least one."""
    codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = []
    periods = np.arange(1, min(unit, len(value) // 2) + 1)
    if len(codes) <= 4 * WINDOW and len(periods):  # periods with enough equal letters at all
        at = np.arange(len(codes))[None] + periods[:, None]
        equal = (at < len(codes)) & (codes[np.minimum(at, len(codes) - 1)] == codes[None])
        periods = periods[equal.sum(axis=1) >= periods]
    for p in periods.tolist():
        same = np.diff(np.concatenate([[0], (codes[p:] == codes[:-p]).view(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(same == 1).tolist(), np.flatnonzero(same == -1).tolist(), strict=True):
            part = value[a : a + p]
            if b - a >= p and (part + part).find(part, 1) == p:
                out.append((a, b + p, p))
    return out


class Guesser:
    """What a value costs to one who knows these words, most common first."""

    def __init__(self, words=()):
        self.rank = {}
        for w in [*WORDS, *words]:
            self.rank.setdefault(w, len(self.rank) + 1)
        self.begins = {w[:k] for w in self.rank for k in range(3, len(w) + 1)}
        self.known: dict[tuple[str, float], float] = {}
        self.bits = np.zeros(0)  # logarithms of whole numbers

    def words_at(self, value: str, low: str, read: str, i: int):
        for s in (low,) if read == low else (low, read):
            for j in range(i + 3, len(value) + 1):
                if s[i:j] not in self.begins:
                    break
                if (rank := self.rank.get(s[i:j])) is not None:
                    caps = sum(c.isupper() for c in value[i:j])
                    bits = math.log2(rank + 1) + (0 if caps == 0 else 1 if caps == j - i or value[i].isupper() and caps == 1 else math.log2(math.comb(j - i, min(caps, (j - i) // 2 or 1)) + 1))
                    yield j, bits + (s is read and read != low)

    def parts_at(self, value: str, low: str, read: str, i: int):
        """(end, bits) of each word, date and walk that begins at i."""
        yield from self.words_at(value, low, read, i)
        if value[i].isdigit() and (m := DATE.match(value, i)):
            yield m.end(), math.log2(365 * 120) + 2 * bool(m[1] or m[2]) if m.end() - i > 4 else math.log2(120)
        turns, k = 0, i
        while k + 1 < min(len(value), i + UNIT) and (low[k], low[k + 1]) in NEXT:
            k += 1
            turns += k - 2 >= i and low[k] == low[k - 2]
            if k >= i + 2:
                yield k + 1, math.log2(47 * (k - i + 1)) + 2 * turns

    def cost(self, value: str, limit: float = math.inf) -> float:
        """Bits of the cheapest segmentation, or limit if that is no less; a bit more for each word, date,
        walk or repeat after the first, for the order tried."""
        if len(value) > SHORT:
            return self.ends(value, limit)[0]
        if (value, limit) not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[value, limit] = self.ends(value, limit)[0]
        return self.known[value, limit]

    def _repeats(self, value: str, found: dict[int, list[tuple[int, int]]], i: int, limit: float):
        """(ends, bits) of the repeats that begin at i, without what comes before: found has the runs by i."""
        for b, p in found.get(i, ()):
            most = (b - i) // p
            least = 2 if most <= MANY else most - LAST
            if most >= len(self.bits):
                self.bits = np.log2(np.maximum(1, np.arange(2 * most)))
            yield slice(i + p * least, i + p * most + 1, p), self.cost(value[i : i + p], limit) + self.bits[least : most + 1]

    @staticmethod
    def _by_start(value: str) -> dict[int, list[tuple[int, int]]]:
        found: dict[int, list[tuple[int, int]]] = {}
        for a, b, p in runs(value):
            for i in range(a, b - 2 * p + 1):
                found.setdefault(i, []).append((b, p))
        return found

    def ends(self, value: str, limit: float = math.inf) -> tuple[float, np.ndarray | None]:
        """The cost, and, where it is below limit, the cost of each end of the value, from there on."""
        n, low = len(value), value.lower()
        if len(low) != n:  # letters whose lower case is longer
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        read = low.translate(READ_AS)
        window = min(n, WINDOW)
        parts: dict[int, list[tuple[int, float]]] = {}
        while True:
            # places are gone on from in order; repeats are those of the window
            found = self._by_start(value[:window]) if n > 1 else {}
            best = np.full(window + 1, limit)
            best[0], reach, beyond = 0.0, 0, False
            for i in range(window):
                if i > reach:
                    break
                if (here := float(best[i])) >= limit:
                    continue
                if i not in parts:
                    parts[i] = list(self.parts_at(value, low, read, i))
                more = here + (i > 0)
                for j, bits in [(i + 1, here + brute(value[i])), *((j, more + bits) for j, bits in parts[i])]:
                    if j > window:
                        beyond = beyond or bits < limit
                    elif bits < best[j]:
                        best[j] = bits
                        reach = max(reach, j)
                for at, bits in self._repeats(value, found, i, limit):
                    better = np.flatnonzero(more + bits < best[at])
                    if len(better):
                        np.minimum(best[at], more + bits, out=best[at])
                        reach = max(reach, at.start + at.step * int(better[-1]))
            if window == n:
                break
            if reach < window - 2 * UNIT and not beyond:
                return limit, None
            window = n if window > WINDOW and n <= WHOLE else min(n, 16 * window)
        if best[n] >= limit or n <= SHORT:
            return float(best[n]), None
        # from the last place back: what follows a place costs the same whatever is before it; a part that begins the value
        # costs a bit less than one that goes on
        rest, alone = np.full(n + 1, limit), np.full(n + 1, limit)
        rest[n] = 0.0
        for i in range(n - 1, -1, -1):
            if i not in parts:
                parts[i] = list(self.parts_at(value, low, read, i))
            part = min((bits + float(rest[j]) for j, bits in parts[i]), default=limit)
            for at, bits in self._repeats(value, found, i, limit):
                part = min(part, float((bits + rest[at]).min()))
            letter = brute(value[i]) + float(rest[i + 1])
            rest[i], alone[i] = min(letter, part + 1, limit), min(letter, part, limit)
        return float(best[n]), alone


PLAIN = Guesser()


def cost(value: str) -> float:
    """Bits of the cheapest segmentation by the fixed words alone."""
    return PLAIN.cost(value)


def named(text: str) -> bool:
    """Whether a text can hold a context at all."""
    low = text.lower()
    return any(name in low for name in NAMES)


def spans(text: str | None, threshold: float = THRESHOLD, guesser: Guesser = PLAIN) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all spans, by start and kind."""
    if not text:
        return []
    out = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20] if "AKIA" in text else []
    if b"x" * 24 in text.encode("utf-8", "surrogatepass").translate(HEX_BYTES):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if not named(text):
        return sorted(out)
    out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    kept: tuple[int, int, np.ndarray] | None = None  # (start, end, costs of its ends) of a value that is cheap as a whole
    for _, at, stop in contexts(text):
        if kept and at >= kept[0] and stop == kept[1]:
            bits = kept[2][at - kept[0]]
        elif stop - at < SHORTEST:
            continue
        elif stop - at > SHORT:
            bits, rest = guesser.ends(text[at:stop], threshold)
            kept = (at, stop, rest) if rest is not None else kept
        else:
            bits = guesser.cost(text[at:stop], threshold)
        if bits >= threshold and stop - at >= SHORTEST:
            out.append((at, 3, stop))
    return sorted(out)


def contexts(text: str):
    """(start of the context, start of its value, end of its value), of each context, also of those inside a value."""
    at, space, inside, markup, code = 0, -1, -1, -1, (-1, -1)
    while m := CONTEXT.search(text, at):
        at = m.end()
        if space < at:  # ends are looked for once for all values before them
            space = SPACE.search(text, at).start()
        stop = space
        if m[1] and (quote := text.find(m[1], at, space)) >= 0:
            stop = quote
        else:
            if markup < at:
                markup = next((x.start() for x in MARKUP.finditer(text, at)), len(text))
            stop = min(stop, markup)
            if inside < at:
                inside = next((x.start() for x in INSIDE.finditer(text, at)), len(text))
            if inside < stop:
                if code[0] < at:
                    code = next((x.span() for x in PART.finditer(text, at) if re.search(r"\d", x[0]) and re.search("[A-Za-z]", x[0])), (len(text), len(text)))
                if code[0] >= stop:
                    stop = inside
            while stop > at and text[stop - 1] in AFTER:
                stop -= 1
        yield m.start(), at, stop


def without_contexts(text: str) -> str:
    """The text without contexts and what stands in them."""
    out, at = [], 0
    for start, _, stop in contexts(text):
        if start >= at:
            out.append(text[at:start])
        at = max(at, stop)
    return " ".join([*out, text[at:]])


def dictionary(docs: DataFrame, most: int = DICTIONARY, least: int = LEAST_TEXTS, text: str = "text") -> list[str]:
    """The words of most texts, most common first, without those that only credential contexts hold, and without those that
    always stand between the same two words, as copies of one text have them. Tasks count, then Spark sums; only so many
    words reach the driver."""

    def count(batches):
        texts: Counter = Counter()
        between: dict[bytes, list[int]] = {}  # the least and the greatest hash of a word's neighbours
        for batch in small(batches):
            for t in batch.column(0).to_pylist():
                if t:
                    plain = without_contexts(t) if named(t) else t
                    words = plain.encode("utf-8", "surrogatepass").translate(LETTERS).split()
                    texts.update({w for w in words if 3 <= len(w) <= LONGEST})
                    for a, w, b in zip([b"", *words], words, [*words[1:], b""], strict=False):
                        if not 3 <= len(w) <= LONGEST:
                            continue
                        x = zlib.crc32(b, zlib.crc32(a))
                        if (had := between.get(w)) is None:
                            between[w] = [x, x]
                        elif x < had[0]:
                            had[0] = x
                        elif x > had[1]:
                            had[1] = x
                if len(texts) >= HELD_WORDS:
                    yield given(texts, between)
                    texts, between = Counter(), {}
        yield given(texts, between)

    def given(texts: Counter, between: dict[bytes, list[int]]) -> pa.RecordBatch:
        held = list(texts)
        columns = [pa.array([w.decode() for w in held], pa.string()), pa.array(texts.values(), pa.int64()), *(pa.array([between[w][k] for w in held], pa.int64()) for k in (0, 1))]
        return pa.RecordBatch.from_arrays(columns, names=["word", "texts", "low", "high"])

    counted = docs.select(text).mapInArrow(count, "word string, texts long, low long, high long").groupBy("word").agg(F.sum("texts").alias("texts"), F.min("low").alias("low"), F.max("high").alias("high"))
    # the first of each task meet in one that keeps the first of all; a row a word is written
    first = cut(counted.where((F.col("texts") >= least) & (F.col("low") < F.col("high"))).orderBy(F.desc("texts"), "word").limit(most), "words")
    return [r.word for r in first.orderBy(F.desc("texts"), "word").toLocalIterator()]


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def redact(text: str | None, found: list[tuple[int, int, int]], mark: str = "[secret]") -> str | None:
    """The text with every span replaced; spans that overlap become one."""
    if not found:
        return text
    out, at, held = [], 0, None
    for a, _, b in found:
        if held and a < held[1]:
            held = held[0], max(held[1], b)
            continue
        if held:
            out += [text[at : held[0]], mark]
            at = held[1]
        held = a, b
    out += [text[at : held[0]], mark, text[held[1] :]]
    return "".join(out)


def scan(docs: DataFrame, words: list[str] = (), threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess) of every row; words as dictionary() gives them."""
    sent = docs.sparkSession.sparkContext.broadcast(list(words))
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"]

    def run(batches):
        guesser = Guesser(sent.value)
        for batch in small(batches):
            rows = []
            for t in batch.column(1).to_pylist():
                found = spans(t, threshold, guesser)
                n = [sum(k == i for _, k, _ in found) for i in range(4)]
                rows.append((*n[:3], hashlib.sha256(written([x for x in found if x[1] < 3]).encode()).hexdigest(), written(found), n[3]))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=names)

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")


def redacted(docs: DataFrame, words: list[str] = (), threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """docs with the text's secrets replaced; n_chars, where it is there, follows."""
    at = docs.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(list(words))

    def run(batches):
        guesser = Guesser(sent.value)
        for batch in small(batches):
            new = pa.array([redact(t, spans(t, threshold, guesser)) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, dictionary(docs)).drop("n_guess")
