"""Token ids by the tokenizers library, a word at a time.

The vocabulary's rules never look across white space, nor from a letter to a mark after it, and know no capitals. So a
text's ids are the ids of its chunks in order, cut at spaces and before such marks, in lower case. Chunks repeat, and
bounded tables of those already seen do most of the work; the library encodes the rest. There are two tables: when the
newer is full it becomes the older, whose chunks move to the newer one as they are seen again, and what was not seen
meanwhile goes with it.
"""

from __future__ import annotations

import gc
import os
from functools import cache
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_BPE = "word_bpe_49k.json"
#: Bytes of a worker's two tables of chunks, about; an entry's own objects take so many.
TABLE_BYTES, ENTRY = 96 << 20, 150
#: NFC and lower case leave letters below this code point letters, one for one.
SIMPLE_BELOW = "\u0250"
#: Neither letters, digits, white space nor the apostrophe, which has rules of its own.
MARKS = ".,!?;:#*$%&|<>()[]{}+=_/\\@^~-"
#: Words that need no rules, but not all of those.
WORD = "^[a-zß-öø-ÿ]+$"
#: What a byte of UTF-8 is: a space or the end of a line; an ASCII letter, a capital; one of MARKS; the first byte of a letter
#: from U+00C0 to U+024F (or of U+00D7 and U+00F7, which are none, or U+0130, in lower case a letter and a mark); the first of a character that never joins one before it.
SPACE, LETTER, CAPITAL, MARK, LEAD, APART = (1 << k for k in range(6))
KINDS = bytes(
    SPACE * (x in b" \n") | LETTER * bytes([x]).isalpha() | CAPITAL * bytes([x]).isupper() | MARK * (x in MARKS.encode()) | LEAD * (0xC3 <= x <= 0xC9) | APART * (x < 0x80 or 0xC2 <= x <= 0xC9)
    for x in range(256)
)
#: Characters of texts that callers give ids() at once; only their different chunks become Python's strings.
AT_ONCE = 2_000_000


def vocabulary(name: str = WORD_BPE) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids(text): the ids of the whole text as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_file(path)  # the model alone: for words that need no rules
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(self.full.get_vocab_size() + 1, dtype=bool)
        for piece, i in self.full.get_vocab().items():
            self.ends[i] = piece.endswith("</w>")
        alphabet = sorted(pre_tokenizers.ByteLevel.alphabet(), key=ord)
        same = [chr(x) for x in (*range(33, 127), *range(161, 173), *range(174, 256))]
        rest = iter([x for x in alphabet if x not in set(same)])
        self.bytes_as = {x: chr(x) if chr(x) in same else next(rest) for x in range(256)}
        self.bytes_as[ord(" ")] = " "  # between words
        self.added = [t.content.lower().encode() for t in self.full.get_added_tokens_decoder().values()]
        self.table: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.tails: dict[str, bytes] = {}

    def _plain(self, words: list[str]) -> None:
        """Letters only, lower case, below SIMPLE_BELOW: each is one piece of the rules."""
        made = [np.zeros(0, dtype="<u4")]
        for k in range(0, len(words), 128):
            some = " ".join(words[k : k + 128])
            some = some if some.isascii() else some.encode().decode("latin-1").translate(self.bytes_as)
            made.append(np.array(self.bare.encode_batch_fast([some], add_special_tokens=False)[0].ids, dtype="<u4"))
        ids = np.concatenate(made)
        cuts = np.append(0, np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(cuts) != len(words) + 1:
            raise ValueError("a word has no single end")
        each = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(ids)])
        self.table.update(zip(words, each.to_numpy(zero_copy_only=False).tolist(), strict=True))

    def _whole(self, chunk: str) -> bytes:
        return np.array(self.full.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, chunks: list[str]) -> None:
        """A chunk of letters and then marks is a word and a tail: the rules always part them. Words are in the table as
        chunks of their own."""
        table, older, tails, parted, need = self.table, self.older, self.tails, [], set()
        held = sum(map(len, chunks)) - ENTRY * len(table)
        if older:
            seen = [*map(older.pop, chunks, repeat(None))]
            table.update((c, x) for c, x in zip(chunks, seen, strict=True) if x is not None)
            chunks = [c for c, x in zip(chunks, seen, strict=True) if x is None]
        words = pc.match_substring_regex(pa.array(chunks, pa.large_string()), WORD).to_numpy(zero_copy_only=False)
        self._plain([*compress(chunks, words.tolist())])
        for c in compress(chunks, (~words).tolist()):
            w = c.rstrip(MARKS).lower()
            if w.isalpha() and (w.isascii() or max(w) < SIMPLE_BELOW):
                if w == c:
                    need.add(w)
                    continue
                parted.append((c, w))
                if w not in table:
                    held += len(w)
                    if (known := older.pop(w, None)) is None:
                        need.add(w)
                    else:
                        table[w] = known
            else:
                table[c] = self._whole(c) if c else b""
                held += len(table[c])
        self._plain([*need])
        for c, w in parted:
            if len(c) == len(w):
                table[c] = table[w]
            else:
                if (tail := c[len(w) :]) not in tails:
                    tails[tail] = self._whole(tail)
                table[c] = table[w] + tails[tail]
        self.held += held + ENTRY * len(table)

    def _chunks(self, texts: list[str]) -> tuple[np.ndarray, pa.LargeStringArray]:
        """The chunks of all texts, and where each text's begin among them. Capitals that a next character could join stay,
        and so do all, uncut, beside what could be read as one of the vocabulary's own marks of texts."""
        held = pa.array(texts, pa.large_string())
        starts = np.frombuffer(held.buffers()[1], dtype=np.int64, count=len(texts) + 1)
        if not starts[-1]:
            return np.zeros(len(texts) + 1, dtype=np.int64), pa.array([], pa.large_string())
        text = held.buffers()[2].slice(0, int(starts[-1])).to_pybytes()
        raw, kind = np.frombuffer(text, dtype=np.uint8), np.frombuffer(text.translate(KINDS), dtype=np.uint8)
        before, after = kind[:-1], np.append(kind[1:], np.uint8(APART))
        low = np.frombuffer(bytearray(text.lower()), dtype=np.uint8)
        stay = np.flatnonzero((kind & CAPITAL != 0) > (after & APART != 0))
        low[stay] = raw[stay]
        letter = kind & LETTER != 0
        second = np.flatnonzero(before & LEAD) + 1
        lead, of = raw[second - 1], raw[second]
        low[second[(lead == 0xC3) & (of <= 0x9E) & (of != 0x97) & (after[second] & APART != 0)]] += 32
        letter[second[~((lead == 0xC3) & (of & 0xDF == 0x97) | (lead == 0xC4) & (of == 0xB0))]] = True
        whole = low.tobytes()
        marks = kind & MARK != 0
        if any(t in whole for t in self.added):
            whole, marks = text, np.zeros_like(marks)
        space = kind & SPACE != 0
        new = np.ones(len(raw), dtype=bool)
        np.logical_or(letter[:-1] & marks[1:], space[:-1], out=new[1:])
        new[starts[:-1][starts[:-1] < len(raw)]] = True
        new &= ~space
        data = whole.translate(None, b" \n")
        offsets = np.append(np.flatnonzero(new[~space]), len(data)).astype(np.int64)
        chunks = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))
        return np.searchsorted(np.flatnonzero(new), starts), chunks

    def ids(self, texts: list[str]) -> list[bytes]:
        """Only different chunks become Python's strings; Arrow puts the ids in their places."""
        starts, cut = self._chunks(texts)
        coded = cut.dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.held > TABLE_BYTES // 2:
            self.table, self.older, self.held = {}, self.table, 0
            self.tails.clear()
        found = pa.array(map(self.table.get, chunks), pa.large_binary(), size=len(chunks))
        if found.null_count:
            unknown = found.is_null()
            missing = [chunks[i] for i in np.flatnonzero(unknown).tolist()]
            self._learn(missing)
            found = pc.replace_with_mask(found, unknown, pa.array([*map(self.table.get, missing)], pa.large_binary()))
        places = found.take(coded.indices)
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(starts, pa.int64()), places), pa.scalar(b"", pa.large_binary())).to_pylist()


def seldom_collect() -> None:
    """Tables of strings hold no cycles: the collector looks through them less often."""
    gc.set_threshold(200_000, 50, 50)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def slices(texts: list[str], chars: int = 1_000_000) -> list[tuple[int, int]]:
    """Ranges of texts of about so many characters in all, one text at least."""
    out, start, held = [], 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= chars:
            out.append((start, i + 1))
            start, held = i + 1, 0
    if start < len(texts):
        out.append((start, len(texts)))
    return out
