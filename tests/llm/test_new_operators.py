"""Languages by held-out accuracy, token links and source divergence by brute force, and odd tables."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import alignment, divergence, languages
from tallyloom.llm.tokens import vocabulary

SF = "/root/testdata/sf0.001"
LONG = "word and " * 3000
ODD_TEXTS = ["two  spaces", " lead", "trail ", "line\nbreak\n\nmore\n end", "\nfirst", "tab\tand \t more", "日本語 の テスト 123,4 ▁x", "it's 's '' don't", "<|endoftext|> <s> </s> <0x41> <unk>", "a\x00b \x00 c", "é́ ́x \xa0y 　z", "x\r\ny\r z", "▁", " ", "\n", "🙂 🙂🙂 ok", "x" * 300]
ODD = [(1, "plain text of some words", "en", "a", 3), (1, "plain text of some words", "en", "a", 3), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "no id here", "de", None, 1), (4, LONG, "en", "b", 9), (5, "ÉTÉ à la plage, 日本語 \x1c \xa0 ß", "fr", "b", 7), (6, "  \n\t ", "en", "b", 4)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = ODD + [(100 + i, t, "en", "c", None) for i, t in enumerate(ODD_TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("pair", "row", "n", "term", "chunk", "place", "draw", "id", "value", "rank", "score")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(vocabulary(alignment.BYTE_BPE), vocabulary(alignment.PIECE_BPE))


def whole(made, text):
    """n_a, n_b, groups as text, and all links, by the definition: both vocabularies over the whole text, every pair of tokens."""
    if not text:
        return 0, 0, [], "", []
    a, b = made.a.encode(" " + text, add_special_tokens=False).ids, made.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(made.bytes_a[i] for i in a) != raw or b"".join(made.bytes_b[i] for i in b) != raw:
        return 0, 0, [], "", []

    def spans(ids, of):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(of[i]), i))
            at += len(of[i])
        return out

    sa, sb = spans(a, made.bytes_a), spans(b, made.bytes_b)
    links = [(i, j) for s, e, i in sa for t, f, j in sb if s < f and t < e]
    cuts = sorted({e for _, e, _ in sa} & {e for _, e, _ in sb})
    groups, low = [], 0
    for c in cuts:
        groups.append(",".join(str(i) for _, e, i in sa if low < e <= c) + "|" + ",".join(str(i) for _, e, i in sb if low < e <= c))
        low = c
    return len(a), len(b), groups, ";".join(groups), links


def test_byte_values_of_the_byte_vocabulary(aligner):
    assert aligner.bytes_a[aligner.a.token_to_id("Ġthe")] == b" the" and aligner.bytes_a[aligner.a.token_to_id("Ċ")] == b"\n"
    assert {x for x in aligner.bytes_a if len(x) == 1} == {bytes([b]) for b in range(256)}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aé .,'\n\t1▁日<0x>\xa0\x1ćs🙂"), min_size=1, max_size=24))
def test_chunks_give_the_tokens_of_the_whole(aligner, text):
    n_a, n_b, groups, said, links = whole(aligner, text)
    got = aligner.documents([text])[0]
    assert got[:4] == (n_a, n_b, len(groups), len(links)) and got[4] == (hashlib.sha256(said.encode()).hexdigest() if said else "")
    want = Counter(a << alignment.B_BITS | b for a, b in links)
    assert dict(zip(np.frombuffer(got[5], "<i4").tolist(), np.frombuffer(got[6], "<i8").tolist(), strict=True)) == want


@pytest.mark.parametrize("room", [alignment.HOT_PAIRS, 300, 0])
def test_alignment(docs, odd, aligner, room):
    """All pairs sent to the tasks, some, and none: the others by the join."""
    some = docs.where(F.length("text") < 2500).select(*SCHEMA.replace(",", "").split()[::2]).unionByName(odd.where("doc_id IS NULL OR doc_id <> 4").select("doc_id", "text", "lang", "source", "n_chars"))
    rows = some.collect()
    found = [(r.doc_id, *whole(aligner, r.text)) for r in rows]
    often = Counter(p for f in found for p in set(f[5]))
    best = defaultdict(int)
    for (a, _), n in often.items():
        best[a] = max(best[a], n)
    want = Counter((d, n_a, n_b, len(g), len(links), sum(often[p] == best[p[0]] for p in links), sum(often[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if said else "") for d, n_a, n_b, g, said, links in found)
    got = alignment.linked(some, vocabulary(alignment.BYTE_BPE), vocabulary(alignment.PIECE_BPE), room)
    assert Counter(map(tuple, got.collect())) == want and sum(w[1] == 0 for w in want) >= 4


def test_alignment_of_odd_tables(odd, none, aligner, monkeypatch):
    assert alignment.linked(odd, vocabulary(alignment.BYTE_BPE), vocabulary(alignment.PIECE_BPE)).count() == odd.count()
    assert alignment.linked(none, vocabulary(alignment.BYTE_BPE), vocabulary(alignment.PIECE_BPE)).count() == 0
    texts = ["some words here", "and others there", "some words again"] * 3
    want = [aligner.documents([t]) for t in texts]
    monkeypatch.setattr(alignment, "TABLE_BYTES", 10)  # a table that is dropped each time changes nothing
    assert [aligner.documents([t]) for t in texts] == want


def divergence_by_hand(rows):
    word = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    holds, count, groups = Counter(), Counter(), defaultdict(set)
    for r in rows:
        lang, source = r.lang or "", r.source or ""
        groups[lang].add(source)
        terms = word.findall((r.text or "").translate(low))
        for t in set(terms):
            holds[lang, t] += 1
        for t in terms:
            count[lang, source, t] += 1
    out = Counter()
    for lang, sources in groups.items():
        kept = [t for (k, t), n in holds.items() if k == lang and n >= 10]
        total = {s: sum(count[lang, s, t] for t in kept) for s in sources}
        v = len(kept)
        p = {s: {t: 1 + 10**9 * (count[lang, s, t] + 2) // (total[s] + 2 * v) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (sum(count[lang, s, t] for s in sources) + 2) // (sum(total.values()) + 2 * v) for t in kept}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources - {s}))
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if count[lang, s, t] and p[s][t] > q[t])[:10]
            for part, items in (("pair", pairs), ("term", terms)):
                out.update((lang, s, part, item, -value, k) for k, (value, _, item) in enumerate(items, 1))
    return out


@pytest.mark.parametrize("sizes", [{}, {"chunk_rows": 300, "block": 3, "slab": 2}, {"chunk_rows": 1000, "block": 1, "slab": 1}])
def test_divergence(docs, odd, sizes):
    """One tile a language, and many tiles, slabs and chunks."""
    both = docs.select("doc_id", "text", "lang", "source").unionByName(odd.select("doc_id", "text", "lang", "source"))
    assert Counter(map(tuple, divergence.audit(both, **sizes).collect())) == divergence_by_hand(both.collect())


def test_divergence_of_odd_tables(spark, odd, none):
    assert Counter(map(tuple, divergence.audit(odd).collect())) == divergence_by_hand(odd.collect())
    assert divergence.audit(none).count() == 0
    many = spark.createDataFrame([("a b b", "en", s) for s in "xyz"] * 7 + [("", "en", "w"), (None, "fr", "x"), ("c", "fr", "y")], "text string, lang string, source string")
    assert Counter(map(tuple, divergence.audit(many, block=2, chunk_rows=2, slab=1).collect())) == divergence_by_hand(many.collect())


def test_long_texts_are_cut_into_terms_whole(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 7)
    text = "One two, THREE ééé 日本語 four " * 9
    assert [w for p in divergence.terms_of(text) for w in p] == text.replace(",", "").replace("One", "one").replace("THREE", "three").encode().split()


def test_shares_are_exact_beyond_64_bits(spark):
    row = spark.createDataFrame([(10**13, 3 * 10**13, 7)], "n long, total long, v long").select(divergence.share("n", "total", "v").alias("p")).first()
    assert row.p == 1 + 10**9 * (10**13 + 2) // (3 * 10**13 + 14)




def test_language_id(spark, odd, none):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = languages.train(d)
    rows = languages.predict(d, model).join(d.select("doc_id", "lang", "text"), "doc_id").where("held_out").collect()
    assert len(rows) > 2000 and all(0 <= r.score <= 1 for r in rows)
    right = Counter((r.lang, r.lang == r.lang_pred) for r in rows)
    assert all(right[k, True] / (right[k, True] + right[k, False]) > 0.97 for k in ("en", "fr", "de", "es"))
    sure = [r for r in rows if not r.ambiguous]
    assert sum(r.lang == r.lang_pred for r in sure) / len(sure) > 0.99 and len(sure) > 0.9 * len(rows)
    got = {r.doc_id: r for r in languages.predict(odd, model).collect()}
    assert languages.predict(odd, model).count() == odd.count() and got[2].lang_pred == got[3].lang_pred == got[6].lang_pred == "und" and got[4].lang_pred == "en"
    assert languages.predict(none, model).count() == 0


def test_labels_of_held_out_rows_teach_nothing(spark, docs):
    wrong = docs.withColumn("lang", F.when(languages.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    a, b = languages.train(docs), languages.train(wrong)
    assert a.langs == b.langs and np.array_equal(a.weights, b.weights) and np.array_equal(a.trust, b.trust)


def test_languages_to_learn_from(spark, docs, odd, none):
    assert {r.lang_pred for r in languages.predict(odd, languages.train(none)).collect()} == {"und"}
    one = languages.train(docs.where("lang = 'fr'"))
    assert {r.lang_pred for r in languages.predict(docs.where("text <> ''"), one).collect()} == {"fr"}
    languages.predict(docs, languages.train(odd)).collect()


def test_codewords_are_apart():
    for n in (2, 4, 7, 8, 30):
        code = languages.codewords(n)
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        assert code.shape[0] == n and apart >= max(1, code.shape[1] // 4) and (np.abs(code.sum(axis=0)) < n).all()


def test_long_texts_are_read_whole(monkeypatch):
    parts = ["der hund und die katze laufen " * 40, "x" * 5000]
    monkeypatch.setattr(languages, "STRETCH", 1000)
    assert ["".join(languages.stretches(p)) for p in parts] == parts
    assert sum(len(s) for p in languages.blocks(parts) for s in p[1]) == sum(map(len, parts))


@pytest.mark.parametrize("sizes", [[1100], [700], [1300, 1500], [1030, 1200, 1390]])
def test_pieces_are_cut_where_that_fills_sequences(spark, sizes):
    """Remainders just over half a sequence, of rows with ids of their own, repeated ids, null ids and equal rows."""
    import zlib

    from tokenizers import Tokenizer

    from tallyloom.llm import packing

    words = ["alpha", "beta", "gamma", "delta", "house", "river"]
    rows = [(None if i % 50 == 3 else i // 2 if i % 2 else i, " ".join(words[(i * 7 + k * (1 + i % 3)) % 6] for k in range(sizes[i % len(sizes)] - 1))) for i in range(400)]
    rows += rows[:40] + [(7, None), (8, "")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.lit("x")).repartition(5), vocabulary()).collect()
    full = Tokenizer.from_file(vocabulary())
    ids = [(d, np.array([*full.encode(t or "", add_special_tokens=False).ids, packing.END], dtype="<u4")) for d, t in rows]
    # by document and text, each id is in exactly one piece as often as the row is repeated
    want, cover = Counter(), Counter()
    for d, x in ids:
        want.update((d, zlib.crc32(x[: packing.LENGTH].tobytes()), k) for k in range(len(x)))
    texts = {(d, len(x), zlib.crc32(x.tobytes())): x for d, x in ids}
    for r in got:
        whole = [k for k, x in texts.items() if k[0] == r.doc_id and k[1] == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32]
        assert whole
        cover[r.doc_id, r.doc_tokens] += r.length
    total = Counter()
    for d, x in ids:
        total[d, len(x)] += len(x)
    assert cover == total and sum(r.length for r in got) == len(want) + sum(want.values()) - len(want)
    used = Counter()
    for r in got:
        used[r.sequence_id] += r.length
    for s in used:
        inside = sorted((r.offset, r.length) for r in got if r.sequence_id == s)
        assert [o for o, _ in inside] == [sum(n for _, n in inside[:i]) for i in range(len(inside))]
    assert max(used.values()) <= packing.LENGTH and sum(used.values()) / (len(used) * packing.LENGTH) > 0.95


def test_quality_of_long_texts_is_read_in_stretches(monkeypatch):
    from tallyloom.llm import quality

    rng = np.random.default_rng(5)
    weights = rng.normal(size=(quality.KINDS, quality.BUCKETS)).astype(np.float32)
    words = ["alpha", "be#ta", "x", "日本語", "é", "longword" * 5, "\n", "\n\n", "\t"]
    texts = [" ".join(rng.choice(words, 200)) + end for end in ("", "\n", " ", "tail")] + ["x" * 500, " " * 100 + "a", "a b c d e " * 40, "one line\n" * 30]
    want = [(quality.base_counts(t), quality.logit([t], weights, 0.5)[0]) for t in texts]
    for size in (7, 64, 333):
        monkeypatch.setattr(quality, "STRETCH", size)
        for t, (base, z) in zip(texts, want, strict=True):
            assert quality.base_counts(t) == base and quality.logit([t], weights, 0.5)[0] == pytest.approx(z, abs=1e-5)


def test_quality_of_a_long_text_in_little_memory():
    import subprocess
    import sys

    code = """
import resource
import numpy as np
from tallyloom.llm import quality as Q
w = np.zeros((Q.KINDS, Q.BUCKETS), np.float32)
text = " ".join(f"word{i % 9973} and" for i in range(1_600_000))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
Q.base_counts(text), Q.logit([text], w, 0.0)
print(len(text), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""
    size, grown = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert size > 20_000_000 and grown < 350
