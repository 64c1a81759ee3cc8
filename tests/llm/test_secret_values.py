"""Where values end, what many values in one cost, and what copies teach."""

import random
import time

import pytest

from tallyloom.llm import secrets_scan as S


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('password: "aB3,xY9;qL2vM7" next', 'password: "[secret]" next'),
        ("pwd: x9$K'q2!vLp7z and", "pwd: [secret] and"),
        ("token: kf9Q<zR3>vT8 end", "token: [secret] end"),
        ("the password is Tr0ub4dor&Zq7! Bye", "the password is [secret] Bye"),
        ("password:\tx9$Kq2!vLp7z now", "password:\t[secret] now"),
        ("secret='x9$K,q2!vL`p7z'.", "secret='[secret]'."),
        ("<b>token: x9$Kq2!vLp7z</b><br>", "<b>token: [secret]</b><br>"),
        ("<li>token: harbour</li><li>and more</li>", "<li>token: harbour</li><li>and more</li>"),
        ("(password: x9$Kq2!vLp7z)", "(password: [secret])"),
        ("columns token,count,name,value,harbour,lantern", "columns token,count,name,value,harbour,lantern"),
        ('the "secret" is what we keep, "token" is what we count', 'the "secret" is what we keep, "token" is what we count'),
        ('{"api_key": "x9$Kq2!vLp7z", "user": "ann"}', '{"api_key": "[secret]", "user": "ann"}'),
    ],
)
def test_values(text, want):
    guesser = S.Guesser("harbour lantern count name value what keep columns more".split())
    found = [x for x in S.spans(text, S.THRESHOLD, guesser) if x[1] == 3]
    assert S.redact(text, found) == want


def test_costs_of_the_ends_of_a_value(monkeypatch):
    """Each end's cost from one pass back equals its own cost, as judged from the front."""
    monkeypatch.setattr(S, "SHORT", 0)
    rng, g = random.Random(4), S.Guesser(["harbour", "lantern"])
    for k in range(40):
        pieces = ["token=", "harbour", "Lantern", "qwerty", "1999-12-31", "ab", "ab", "7", "x$"]
        value = "".join(rng.choice(pieces) * rng.choice([1, 1, 2, 5]) for _ in range(rng.randint(1, 9)))
        monkeypatch.setattr(S, "WINDOW", rng.choice([3, 20, 256]))
        total, alone = g.ends(value, 1e6)
        assert total == pytest.approx(alone[0]), value
        for s in range(0, len(value), 3):
            assert alone[s] == pytest.approx(g.ends(value[s:], 1e6)[0]), (value, s, k)


def test_windows_change_no_cost(monkeypatch):
    rng, g = random.Random(9), S.Guesser(["harbour", "lantern"])
    for _ in range(30):
        value = "".join(rng.choice(["harbour", "qwe", "aaaa", "12", "x9$K"]) * rng.choice([1, 3]) for _ in range(12))
        monkeypatch.setattr(S, "WINDOW", 10_000)
        want = g.ends(value, 36.0)[0], g.ends(value, 1e6)[0]
        monkeypatch.setattr(S, "WINDOW", 8)
        assert (g.ends(value, 36.0)[0], g.ends(value, 1e6)[0]) == pytest.approx(want)


@pytest.mark.parametrize("text", ["token=" * 20_000, "token=x9$Kq2!vLp7z" * 2000, "token=" + "x9$Kq2!vLp7z" * 100_000, "secret " * 50_000, 'token="' * 20_000, "token=a," * 20_000])
def test_hostile_texts_take_no_long(text):
    start = time.process_time()
    S.spans(text)
    assert time.process_time() - start < 8  # two on a machine of its own; by the square of the length it would be hours


def test_many_times_of_a_repeat_end_late():
    g = S.Guesser()
    for n in (1024, 1025, 1500, 4000):
        want = min(g.cost("ab") + __import__("math").log2(n), 1e9)
        assert g.cost("ab" * n) == pytest.approx(want)
        assert g.cost("ab" * n + "harbour") == pytest.approx(want + min(g.cost("harbour"), 7 * S.brute("a")), abs=1.01)


def test_copies_teach_no_secret(spark):
    secret = "xkqjzwvhtnbpm"
    texts = [f"the key {secret} opens the door number {k}" for k in range(30)] + ["a harbour by the sea", "our harbour is old", "the harbour town"]
    words = S.dictionary(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4))
    assert secret not in words and "harbour" in words and "the" in words
    assert S.spans(f"password: {secret} now", S.THRESHOLD, S.Guesser(words)) != []
