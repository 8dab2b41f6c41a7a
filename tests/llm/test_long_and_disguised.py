"""Texts of many findings, findings anywhere in a text, and more disguises."""

from __future__ import annotations

import random
import time

import pytest

from stallwise.llm import pii, secret_scan


@pytest.mark.parametrize(
    ("text", "kind", "start", "end"),
    [
        ("see 192[.]168[.]0[.]1 now", "ip", 4, 21),
        ("see 192 dot 168 dot 0 dot 1 now", "ip", 4, 27),
        ("at one nine two dot one six eight dot zero dot one, yes", "ip", 3, 50),
        ("mail jane&#64;example.com today", "email", 5, 25),
        ("mail jane&commat;example&period;com today", "email", 5, 35),
        ("mail jane @ example . com today", "email", 5, 25),
        ("mail j\u0251ne@example.com today", "email", 5, 21),
        ("mail jane[@]example[.]com today", "email", 5, 25),
        ("ruf plus vier neun eins sieben zwei drei vier fünf sechs an", "phone", 4, 56),
        ("appelez plus trois trois un deux trois quatre cinq six sept merci", "phone", 8, 59),
        ("llama plus tres cuatro seis uno dos tres cuatro cinco seis ya", "phone", 6, 58),
    ],
)
def test_disguises(text, kind, start, end):
    base, spans = pii.found(text)
    assert (kind, start, end) in spans and (kind, start, end) not in base


@pytest.mark.parametrize(
    "text",
    [
        "She said: one, two, three, and then four of them left at noon. Period.",
        "Un homme, deux femmes, trois enfants et quatre chiens.",
        "He waited @ home . Then he left",
        "version 1 dot 2, see [1], (2) and <3>",
        "uno dos tres, eins zwei drei, &amp; &#8217;",
    ],
)
def test_clean_texts(text):
    assert pii.found(text) == ([], [])


def test_a_span_within_a_base_span_is_not_added():
    chance = random.Random(4)
    for _ in range(200):
        parts = [chance.choice(["jane@example.com", "jane (at) example (dot) com", "192[.]168[.]0[.]1", "10.0.0.1", "a\uff20b.org", "x"]) for _ in range(8)]
        base, spans = pii.found(" ; ".join(parts))
        added = [s for s in spans if s not in base]
        assert not any(x <= a and b <= y for _, a, b in added for _, x, y in base)
        assert all(s in spans for s in base)


def test_many_addresses_take_seconds():
    text = " ".join(f"user{k} (at) example{k} (dot) com and other{k}@mail.org" for k in range(60_000))
    began = time.process_time()
    base, spans = pii.found(text)
    assert (len(base), len(spans)) == (60_000, 120_000)
    assert time.process_time() - began < 30


def overlapping(text: str) -> list[tuple]:
    """Candidates one by one against all accepted ones."""
    return [f for i, f in enumerate(secret_scan.findings(text)) if any(f[1] < o[2] and o[1] < f[2] for o in secret_scan.findings(text)[:i])]


def test_findings_do_not_overlap():
    chance = random.Random(5)
    alphabet = "abcdefABCDEF0123456789+/"
    for _ in range(50):
        words = ["".join(chance.choices(alphabet, k=chance.choice([8, 20, 33, 40]))) for _ in range(12)]
        signs = [chance.choice(["password=", "token: ", "", "AKIA", "key = '", " "]) for _ in words]
        text = " ".join(s + w for s, w in zip(signs, words, strict=True))
        assert overlapping(text) == []
        assert [f[1] for f in secret_scan.findings(text)] == sorted(f[1] for f in secret_scan.findings(text))


def test_many_findings_take_seconds():
    chance = random.Random(6)
    text = " ".join("".join(chance.choices("abcdef0123456789XYZ", k=32)) for _ in range(60_000))
    began = time.process_time()
    assert len(secret_scan.findings(text)) > 59_000
    assert time.process_time() - began < 20


def test_planted_findings_stand_anywhere_in_a_text():
    text = "word " * 20_000 + "LATE " * 20_000
    late = [whole for seed in range(40) for whole, _, _ in secret_scan.planted(text, random.Random(seed)) if "LATE" in whole]
    assert len(late) > 10
    assert list(secret_scan.planted("x", random.Random(1)))
