"""Identifiers of which only a part is plain."""

from __future__ import annotations

import pytest

from stallwise.llm import pii


@pytest.mark.parametrize(
    "text, kind, base, whole",
    [
        ("mail jаne@example.com now", "email", "ne@example.com", "jаne@example.com"),
        ("call +1 202 555 01 two three four now", "phone", "+1 202 555 01", "+1 202 555 01 two three four"),
        ("host 10.20.30.4５ up", "ip", "10.20.30.4", "10.20.30.4５"),
        ("mail jane@mail.exаmple.com now", "email", "jane@mail.ex", "jane@mail.exаmple.com"),
    ],
)
def test_a_disguised_span_beyond_a_base_span_counts(text, kind, base, whole):
    plain, spans = pii.found(text)
    assert [(k, text[a:b]) for k, a, b in plain] == [(kind, base)]
    assert set(plain) <= set(spans)
    assert (kind, whole) in [(k, text[a:b]) for k, a, b in spans]
    assert len(spans) == len(set(spans))
