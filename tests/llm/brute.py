"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def spaced(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text: str | None, k: int = 4) -> set[tuple[str, ...]]:
    words = spaced(lower(text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def linked(docs: list[tuple[int | None, str | None]], percent: int = 85) -> list[tuple]:
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(docs)), key=str)


def contamination(docs, items, window: int = 13) -> list[tuple]:
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = lambda t: re.findall(pattern, lower(t or ""))
    wanted: dict[tuple, set[str]] = {}
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        if item is not None and w:
            for i in range(len(w) - size + 1):
                wanted.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w = words(text)
        hit, ids = set(), set()
        for size in {len(p) for p in wanted}:
            for i in range(len(w) - size + 1):
                if found := wanted.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    ids |= found
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def cut_bytes(docs, length: int = 100) -> list[tuple]:
    """Documents with different ids."""
    seen: set[bytes] = set()
    out = []
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            if raw[i : i + length] in seen:
                gone[i : i + length] = [True] * length
            seen.add(raw[i : i + length])
        left = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def cut_words(docs, window: int = 35) -> list[tuple]:
    texts = [spaced(t) for _, t in docs]
    counts = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(docs, texts, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        left = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=str)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        total += int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10))
    return total % 10 == 0


def personal(text: str | None) -> str:
    found = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(f[2] for f in sorted(found))


def nearest(rows, k: int = 5) -> list[tuple]:
    import math

    usable = []
    for vec, x in rows:
        if vec is not None and x and all(v is not None and math.isfinite(v) for v in x):
            usable.append((vec, [math.floor(256 * float(v)) for v in x]))
    out = []
    for q, a in usable:
        if q % 50 == 0:
            scored = sorted((-sum(s * t for s, t in zip(a, b, strict=True)), v) for v, b in usable if v != q and len(a) == len(b))
            out += [(q, r + 1, v, -s) for r, (s, v) in enumerate(scored[:k])]
    return sorted(out)
