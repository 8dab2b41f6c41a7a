"""Secrets in texts, with a random forest that removes false findings.

Patterns propose candidates: values given to names like ``token`` or
``password``, strings with the prefixes of well-known keys, private key headers,
and long runs of letters and digits.  A forest then judges each by its length,
its character transitions (how likely its letter pairs are in the words of the
corpus, how often it changes between digits and letters), the share of it that
dictionary words cover, whether it stands in a path, and the words around it.

The forest is trained in numpy on labelled findings, at most ``SAMPLE`` of each
label.  No table of labelled findings exists, so ``planted`` makes them up: it
sets invented secrets and the usual false alarms, both of every kind of
candidate, into texts of the corpus, and takes their surroundings as they are
there.
"""

from __future__ import annotations

import math
import pickle
import random
import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents that lend their text to labelled findings, and findings of each label, at most.
SAMPLE = 1500
TREES, DEPTH, LEAF, SPLITS = 24, 8, 4, 12
KEEP = 0.5
AROUND = 48

# Names of secrets, marks of placeholders, and common words.
NAMES = "password passwd pwd secret token apikey api_key api-key access_key accesskey auth credential private_key".split()
PLACEHOLDERS = "example sample dummy placeholder changeme your insert redacted xxxx test fake demo todo".split()
DICTIONARY = frozenset(
    """about access account action admin after again all and any api are back base been before block body build can change check
    class client code config content control count create data date default delete document down each email end error event
    example field file find first for from function get good group have header help here home host image index info into item key
    last level library license line link list load local long main make manager message method model module more name new node not
    number object one only open option order other output over package page parent password path place point port process project
    public query read record report request response result return right root run sample search secret section server service
    session set should show size some source start state status step stop storage string support system table task template test
    text that the their there this time title token total tree type update user value version view was week where which will with
    word work world write year you your""".split()
)

#: No longer end of a word is in the dictionary.
LONGEST = max(map(len, DICTIONARY))
_NAMES = "|".join(re.escape(n) for n in NAMES)
_PATTERNS = {
    "private_key": re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    "prefixed": re.compile(
        r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[0-9A-Za-z_-]{35}"
        r"|sk-[A-Za-z0-9_-]{20,}+|eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)(?![A-Za-z0-9])"
    ),
    "assigned": re.compile(rf"(?:{_NAMES})[a-z_]{{0,12}}[\"']?\s{{0,3}}(?:[:=]|=>|:=)\s{{0,3}}[\"']?([^\s\"'<>,;]{{8,}}+)", re.I),
    "random": re.compile(r"[A-Za-z0-9+/_=-]{20,}+"),
}
KINDS = list(_PATTERNS)
_PREFIXES = ("AKIA", "gh", "xox", "AIza", "sk-", "eyJ")
#: What commonly stands before numbers and hashes that are no secret.
HARMLESS = re.compile(r"\b(?:commit|revision|rev|object|checksum|digest|sha\d*|md5|hash|etag|id|uuid|guid|see|order|no|number)\b")
_WORD = re.compile("[a-z]{3,}")
_PATH = re.compile(r"(?:[A-Za-z]:\\|\.{0,2}/|\w://)[^\s\"']*$|\.(?:py|js|md|txt|html?|json|ya?ml|png|jpg|css|lock)\b")

Finding = tuple[str, int, int]


def findings(text: str) -> list[Finding]:
    """Candidates that don't overlap, the surer patterns first: kind, start and end in code points."""
    out: list[Finding] = []
    starts: list[int] = []
    ends: list[int] = []
    lower = None
    for kind, pattern in _PATTERNS.items():
        if kind == "private_key" and "-----BEGIN" not in text:
            continue
        if kind == "prefixed" and not any(p in text for p in _PREFIXES):
            continue
        if kind == "assigned":
            lower = text.lower()
            if not any(n in lower for n in NAMES):
                continue
        for m in pattern.finditer(text):
            a, b = m.span(1) if kind == "assigned" else m.span()
            if kind == "random":
                run = m[0]
                if run.isalpha() or not any(c.isalpha() for c in run) and len(run) < 24:
                    continue
            # Findings do not overlap, so only the neighbours can be in the way.
            place = bisect_right(starts, a)
            if (place == 0 or ends[place - 1] <= a) and (place == len(starts) or starts[place] >= b):
                starts.insert(place, a)
                ends.insert(place, b)
                out.append((kind, a, b))
    return sorted(out, key=lambda f: f[1])


def letter_pairs(texts: DataFrame, text: str) -> np.ndarray:
    """How often one letter stands after another, in all of every text; other characters are one letter."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(27 * 27, dtype=np.int64)
        for batch in batches:
            for t in batch.column(0):
                codes = letters(t.as_py() or "")
                counts += np.bincount(codes[:-1] * 27 + codes[1:], minlength=27 * 27)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(27 * 27)), pa.array(counts)], names=["pair", "n"])

    rows = texts.select(text).mapInArrow(counted, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(27 * 27, dtype=np.int64)
    for pair, n in rows:
        counts[pair] = n
    return counts.reshape(27, 27)


def transitions(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of one letter after another, from how often they do."""
    return np.log((counts + 1.0) / (counts + 1.0).sum(axis=1, keepdims=True))


def letters(text: str) -> np.ndarray:
    codes = np.frombuffer(text.lower().encode("ascii", "replace"), dtype=np.uint8).astype(np.int64) - 97
    return np.where((codes >= 0) & (codes < 26), codes, 26)


def features(text: str, finding: Finding, pairs: np.ndarray) -> list[float]:
    kind, a, b = finding
    value, before, after = text[a:b], text[max(0, a - AROUND) : a], text[b : b + AROUND]
    low, near = value.lower(), (before + " " + after).lower()
    n = len(value)
    counts = [value.count(c) for c in set(value)]
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    classes = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s" for c in value]
    changes = sum(x != y for x, y in zip(classes, classes[1:], strict=False))
    codes = letters(value)
    likely = float(pairs[codes[:-1], codes[1:]].mean()) if n > 1 else 0.0
    covered = sum(len(w) for w in _WORD.findall(low) if w in DICTIONARY or any(w.startswith(d) and w[len(d) :] in DICTIONARY for d in (w[:k] for k in range(max(3, len(w) - LONGEST), len(w) - 2))))
    left = before[-24:].lower()
    return [
        n,
        entropy,
        classes.count("d") / n,
        classes.count("u") / n,
        classes.count("s") / n,
        changes / n,
        likely,
        covered / n,
        len(counts) / n,
        float(bool(_PATH.search(before[-AROUND:] + value))),
        float(any(x in left for x in NAMES)),
        float(left.rstrip(" \"'")[-1:] in ("=", ":")),
        float(any(x in low for x in PLACEHOLDERS)),
        float(any(x in near for x in PLACEHOLDERS)),
        float(bool(HARMLESS.search(left))),
        float(KINDS.index(kind)),
    ]


class Forest:
    """Binary trees on bootstrapped rows, each split the best of some random ones."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5):
        chance = np.random.default_rng(seed)
        self.trees = []
        for _ in range(TREES):
            rows = chance.integers(0, len(y), len(y))
            self.trees.append(self._grow(x[rows], y[rows], DEPTH, chance))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, chance) -> tuple | float:
        share = float(y.mean())
        if depth == 0 or len(y) < 2 * LEAF or share in (0.0, 1.0):
            return share
        best = None
        for column in chance.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1])) + 1), replace=False):
            values = x[:, column]
            for cut in np.unique(chance.choice(values, SPLITS)):
                left = values <= cut
                m = int(left.sum())
                if LEAF <= m <= len(y) - LEAF:
                    p, q = y[left].mean(), y[~left].mean()
                    impurity = m * p * (1 - p) + (len(y) - m) * q * (1 - q)
                    if best is None or impurity < best[0]:
                        best = (impurity, int(column), float(cut), left)
        if best is None:
            return share
        _, column, cut, left = best
        return column, cut, self._grow(x[left], y[left], depth - 1, chance), self._grow(x[~left], y[~left], depth - 1, chance)

    def score(self, row: list[float]) -> float:
        total = 0.0
        for tree in self.trees:
            while isinstance(tree, tuple):
                tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
            total += tree
        return total / len(self.trees)


def _secret(chance: random.Random) -> tuple[str, str]:
    """A secret and what stands before it."""
    hexed = "".join(chance.choices("0123456789abcdef", k=chance.choice([32, 40, 64])))
    mixed = "".join(chance.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=chance.randint(20, 44)))
    key = "AKIA" + "".join(chance.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16))
    word = "".join(chance.choices("abcdefghjkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789!#%", k=chance.randint(10, 18)))
    name = chance.choice(NAMES)
    if chance.random() < 0.5:
        name = name.upper()
    sign = chance.choice([' = "', ": ", "=", ' := "', "='"])
    kind = chance.randrange(8)
    if kind == 0:
        return chance.choice([key, *_prefixed(chance)]), chance.choice(["", f"{name}{sign}"])
    if kind == 1:
        return "ghp_" + (mixed * 2)[:36], chance.choice(["", f"{name}{sign}"])
    if kind < 5:
        return [hexed, mixed, word][kind - 2], f"{name}{sign}"
    if kind == 5:
        return _private_key(chance, "\n".join(_base64(chance, 64) for _ in range(4))), chance.choice(["", "\n", f"{name}{sign}"])
    # Without a name beside it.
    bare = chance.choice([hexed, mixed + str(chance.randrange(10)), _base64(chance, chance.choice([28, 40, 44, 64, 88]))])
    return bare, chance.choice(["", "", "\n", "key: ", "key = ", "use ", "Bearer ", "value=", "-k "])


def _base64(chance: random.Random, n: int) -> str:
    end = chance.choice(["", "=", "=="])
    return "".join(chance.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=n - len(end))) + end


def _prefixed(chance: random.Random) -> list[str]:
    """A key of each of the other known prefixes."""
    run = lambda n: "".join(chance.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=n))
    number = lambda: "".join(chance.choices("0123456789", k=12))
    return [
        f"xox{chance.choice('abprs')}-{chance.choice([f'{number()}-{number()}-', ''])}{chance.choice([run(24), run(40), f'{chance.getrandbits(160):040x}'])}",
        "AIza" + run(35),
        "sk-" + chance.choice(["", "proj-"]) + run(chance.randint(24, 60)),
        f"eyJ{run(33)}.eyJ{run(chance.randint(40, 300))}.{run(chance.choice([43, 86, 342, 683]))}",
    ]


def _private_key(chance: random.Random, body: str) -> str:
    kind = chance.choice(["", "RSA ", "EC ", "OPENSSH "])
    return f"-----BEGIN {kind}PRIVATE KEY-----\n{body}\n-----END {kind}PRIVATE KEY-----"


def _false_alarm(chance: random.Random) -> tuple[str, str]:
    """What looks like a secret at first, and what stands before it."""
    words = chance.sample(sorted(DICTIONARY), 4)
    hexed = "".join(chance.choices("0123456789abcdef", k=chance.choice([32, 40, 64])))
    number = "".join(chance.choices("0123456789", k=chance.randint(24, 30)))
    name = chance.choice(NAMES)
    sign = chance.choice([' = "', ": ", "=", ' := "', "='"])
    return chance.choice(
        [
            ("_".join(words) + str(chance.randint(1, 99)), chance.choice(["", f"{name}{sign}"])),
            (chance.choice(["your", "example", "changeme", "dummy", "test"]) + "-" + "-".join(words[:2]) + "-1", f"{name}{sign}"),
            (chance.choice("x*0") * chance.randint(12, 32), f"{name}{sign}"),
            (f"/{words[0]}/{words[1]}/{hexed}.{chance.choice(['js', 'css', 'png'])}", ""),
            (str(uuid.UUID(int=chance.getrandbits(128))), chance.choice(["id ", "see ", "order "])),
            (f"sha256-{hexed}", chance.choice(["commit ", "checksum ", "digest "])),
            (hexed, chance.choice(["commit ", "revision ", "object "])),
            (number, chance.choice(["", "no. "])),
            (f"self.{words[0]}_{words[1]}", f"{name}="),
            (f"${{{words[0].upper()}_{words[1].upper()}}}", f"{name}: "),
            ("AKIA" + "".join(chance.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=9)) + "EXAMPLE", chance.choice(["", f"{name}{sign}"])),
            ("ghp_" + chance.choice("xX0") * 36, chance.choice(["", f"{name}{sign}"])),
            ("sk-" + "-".join(chance.sample(sorted(DICTIONARY), 5)), ""),
            (_private_key(chance, chance.choice(["YOUR_KEY_HERE", "<insert your key>", "xxxxxxxxxxxx", "example", "REDACTED"])), ""),
        ]
    )


def planted(text: str, chance: random.Random) -> Iterator[tuple[str, Finding, int]]:
    """A text with a secret set into it, and one with a false alarm: text, finding, label."""
    for label, make in ((1, _secret), (0, _false_alarm)):
        value, before = make(chance)
        place = text.find(" ", chance.randrange(len(text) + 1)) + 1  # after a space anywhere in the text
        whole = text[max(0, place - 200) : place] + before
        start = len(whole)
        close = '"' if before.endswith('"') else "'" if before.endswith("'") else ""
        whole += value + close + " " + text[place : place + 200]
        for finding in findings(whole):
            if finding[1] < start + len(value) and start < finding[2]:
                yield whole, finding, label
                break


FEATURE = T.ArrayType(T.DoubleType())


def trained(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[Forest | None, np.ndarray]:
    """A forest and the letter pairs: these from all texts, the forest from findings planted into at most ``SAMPLE`` documents by hash.

    One task trains it.
    """
    texts = docs.select(F.col(key).cast("string").alias("_id"), F.col(text).alias("_text")).filter(F.octet_length("_text") > 0)
    pairs = transitions(letter_pairs(texts, "_text"))
    rows = texts.select(F.md5(F.coalesce("_id", F.lit(""))).alias("_order"), F.xxhash64("_text").alias("_hash"), "_text")
    # Which texts, before any text is moved; equal rows are one.
    first = rows.select("_order", "_hash").distinct().orderBy("_order", "_hash").limit(SAMPLE)
    chosen = rows.join(F.broadcast(first), ["_order", "_hash"]).dropDuplicates(["_order", "_hash"])  # at most SAMPLE rows

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(t for batch in batches for t in batch.column(0).to_pylist())
        rows, labels = [], []
        for k, t in enumerate(found):
            for whole, finding, label in planted(t, random.Random(k)):
                rows.append(features(whole, finding, pairs))
                labels.append(label)
        forest = Forest(np.array(rows), np.array(labels, dtype=float)) if len(set(labels)) == 2 else None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(forest)])], names=["model"])

    rows = chosen.select("_text").repartition(1).mapInArrow(fit, "model binary").collect()
    return (pickle.loads(rows[0][0]) if rows else None), pairs


def judged(docs: DataFrame, model: tuple[Forest | None, np.ndarray], columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` with ``findings``: arrays of (kind, start, end, score), all candidates; NULL and empty texts have none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    entry = T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]
    )
    schema = docs.select(*[F.col(f"`{c}`") for c in columns]).schema.add("findings", T.ArrayType(entry))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, pairs = shared.value
        for batch in batches:
            column = batch.column(len(columns))
            for first in range(0, len(column), 256):
                rows = []
                for t in column.slice(first, 256).to_pylist():
                    rows.append(
                        [
                            {"kind": f[0], "start": f[1], "end": f[2], "score": round(forest.score(features(t, f, pairs)), 6) if forest else 1.0}
                            for f in findings(t or "")
                        ]
                    )
                carried = [c.slice(first, 256) for c in batch.columns[: len(columns)]]
                yield pa.RecordBatch.from_arrays([*carried, pa.array(rows, type=kind)], names=schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in columns], F.col(text)).mapInArrow(run, schema)


def secret_report(docs: DataFrame) -> DataFrame:
    """One row per document: candidates, those the forest keeps, and where they stand."""
    rows = judged(docs, trained(docs), ["doc_id"])
    real = F.filter("findings", lambda f: f["score"] >= KEEP)
    spans = F.transform(real, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string")))
    return rows.select(
        "doc_id",
        F.size("findings").cast("long").alias("n_candidates"),
        F.size(real).cast("long").alias("n_secrets"),
        F.coalesce(F.array_max(F.transform("findings", lambda f: f["score"])), F.lit(0.0)).alias("top_score"),
        F.array_join(spans, ",").alias("spans"),
    )
