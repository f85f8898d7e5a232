"""Secrets in texts: fixed patterns, and values in credential contexts that would take many guesses."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from sievelab.llm.common import full_text, id_key, with_null_ids

KINDS = ("assign", "access", "hex", "password")
ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KEY = (
    r"""(?:password|passwd|passphrase|passcode|pwd|pass|pin|secret|token|credentials?|auth|bearer"""
    r"""|(?:private|access|api|secret)[_-]?key)["']?[\x20\t]*"""
)
# a key may end a joined name (dbPassword, userpwd), but before "is" it begins a word or a part of a camel-case name
BEGIN = r"(?:(?<![A-Za-z0-9])|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z]))"
CONTEXT = re.compile(rf"""(?:(?ai:{KEY}(?::=|=>|[:=]))|{BEGIN}(?ai:{KEY}\bis\b))[\x20\t]*["']?([^\s"'<>,;]+)""")
CONTEXT_WORDS = ("pass", "pwd", "pin", "secret", "token", "credential", "auth", "bearer", "key")
GUESSES = 8.0  # powers of ten from which a value counts as a secret

# fixed: words that guessing starts with, most common first
COMMON_WORDS = (
    "password the admin love secret letmein welcome monkey dragon master hello login user test guest root change "
    "changeme default example sample demo your my here none null true false value string token key api pass passwd "
    "iloveyou sunshine princess football baseball shadow michael jordan superman batman trustno hunter killer pepper "
    "summer winter spring autumn orange banana cookie cheese flower happy freedom whatever computer internet server "
    "system access account security service public private temp temporary please enter insert place holder placeholder "
    "redacted hidden removed foo bar baz qux abc asdf qwerty january february march april may june july august "
    "september october november december monday tuesday friday sunday is of and to in that for with on as by at from"
).split()
LEET = str.maketrans("@4301!5$7", "aaeoiisst")
DATE = re.compile(r"(?:(?:19|20)\d\d[-/.]?[01]?\d[-/.]?[0-3]?\d|[0-3]?\d[-/.][01]?\d[-/.](?:19|20)?\d\d|(?:19|20)\d\d)")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
NEXT_SEGMENT = 1.0


def keyboard() -> dict[str, str]:
    """Keys beside each key; a row is half a key to the right of the one above."""
    place = {c: (r, i - (r == 0)) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
    beside = lambda a, b: a != b and (
        (a[0] == b[0] and abs(a[1] - b[1]) == 1) or (b[0] - a[0] == 1 and b[1] - a[1] in (-1, 0)) or (a[0] - b[0] == 1 and a[1] - b[1] in (-1, 0))
    )
    return {c: "".join(d for d in place if beside(place[c], place[d])) for c in place}


NEAR = keyboard()


@cache
def ranks() -> dict[str, int]:
    """Guessing order of words: the fixed ones, then the about 20,000 lower-case words that are one token of a public
    vocabulary, in the order of its ids, which is about that of their frequency."""
    vocabulary = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).get_vocab()
    words = sorted((i, w[1:]) for w, i in vocabulary.items() if w[0] == "Ġ")
    plain = [w for _, w in words if w.isascii() and w.isalpha() and w.islower()]
    return {w: i for i, w in enumerate(dict.fromkeys([*COMMON_WORDS, *plain]), 1)}


@cache
def longest_word() -> int:
    return max(map(len, ranks()))


def alphabet(c: str) -> int:
    if c.isdigit():
        return 10
    if c.isalpha():
        return 26 if c.isascii() else 100
    return 33


def guesses(value: str) -> tuple[float, list[tuple[str, str]]]:
    """log10 of the guesses of the cheapest segmentation, and its (kind, segment) parts.

    Segments are dictionary words (any case, common letter substitutes), dates and years, repeats of one character or of
    a short unit, walks over neighbouring keys or codes, and brute-force spans. Runs are entered anywhere and left at
    their end, so time is linear in the value's length.
    """
    n = len(value)
    rank_of, longest = ranks(), longest_word()
    lower = value.lower() if len(value.lower()) == n else value
    plain = lower.translate(LEET)
    best = [0.0] + [math.inf] * n
    back: list[tuple[int, str]] = [(0, "")] * (n + 1)
    ends = {1: [n] * (n + 1), 2: [n] * (n + 1), 3: [n] * (n + 1)}  # where a repeat of a unit of 1 to 3 ends
    for unit, end in ends.items():
        for i in range(n - unit - 1, -1, -1):
            end[i] = end[i + 1] if value[i] == value[i + unit] and i + 1 <= n - unit else i + unit
    walk, step = [n] * (n + 1), [n] * (n + 1)
    for i in range(n - 2, -1, -1):
        walk[i] = walk[i + 1] if lower[i + 1] in NEAR.get(lower[i], "") else i + 1
        steps = ord(lower[i + 1]) - ord(lower[i])
        on = i + 2 < n and ord(lower[i + 2]) - ord(lower[i + 1]) == steps
        step[i] = (step[i + 1] if on else i + 2) if abs(steps) == 1 else i + 1

    def offer(i: int, j: int, cost: float, kind: str) -> None:
        total = best[i] + cost + (NEXT_SEGMENT if i else 0.0)
        if total < best[j]:
            best[j], back[j] = total, (i, kind)

    for i in range(n):
        if back[i][1] == "brute":  # a brute-force span goes on without a new segment
            total = best[i] + math.log10(alphabet(value[i]))
            if total < best[i + 1]:
                best[i + 1], back[i + 1] = total, (back[i][0], "brute")
        offer(i, i + 1, math.log10(alphabet(value[i])), "brute")
        for j in range(i + 3, min(n, i + longest) + 1):
            rank = rank_of.get(lower[i:j])
            if rank is None and (rank := rank_of.get(plain[i:j])) is not None:
                rank *= 4
            if rank is not None:
                offer(i, j, math.log10(rank * (1 if value[i:j] == lower[i:j] else 2)), "word")
        if (date := DATE.match(value, i)) and date.end() - i >= 4:
            offer(i, date.end(), math.log10(120 if date.end() - i == 4 else 120 * 365), "date")
        for unit, end in ends.items():
            if end[i] - i >= max(3, 2 * unit):
                cost = sum(math.log10(alphabet(c)) for c in value[i : i + unit])
                offer(i, end[i], cost + math.log10((end[i] - i) / unit), "repeat")
        if walk[i] - i >= 3:
            turns = sum(lower[k + 1] != lower[k] for k in range(i, min(walk[i] - 1, i + 4)))
            offer(i, walk[i], math.log10(47) + min(turns, 3) * math.log10(4.6) + math.log10(walk[i] - i), "walk")
        if step[i] - i >= 3:
            offer(i, step[i], math.log10(4 * (step[i] - i)), "sequence")
    parts: list[tuple[str, str]] = []
    j = n
    while j:
        i, kind = back[j]
        parts.append((kind, value[i:j]))
        j = i
    return best[n], parts[::-1]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, end) of the fixed patterns, leftmost and non-overlapping within a kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def password_spans(text: str, base: list[tuple[int, int, str]], least: float = GUESSES) -> Iterator[tuple[int, int, int, float]]:
    """Values in credential contexts outside the base spans that take ``least`` powers of ten guesses or more."""
    lower = text.lower()
    if not any(c in lower for c in (":", "=", "is")) or not any(w in lower for w in CONTEXT_WORDS):
        return
    for m in CONTEXT.finditer(text):
        start, end = m.span(1)
        while end > start and text[end - 1] in ".:!?)":
            end -= 1
        if any(a < end and start < b for a, _, b in base):
            continue
        cost, _ = guesses(text[start:end])
        if cost >= least:
            yield start, 3, end, cost


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_secrets(docs: DataFrame, least: float = GUESSES) -> DataFrame:
    """Secret spans of every document; null texts are empty.

    ``spans`` has the fixed patterns and the values in credential contexts whose cheapest segmentation takes 10^``least``
    guesses or more, by start, then kind; ``most_guesses`` is the largest exponent of the latter.
    """

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["text"]:
                base = base_spans(text)
                added = list(password_spans(text, base, least))
                number = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                everything = sorted(base + [x[:3] for x in added])
                rows.append((*number, digest, joined(everything), max((x[3] for x in added), default=None)))
            names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "most_guesses"]
            out = pd.DataFrame(rows, columns=names).astype({"most_guesses": "float64"})
            out.insert(0, "doc_id", frame["doc_id"])
            yield out

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, most_guesses double"
    return with_null_ids(docs.select(id_key(), full_text().alias("text")).mapInPandas(scan, schema))
