"""Secret scans: fixed patterns, and a linear-chain conditional random field."""

from __future__ import annotations

import functools
import hashlib
import json
import math
import operator
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fresh, in_parts, saved, shipped

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE, MIN_ACCESS = 6, 20

#: The patterns as one for Spark, and what makes a text without a secret a hard one.
HOLDS = rf"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{{{MIN_VALUE},}}|AKIA[A-Z0-9]{{{MIN_ACCESS - 4},}}|[0-9a-f]{{24,}}"""
MIXED = "[0-9][A-Za-z]|[A-Za-z][0-9]"
#: Texts the field is fitted on: half of them with a secret, a quarter hard, if there are as many.
FIT_ROWS = 2000
ROUNDS = 5
#: Labels: outside, begin, inside.
OUT, BEGIN, IN = 0, 1, 2
#: Snippets of a training text: its own, and rewritten ones; characters kept on either side.
REWRITES, SNIPPETS, SIDE = 4, 1, 120
#: Words that announce a secret, for rewritten snippets.
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey", "pwd", "passphrase", "key")
SLICE = 1 << 18
MASK = "[SECRET]"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, in code points, the end exclusive."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def _values(text: str) -> list[tuple[int, int]]:
    """What is secret in the fixed patterns' spans: of an assignment its value."""
    found = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    found += [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    return found + [m.span() for m in HEX.finditer(text)]


# ------------------------------------------------------------------ tokens and features


def _set(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


_LOWERS, _UPPERS, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_UPPER, _LOWER, _DIGIT, _VOWEL = _set(_UPPERS), _set(_LOWERS), _set(_DIGITS), _set("aeiouyAEIOUY")
_HEX, _RUN = _set(_DIGITS + "abcdefABCDEF"), _set(_LOWERS + _UPPERS + _DIGITS + "+/_.-")
_HIGH = np.arange(256) >= 128
#: Space 0, letter 1, digit 2; any other byte is a class of its own, so equal signs in a row are one token.
_CLASS = np.where(np.arange(256) <= 32, 0, np.where(_UPPER | _LOWER | _HIGH, 1, np.where(_DIGIT, 2, np.arange(256)))).astype(np.uint8)
_FOLD = np.where(_UPPER, np.arange(256) + 32, np.arange(256)).astype(np.uint32)
_TIMES = 0x01000193
_BITS = 16


def _hashed(slot: int, *columns: np.ndarray) -> np.ndarray:
    h = columns[0].astype(np.uint32)
    h += np.uint32((slot * 0x9E3779B1) & 0xFFFFFFFF)
    for c in columns[1:]:
        h *= np.uint32(0x85EBCA6B)
        h += c.astype(np.uint32)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x27D4EB2F)
    h >>= np.uint32(32 - _BITS)
    return h.astype(np.int32)


def _moved(values: np.ndarray, by: int) -> np.ndarray:
    """The value `by` tokens before, or behind if negative; zero beyond the ends."""
    out = np.zeros_like(values)
    if by > 0:
        out[by:] = values[:-by]
    else:
        out[:by] = values[-by:]
    return out


def symbol_share(raw: bytes) -> float:
    """How much of the file is punctuation of code and settings."""
    return sum(map(raw.count, (b"=", b":", b"{", b";", b'"'))) / max(1, len(raw))


@dataclass
class Tokens:
    """Every token of some texts in a row: its text, bytes within it, and hashed features.

    `own` has a row per token, `shared` a row per run; `run` gives a token's run.
    """

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    run: np.ndarray
    own: np.ndarray
    shared: np.ndarray

    @property
    def features(self) -> np.ndarray:
        return np.concatenate([self.own, self.shared[self.run]], axis=1)


def tokens_of(raws: list[bytes], shares: list[float]) -> Tokens:
    """Tokens are runs of letters, of digits, or of one other sign; white space parts them.

    Features are a token's shape, the shape of the unbroken run it stands in, its place there,
    the words and signs around it, the run before, and the kind of file. Takes some 60 bytes
    a byte of text.
    """
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    kind = _CLASS[data]
    change = np.flatnonzero(np.diff(kind, prepend=np.uint8(0))).astype(np.int64)
    start = change[kind[change] > 0]
    if not len(start):
        none = np.zeros(0, np.int64)
        return Tokens(none, none, none, none, np.zeros((0, 0), np.int32), np.zeros((0, 0), np.int32))
    end = np.append(change[1:], len(data))[kind[change] > 0]
    begins = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])]).astype(np.int64)
    text = np.searchsorted(begins, start, side="right") - 1
    size = end - start

    # A polynomial hash of each token from prefix sums modulo 2^32.
    power = np.cumprod(np.full(len(data), _TIMES, np.uint32), dtype=np.uint32)
    back = np.cumprod(np.full(len(data), pow(_TIMES, -1, 1 << 32), np.uint32), dtype=np.uint32)
    sums = np.concatenate([np.zeros(1, np.uint32), np.cumsum(_FOLD[data] * power, dtype=np.uint32)])
    own = (sums[end] - sums[start]) * back[start] + np.uint32(1)
    del power, back, sums

    def count(table: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[data], dtype=np.int32)])
        return total[to] - total[at]

    sort = kind[start]
    ups, highs = count(_UPPER, start, end), count(_HIGH, start, end)
    shape = np.select(
        [sort == 2, sort != 1, highs > 0, ups == 0, ups == size, (ups == 1) & _UPPER[data[start]]], [5, 8 + sort.astype(np.int64), 4, 0, 1, 2], 3
    )
    small = np.minimum(size, 12)

    # Runs: tokens of letters, digits and joining signs without a break.
    joins = _RUN[data[start]] & (highs == 0)
    glued = np.zeros(len(start), bool)
    glued[1:] = joins[1:] & joins[:-1] & (start[1:] == end[:-1])
    first = np.flatnonzero(~glued)
    run = np.cumsum(~glued) - 1
    last = np.append(first[1:], len(start)) - 1
    at, to = start[first], end[last]
    length = to - at
    log = np.minimum(15, (2 * np.log2(length)).astype(np.int64))
    letters = np.maximum(1, count(_UPPER | _LOWER, at, to))
    digits = 8 * count(_DIGIT, at, to) // length
    hexed = count(_HEX, at, to) == length
    upper, lower = count(_UPPER, at, to), count(_LOWER, at, to)
    case = (upper > 0) + 2 * (lower > 0)
    vowels = np.minimum(7, 8 * count(_VOWEL, at, to) // letters)
    # Changes of case or kind show random text: counted between the bytes of a run.
    look = np.where(_UPPER, 1, np.where(_LOWER, 2, np.where(_DIGIT, 3, 4))).astype(np.uint8)[data]
    turned = np.concatenate([[0, 0], np.cumsum(look[1:] != look[:-1], dtype=np.int32)])
    turns = np.minimum(7, 10 * (turned[to] - turned[at + 1]) // length)

    lines = np.concatenate([[0], np.cumsum(data == 10, dtype=np.int32)])
    parted = text[1:] != text[:-1]
    gap = np.full(len(start), 3)
    gap[1:] = np.where(parted, 3, np.where(start[1:] == end[:-1], 0, np.where(lines[start[1:]] > lines[end[:-1]], 2, 1)))

    def near(values: np.ndarray, by: int) -> np.ndarray:
        """The neighbour's value in the same text, else zero."""
        return np.where(_moved(text + 1, by) == text + 1, _moved(values, by), np.zeros(1, values.dtype))

    # The last word before the run, the sign that stands right before it, and the run before.
    place = np.where(sort == 1, np.arange(1, len(start) + 1), 0)
    word = np.concatenate([[0], np.maximum.accumulate(place)])[first]
    in_text = text[first]
    said = np.where((word > 0) & (text[word - 1] == in_text), own[word - 1], np.uint32(0))
    behind = near(shape, 1)
    sign = behind[first]
    known = np.append(False, in_text[1:] == in_text[:-1])
    before = np.where(known, _moved(log * 9 + digits + 1, 1), 0)
    share = np.array([min(5, int(s * 100)) for s in shares])[in_text]
    inner = np.minimum(2, np.arange(len(start)) - first[run]) * 2 + (np.arange(len(start)) == last[run])
    spot = (gap * 6 + inner) * 16 + log[run]
    form = log * 4 + case

    by_run = [
        (log * 9 + digits, form * 2 + hexed), (form * 8 + vowels,), (log * 8 + turns, vowels), (said,), (said, sign), (before, gap[first] * 16 + log), (share * 16 + log,), (log * 9 + digits, before),
    ]
    by_token = [
        (shape * 16 + small,), (behind, own), (near(own, 1),), (near(own, 2),), (near(own, -1),), (own,), (spot,), (shape * 4 + gap, behind), (shape, near(shape, -1)), (spot, said[run]), (np.zeros(len(start), np.uint32),),
    ]
    shared = np.stack([_hashed(k, *c) for k, c in enumerate(by_run)], axis=1)
    features = np.stack([_hashed(len(by_run) + k, *c) for k, c in enumerate(by_token)], axis=1)
    return Tokens(text, start - begins[text], end - begins[text], run, features, shared)


# ------------------------------------------------------------------ the field

FORBIDDEN = -1e4


@dataclass
class Field:
    """A weight per hashed feature for begin and inside, and one per pair of labels; inside never follows outside."""

    weights: np.ndarray
    moves: np.ndarray

    def emissions(self, tokens: Tokens) -> np.ndarray:
        """Scores of begin and inside against outside, a row per token."""

        # Both weights of a feature are fetched at once, as the parts of a complex number.
        pairs = np.ascontiguousarray(self.weights, np.float32).view(np.complex64)[:, 0]

        def total(features: np.ndarray) -> np.ndarray:
            out = np.zeros(len(features), np.complex128)
            for column in features.T:
                out += pairs[column]
            return out

        both = total(tokens.own)
        both += total(tokens.shared)[tokens.run]
        return both.view(np.float64).reshape(-1, 2)

    def decode(self, scores: np.ndarray) -> list[int]:
        """The best labels of a chain, by Viterbi; outside stands before and behind it."""
        moves = self.moves.tolist()
        best, back = [0.0, -math.inf, -math.inf], []
        for b, i in scores.tolist():
            step = [max((best[a] + moves[a][k], a) for a in range(3)) for k in range(3)]
            back.append([s[1] for s in step])
            best = [step[OUT][0], step[BEGIN][0] + b, step[IN][0] + i]
        label = max(range(3), key=lambda a: best[a] + moves[a][OUT])
        labels = []
        for row in reversed(back):
            labels.append(label)
            label = row[label]
        return labels[::-1]

    def open_tokens(self, scores: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Whether a token may be secret in a best chain: a bound, never too low.

        A stretch without outside tokens gains at most the sum of each token's best score and
        best move into it, and the best move out. Where no stretch through a token can gain,
        the token is outside in the best chain, which falls apart there.
        """
        m = self.moves - self.moves[OUT, OUT]
        gain = np.maximum(scores[:, 0] + m[:, BEGIN].max(), scores[:, 1] + m[BEGIN:, IN].max())
        leave = max(0.0, float(m[BEGIN:, OUT].max()))

        def reach(gain: np.ndarray, text: np.ndarray) -> np.ndarray:
            """The best sum of a stretch that ends at a token within its text."""
            total = np.cumsum(gain)
            before = total - gain
            # A text's own floor: sums of earlier texts are lifted above all of its own.
            order = np.cumsum(np.diff(text, prepend=text[:1]) != 0)
            lift = (np.abs(total).max() + 1) * 4
            return total - (np.minimum.accumulate(before - order * lift) + order * lift)

        if not len(gain):
            return np.zeros(0, bool)
        best = reach(gain, text) + reach(gain[::-1], text[::-1])[::-1] - gain
        return best + leave >= -1e-3

    def spans(self, tokens: Tokens) -> list[tuple[int, int, int]]:
        """(text, start, end) of every secret, in bytes."""
        scores = self.emissions(tokens)
        kept = np.flatnonzero(self.open_tokens(scores, tokens.text))
        found = []
        parts = np.flatnonzero((np.diff(kept) > 1) | (np.diff(tokens.text[kept]) != 0)) + 1
        for part in np.split(kept, parts) if len(kept) else []:
            for k, label in zip(part.tolist(), self.decode(scores[part])):
                if label == BEGIN:
                    found.append((int(tokens.text[k]), int(tokens.start[k]), int(tokens.end[k])))
                elif label == IN:
                    found[-1] = (*found[-1][:2], int(tokens.end[k]))
        return found


def gradient(scores: np.ndarray, moves: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected minus observed counts of chains of one length: per token and label, per pair of labels.

    `scores` is chains x tokens x labels, `gold` chains x tokens.
    """
    n, size = gold.shape
    scores = scores.transpose(1, 0, 2)
    step = np.exp(moves)
    token = np.exp(np.maximum(scores - scores.max(axis=2, keepdims=True), -300))
    forward, backward = np.empty((size, n, 3)), np.empty((size, n, 3))
    # Both passes are scaled at every token: only the ratio of labels there matters.
    forward[0], backward[-1] = step[OUT] * token[0], step[:, OUT]
    for i in range(1, size):
        f = (forward[i - 1] @ step) * token[i]
        forward[i] = f / f.sum(axis=1, keepdims=True)
    for i in range(size - 2, -1, -1):
        b = (token[i + 1] * backward[i + 1]) @ step.T
        backward[i] = b / b.sum(axis=1, keepdims=True)
    at = forward * backward
    at = (at / at.sum(axis=2, keepdims=True)).transpose(1, 0, 2)
    pairs = forward[:-1, :, :, None] * step * (token[1:] * backward[1:])[:, :, None, :]
    moved = (pairs / pairs.sum(axis=(2, 3), keepdims=True)).sum(axis=(0, 1))
    moved[OUT] += at[:, 0].sum(axis=0)
    moved[:, OUT] += at[:, -1].sum(axis=0)
    edged = np.pad(gold, ((0, 0), (1, 1)), constant_values=OUT)
    np.subtract.at(moved, (edged[:, :-1], edged[:, 1:]), 1)
    return at - np.eye(3)[gold], moved


def train(chains: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS) -> Field:
    """Maximum likelihood by AdaGrad over (features, labels) of chains. Without a secret nothing is one."""
    moves = np.zeros((3, 3))
    moves[OUT, IN] = FORBIDDEN
    weights = np.zeros((1 << _BITS, 2))
    chains = [c for c in chains if len(c[1])]
    if not any((gold == BEGIN).any() for _, gold in chains):
        moves[OUT, BEGIN] = FORBIDDEN
        return Field(weights.astype(np.float32), moves)
    chains = sorted(chains, key=lambda c: len(c[1]))
    width = chains[0][0].shape[1]
    batches = []
    for k in range(0, len(chains), 64):
        part = chains[k : k + 64]
        longest = max(len(g) for _, g in part)
        names, gold, real = np.zeros((len(part), longest, width), np.int32), np.zeros((len(part), longest), np.int64), np.zeros((len(part), longest), bool)
        for row, (f, g) in enumerate(part):
            names[row, : len(g)], gold[row, : len(g)], real[row, : len(g)] = f, g, True
        batches.append((names, gold, real))
    rng = np.random.default_rng(7)
    squares, move_squares = np.full(weights.shape, 1e-6), np.full((3, 3), 1e-6)
    for _ in range(rounds):
        for k in rng.permutation(len(batches)):
            names, gold, real = batches[k]
            scores = np.zeros((*gold.shape, 3))
            scores[..., 1:] = weights[names].sum(axis=2)
            # What fills a short chain up is outside for certain and changes nothing.
            scores[~real, 1:] = FORBIDDEN
            at, moved = gradient(scores, moves, gold)
            used = names[real].ravel()
            d = np.stack([np.bincount(used, np.repeat(at[real][:, c], width), 1 << _BITS) for c in (BEGIN, IN)], axis=1) / len(gold)
            d += np.where(d != 0, 1e-4 * weights, 0)
            squares += d * d
            weights -= 0.1 * d / np.sqrt(squares)
            moved = np.where(moves > FORBIDDEN / 2, moved / len(gold), 0)
            move_squares += moved * moved
            moves -= 0.1 * moved / np.sqrt(move_squares)
    return Field(weights.astype(np.float32), moves)


# ------------------------------------------------------------------ training texts


def _made(rng: random.Random, alphabet: str, low: int, high: int) -> str:
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(low, high)))


def rewritten(rng: random.Random, value: str, words: list[str]) -> tuple[str, str, str]:
    """(before, secret, behind): a secret of another form than the fixed patterns know."""
    quote = rng.choice(('"', "'", ""))
    said = f"{rng.choice(KEYWORDS)}{rng.choice((' = ', '=', ': ', ':'))}{quote}"
    masked = (f"{rng.choice(words)} {quote}", quote) if rng.random() < 0.5 else (said, quote)
    alnum = _LOWERS + _UPPERS + _DIGITS
    form = rng.randrange(7)
    if form == 0:
        return masked[0], (value if rng.random() < 0.5 else _made(rng, "0123456789abcdef", 20, 40)), masked[1]
    if form == 1:
        return masked[0], _made(rng, alnum, 18, 48), masked[1]
    if form == 2:
        width = rng.choice((32, 48, 64, 64, 76))
        body = "\n".join([*(_made(rng, alnum + "+/", width, width) for _ in range(rng.randint(1, 8))), _made(rng, alnum + "+/", 8, width) + rng.choice(("", "=", "=="))])
        name = rng.choice(("PRIVATE KEY", "RSA PRIVATE KEY", "SECRET"))
        return (f"-----BEGIN {name}-----\n", body, f"\n-----END {name}-----") if rng.random() < 0.6 else ("\n", body, "\n")
    if form == 3:
        sign = rng.choice("-_")
        lead = sign.join([_made(rng, _LOWERS, 2, 4), *([rng.choice(("live", "test", "prod", "key"))] if rng.random() < 0.6 else [])])
        return masked[0], lead + rng.choice("-_") + _made(rng, alnum, 16, 40), masked[1]
    if form == 4:
        return masked[0], _made(rng, _UPPERS + _DIGITS, 18, 40), masked[1]
    if form == 5:
        return said, _made(rng, alnum + "!@#$%^&*", 5, 14), quote
    return masked[0], "-".join(_made(rng, _UPPERS + _DIGITS, 5, 5) for _ in range(rng.randint(4, 6))), masked[1]


def plain(rng: random.Random, words: list[str]) -> str:
    """Names, paths, addresses, dates and numbers, none of them a secret."""
    some = [rng.choice(words) for _ in range(rng.randint(2, 5))]
    form = rng.randrange(7)
    if form == 0:
        return rng.choice("._-/").join(some) + rng.choice(("", str(rng.randrange(3000))))
    if form == 1:
        return "".join(w.capitalize() for w in some) + rng.choice(("", str(rng.randrange(100))))
    if form == 2:
        return f"https://www.{some[0]}{rng.randrange(100)}.{rng.choice(('com', 'org', 'net'))}/{'/'.join(some[1:])}?id={rng.randrange(10**6)}"
    if form == 3:
        return f"{some[0]}.{rng.randrange(100)}@{some[1]}{rng.randrange(10)}.example.com"
    if form == 4:
        return f"20{rng.randrange(100):02d}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}T{rng.randrange(24):02d}:{rng.randrange(60):02d}:{rng.randrange(60):02d}Z"
    if form == 5:
        return rng.choice((str(rng.randrange(10**16)), f"+{rng.randrange(10**11)}", f"({rng.randrange(1000)}) {rng.randrange(1000)}-{rng.randrange(10**4):04d}", f"{rng.randrange(10**6) / 100}"))
    return f"the {rng.choice(KEYWORDS)} {some[0]} {rng.choice(KEYWORDS)}s, {some[1]}. {rng.choice(KEYWORDS)}: {rng.choice(('a', 'no', 'the', 'see'))} "


_LETTERS = re.compile(r"[A-Za-z]{2,12}")


def snippets(text: str) -> list[tuple[str, list[tuple[int, int]]]]:
    """Parts of a training text with its secrets in them, then the same with other secrets or names.

    They depend on the text alone. Of a text any number of secrets is taken, but only `SNIPPETS` parts without one.
    """
    rng = random.Random(int.from_bytes(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:8], "big"))
    values = sorted(set(_values(text)))
    out, spots = [], values[:SNIPPETS]
    for a, b in spots:
        lo, hi = max(0, a - SIDE), min(len(text), b + SIDE)
        out.append((text[lo:hi], [(max(x, lo) - lo, min(y, hi) - lo) for x, y in values if x < hi and y > lo]))
    hard = [m.start() for _, m in zip(range(SNIPPETS), re.finditer(MIXED, text))]
    for at in [*hard, *(rng.randrange(max(1, len(text))) for _ in range(SNIPPETS))]:
        lo, hi = max(0, at - SIDE), min(len(text), at + SIDE)
        out.append((text[lo:hi], [(max(x, lo) - lo, min(y, hi) - lo) for x, y in values if x < hi and y > lo]))
    words = _LETTERS.findall(text[: 1 << 16]) or ["the"]

    def around(before: str, middle: str, behind: str, secret: bool) -> None:
        at = rng.randrange(max(1, len(text)))
        gap = text.find(" ", at)
        at = gap if gap >= 0 else at
        lead, tail = text[max(0, at - SIDE // 2) : at] + " " + before, behind + text[at : at + SIDE // 2]
        known = [(x, y) for x, y in values if x < at + SIDE // 2 and y > at - SIDE // 2]
        if not known:
            out.append((lead + middle + tail, [(len(lead), len(lead) + len(middle))] if secret else []))

    for a, b in spots:
        for _ in range(REWRITES):
            around(*rewritten(rng, text[a:b], words), True)
    around("", plain(rng, words), "", False)
    return out


def labelled(parts: list[tuple[str, list[tuple[int, int]], float]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, labels) of (text, secrets in code points, share): a token that a secret overlaps is secret."""
    out = []
    for lo in range(0, len(parts), 256):
        raws = [text.encode("utf-8", "surrogatepass") for text, _, _ in parts[lo : lo + 256]]
        tokens = tokens_of(raws, [share for _, _, share in parts[lo : lo + 256]])
        features = tokens.features
        ends = np.searchsorted(tokens.text, np.arange(len(raws) + 1))
        for k, (text, secret, _) in enumerate(parts[lo : lo + 256]):
            here = slice(ends[k], ends[k + 1])
            start, end = tokens.start[here], tokens.end[here]
            gold = np.zeros(len(start), np.int64)
            reached = 0
            for x, y in sorted(secret):
                a, b = (len(text[:j].encode("utf-8", "surrogatepass")) for j in (x, y))
                hit = np.flatnonzero((start < b) & (a < end) & (start >= reached))
                if len(hit):
                    gold[hit], gold[hit[0]] = IN, BEGIN
                    reached = int(end[hit[-1]])
            out.append((features[here], gold))
    return out


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> Field:
    """The field of a bounded sample of the texts, labelled by the fixed patterns.

    All texts are labelled first. Half of `rows` hold a secret, a quarter a letter next to a
    digit, the rest neither: the first by a hash of the text. Where one kind is short, the
    others fill its place. Equal texts count once. The driver gets their snippets only.
    """
    h = F.xxhash64("text").alias("h")
    kind = F.when(F.col("text").rlike(HOLDS), 2).when(F.col("text").rlike(MIXED), 1).otherwise(0)
    marked = saved(docs.filter("text is not null").select(h, kind.alias("kind")).groupBy("h").agg(F.max("kind").alias("kind")), "secrets-marked")
    known = {k: [r["h"] for r in marked.filter(F.col("kind") == k).orderBy("h").limit(rows).select("h").collect()] for k in (2, 1, 0)}
    left, picked = rows, []
    for k, part in ((2, 2), (1, 2), (0, 1)):
        others = sum(len(v) for j, v in known.items() if j < k)
        take = known[k][: max(left // part, left - others)]
        left -= len(take)
        if take:
            picked.append((F.col("kind") == k) & (F.col("h") <= take[-1]))
    if not picked:
        return train([])
    picked = marked.filter(functools.reduce(operator.or_, picked)).select("h")
    sample = docs.select(h, "text").join(F.broadcast(picked), "h", "left_semi").groupBy("h").agg(F.first("text").alias("text"))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [(part, secret, symbol_share(t.encode("utf-8", "surrogatepass"))) for t in batch["text"] for part, secret in snippets(t)]
            yield pd.DataFrame(got, columns=["part", "secret", "share"]).assign(secret=lambda d: d["secret"].map(json.dumps))

    found = sample.select("text").mapInPandas(learn, "part string, secret string, share double").toPandas().sort_values(["part", "secret", "share"])
    return train(labelled([(p, json.loads(s), share) for p, s, share in found.itertuples(index=False)]))


def scan(texts: list[str], field: Field) -> list[list[tuple[int, int, int]]]:
    """All spans of every text, by start and kind; what the field finds inside a fixed span adds none."""
    out = [base_spans(t) for t in texts]
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    more: dict[int, list[tuple[int, int]]] = {}
    for lo, hi in chunks([len(r) + 1 for r in raws], SLICE):
        part = raws[lo:hi]
        for t, start, end in field.spans(tokens_of(part, [symbol_share(r) for r in part])):
            more.setdefault(lo + t, []).append((start, end))
    for t, found in more.items():
        raw, base, place, chars = raws[t], list(out[t]), 0, 0
        for start, end in found:
            chars += len(raw[place:start].decode("utf-8", "surrogatepass"))
            a = chars
            chars += len(raw[start:end].decode("utf-8", "surrogatepass"))
            place = end
            if not any(s[0] <= a and chars <= s[1] for s in base):
                out[t].append((a, chars, 3))
        out[t].sort(key=lambda s: (s[0], s[2]))
    return out


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, masked string"


def with_spans(docs: DataFrame, field: Field, mask: bool = False) -> tuple[DataFrame, str]:
    """`docs` with a struct column of counts and spans, and with `mask` the text without its secrets."""
    load = shipped(docs.sparkSession, field)

    @F.pandas_udf(RESULT)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in in_parts(batches):
            texts = [t or "" for t in batch]
            found = scan(texts, model)
            base = [[s for s in spans if s[2] < 3] for spans in found]
            yield pd.DataFrame(
                {
                    "n_assign": [sum(s[2] == 0 for s in b) for b in base],
                    "n_access": [sum(s[2] == 1 for s in b) for b in base],
                    "n_hex": [sum(s[2] == 2 for s in b) for b in base],
                    "base_sha256": [hashlib.sha256(_listed(b).encode()).hexdigest() for b in base],
                    "spans": [_listed(s) for s in found],
                    "masked": [masked(t, s) if mask and s else None for t, s in zip(texts, found)],
                }
            )

    name = fresh(docs, "secrets_")
    return docs.withColumn(name, scanned.asNondeterministic()("text")), name


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, place = [], 0
    for start, end, _ in spans:
        if start >= place:
            out += [text[place:start], MASK]
        place = max(place, end)
    return "".join([*out, text[place:]])


def secret_scans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every whole text.

    Null texts count as empty: no span, and the digest of nothing. Repeated rows and null
    ids are kept. If the sample holds no secret, the field adds none.
    """
    found, name = with_spans(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", *(F.col(f"{name}.{c}").alias(c) for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")))


def mask(docs: DataFrame) -> DataFrame:
    """The documents with a mark in place of every secret; `n_chars`, if there, follows."""
    found, name = with_spans(docs, fit(docs), mask=True)
    text = F.col(f"{name}.masked")
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.coalesce(text, F.col("text")).alias("text"))
        elif c == "n_chars":
            columns.append(F.when(text.isNotNull(), F.length(text)).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(c))
    return found.select(*columns)
