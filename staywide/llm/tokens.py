"""Token counts: how many tokens every prefix of a text has."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, in_parts

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
SPACE = "▁"
#: No piece of the vocabulary holds a space mark behind another character, so no token
#: reaches over such a place and the stretches between them are encoded on their own.
STRETCH = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Stretches and prefixes that are remembered; a full memory is emptied.
MEMORY = 500_000
NODES = 1_000_000
#: Longer stretches are not remembered.
SHORT = 64


class _Counts(dict):
    """Stretch to token count, worked out at first use."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, stretch: str) -> int:
        n = self.counter.total(stretch)
        if len(stretch) <= SHORT:
            if len(self) >= MEMORY:
                self.clear()
            self[stretch] = n
        return n


class PrefixCounter:
    """Exact token counts of all prefixes under a merge vocabulary with byte fallback.

    Dynamic programme over positions: the encoding of a prefix ends with exactly one
    token whose predecessor is the last token of the prefix in front of it. A token may
    follow another if encoding the two together gives the two again; a sequence in which
    every neighbouring pair is so is the encoding. Characters without a piece become
    their bytes, one token each, and never merge.

    What is known of a prefix, its count and last token, is stored once for all stretches
    that begin with it.
    """

    def __init__(self, path: str | None = None):
        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(MODEL))
        self.order: dict[str, float] = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                self.order[model.id_to_piece(i)] = -model.get_score(i)
        if any(SPACE in p.lstrip(SPACE) for p in self.order):
            raise ValueError("the vocabulary has pieces across words")
        #: The endings of pieces, and whether they are pieces.
        self.pieces = {p[i:]: False for p in self.order for i in range(1, len(p))} | dict.fromkeys(self.order, True)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.parts: dict[str, list[str] | None] = {}
        self.memory = _Counts(self)
        self.known = {"": 0}

    def merged(self, text: str, down_to: int = 1) -> list[str]:
        """The encoding of a short text: the first pair in order is joined, the leftmost of equals."""
        parts = list(text)
        order = self.order
        while len(parts) > down_to:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = order.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _split(self, piece: str) -> list[str] | None:
        """The two parts a piece is joined from last; none if it is never a token."""
        if piece not in self.parts:
            parts = self.merged(piece, 2)
            self.parts[piece] = parts if len(parts) == 2 else None
        return self.parts[piece]

    def _follows(self, a: str, b: str) -> bool:
        """Whether a and b stay two tokens when encoded together.

        Both are taken apart again, the join that comes later in order first. Nothing may
        join across them before what stands there is complete.
        """
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) > NODES:
                self.pairs.clear()
            ok = self.pairs[a, b] = self._stay(a, b)
        return ok

    def _stay(self, a: str, b: str) -> bool:
        # Runs of spaces share one rank and are joined out.
        if SPACE * 2 in a or SPACE * 2 in b:
            return self.merged(a + b) == [a, b]
        if not (self._whole(a) and self._whole(b)):
            return False
        order, limit = self.order, float("inf")
        while True:
            across = order.get(a + b)
            if across is not None and across < limit:
                return False
            made_a = order[a] if len(a) > 1 else -1
            made_b = order[b] if len(b) > 1 else -1
            if made_a > made_b:
                limit, a = made_a, self._split(a)[1]
            elif made_b >= 0:
                # Of equals the left one, across, comes first.
                limit, b = made_b + 0.5, self._split(b)[0]
            else:
                return True

    def stretch(self, text: str) -> array:
        """The token counts of the prefixes of one stretch, from one character on."""
        values = [0]
        for end in range(1, len(text) + 1):
            values.append(self._extend(text, end, values.__getitem__))
        return array("q", [v >> 8 for v in values[1:]])

    def total(self, text: str) -> int:
        """The token count of one stretch, by what is known of its prefixes."""
        if len(text) > SHORT:
            return self.stretch(text)[-1]
        known = self.known
        if len(known) > NODES:
            known.clear()
            known[""] = 0
        return self._value(text) >> 8

    def _value(self, head: str) -> int:
        """The value of a prefix; of shorter ones only those a last token asks for are worked out."""
        value = self.known.get(head)
        if value is None:
            value = self.known[head] = self._extend(head, len(head), lambda start: self._value(head[:start]))
        return value

    def _extend(self, text: str, end: int, at: Callable[[int], int]) -> int:
        """The value of the prefix up to `end`; `at` gives those of shorter ones.

        A value is the count, and in its low byte the length of the last token.
        """
        pieces, pairs = self.pieces, self.pairs
        start, fits = end - 1, []
        while start >= 0 and (is_piece := pieces.get(text[start:end])) is not None:
            if is_piece:
                fits.append(start)
            start -= 1
        for start in reversed(fits):
            piece = text[start:end]
            if start == 0:
                # The first token must also be one by itself.
                if self._whole(piece):
                    return 256 | end
                continue
            before = at(start)
            pair = text[start - (before & 255) : start], piece
            ok = pairs.get(pair)
            if ok if ok is not None else self._follows(*pair):
                return (before & ~255) + 256 | end - start
        char = text[end - 1]
        more = 1 if char in self.order else len(char.encode("utf-8", "surrogatepass"))
        return (at(end - 1) & ~255) + (more << 8) | 1

    def _whole(self, piece: str) -> bool:
        return len(piece) == 1 or self._split(piece) is not None

    def _stretches(self, text: str) -> list[str]:
        return STRETCH.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(self.memory.__getitem__, self._stretches(text or "")))

    def prefixes(self, text: str | None) -> array:
        """Entry i is the token count of the first i characters."""
        out, total = array("q", [0]), 0
        for k, s in enumerate(self._stretches(text or "")):
            counts = self.stretch(s)
            # The first mark is the library's own and no character of the text.
            out.extend(total + n for n in (counts[1:] if k == 0 else counts))
            total += counts[-1]
        return out

    def fitting(self, text: str | None, budget: int) -> int:
        """The characters of the longest prefix all of whose prefixes have `budget` tokens at most."""
        text = text or ""
        total = place = 0
        for k, s in enumerate(self._stretches(text)):
            n = self.memory[s]
            # Counts may dip inside a stretch: look there as soon as it could pass the budget.
            if total + len(s.encode("utf-8", "surrogatepass")) > budget:
                for i, c in enumerate(self.stretch(s)):
                    if total + c > budget:
                        return max(0, place + i - (k == 0))
            total += n
            place += len(s) - (k == 0)
        return len(text)


RESULT = "n_bytes long, n_tokens long, over_limit boolean, fit_chars long"


def with_counts(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> tuple[DataFrame, str]:
    """`docs` with a struct column (n_bytes, n_tokens, over_limit, fit_chars), and its name."""

    @F.pandas_udf(RESULT)
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = PrefixCounter(path)
        for batch in in_parts(texts):
            rows = []
            for t in batch:
                t = t or ""
                n = counter.count(t)
                rows.append((len(t.encode("utf-8", "surrogatepass")), n, n > limit, counter.fitting(t, limit) if n > limit else len(t)))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_tokens", "over_limit", "fit_chars"])

    name = fresh(docs, "counted_")
    return docs.withColumn(name, counted.asNondeterministic()("text")), name


def token_counts(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars) of every whole text.

    `fit_chars` is where to cut the text for it to stay within the limit. Null texts count
    as empty: no bytes, no tokens. Repeated rows and null ids are kept.
    """
    counted, name = with_counts(docs.select("doc_id", "text"), limit, path)
    return counted.select("doc_id", *(F.col(f"{name}.{c}").alias(c) for c in ("n_bytes", "n_tokens", "over_limit", "fit_chars")))


def prefix_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, prefix_tokens): the token count at every prefix, for later cuts and budgets."""

    @F.pandas_udf("array<long>")
    def counts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = PrefixCounter(path)
        for batch in texts:
            yield pd.Series([counter.prefixes(t).tolist() for t in batch])

    return docs.select("doc_id", counts("text").alias("prefix_tokens"))
