"""Byte-level BPE by tree reduction: halves are encoded and joined where they meet."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, in_parts

RANKS = "byte_bpe_50k.tiktoken"
#: A text is halved down to leaves of so many characters, a match to so many bytes.
LEAF_CHARS = 16384
LEAF_BYTES = 96
#: A match looks so many characters beyond its end at most.
REACH = 2
#: Matches whose ids are remembered; a full memory is emptied.
MEMORY = 250_000


class _Ids(dict):
    """Match to ids (little-endian, four bytes each), worked out at first use."""

    def __init__(self, codec: TreeCodec):
        super().__init__()
        self.codec = codec

    def __missing__(self, match: str) -> bytes:
        raw = match.encode("utf-8", "surrogatepass")
        ids = np.array(self.codec.encode_bytes(raw), "<u4").tobytes()
        if len(raw) <= LEAF_BYTES:
            if len(self) >= MEMORY:
                self.clear()
            self[match] = ids
        return ids


class TreeCodec:
    """Encoder and decoder of one vocabulary of ranks.

    A text is a tree: its leaves are encoded, and two neighbours are joined by encoding
    anew only what their meeting place can change. Joining is associative with the empty
    text as its neutral element, so any tree over a text gives the same ids.
    """

    def __init__(self, path: str | None = None, pattern: str = public_tokenizers.PATTERN):
        with open(path or public_tokenizers.path(RANKS), "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        #: Encodes a leaf: a few bytes, without a pattern.
        self.leaf = tiktoken.Encoding("leaves", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.pattern = regex.compile(pattern)
        self.memory = _Ids(self)

    # ------------------------------------------------------------ one match: a tree over bytes

    def encode_bytes(self, raw: bytes) -> list[int]:
        if len(raw) <= LEAF_BYTES:
            return self.leaf(raw) if raw else []
        half = len(raw) // 2
        return self.join_ids(self.encode_bytes(raw[:half]), self.encode_bytes(raw[half:]))

    def join_ids(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of two neighbouring pieces of one match.

        A window around the meeting place is encoded anew and grows until its outer tokens
        agree with those beyond: two tokens that stay two when encoded together. A sequence
        whose neighbours all do so is the encoding of its bytes, and outside the window
        they did before.
        """
        if not left or not right:
            return left or right
        tokens = self.tokens
        size = 2
        while True:
            a, b = max(0, len(left) - size), min(len(right), size)
            window = self.leaf(b"".join(map(tokens.__getitem__, left[a:] + right[:b])))
            if (a == 0 or self._stay(left[a - 1], window[0])) and (b == len(right) or self._stay(window[-1], right[b])):
                return left[:a] + window + right[b:]
            size *= 2

    def _stay(self, a: int, b: int) -> bool:
        return self.leaf(self.tokens[a] + self.tokens[b]) == [a, b]

    # ------------------------------------------------------------ a text: a tree over characters

    def matches(self, text: str) -> list[str]:
        if len(text) <= LEAF_CHARS:
            return self.pattern.findall(text)
        half = len(text) // 2
        return self.join_matches(self.matches(text[:half]), self.matches(text[half:]))

    def join_matches(self, left: list[str], right: list[str]) -> list[str]:
        """The matches of two neighbouring pieces of a text.

        A match depends on the text behind its start only, and on two characters behind
        its end at most (an apostrophe and the letters of a contraction). On the left just
        those that end so near can change, and white space in front of them. From there
        the pattern is run on into the right piece until it ends a match where the right
        piece does too; from that place on the two agree for good.
        """
        if not left or not right:
            return left or right
        keep, behind = len(left) - 1, len(left[-1])
        while keep > 0 and (behind < REACH or left[keep].isspace()):
            keep -= 1
            behind += len(left[keep])
        tail = "".join(left[keep:])
        size = 8
        while True:
            upto = min(len(right), size)
            window = tail + "".join(right[:upto])
            # Where the right piece ends its matches, and how many it has up to there.
            ends, place = {len(tail): 0}, len(tail)
            for k in range(upto):
                place += len(right[k])
                ends[place] = k + 1
            found = []
            for m in self.pattern.finditer(window):
                # What ends near the window's own end may still change.
                if upto < len(right) and m.end() > len(window) - REACH - 1:
                    break
                found.append(m.group())
                if m.end() in ends:
                    return left[:keep] + found + right[ends[m.end()] :]
            if upto == len(right):
                return left[:keep] + found
            size *= 2

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text."""
        return np.frombuffer(b"".join(map(self.memory.__getitem__, self.matches(text or ""))), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; concatenation is the join of the tree."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def encode_documents(docs: DataFrame, ids: bool = False, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, with `ids` also the ids.

    Null texts count as empty: no tokens. Repeated rows and null ids are kept.
    """
    result = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")

    @F.pandas_udf(result)
    def encoded(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = TreeCodec(path)
        for batch in in_parts(texts):
            got = [codec.encode(t) for t in batch]
            out = pd.DataFrame({"n_tokens": [len(g) for g in got]}, dtype="int64")
            out["ids_sha256"] = [hashlib.sha256(g.tobytes()).hexdigest() for g in got]
            out["decoded_sha256"] = [hashlib.sha256(codec.decode(g)).hexdigest() for g in got]
            if ids:
                out["ids"] = [g.astype(np.int32) for g in got]
            yield out

    name = fresh(docs, "encoded_")
    found = docs.select("doc_id", "text").withColumn(name, encoded.asNondeterministic()("text"))
    fields = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids
    return found.select("doc_id", *(F.col(f"{name}.{f}").alias(f) for f in fields))


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give an empty text, bytes that are no text a mark."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = TreeCodec(path)
        for batch in batches:
            yield pd.Series(["" if x is None else codec.decode(np.asarray(x)).decode("utf-8", "replace") for x in batch])

    return encoded.select("doc_id", decoded("ids").alias("text"))
