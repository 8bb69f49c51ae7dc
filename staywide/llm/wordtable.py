"""Byte-level BPE by a table of distinct words: each is encoded once, ids go back by position."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import blocks
from .common import or_empty, saved

FILE = "byte_bpe_50k.json"
SPLIT = public_tokenizers.PATTERN
#: Code points that Java does not know as letters or digits but a newer library may.
UNKNOWN = r"\p{Cn}"


def _path(path: str | None) -> str:
    return path or public_tokenizers.path(FILE)


def load(path: str | None = None) -> Tokenizer:
    """The tokenizer of the file, without truncation and padding.

    Only what the word table can stand for is taken: no normaliser, the byte-level pattern
    without a prefix space, added tokens that match exactly as they are written.
    """
    with open(_path(path), encoding="utf-8") as f:
        described = json.load(f)
    pre = described["pre_tokenizer"] or {}
    plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in described["added_tokens"])
    if described["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or not plain:
        raise ValueError("not a byte-level tokenizer without normaliser and with plain added tokens")
    tokenizer = Tokenizer.from_file(_path(path))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def added(tokenizer: Tokenizer) -> list[str]:
    """The added tokens' strings, the longest first."""
    return sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=lambda s: (-len(s), s))


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary, by the byte-level rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def piece_bytes(path: str | None = None) -> list[bytes]:
    """The bytes of every id, by id: as many as the vocabulary has, whatever the corpus is."""
    tokenizer, byte_of = load(path), _byte_of()
    special = tokenizer.get_added_tokens_decoder()
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        plain = i in special or any(c not in byte_of for c in token)
        out[i] = token.encode() if plain else bytes(map(byte_of.__getitem__, token))
    return out


def pieces(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(id, piece): the bytes of every id as a table."""
    rows = [(i, bytearray(piece)) for i, piece in enumerate(piece_bytes(path))]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["id", "piece"]), "id int, piece binary")


def split_words(text: Column, specials: list[str]) -> Column:
    """The words of a text, added tokens on their own, by the pattern in the JVM."""
    words = F.regexp_extract_all(text, F.lit("(?U)" + SPLIT), F.lit(0))
    if not specials:
        return words
    quoted = "|".join(re.escape(s) for s in specials)
    found = F.array(*map(F.lit, specials))
    # Cut in front of and behind every added token: its own matches and what lies between.
    marked = F.regexp_replace(text, f"({quoted})", "\u0000$1\u0000")
    segments = F.split(marked, "\u0000")
    apart = F.flatten(
        F.transform(segments, lambda s: F.when(F.array_contains(found, s), F.array(s)).otherwise(F.regexp_extract_all(s, F.lit("(?U)" + SPLIT), F.lit(0))))
    )
    return F.when(text.rlike(quoted), apart).otherwise(words)


def splitter(path: str | None = None):
    """The library's own splitting, for texts with characters that Java is too old for."""

    def load_split():
        tokenizer = load(path)
        specials = added(tokenizer)
        cut = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None

        def split(text: str) -> list[str]:
            out: list[str] = []
            for segment in cut.split(text) if cut else [text]:
                if segment in specials:
                    out.append(segment)
                else:
                    out += [segment[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(segment)]
            return out

        return split

    return load_split


def _encoded_words(words: DataFrame, path: str | None) -> DataFrame:
    """(block, numbers, sizes, ids): the ids of every block's words, each distinct word encoded once.

    Lists of words meet by the hash of their words. A task goes from bucket to bucket and
    holds the distinct words of one. `numbers` has the words' numbers in the block, `sizes` how
    many ids each has, `ids` all of them, all packed.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer, known, at = load(path), {}, None
        for batch in batches:
            sizes, ids = [], []
            for bucket, raw in zip(batch.column("bucket").to_pylist(), batch.column("words")):
                if bucket != at:
                    known, at = {}, bucket
                own = blocks.unpack_words(raw.as_py())
                new = [w for w in own if w not in known]
                for word, found in zip(new, tokenizer.encode_batch(new, add_special_tokens=False)):
                    known[word] = found.ids
                sizes.append(blocks.pack_codes(np.array([len(known[w]) for w in own], np.int64)))
                ids.append(blocks.pack_codes(np.array([i for w in own for i in known[w]], np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("numbers"), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())], names=["block", "numbers", "sizes", "ids"])

    dealt = words.repartition("bucket").sortWithinPartitions("bucket", "block")
    return dealt.mapInArrow(encode, "block long, numbers binary, sizes binary, ids binary")


def encode_documents(docs: DataFrame, ids: bool = False, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, with `ids` also the ids.

    Texts are split into words in the JVM and packed into blocks with a word table each.
    Distinct words are encoded once; a block gets the ids of its words back and puts them at
    their places. To decode, the ids are joined with their pieces, a table as large as the
    vocabulary that every task holds. Null texts count as empty: no tokens. Repeated rows and
    null ids are kept, other columns are ignored.
    """
    specials = added(load(path))
    text = or_empty(F.col("text"))
    # A zero byte marks the cuts around added tokens: texts that hold one are split by the library.
    odd = F.when(text.rlike(UNKNOWN) | text.contains("\u0000"), text)
    words = F.when(odd.isNull(), split_words(text, specials)).otherwise(F.array().cast("array<string>"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.lit("").alias("part"), words.alias("words"), odd.alias("odd"), "doc_id")
    buckets = blocks.bucket_count(4 * docs.rdd.getNumPartitions())
    packed = blocks.coded(rows, f"doc_id {kind}", "word-blocks", buckets, splitter(path))
    found = _encoded_words(blocks.words_of(packed), path)
    shipped = docs.sparkSession.sparkContext.broadcast(piece_bytes(path))
    result = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")

    def placed(rows: pa.Table, words: pa.Table) -> pa.Table:
        n = rows["size"][0].as_py() if rows.num_rows else 0
        pieces = shipped.value
        numbers: list[bytes] = [b""] * n
        raws: list[bytes] = [b""] * n
        for number, sizes, own in zip(words["numbers"].to_pylist(), words["sizes"].to_pylist(), words["ids"].to_pylist()):
            found = blocks.unpack_codes(own)
            raw, joined, end = found.astype("<u4").tobytes(), list(map(pieces.__getitem__, found.tolist())), 0
            sizes = blocks.unpack_codes(sizes).tolist()
            for i, size in zip(blocks.numbers_of(number, len(sizes)), sizes):
                start, end = end, end + size
                numbers[i], raws[i] = raw[4 * start : 4 * end], b"".join(joined[start:end])
        doc_ids, counts, digests, decoded, lists = [], [], [], [], []
        for codes, lengths, carried in zip(rows["codes"].to_pylist(), rows["lengths"].to_pylist(), rows["doc_id"].to_pylist()):
            every, end = blocks.unpack_codes(codes).tolist(), 0
            doc_ids += carried
            for length in lengths:
                start, end = end, end + length
                at = every[start:end]
                packed_ids, text = b"".join(map(numbers.__getitem__, at)), b"".join(map(raws.__getitem__, at))
                counts.append(len(packed_ids) // 4)
                digests.append(hashlib.sha256(packed_ids).hexdigest())
                decoded.append(hashlib.sha256(text.decode("utf-8", "replace").encode()).hexdigest())
                if ids:
                    lists.append(np.frombuffer(packed_ids, "<i4"))
        columns = [pa.array(doc_ids, rows.schema.field("doc_id").type.value_type), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if ids:
            columns.append(pa.array(lists, pa.list_(pa.int32())))
            names.append("ids")
        return pa.table(columns, names=names)

    return blocks.rows_of(packed, "doc_id").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(placed, result)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): every id is joined with its piece, by position.

    Null ids, like none, give an empty text; bytes that are no text give a mark; an id that
    is not in the vocabulary gives nothing, as in the library. Repeated rows are kept.
    """
    rows = saved(encoded.select(F.monotonically_increasing_id().alias("row"), "doc_id", "ids"), "to-decode")
    places = rows.select("row", "doc_id", F.posexplode_outer("ids").alias("pos", "id"))
    joined = places.join(F.broadcast(pieces(encoded.sparkSession, path)), "id", "left")
    found = joined.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("p"))
    raw = F.expr("aggregate(filter(p.piece, x -> x IS NOT NULL), X'', (a, b) -> concat(a, b))")
    return found.select("doc_id", F.make_valid_utf8(raw.cast("string")).alias("text"))
