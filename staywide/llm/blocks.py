"""Blocks of rows with a word table of their own: words become positions in it.

A block is what one task packs together, some megabytes of words, whatever their rows are
about: no key decides where a row goes, so none can be hot. A very common word is there once
per block, not once per occurrence. What is found out about a distinct word goes back to the
blocks that hold it, and from there to every place by its number.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import chunks, saved

#: Bytes of words in a block; a longer row is a block alone.
BLOCK_BYTES = 32 << 20
#: Words of a block that are numbered by how common they are; the others are numbered by bucket.
COMMON = 1 << 16
#: Words in a packed group of rows; a longer row is a group alone.
GROUP = 1 << 16
MOST_BUCKETS = 1 << 16


def squeezed(raw: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(raw)


def expanded(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def hashes(words: list[str]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def pack_words(words: list[str]) -> bytes:
    return squeezed(json.dumps(words, ensure_ascii=False, separators=(",", ":")).encode(), 9)


def unpack_words(raw: bytes) -> list[str]:
    return json.loads(expanded(raw))


def pack_codes(codes: np.ndarray) -> bytes:
    """Numbers, small ones mostly: a byte each, 255 for a larger one, whose bytes follow in planes."""
    small = squeezed(np.minimum(codes, 255).astype(np.uint8).tobytes())
    planes = (codes[codes >= 255] - 255).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return len(small).to_bytes(4, "little") + small + squeezed(np.ascontiguousarray(planes).tobytes())


def unpack_codes(raw: bytes) -> np.ndarray:
    size = 4 + int.from_bytes(raw[:4], "little")
    out = np.frombuffer(expanded(raw[4:size]), np.uint8).astype(np.int64)
    planes = np.frombuffer(expanded(raw[size:]), np.uint8).reshape(4, -1).T
    out[out == 255] = np.ascontiguousarray(planes).view("<u4").ravel().astype(np.int64) + 255
    return out


def numbers_of(raw: bytes, n_words: int) -> list[int]:
    """The numbers of a packed list's words: those of its common words, then a run of the others."""
    numbers = unpack_codes(raw).tolist()
    first = numbers.pop()
    return numbers + list(range(first, first + n_words - len(numbers)))


def unpack_words_of(numbers: pa.ChunkedArray, words: pa.ChunkedArray, size: int) -> list[str]:
    """The words of a block by number, of its packed lists."""
    out = [""] * size
    for some, raw in zip(numbers.to_pylist(), words.to_pylist()):
        if raw is not None:
            own = unpack_words(raw)
            for i, word in zip(numbers_of(some, len(own)), own):
                out[i] = word
    return out


def _runs(parts: list) -> Iterator[list[int]]:
    """Indices of equal parts."""
    found: dict = {}
    for i, part in enumerate(parts):
        found.setdefault(part, []).append(i)
    yield from found.values()


def coded(rows: DataFrame, carry: str, label: str, buckets: int = 1, split: Callable[[], Callable[[str], list[str]]] | None = None, block_bytes: int | None = None) -> DataFrame:
    """Rows (`part`, `words`, and `carry`) as blocks, written to the shared folder.

    `part` is a string, `words` an array of strings; rows of different parts never share a
    block. With `split` there is a column `odd` as well: where it is not null, `split()(odd)`
    gives the words instead. Distinct words of a block are numbered, the most common first, the
    rest by bucket and word. A block has a row for each `bucket`, the hash of a word modulo `buckets` (`words` and their
    `numbers`, packed), and one for every few rows (`codes`: the numbers of their words in
    order, packed; `lengths`: how many each row has; `carry` of each row). `size` is the number
    of distinct words of the block.
    """
    name, kind = carry.split()
    limit = block_bytes or BLOCK_BYTES
    schema = f"block long, part string, size int, bucket int, numbers binary, words binary, codes binary, lengths array<int>, {name} array<{kind}>"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        again = None
        for batch in batches:
            lists, parts, kept = batch.column("words"), batch.column("part").to_pylist(), batch.column(name)
            if split and batch.column("odd").null_count < len(parts):
                odd, again = batch.column("odd").to_pylist(), again or split()
                lists = pa.array([x.as_py() if o is None else again(o) for x, o in zip(lists, odd)], pa.list_(pa.string()))
            flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
            ends = np.concatenate([[0], np.cumsum(sizes)])
            byte = np.concatenate([[0], np.cumsum(pc.binary_length(flat).to_numpy(), dtype=np.int64)])
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(kept.type)]
            out = pa.schema(list(zip(["block", "part", "size", "bucket", "numbers", "words", "codes", "lengths", name], kinds)))

            def made(n: int, **columns) -> pa.RecordBatch:
                fields = [columns.get(f.name, pa.nulls(n, f.type)) for f in out]
                return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(fields, out)], schema=out)

            for run in _runs(parts):
                weights = [int(byte[ends[i + 1]] - byte[ends[i]]) + 64 for i in run]
                for lo, hi in chunks(weights, limit):
                    mine = run[lo:hi]
                    table = pa.concat_arrays([flat.slice(ends[i], sizes[i]) for i in mine]).dictionary_encode()
                    words, n = table.dictionary.to_pylist(), len(table.dictionary)
                    codes = table.indices.to_numpy(zero_copy_only=False)
                    ranked = np.argsort(-np.bincount(codes, minlength=n), kind="stable")
                    bucket = (hashes(words) % np.uint64(buckets)).astype(np.int64)
                    rest = sorted(ranked[COMMON:].tolist(), key=lambda i: (bucket[i], words[i]))
                    number = np.empty(n, np.int64)
                    number[ranked[:COMMON]] = np.arange(len(ranked[:COMMON]))
                    number[rest] = np.arange(n - len(rest), n)
                    codes = number[codes]
                    order = np.lexsort((number, bucket))
                    firsts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                    lists_of = np.split(order, firsts[1:]) if n else []
                    same = {"block": [block], "part": [parts[mine[0]]], "size": [n]}
                    m = len(firsts)
                    raw = [pack_words([words[i] for i in some.tolist()]) for some in lists_of]
                    numbers = []
                    for some in lists_of:
                        own = number[some]
                        k = int(np.searchsorted(own, n - len(rest)))
                        numbers.append(pack_codes(np.append(own[:k], own[k] if k < len(own) else 0)))
                    yield made(m, **{k: v * m for k, v in same.items()}, bucket=bucket[order][firsts], numbers=numbers, words=raw)
                    own = sizes[mine]
                    cuts = np.concatenate([[0], np.cumsum(own)])
                    groups = list(chunks([*map(int, own + 64)], GROUP))
                    m = len(groups)
                    raw = [pack_codes(codes[cuts[a] : cuts[b]]) for a, b in groups]
                    yield made(m, **{k: v * m for k, v in same.items()}, codes=raw, lengths=[own[a:b].tolist() for a, b in groups], **{name: pa.ListArray.from_arrays([a for a, _ in groups] + [len(mine)], kept.take(pa.array(mine)))})
                    block += 1
            # What the batch took goes back, not into what the worker holds for later ones.
            del lists, flat, byte
            pa.default_memory_pool().release_unused()

    columns = ["part", "words", *(["odd"] if split else []), name]
    return saved(rows.select(*columns).mapInArrow(pack, schema), label)


def words_of(packed: DataFrame) -> DataFrame:
    """(block, bucket, numbers, words): the word tables of the blocks."""
    return packed.filter("words IS NOT NULL").select("block", "bucket", "numbers", "words")


def rows_of(packed: DataFrame, carry: str) -> DataFrame:
    """(block, size, codes, lengths, carry): the rows of the blocks, some in one."""
    return packed.filter("codes IS NOT NULL").select("block", "size", "codes", "lengths", carry)


def bucket_count(n: int) -> int:
    """A power of two near the number of blocks: what meets in a bucket is about as much as a block."""
    return min(MOST_BUCKETS, max(16, 1 << max(0, n - 1).bit_length()))
