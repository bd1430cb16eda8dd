"""64-bit hashes of the words of many texts at once, and a fixed-size table of how common hashes are."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 20
BUCKETS, CHUNKS = 1 << 20, 64
_P = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (one to one)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word (bytes other than ASCII white space) of UTF-8 text.

    Blocks of eight bytes are scrambled, each with its place in the word, and scrambled again; their sum is scrambled with the
    word's length. Nothing in it is linear in the bytes, so words made of the same parts in another order do not meet.
    """
    raw = np.frombuffer(data, np.uint8)
    if lower:
        raw = _LOWER[raw]
    solid = np.concatenate([[False], ~_SPACE[raw], [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    first, end = edges[::2], edges[1::2]
    if not len(first):
        return np.zeros(0, np.uint64), first, end
    eight = np.ndarray((len(raw),), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]).tobytes(), 0, (1,))
    size = end - first
    # Most words are one block; those of several add their other blocks.
    value = mix(mix(eight[first] << (8 * np.maximum(8 - size, 0)).astype(np.uint64)) ^ np.uint64(_P))
    long = np.flatnonzero(size > 8)
    if len(long):
        blocks = (size[long] - 1) // 8
        begin = np.concatenate([[0], np.cumsum(blocks)[:-1]])
        word = np.repeat(long, blocks)
        number = np.arange(1, len(word) + 1) - np.repeat(begin, blocks)
        at = first[word] + 8 * number
        over = (8 * np.maximum(8 - (end[word] - at), 0)).astype(np.uint64)
        value[long] += np.add.reduceat(mix(mix(eight[at] << over) ^ ((number + 1).astype(np.uint64) * np.uint64(_P))), begin)
    return mix(value + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), first, end


def joined(texts: list[str | None]) -> tuple[bytes, np.ndarray]:
    """The texts as UTF-8 with a line break after each, and where each begins (and the end)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return b"\n".join(raw) + b"\n", np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]).astype(np.int64)


def chunks(texts: list[str | None], most: int = CHUNK) -> Iterator[tuple[int, list[str | None]]]:
    """Consecutive texts of together about ``most`` characters, at least one; with the number of the first."""
    first, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= most:
            yield first, texts[first:k + 1]
            first, size = k + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def shingles(texts: list[str | None], size: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words per text, a shorter text as one run; returns them and each text's offsets."""
    return runs(texts, size, lower)[:2]


def runs(texts: list[str | None], size: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``shingles``, with the hashes of all words, and the first word and the end of each run among them."""
    data, starts = joined(texts)
    words, first, _ = word_hashes(data, lower)
    at = np.searchsorted(first, starts)
    n = np.diff(at)
    rolled = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        rolled = mix(rolled ^ words[k:len(words) - size + 1 + k]) + np.uint64(k + 1) if len(rolled) else rolled
    count = np.where(n >= size, n - size + 1, 0)
    offsets = np.concatenate([[0], np.cumsum(np.where(n == 0, 0, np.maximum(count, 1)))])
    out = np.empty(int(offsets[-1]), np.uint64)
    begin = np.empty(len(out), np.int64)
    place = np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
    slot = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
    out[slot], begin[slot] = rolled[place], place
    end = begin + size
    for k in np.flatnonzero((n > 0) & (n < size)).tolist():
        whole = np.uint64(n[k])
        for w in words[at[k]:at[k + 1]]:
            whole = mix(np.atleast_1d(whole ^ w))[0] + np.uint64(77)
        out[offsets[k]], begin[offsets[k]], end[offsets[k]] = whole, at[k], at[k + 1]
    return out, offsets, words, begin, end


def signatures(values: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit numbers for a sorted set of hashes: a BLAKE2 digest, which no two sets are known to share."""
    return struct.unpack("<qq", hashlib.blake2b(np.ascontiguousarray(values).tobytes(), digest_size=16).digest())


def commonness(docs: DataFrame, hashes: Callable[[list[str | None]], np.ndarray], buckets: int = BUCKETS) -> np.ndarray:
    """How often hashes fall into each of ``buckets`` counters, over the whole table.

    A common hash has a high counter; a rare one has about the mean. The table has a fixed size, each task sends one, and
    they are added up in parts before the driver gets the sum. It only sets an order, on which no result depends.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, "<u4")
        for batch in batches:
            for _, texts in chunks(batch.column("text").to_pylist(), CHUNK // 4):
                np.add.at(total, (hashes(texts) & np.uint64(buckets - 1)).astype(np.int64), np.uint32(1))
        if total.any():
            parts = total.reshape(CHUNKS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[part] = sums.get(part, np.zeros(buckets // CHUNKS, np.int64)) + np.frombuffer(zlib.decompress(counts), "<u4")
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(np.minimum(s, 0xFFFFFFFF).astype("<u4").tobytes(), 1) for s in sums.values()],
                                                                                       pa.binary())], ["part", "counts"])

    schema = "part int, counts binary"
    out = np.zeros((CHUNKS, buckets // CHUNKS), np.uint32)
    found = docs.select("text").where(F.col("text").isNotNull()).mapInArrow(run, schema).repartition("part").mapInArrow(add, schema)
    for row in found.collect():
        out[row["part"]] = np.frombuffer(zlib.decompress(row["counts"]), "<u4")
    return out.ravel()
