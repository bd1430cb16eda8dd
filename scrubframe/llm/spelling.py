"""Spelling variants: generated edits probe Bloom filters of the vocabulary; only positives are joined with it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubframe.llm.common import ascii_lower, stored
from scrubframe.llm.hashing import mix

LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
SHARDS, WORDS_PER_BLOCK, PASS_BLOCKS = 64, 4, 1 << 22
SLAB = 1 << 15


def runs(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """One row per maximal run of letters of at least ``least`` code points: doc_id, word (A-Z lower-cased)."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"([{LETTERS}]{{{least},}})"), F.lit(1))).alias("word"))
    return found.withColumn("word", F.when(F.col("word").rlike("[A-Z]"), ascii_lower(F.col("word"))).otherwise(F.col("word")))


def _code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words in a row, and where each word begins (with the end)."""
    raw = [w.encode("utf-32-le", "surrogatepass") for w in words]
    return np.frombuffer(b"".join(raw), "<u4"), np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int64)


def _letter(code: np.ndarray, place: np.ndarray) -> np.ndarray:
    """What a letter at a place adds to the hash of its word, so that an edit changes the sum by a few of these."""
    return mix((code.astype(np.uint64) << np.uint64(32) | place.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))


def _key(total: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mix(total + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def keys(words: list[str]) -> np.ndarray:
    code, at = _code_points(words)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_letter(code, np.arange(len(code)) - np.repeat(at[:-1], np.diff(at))), dtype=np.uint64)])
    return _key(sums[at[1:]] - sums[at[:-1]], np.diff(at))


@dataclass(frozen=True)
class Layout:
    """Where the filter of each length begins in one row of 64-bit blocks, and how many blocks it has.

    Words of ``SHARDS`` or more letters share the last filter; their length is part of the key.
    """

    first: np.ndarray
    blocks: np.ndarray

    @classmethod
    def of(cls, counts: dict[int, int], per_block: int = WORDS_PER_BLOCK) -> Layout:
        blocks = np.array([-(-counts.get(k, 0) // per_block) for k in range(SHARDS + 1)], np.int64)
        return cls(np.concatenate([[0], np.cumsum(blocks)[:-1]]), blocks)

    def block(self, key: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The block of a key, -1 where no word has its length."""
        shard = np.minimum(length, SHARDS)
        inside = ((key >> np.uint64(32)) * self.blocks[shard].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        return np.where(self.blocks[shard] > 0, self.first[shard] + inside, -1)


def bits(key: np.ndarray) -> np.ndarray:
    """The four bits of a key in its block."""
    one = np.uint64(1)
    return (one << (key & np.uint64(63))) | (one << (key >> np.uint64(6) & np.uint64(63))) | (one << (key >> np.uint64(12) & np.uint64(63))) | (
        one << (key >> np.uint64(18) & np.uint64(63)))


class Filters:
    """The blocks ``low`` to ``low + len(data)`` of the layout."""

    def __init__(self, layout: Layout, low: int, data: np.ndarray) -> None:
        self.layout, self.low, self.data = layout, low, data

    def may_hold(self, key: np.ndarray, length: np.ndarray) -> np.ndarray:
        at = self.layout.block(key, length) - self.low
        some = np.flatnonzero((at >= 0) & (at < len(self.data)))
        block = self.data[at[some]]
        hit = (block >> (key[some] & np.uint64(63)) & np.uint64(1)) > 0
        some, block = some[hit], block[hit]
        want = bits(key[some])
        return some[(block & want) == want]


def positives(words: list[str], alphabet: np.ndarray, filters: Filters) -> Iterator[tuple[np.ndarray, ...]]:
    """Edits that the filters may hold: number of the word, key, place, and the new letter's number (-1: deleted).

    Edits are one deleted letter, or one letter replaced by a greater one: of two near words, at least one has the other
    among these. An edit that gives the same word as another comes once.
    """
    code, at = _code_points(words)
    size = np.diff(at)
    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(code)) - at[owner]
    value = _letter(code, place)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    moved = np.where(place > 0, _letter(code, np.maximum(place - 1, 0)), np.uint64(0))
    tails = np.concatenate([np.zeros(1, np.uint64), np.cumsum(moved, dtype=np.uint64)])
    whole = sums[at[1:]] - sums[at[:-1]]
    begin, end = at[owner], at[owner + 1]
    kept = (place == 0) | (code != np.concatenate([code[:1], code[:-1]]))
    deleted = (sums[:-1] - sums[begin] + tails[end] - tails[1:])[kept]
    of, where = owner[kept], place[kept]
    key = _key(deleted, size[of] - 1)
    hit = filters.may_hold(key, size[of] - 1)
    yield of[hit], key[hit], where[hit], np.full(len(hit), -1)
    for low in range(0, len(code), SLAB):
        c, p, o = code[low:low + SLAB], place[low:low + SLAB], owner[low:low + SLAB]
        row, letter = np.nonzero(alphabet[None, :] > c[:, None])
        places, which = np.unique(p, return_inverse=True)
        table = _letter(np.tile(alphabet, len(places)), np.repeat(places, len(alphabet))).reshape(len(places), len(alphabet))
        key = _key((whole[o] - value[low:low + SLAB])[row] + table[which[row], letter], size[o][row])
        hit = filters.may_hold(key, size[o][row])
        yield o[row[hit]], key[hit], p[row[hit]], letter[hit]


def vocabulary(words: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """The distinct words that occur at least ``least_count`` times: id, word, n, key (of the filters), shard."""
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys(batch.column("word").to_pylist()).view(np.int64))], ["word", "n", "key"])

    keyed = counted.select("word", "n").mapInArrow(run, "word string, n bigint, key bigint")
    shard = F.least(F.char_length("word"), F.lit(SHARDS)).cast("int")
    return stored(keyed.select(F.monotonically_increasing_id().alias("id"), "word", "n", "key", shard.alias("shard")), "vocabulary")


def _filters(words: DataFrame, layout: Layout, low: int, high: int) -> Filters:
    """The filters' blocks from ``low`` to ``high``: at most as many rows reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy().view(np.uint64)
            at = layout.block(key, batch.column("length").to_numpy().astype(np.int64))
            good = (at >= low) & (at < high)
            yield pa.RecordBatch.from_arrays([pa.array(at[good]), pa.array(bits(key[good]).view(np.int64))], ["block", "bits"])

    rows = words.select("key", F.char_length("word").alias("length")).mapInArrow(run, "block bigint, bits bigint")
    found = rows.groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    data = np.zeros(high - low, np.uint64)
    data[found.column("block").to_numpy() - low] = found.column("bits").to_numpy().view(np.uint64)
    return Filters(layout, low, data)


def near_pairs(words: DataFrame, alphabet: list[str], per_block: int = WORDS_PER_BLOCK, pass_blocks: int = PASS_BLOCKS) -> DataFrame:
    """Pairs of words of the vocabulary that differ by one inserted, deleted or replaced letter, each once:
    a_id, a, a_n, b_id, b, b_n."""
    spark = words.sparkSession
    counts = {r["shard"]: r["many"] for r in words.groupBy("shard").agg(F.count(F.lit(1)).alias("many")).collect()}
    layout, letters = Layout.of(counts, per_block), np.array(sorted(map(ord, alphabet)), np.uint32)
    strings, total, found = pa.array(["", *map(chr, letters)], pa.string()), int(layout.blocks.sum()), []
    for low in range(0, total, pass_blocks):
        high = min(low + pass_blocks, total)
        held = [k for k in range(SHARDS + 1) if layout.blocks[k] and layout.first[k] < high and layout.first[k] + layout.blocks[k] > low]
        shared = spark.sparkContext.broadcast(_filters(words.where(F.col("shard").isin(held)), layout, low, high))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("id").to_numpy()
                for row, key, place, letter in positives(batch.column("word").to_pylist(), letters, shared.value):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(key.view(np.int64)), pa.array(place.astype(np.int32)),
                                                      strings.take(pa.array(letter + 1))], ["id", "key", "place", "letter"])

        asking = words.where(F.col("shard").isin(sorted({s for k in held for s in (k, min(k + 1, SHARDS))}))).select("id", "word")
        found.append(stored(asking.mapInArrow(run, "id bigint, key bigint, place int, letter string"), "positives"))
        shared.destroy()
    if not found:
        return words.select(*[F.col(c).alias(f"{side}{n}") for side in "ab" for c, n in (("id", "_id"), ("word", ""), ("n", "_n"))]).limit(0)
    asked = found[0]
    for more in found[1:]:
        asked = asked.unionByName(more)
    held = words.select("key", F.col("id").alias("b_id"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    met = asked.withColumnRenamed("id", "a_id").join(held, "key").drop("key")
    pairs = met.join(words.select(F.col("id").alias("a_id"), F.col("word").alias("a"), F.col("n").alias("a_n")), "a_id")
    edit = F.concat(F.left("a", F.col("place")), F.col("letter"), F.substring("a", F.col("place") + 2, F.char_length("a")))
    return stored(pairs.where(edit == F.col("b")).drop("place", "letter"), "near-words")


def _roots(forms: DataFrame) -> DataFrame:
    """The end of the path of forms of each word (id, to_id, to): the steps known double in each round.

    A form is ``RATIO`` times as frequent as its word, so paths have no circle and end after a few steps."""
    known = stored(forms, "forms")
    while True:
        ends = known.select(F.col("id").alias("to_id"), F.col("to_id").alias("far_id"), F.col("to").alias("far"))
        joined = known.join(ends, "to_id", "left")
        if joined.where("far_id is not null").isEmpty():
            return known
        known = stored(joined.select("id", F.coalesce("far_id", "to_id").alias("to_id"), F.coalesce("far", "to").alias("to")), "forms")


def variants(words: DataFrame, least_count: int = LEAST_COUNT, ratio: int = RATIO, alphabet: list[str] | None = None,
             per_block: int = WORDS_PER_BLOCK, pass_blocks: int = PASS_BLOCKS) -> DataFrame:
    """Group spelling variants of the words in column ``word``, one row per occurrence.

    Returns for every distinct word with at least ``least_count`` occurrences (n): n_near (how many others differ by one
    inserted, deleted or replaced code point), form (of the near ones that of largest n, ties: the smallest, if its n is at
    least ``ratio`` times the word's) with form_n, and root (the end of the path of forms, the word itself without one).
    Null and empty words are left out, other columns are ignored, an empty table gives no rows. Words may have any length.

    The filters of a pass have at most ``pass_blocks`` blocks of 8 bytes, whatever the vocabulary; larger ones are dealt
    into passes, each of which probes the words whose edits may lie in it. ``alphabet`` defaults to all letters in use.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1, or paths of forms may have circles")
    words = vocabulary(words.select("word").where("word <> ''"), least_count)
    if alphabet is None:
        alphabet = [r["c"] for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()]
    pairs = near_pairs(words, alphabet, per_block, pass_blocks)

    def side(a: str, b: str) -> Column:
        return F.struct(F.col(f"{a}_id").alias("id"), (-F.col(f"{b}_n")).alias("minus"), F.col(b).alias("near"), F.col(f"{b}_id").alias("near_id"))

    both = pairs.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("s")).select("s.*")
    best = both.groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct("minus", "near", "near_id")).alias("best"))
    told = words.select("id", "word", "n").join(best, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "best",
        F.coalesce(-F.col("best.minus") >= ratio * F.col("n"), F.lit(False)).alias("has"))
    told = stored(told, "best-near")
    roots = _roots(told.where("has").select("id", F.col("best.near_id").alias("to_id"), F.col("best.near").alias("to")))
    return told.join(roots.select("id", "to"), "id", "left").select(
        "word", F.when(F.col("has"), F.col("best.near")).alias("form"), F.coalesce("to", "word").alias("root"), "n", "n_near",
        F.when(F.col("has"), -F.col("best.minus")).alias("form_n"))
