"""Benchmark decontamination: an FM-index per shard of documents, searched for all windows of the benchmark items."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubframe.llm.common import stored

WINDOW, SAMPLE, SHARD_WORDS = 10, 16, 1 << 20
PART_BYTES = 64 << 20
#: A word in text that is not lower-cased yet: digits, ASCII letters and everything beyond ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes with A-Z lower-cased and every ASCII byte that is in no word as a space.
_LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BYTES = bytes(c if re.match(rb"[0-9a-z\x80-\xff]", bytes([c])) else 32 for c in _LOW)
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split()


class WaveletMatrix:
    """Bit planes of a sequence, each stably parted by its bits; ``walk`` maps a position of the sequence through all planes."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.planes: list[tuple[int, np.ndarray, int]] = []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            ones = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
            self.planes.append((level, ones, len(symbols) - int(ones[-1])))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, ones, zeros in self.planes:
            below = ones[at]
            at = np.where((symbol >> level) & 1, zeros + below, at - below)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self.walk(symbol, at) - self.walk(symbol, np.zeros_like(at))


class FMIndex:
    """Index of a sequence of word numbers from 1 in which every 0 ends a run; no match crosses a 0. The sequence ends with 0."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE) -> None:
        n = len(text)
        ends = text == 0
        rank = np.where(ends, np.cumsum(ends) - 1, text + int(ends.sum()))
        step = 1
        while True:
            follow = np.zeros(n, np.int64)
            follow[:-step] = rank[step:] + 1
            key = rank * np.int64(n + symbols + 2) + follow
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) > 0]))
            step *= 2
            if rank[order[-1]] == n - 1 or step >= n:
                break
        self.n = n
        self.last = text[order - 1]
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.ranks = WaveletMatrix(self.last, max(1, int(symbols).bit_length()))
        first_of_run = np.concatenate([[True], ends[:-1]])
        sampled = (order % sample == 0) | first_of_run[order]
        self.sampled, self.places = np.concatenate([[0], np.cumsum(sampled)]), order[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the index whose suffixes begin with each pattern (a row of ``patterns``), by backward search."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, k]
            a = self.below[symbol] + self.ranks.rank(symbol, low[alive])
            b = self.below[symbol] + self.ranks.rank(symbol, high[alive])
            low[alive], high[alive] = a, np.maximum(a, b)
            alive = alive[b > a]
            if not len(alive):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of suffixes: steps back to a sampled place; the first word of a run is always one, so no step leaves a run."""
        out, steps, open_ = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            hit = self.sampled[rows + 1] > self.sampled[rows]
            out[open_[hit]] = self.places[self.sampled[rows[hit]]] + steps
            open_, rows = open_[~hit], rows[~hit]
            symbol = self.last[rows]
            rows = self.below[symbol] + self.ranks.rank(symbol, rows)
            steps += 1
        return out


@dataclass
class Phrases:
    """Windows of items as word numbers, by length: the windows and, for each, its items."""

    numbers: dict[bytes, int]
    windows: dict[int, np.ndarray]
    owners: dict[int, list[tuple[str, ...]]]

    @classmethod
    def of(cls, items: list[tuple[object, str | None]], window: int = WINDOW) -> Phrases:
        numbers: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, text in items:
            ids = [numbers.setdefault(w, len(numbers) + 1) for w in words_of(text or "")]
            size = min(window, len(ids))
            for k in range(len(ids) - size + 1 if size else 0):
                found.setdefault(size, {}).setdefault(tuple(ids[k:k + size]), set()).add("" if item is None else str(item))
        return cls(numbers, {n: np.array(list(w), np.int64) for n, w in found.items()}, {n: [tuple(v) for v in w.values()] for n, w in found.items()})


def find(documents: list[list[bytes]], phrases: Phrases) -> list[tuple[np.ndarray, set[str]]]:
    """Per document the marks of words inside an occurrence and the items that occur.

    Words that are in no item end a run, and runs shorter than the shortest window hold no occurrence; the index covers
    all other runs of the shard.
    """
    get = phrases.numbers.get
    sizes = np.array([len(d) for d in documents], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    ids = np.zeros(int(starts[-1]) + 1, np.int64)
    for at, words in zip(starts.tolist(), documents, strict=False):
        ids[at:at + len(words)] = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
    marks, items = np.zeros(len(ids) + 1, np.int64), [set() for _ in documents]
    if phrases.windows:
        edges = np.flatnonzero(np.diff(np.concatenate([[0], ids != 0, [0]]).astype(np.int8)))
        runs = edges.reshape(-1, 2)
        runs = runs[runs[:, 1] - runs[:, 0] >= min(phrases.windows)]
        if len(runs):
            inside = np.zeros(len(ids) + 1, np.int64)
            np.add.at(inside, runs[:, 0], 1)
            np.add.at(inside, runs[:, 1] + 1, -1)
            places = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
            index = FMIndex(ids[places], len(phrases.numbers))
            for size, windows in phrases.windows.items():
                low, high = index.search(windows)
                count = high - low
                rows = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
                at = places[index.locate(rows)]
                np.add.at(marks, at, 1)
                np.add.at(marks, at + size, -1)
                window = np.repeat(np.arange(len(windows)), count)
                pairs = np.unique(np.stack([np.searchsorted(starts, at, "right") - 1, window], axis=1), axis=0)
                for d, w in pairs.tolist():
                    items[d].update(phrases.owners[size][w])
    hit = np.cumsum(marks)[:-1] > 0
    return [(hit[a:a + n], items[d]) for d, (a, n) in enumerate(zip(starts[:-1].tolist(), sizes.tolist(), strict=True))]


def spans_of(hit: np.ndarray) -> list[tuple[int, int]]:
    """Merged removal spans: maximal stretches of marked words, end exclusive."""
    return [tuple(x) for x in np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]]).astype(np.int8))).reshape(-1, 2).tolist()]


def cut(text: str, hit: np.ndarray, phrases: Phrases) -> str:
    """The text without its marked words and what stands between them; repeated until closing up leaves no occurrence."""
    while hit.any():
        at = [m.span() for m in WORD.finditer(text)]
        out, last = [], 0
        for a, b in spans_of(hit):
            out.append(text[last:at[a][0]])
            last = at[b - 1][1]
        text = "".join([*out, text[last:]])
        hit = find([words_of(text)], phrases)[0][0]
    return text


def _shards(batch: pa.RecordBatch, most: int) -> Iterator[tuple[int, list[list[bytes]]]]:
    first, documents, size = 0, [], 0
    for row, text in enumerate(batch.column("_text")):
        documents.append(words_of(text.as_py() or ""))
        size += len(documents[-1])
        if size >= most:
            yield first, documents
            first, documents, size = row + 1, [], 0
    if documents:
        yield first, documents


def _scan(docs: DataFrame, phrases: Phrases, keep: list[str], removing: bool, shard_words: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(phrases)
    rows = docs.select(*keep, F.col("text").alias("_text"))
    fields = [*rows.drop("_text").schema.fields, T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS),
              T.StructField("items", T.ArrayType(T.StringType()))]
    if removing:
        fields.append(T.StructField("text", T.StringType()))
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, documents in _shards(batch, shard_words):
                part = batch.slice(first, len(documents))
                found = find(documents, shared.value)
                columns = [*part.columns[:-1], pa.array([len(d) for d in documents], pa.int64()),
                           pa.array([[{"start": a, "end": b} for a, b in spans_of(hit)] for hit, _ in found], spans_type),
                           pa.array([sorted(items) for _, items in found], pa.list_(pa.string()))]
                if removing:
                    texts = part.column("_text").to_pylist()
                    columns.append(pa.array([cut(t, hit, shared.value) if hit.any() else t for t, (hit, _) in zip(texts, found, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return rows.mapInArrow(run, T.StructType(fields))


def _parts(benchmark: DataFrame, part_bytes: int, window: int) -> list[Phrases]:
    """The items in parts of about ``part_bytes`` of text, so that what one pass broadcasts is bounded."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // part_bytes))
    rows = benchmark.select("item_id", "text").withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    return [Phrases.of([(r["item_id"], r["text"]) for r in rows.where(F.col("part") == k).collect()], window) for k in range(n)]


def contaminated(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = WINDOW, part_bytes: int = PART_BYTES,
                 shard_words: int = SHARD_WORDS) -> DataFrame:
    """Add n_words, spans (word positions inside an occurrence of a benchmark window, merged, end exclusive) and items.

    A window is ``window`` consecutive words of an item; a shorter item is one window, an item without words none. The
    documents stay where they are: each task indexes its own shards and searches all windows in them. Null and empty texts
    have no words. Rows are independent, so null, tied and repeated ids are fine; items with equal text all count; an empty
    benchmark marks nothing. Columns with the added names are replaced. A benchmark of more than ``part_bytes`` is searched
    in several passes whose spans are united.
    """
    added = ("n_words", "spans", "items")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    parts = _parts(benchmark, part_bytes, window)
    if len(parts) == 1:
        return _scan(docs, parts[0], keep, False, shard_words)
    rows = docs.select(*dict.fromkeys([*keep, "text"])).withColumn("_spans", F.array().cast(SPANS)).withColumn("_items", F.array().cast("array<string>"))
    for phrases in parts:
        rows = _scan(rows, phrases, [*dict.fromkeys([*keep, "text"]), "_spans", "_items"], False, shard_words)
        rows = rows.withColumn("_spans", united(F.concat("_spans", "spans"))).withColumn("_items", F.array_union("_items", "items"))
        rows = rows.drop("spans", "items") if phrases is not parts[-1] else rows
        rows = rows.drop("n_words") if phrases is not parts[-1] else rows
    return rows.select(*keep, "n_words", F.col("_spans").alias("spans"), F.array_sort("_items").alias("items"))


def united(spans: Column) -> Column:
    """Union of spans as sorted spans that do not touch."""
    def step(out: Column, span: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        grown = F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))))
        return F.when((F.size(out) > 0) & (last["end"] >= span["start"]), grown).otherwise(F.concat(out, F.array(span)))

    return F.aggregate(F.array_sort(spans), F.array().cast(SPANS), step)


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The documents with every occurrence cut out of ``text``; clean documents are returned as they are, null texts too.

    After the cut no window of the benchmark is left, also none that arose where the text closed up. With several parts
    the passes follow each other until one finds nothing.
    """
    parts, columns = _parts(benchmark, part_bytes, window), docs.columns
    keep = [c for c in columns if c != "text"]
    while True:
        found = None
        for phrases in parts:
            docs = _scan(docs, phrases, keep, True, shard_words)
            if len(parts) > 1:
                docs = stored(docs, "cut")
                found = bool(found) or not docs.where(F.size("spans") > 0).isEmpty()
            docs = docs.select(*columns)
        if not found:
            return docs
