"""Periodic runs of words: a sparse dynamic program over diagonals (lags) of equal words and blocks of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST = 12
CHUNK_BYTES, PAIRS = 1 << 20, 1 << 21
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
ARROW_RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])


def _names(keys: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A number per position: equal for equal keys that occur more than once, otherwise one of its own (below zero)."""
    names = -1 - np.arange(n, dtype=np.int64)
    if len(at):
        _, code, count = np.unique(keys, return_inverse=True, return_counts=True)
        often = count[code] > 1
        names[at[often]] = code[often]
    return names.astype(np.int32) if n < 1 << 31 else names


def _seeds(names: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (position, lag) of equal blocks with ``size`` <= lag < 2 * ``size``, in portions of bounded size.

    A block with an equal one at most half its size away on both sides lies inside a shorter run. Two such blocks need not
    meet: if they are in the same shorter run, their lag is a multiple of its period; if they are in two of them, an end of
    one of the two runs lies on the same diagonal, and a block at that end finds it.
    """
    at = np.flatnonzero(names >= 0)
    order = np.argsort(names[at], kind="stable")
    at, name = at[order].astype(np.int64), names[at][order].astype(np.int64)
    if not len(at):
        return
    near = np.concatenate([[False], (name[1:] == name[:-1]) & (at[1:] - at[:-1] <= size // 2), [False]])
    inside = near[1:] & near[:-1]
    place = name * (len(names) + 1) + at

    def pairs(asks: np.ndarray, low: np.ndarray, high: np.ndarray, back: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        width = high - low
        some = width > 0
        asks, low, width = asks[some], low[some], width[some]
        total = np.concatenate([[0], np.cumsum(width)])
        first = 0
        while first < len(asks):
            last = max(first + 1, int(np.searchsorted(total, total[first] + PAIRS, "right")) - 1)
            w = width[first:last]
            mine = np.repeat(at[asks[first:last]], w)
            others = at[np.repeat(low[first:last] - (total[first:last] - total[first]), w) + np.arange(int(w.sum()))]
            later, earlier = (mine, others) if back else (others, mine)
            yield later, later - earlier
            first = last

    asks = np.flatnonzero(~inside)
    base = name[asks] * (len(names) + 1)
    here = at[asks]
    yield from pairs(asks, np.searchsorted(place, base + np.maximum(here - 2 * size + 1, 0)),
                     np.searchsorted(place, base + np.maximum(here - size + 1, 0)), True)
    if inside.any():
        # Ends of shorter runs also ask the later blocks; those of them that ask back are found twice.
        yield from pairs(asks, np.searchsorted(place, base + np.minimum(here + size, len(names))),
                         np.searchsorted(place, base + np.minimum(here + 2 * size, len(names))), False)


def runs_of(words: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of a sequence of numbers >= 0, as start, length and smallest period, ordered by start and period.

    Words are met by their earlier occurrences: level by level, blocks of 1, 2, 4, ... words are named by the two halves they
    consist of, and every block asks for its equals at lags from its size to twice that. On each diagonal (lag) consecutive
    hits count up one match; a diagonal that ends after a match of sufficient length gives a run. Only blocks that repeat
    get to the next level, so a text without repetitions ends after a few levels. Memory is linear in the words, times the
    number of levels; steps are linear per level, also in texts of one word.
    """
    n = len(words)
    levels = [_names(words, np.arange(n), n)]
    found: list[np.ndarray] = []
    size = 1
    while (levels[-1] >= 0).any():
        names = levels[-1]
        at = np.flatnonzero(names >= 0)
        at = at[at >= size]
        at = at[names[at - size] >= 0]
        levels.append(_names(names[at - size].astype(np.int64) * (n + 1) + names[at], at, n))
        size *= 2
    for level, names in enumerate(levels[:-1]):
        for at, lag in _seeds(names, 1 << level):
            order = np.lexsort((at, lag))
            at, lag = at[order], lag[order]
            # A hit right after another one on the same diagonal only makes that match longer.
            first = np.concatenate([[True], (lag[1:] != lag[:-1]) | (at[1:] > at[:-1] + 1)])
            at, lag = at[first], lag[first]
            low, high = at - (1 << level) + 1, at.copy()
            for k in range(len(levels) - 2, -1, -1):
                step, block = 1 << k, levels[k]
                to = high + step
                good = to < n
                good[good] = block[to[good]] == block[to[good] - lag[good]]
                high[good] += step
                good = low - lag - step >= 0
                good[good] = block[low[good] - 1] == block[low[good] - 1 - lag[good]]
                low[good] -= step
            start, end = low - lag, high
            length = end - start + 1
            good = (length >= least) & (length >= 2 * lag)
            if good.any():
                found.append(np.unique(np.stack([start[good], length[good], lag[good]], axis=1), axis=0))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = np.unique(np.concatenate(found), axis=0).T
    # The same stretch with a multiple of its period comes later in this order.
    keep = np.concatenate([[True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])])
    start, length, period = start[keep], length[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _chunks(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or b"")
        if size >= CHUNK_BYTES:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _collapsed(texts: list[bytes | None], least: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Number of words, runs, and the words that stay, per text. The texts are one sequence in which no two share a word."""
    split = [(t or b"").split() for t in texts]
    n = np.array([len(w) for w in split], np.int64)
    begin = np.concatenate([[0], np.cumsum(n)])
    flat = pa.array([w for ws in split for w in ws], pa.binary()).dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), n)
    start, length, period = runs_of(owner * (len(flat.dictionary) + 1) + codes, least)
    gone = np.zeros(len(codes) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, start + length, -1)
    stays = np.cumsum(gone[:-1]) == 0
    text = np.searchsorted(begin, start, "right") - 1
    offsets = np.searchsorted(text, np.arange(len(texts) + 1))
    runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(start - begin[text]), pa.array(length), pa.array(period)], fields=list(ARROW_RUN)))
    kept = [None if t is None else b" ".join([w for w, s in zip(ws, stays[a:b].tolist(), strict=True) if s])
            for t, ws, a, b in zip(texts, split, begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
    return pa.array(n), runs, pa.array(kept, pa.binary()).cast(pa.string())


def periodic_runs(docs: DataFrame, least: int = LEAST, keep: list[str] | None = None) -> DataFrame:
    """Find every periodic run of words in ``text``; adds n_words, runs (start, length, period) and collapsed.

    Words are runs without ASCII white space, numbered from 0. A run is a stretch of at least ``least`` words and twice its
    smallest period that no neighbouring word extends. ``collapsed`` joins the words that no run holds after its first
    period, by one space. Null text has no words and null ``collapsed``; a text without words gives an empty one. Rows are
    treated one by one (repeated rows alike, an empty table gives none), each by whole text, so a very long text takes the
    memory of one task: some 100 bytes a word, plus 4 for each doubling of its longest repeated passage. Other columns
    come along (``keep`` limits them); columns called text, n_words, runs or collapsed are replaced.
    """
    added = ["n_words", "runs", "collapsed"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("text", *added)]
    rows = docs.select(*keep, F.col("text").cast("string").cast("binary").alias("text"))
    schema = T.StructType([*rows.select(*keep).schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)),
                           T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            for low, high in _chunks(texts):
                part = batch.slice(low, high - low).columns[:-1]
                yield pa.RecordBatch.from_arrays([*part, *_collapsed(texts[low:high], least)], [f.name for f in schema])

    return rows.mapInArrow(run, schema)
