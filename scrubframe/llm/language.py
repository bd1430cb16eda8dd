"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM, LETTERS, SEED = 1024, 64, 11
UNKNOWN = "und"
ROWS = 256


def letter_vectors(dim: int = DIM, seed: int = SEED) -> np.ndarray:
    """A random vector of +1 and -1 for each class of letters."""
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (LETTERS, dim))


def _classes() -> np.ndarray:
    """Class per code point of the basic plane: 0 for what is no letter, a to z, and shared classes for other letters."""
    table = np.zeros(0x10000, np.int32)
    for code in range(0x10000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        letter = chr(code)
        if letter.isalpha():
            low = letter.lower()[0]
            table[code] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) * 40503 % (LETTERS - 27)
    return table


_TABLE: np.ndarray | None = None


def letters_of(text: str) -> np.ndarray:
    """Letter classes of a text, with runs of other characters as one 0 and a 0 at both ends."""
    global _TABLE
    if _TABLE is None:
        _TABLE = _classes()
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    classes = np.where(codes < 0x10000, _TABLE[np.minimum(codes, 0xFFFF)], 27 + codes % (LETTERS - 27)).astype(np.int32)
    if len(codes) and codes.max() >= 0x10000:
        high = np.flatnonzero(codes >= 0x10000)
        classes[high] = [27 + c % (LETTERS - 27) if chr(c).isalpha() else 0 for c in codes[high].tolist()]
    classes = np.concatenate([[0], classes, [0]])
    return classes[np.concatenate([[True], (classes[1:] != 0) | (classes[:-1] != 0)])]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct three-letter grams of a text and how often each occurs."""
    x = letters_of(text)
    if len(x) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ids = (x[:-2] * LETTERS + x[1:-1]) * LETTERS + x[2:]
    return np.unique(ids, return_counts=True)


def gram_vectors(ids: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Bind the letters of each gram: the first rotated by two places, the second by one, multiplied with the third."""
    first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    return first[ids // LETTERS ** 2] * second[ids // LETTERS % LETTERS] * letters[ids % LETTERS]


def bundle(documents: list[tuple[np.ndarray, np.ndarray]], letters: np.ndarray) -> np.ndarray:
    """The vector of each document: the sum of the vectors of its grams, damped by the square root of their counts."""
    known = np.unique(np.concatenate([ids for ids, _ in documents] or [np.empty(0, np.int64)]))
    out = np.zeros((len(documents), letters.shape[1]), np.float32)
    step = 8192
    for low in range(0, len(known), step):
        part = known[low:low + step]
        counts = np.zeros((len(documents), len(part)), np.float32)
        for row, (ids, n) in enumerate(documents):
            a, b = np.searchsorted(ids, part[0]), np.searchsorted(ids, part[-1], "right")
            counts[row, np.searchsorted(part, ids[a:b])] = np.sqrt(n[a:b])
        out += counts @ gram_vectors(part, letters).astype(np.float32)
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norm > 0, norm, 1)


def learn(docs: DataFrame, dim: int = DIM, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Language names and prototypes from all rows with text and lang: per language the sum of the documents' unit vectors.

    Sums are made per task and then per language, so only one row per task and language moves.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums = letter_vectors(dim, seed), {}
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                vectors = unit(bundle([grams(t) for t in part.column("text").to_pylist()], letters))
                names = np.array(part.column("lang").to_pylist(), object)
                for name in dict.fromkeys(names.tolist()):
                    sums[name] = sums.get(name, 0) + vectors[names == name].sum(axis=0, dtype=np.float64)
        for name, total in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [name], "total": [total.tolist()]}, pa.schema([("lang", pa.string()), ("total", pa.list_(pa.float64()))]))

    rows = docs.where("text is not null and lang is not null").select("lang", "text").mapInArrow(run, "lang string, total array<double>")
    one = rows.select("lang", F.posexplode("total").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    found = one.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v")).orderBy("lang").select("lang", "v.x").collect()
    names = [r["lang"] for r in found]
    return names, unit(np.array([r["x"] for r in found], np.float64).reshape(len(names), dim)).astype(np.float32)


def identify(docs: DataFrame, names: list[str], prototypes: np.ndarray, keep: list[str] | None = None, seed: int = SEED) -> DataFrame:
    """Add lang_pred and score (cosine with the nearest prototype, 0 at least) from the whole text of each row.

    A text that is null or has no letter gets ``und`` and 0, also when nothing was learned. Ties go to the language first
    by name. Only the text is used; columns named lang_pred or score are replaced; nothing is shuffled. The prototypes
    (one vector per language) are broadcast. ``keep`` names the columns that come along, by default all.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    rows = docs.select(*keep, F.col("text").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(prototypes)
    schema = T.StructType([*rows.drop("_text").schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        letters = letter_vectors(known.shape[1] if known.size else DIM, seed)
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                counted = [grams(t or "") for t in part.column("_text").to_pylist()]
                has = np.array([len(ids) > 0 for ids, _ in counted])
                if names:
                    cosine = unit(bundle(counted, letters)) @ known.T
                    best = cosine.argmax(axis=1)
                    score = np.where(has, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0)
                    pred = [names[k] if h else UNKNOWN for k, h in zip(best, has, strict=True)]
                else:
                    score, pred = np.zeros(part.num_rows), [UNKNOWN] * part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(pred, pa.string()), pa.array(score.astype(np.float64))],
                                                 [*part.schema.names[:-1], "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def held_out() -> Column:
    """Rows that nothing is learned from; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
