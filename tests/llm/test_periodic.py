"""Periodic runs against brute force."""

import numpy as np
import pytest

from scrubframe.llm import periodic, queries


def brute_runs(words, least=periodic.LEAST):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        start = None
        for i in range(q, n + 1):
            if i < n and words[i] == words[i - q]:
                start = i if start is None else start
            elif start is not None:
                length = i - start + q
                if length >= max(least, 2 * q):
                    found.setdefault((start - q, length), q)
                start = None
    return sorted((s, length, q) for (s, length), q in found.items())


def fibonacci(n):
    a, b = "0", "01"
    while len(b) < n:
        a, b = b, b + a
    return [int(c) for c in b[:n]]


@pytest.mark.parametrize("least", [12, 2])
def test_runs_against_brute_force(least):
    rng = np.random.default_rng(11)
    texts = [[], [3], [1] * 40, fibonacci(233), [0, 1] * 6 + [0] + [0, 1] * 6, ([0] * 9 + [1]) * 7, [int(bin(k).count("1") % 2) for k in range(128)]]
    for _ in range(400):
        words = rng.integers(0, rng.integers(1, 4) + 1, rng.integers(1, 30)).tolist()
        text = words * int(rng.integers(1, 6)) + rng.integers(0, 3, rng.integers(0, 12)).tolist()
        if rng.random() < .5:
            text[int(rng.integers(0, len(text)))] = 9
        texts.append(text + text[int(rng.integers(0, len(text))):])
    for text in texts:
        got = list(zip(*(x.tolist() for x in periodic.runs_of(np.array(text, np.int64), least)), strict=True))
        assert got == brute_runs(text, least), text


def test_long_texts_of_one_word_and_of_blocks():
    assert [x.tolist() for x in periodic.runs_of(np.zeros(300_000, np.int64))] == [[0], [300_000], [1]]
    start, length, period = periodic.runs_of(np.tile(np.arange(50_000) % 49_999, 4))
    assert (0, 200_000, 50_000) in set(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))


def collapse(words, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def test_edge_rows(spark):
    texts = [None, "", " \t\n", "a " * 20, "x\x0b" + "é b\xa0c\n" * 9 + "y", "one two three"]
    rows = [(k, t, "r", "c") for k, t in enumerate(texts)] + [(None, "z " * 14, None, None), (3, texts[3], "r", "c")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, collapsed string")
    got = {r["doc_id"]: r for r in periodic.periodic_runs(frame).collect()}
    assert frame.count() == periodic.periodic_runs(frame).count()
    for k, text in enumerate(texts):
        words = [w.decode() for w in (text or "").encode().split()]
        runs = brute_runs(words)
        assert [tuple(r) for r in got[k]["runs"]] == runs and got[k]["n_words"] == len(words)
        assert got[k]["collapsed"] == (None if text is None else collapse(words, runs))
    assert [tuple(r) for r in got[None]["runs"]] == [(0, 14, 1)]
    assert periodic.periodic_runs(frame.limit(0)).count() == 0


def test_planted_rows(spark):
    import zlib
    rows = [(k, " ".join(f"w{j}" for j in range(k % 90))) for k in range(300)] + [(None, None)]
    for r in queries.planted(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        text = dict(rows)[r["doc_id"]]
        h, words = zlib.crc32(str(r["doc_id"]).encode()), (text or "").split()
        n, g = len(words), h // 10
        if r["doc_id"] is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        assert (r["text"] or "").split() == words
