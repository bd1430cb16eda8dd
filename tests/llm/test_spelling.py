"""Spelling variants against brute force."""

import zlib

import numpy as np
import pytest

from scrubframe.llm import queries, spelling


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return len(b) == len(a) + 1 and b[:k] + b[k + 1:] == a


def brute(counts, least=2, ratio=10):
    words = {w: n for w, n in counts.items() if n >= least}
    near = {w: [v for v in words if distance_one(w, v)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if words[v] >= ratio * words[w]}
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), words.get(form.get(w)))
    return out


def check(spark, counts, **limits):
    rows = [(w, "x", 1) for w, n in counts.items() for _ in range(n)] + [(None, None, None), ("", "x", 1), ("", "x", 1)]
    frame = spark.createDataFrame(rows, "word string, form string, n int").repartition(5)
    got = spelling.variants(frame, **limits).collect()
    want = brute(counts, limits.get("least_count", 2), limits.get("ratio", 10))
    assert len(got) == len(want) and {r["word"]: tuple(r)[1:] for r in got} == want


@pytest.mark.parametrize("limits", [{}, {"per_block": 1, "pass_blocks": 60}, {"per_block": 1 << 20}, {"ratio": 2, "least_count": 1}])
def test_variants_against_brute_force(spark, limits):
    rng = np.random.default_rng(4)
    counts = {"aaaaaaa": 300, "aaaaaaab": 30, "aaaaaabb": 3, "aaaaaabc": 1, "zzzzzzz": 2, "ÀÉéÿöüß": 25, "ÀÉéÿöü": 2, "tie_one": 40, "tie_two": 40, "tie_tno": 3}
    for _ in range(250):
        counts["".join(rng.choice(list("abé"), rng.integers(5, 9)))] = int(rng.choice([1, 2, 3, 20, 200]))
    long = "ab" * 200
    counts |= {long: 25, long[:-1]: 2, long + "c": 2, "b" + long[1:]: 2, long[:63]: 30, long[:64]: 3, long[:65]: 2, long[:62] + "z": 2, long[:64] + "z": 2}
    check(spark, counts, **limits)


def test_very_long_word_and_empty_table(spark):
    long = "qwertz" * 20_000
    check(spark, {long: 20, long[:-1]: 2, "x" + long[1:]: 2})
    assert spelling.variants(spark.createDataFrame([], "word string")).count() == 0


def test_runs_and_planted_rows(spark):
    texts = [(1, "Straßenbahn STRASSENBAHN short ÄRGERNISSE x" + "y" * 30), (2, None), (3, ""), (None, "wordwithoutid 1234567 abcdefg")]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = sorted((str(r["doc_id"]), r["word"]) for r in spelling.runs(frame).collect())
    assert got == sorted([("1", "straßenbahn"), ("1", "strassenbahn"), ("1", "ÄrgernisseÄ"[:-1]), ("1", "x" + "y" * 30), ("None", "wordwithoutid"), ("None", "abcdefg")])
    rows = [(k, f"wörter{chr(97 + k % 26)}") for k in range(500)]
    want = []
    for k, w in rows:
        h = zlib.crc32(f"{k}:{w}".encode())
        want.append(w if h % 31 else w[:h % len(w)] + w[h % len(w) + 1:])
    got = [r["word"] for r in queries.misspelt(spark.createDataFrame(rows, "doc_id bigint, word string")).collect()]
    assert sorted(got) == sorted(w for w in want if len(w) >= 7) and len(got) < 500


def test_filters_have_no_false_negatives():
    words = ["a" * k for k in range(1, 90)] + ["bcd" * k for k in range(1, 40)]
    counts = {}
    for w in words:
        counts[min(len(w), spelling.SHARDS)] = counts.get(min(len(w), spelling.SHARDS), 0) + 1
    layout = spelling.Layout.of(counts)
    key, length = spelling.keys(words), np.array([len(w) for w in words])
    data = np.zeros(int(layout.blocks.sum()), np.uint64)
    np.bitwise_or.at(data, layout.block(key, length), spelling.bits(key))
    assert len(spelling.Filters(layout, 0, data).may_hold(key, length)) == len(words)
