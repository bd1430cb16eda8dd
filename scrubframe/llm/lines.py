"""Near-duplicate lines: an exact set-similarity join with prefix, positional and length filters, and removal of later matches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubframe.llm.common import join_counted, maybe_in, stored
from scrubframe.llm.hashing import BUCKETS, chunks, commonness, joined, mix, word_hashes

PERCENT = 80
LIST_ROWS, KEPT = 20_000, 4
KEY = ["doc_id", "th"]
#: First lines of sets in a packed row, and the least number of postings in a bucket.
PACK, LEAST = 1 << 15, 1 << 17
#: Columns of a line: its place in the corpus (``some`` is 0 if doc_id is null), the size of its set and parity bits of its tokens.
#: A posting's list is four bytes of a token's hash (e) and the number of a cell.
LINE = {"some": "<i8", "doc_id": "<i8", "th": "<i8", "ln": "<i8", "n": "<i8", "bits": "<u8"}
FIRST = LINE | {"size": "<i8"}
POSTING = LINE | {"e": "<i8", "cell": "<i8", "pos": "<i8", "ask": "<i8"}
Rows = dict[str, np.ndarray]


def tokens(texts: list[str | None]) -> np.ndarray:
    return word_hashes(joined(texts)[0], True)[0]


def line_sets(texts: list[str | None], levels: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct tokens of all lines of the texts in order of text, line and rarity.

    Returns per token its line (numbered through) and hash, per line its text, its number in the text and where its tokens
    begin (with the end). Lines without tokens do not appear. Tokens are sorted by line, by the level of their counter (on a
    logarithmic scale, in ``levels``) and by hash: the same order in every line of the corpus.
    """
    data, starts = joined(texts)
    words, first, _ = word_hashes(data, True)
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    line = np.searchsorted(breaks, first)
    numbered, dense = np.unique(line, return_inverse=True)
    level = levels[(words & np.uint64(len(levels) - 1)).astype(np.int64)].astype(np.uint64)
    bits = np.uint64(max(1, int(len(numbered)).bit_length()))
    key = (dense.astype(np.uint64) << (np.uint64(64) - bits)) | (level << (np.uint64(56) - bits)) | (words >> (bits + np.uint64(8)))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    if (words[order[1:]][same] != words[order[:-1]][same]).any():
        order = np.lexsort((words, key))
    dense, words = dense[order], words[order]
    new = np.concatenate([[True], (dense[1:] != dense[:-1]) | (words[1:] != words[:-1])]) if len(words) else np.zeros(0, bool)
    dense, words = dense[new], words[new]
    begins = np.searchsorted(dense, np.arange(len(numbered) + 1))
    text = np.searchsorted(starts, np.concatenate([[0], breaks + 1])[numbered], "right") - 1
    first_line = np.searchsorted(breaks, starts[:-1])
    return dense, words, text, numbered - first_line[text], begins


def digests(words: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two signed 64-bit numbers per set of tokens: the halves of a BLAKE2 digest of its hashes, in the order of ``line_sets``."""
    data, at = words.tobytes(), (8 * begins).tolist()
    found = b"".join([hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(at, at[1:], strict=False)])
    both = np.frombuffer(found, "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def schema_of(kind: dict[str, str]) -> str:
    return "struct<count:bigint," + ",".join(f"{c}:binary" for c in kind) + ">"


def packed(rows: Rows, cuts: list[int]) -> pa.StructArray:
    """The rows from each of ``cuts`` to the next as one value: per column its numbers, as wide as the largest of all needs."""
    columns = [pa.array(np.diff(cuts), pa.int64())]
    for values in rows.values():
        top = int(values.max()) if int(values.min()) >= 0 else 1 << 63
        narrow = next((values.astype(kind) for kind, bits in (("u1", 8), ("<u2", 16), ("<u4", 32)) if top < 1 << bits), values) if top else np.zeros(0, "u1")
        columns.append(pa.array([narrow[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()))
    return pa.StructArray.from_arrays(columns, ["count", *rows])


def unpacked(values: pa.StructArray, kind: dict[str, str]) -> Iterator[Rows]:
    count, *columns = values.flatten()
    for number, *parts in zip(count.to_pylist(), *columns, strict=True):
        out = {}
        for (name, wide), part in zip(kind.items(), parts, strict=True):
            data = part.as_buffer()
            out[name] = np.frombuffer(data, {1: "u1", 2: "<u2", 4: "<u4", 8: wide}[data.size // number]).astype(wide) if data.size else np.zeros(number, wide)
        yield out


def taken(rows: Rows, at: np.ndarray) -> Rows:
    return {c: v[at] for c, v in rows.items()}


def together(parts: list[Rows]) -> Rows:
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def place_of(batch: pa.RecordBatch) -> Rows:
    ids = batch.column("doc_id")
    return {"some": ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), "doc_id": ids.fill_null(0).to_numpy(), "th": batch.column("th").to_numpy(),
            "ln": batch.column("ln").to_numpy()}


def ranks(rows: Rows) -> np.ndarray:
    """Numbers in the order of the lines by doc_id (null first), th and ln; equal for the same line."""
    base, most = int(rows["doc_id"].min()), int(rows["ln"].max()) + 1
    if not rows["th"].any() and rows["some"].all() and (int(rows["doc_id"].max()) - base + 1) * most < 1 << 62:
        return (rows["doc_id"] - base) * most + rows["ln"]
    place = [rows[c] for c in ("ln", "th", "doc_id", "some")]
    order = np.lexsort(place)
    out = np.empty(len(order), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(np.any([c[order[1:]] != c[order[:-1]] for c in place], axis=0))])
    return out


def keys(rows: Rows, at: np.ndarray) -> list[pa.Array]:
    """The columns of ``KEY`` and ln of some rows."""
    return [pa.array(rows["doc_id"][at], mask=rows["some"][at] == 0), pa.array(rows["th"][at]), pa.array(rows["ln"][at])]


def describe(docs: DataFrame, common: np.ndarray, percent: int, list_rows: int) -> DataFrame:
    """One row per line with tokens: doc_id, th, ln and ``copy``, true if an earlier line of the same chunk has the same set.

    For the others also the set's signatures a and b, its size n, parity bits, the rarest tokens (prefix, four bytes of each
    hash) and those of them that may be in long lists. Sets so small that only an equal one is similar (at best n of n + 1
    tokens are shared) have no prefix: their signatures are enough."""
    levels = np.minimum(8 * np.log2(common.astype(np.float64) + 1), 255).astype(np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast((levels, np.flatnonzero(common > list_rows)))
    names = ["doc_id", "th", "ln", "copy", "a", "b", "n", "bits", "prefix", "frequent"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, many = shared.value
        often = np.zeros(len(levels), bool)
        often[many] = True
        for batch in batches:
            ids, hashes = batch.column("doc_id"), batch.column("th")
            for low, texts in chunks(batch.column("text").to_pylist()):
                dense, words, text, ln, begins = line_sets(texts, levels)
                n = np.diff(begins)
                if not len(n):
                    continue
                a, b = digests(words, begins)
                parity = np.bitwise_xor.reduceat(np.uint64(1) << (words >> np.uint64(58)), begins[:-1]).view(np.int64)
                rows = pa.array(low + text)
                id_, th = ids.take(rows), hashes.take(rows)
                some, number = id_.is_valid().to_numpy(zero_copy_only=False), id_.fill_null(0).to_numpy()
                place = [ln, th.to_numpy(), number, some]
                order = np.lexsort((*place, b, a))
                head = np.concatenate([[True], (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])])
                first = np.empty(len(n), np.int64)
                first[order] = order[np.maximum.accumulate(np.where(head, np.arange(len(n)), 0))]
                fresh = first == np.arange(len(n))
                copy = np.any([c != c[first] for c in place], axis=0)
                take = np.where(fresh & (100 * n >= percent * (n + 1)), n - -(-percent * n // 100) + 1, 0)
                chosen = np.arange(len(words)) - begins[dense] < take[dense]
                prefix, of = (words[chosen] >> np.uint64(32)).astype("<u4"), dense[chosen]
                hot = often[(words[chosen] & np.uint64(len(often) - 1)).astype(np.int64)]
                lists = [pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], 4 * np.cumsum(np.bincount(o, minlength=len(n)))]).astype("<i4")),
                                                                     pa.py_buffer(p.tobytes())]) for p, o in ((prefix, of), (prefix[hot], of[hot]))]
                told = pa.RecordBatch.from_arrays([id_, th, pa.array(ln), pa.array(copy), *(pa.array(c, mask=copy) for c in (a, b, n, parity)), *lists], names)
                yield told.filter(pa.array(fresh | copy))

    schema = "doc_id bigint, th bigint, ln bigint, copy boolean, a bigint, b bigint, n bigint, bits bigint, prefix binary, frequent binary"
    return docs.mapInArrow(run, schema)


def line_groups(lines: DataFrame) -> DataFrame:
    """Lines of equal sets meet. Rows with doc_id, th and ln are the lines that have an earlier line with the same set; the first
    lines of sets with a prefix are packed, many in a row: ``lines``, the tokens of their prefixes, the number of ``postings``,
    and how often tokens that may be in long lists occur (hot, many)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "th", "ln", "lines", "prefix", "postings", "hot", "many"]
        held: list[tuple[Rows, bytes, bytes]] = []
        last: tuple | None = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                rows, prefix, frequent = together([h[0] for h in held]), b"".join(h[1] for h in held), b"".join(h[2] for h in held)
                hot, many = np.unique(np.frombuffer(frequent, "<u4").astype(np.int64), return_counts=True)
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, packed(rows, [0, len(rows["n"])]), pa.array([prefix], pa.binary()), pa.array([len(prefix) // 4]),
                                                  pa.array([hot.tolist()], pa.list_(pa.int64())), pa.array([many.tolist()], pa.list_(pa.int64()))], names)
                held.clear()

        def joined_of(values: pa.Array) -> bytes:
            return b"".join(values.to_pylist())

        for batch in batches:
            if not batch.num_rows:
                continue
            copy = batch.column("copy").to_numpy(zero_copy_only=False)
            a, b, n, bits = (batch.column(c).fill_null(0).to_numpy() for c in ("a", "b", "n", "bits"))
            rows = place_of(batch)
            place = np.stack(list(rows.values()))
            head = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | copy[1:] | copy[:-1]])
            first = place[:, np.maximum.accumulate(np.where(head, np.arange(len(n)), 0))]
            if last is not None and not copy[0] and (a[0], b[0]) == last[:2]:
                end = int(np.flatnonzero(np.append(head[1:], True))[0]) + 1
                first[:, :end], head[0] = last[2], False
            if not copy[-1]:
                last = a[-1], b[-1], first[:, -1:].copy()
            gone = copy | (~head & (place != first).any(axis=0))
            if gone.any():
                at = pa.array(gone)
                kinds = [pa.struct({"count": pa.int64()} | dict.fromkeys(FIRST, pa.binary())), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(at) for c in names[:3]), *(pa.nulls(int(gone.sum()), t) for t in kinds)], names)
            prefix, frequent = batch.column("prefix"), batch.column("frequent")
            size = pc.binary_length(prefix).to_numpy().astype(np.int64) // 4
            stay = head & ~copy & (size > 0)
            if stay.any():
                at = pa.array(stay)
                some = pa.array(stay & (pc.binary_length(frequent).to_numpy() > 0))
                held.append((taken(rows | {"n": n, "bits": bits.view(np.uint64), "size": size}, stay), joined_of(prefix.filter(at)), joined_of(frequent.filter(some))))
                if sum(len(h[0]["n"]) for h in held) >= PACK or sum(len(h[1]) for h in held) >= 32 * PACK:
                    yield from flush()
        yield from flush()

    # Copies within a chunk need no partner; they are dealt out by their place.
    dealt = lines.withColumn("deal", F.when(F.col("copy"), F.xxhash64(*KEY, "ln")).otherwise(F.col("a"))).repartition("deal").sortWithinPartitions("a", "b", *KEY, "ln").drop("deal")
    return dealt.mapInArrow(run, f"doc_id bigint, th bigint, ln bigint, lines {schema_of(FIRST)}, prefix binary, postings bigint, hot array<bigint>, many array<bigint>")


def lists_of(rows: Rows) -> np.ndarray:
    return (rows["e"].astype(np.uint64) << np.uint64(32)) | rows["cell"].astype(np.uint64)


def spots(lists: np.ndarray) -> np.ndarray:
    return (mix(lists) >> np.uint64(39)).astype(np.int64)


def by_bucket(rows: Rows, buckets: int) -> pa.RecordBatch:
    """Postings packed by bucket, in order of their tokens."""
    bucket = mix(lists_of(rows)) % np.uint64(buckets)
    order = np.argsort((bucket << np.uint64(32)) | rows["e"].astype(np.uint64))
    rows, bucket = taken(rows, order), bucket[order]
    cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]]).tolist()
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int64)), packed(rows, cuts)], ["bucket", "rows"])


def postings_of(sets: DataFrame, hot: tuple[np.ndarray, np.ndarray], buckets: int, asked: np.ndarray | None = None) -> DataFrame:
    """One posting per set and prefix token, packed by bucket. A token in more sets than a list may hold (``hot``: tokens, numbers
    of parts) is dealt into cells: its sets into parts, and each pair of parts is a cell, so that no list is longer than two
    parts and every two sets still meet. ``asked`` is a bit map of lists that are wanted."""
    shared = sets.sparkSession.sparkContext.broadcast((*hot, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_, parts, wanted = shared.value

        def made(lines: Rows, e: np.ndarray) -> Rows:
            size = lines["size"]
            owner, begin = np.repeat(np.arange(len(size)), size), np.repeat(np.cumsum(size) - size, size)
            # Parity of the tokens from this one on: a token's bit is the top of its hash.
            before = np.concatenate([[np.uint64(0)], np.bitwise_xor.accumulate(np.uint64(1) << (e >> np.uint32(26)).astype(np.uint64))])
            rows = {"owner": owner, "e": e.astype(np.int64), "cell": np.zeros(len(e), np.int64), "pos": np.arange(len(e)) - begin,
                    "bits": lines["bits"][owner] ^ before[:-1] ^ before[begin]}
            if len(hot_):
                at = np.minimum(np.searchsorted(hot_, rows["e"]), len(hot_) - 1)
                k = np.where(hot_[at] == rows["e"], parts[at], 1)
                row = np.repeat(np.arange(len(e)), k)
                other = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
                place = mix(mix(lines["doc_id"].view(np.uint64) ^ mix(lines["th"].view(np.uint64))) + lines["ln"].astype(np.uint64))
                rows, k = taken(rows, row), k[row]
                part = (place[rows["owner"]] % k.astype(np.uint64)).astype(np.int64)
                rows["cell"] = np.minimum(part, other) * k + np.maximum(part, other)
            if wanted is not None:
                spot = spots(lists_of(rows))
                rows = taken(rows, (wanted[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1)
            owner = rows.pop("owner")
            return {c: rows[c] if c in rows else lines[c][owner] if c in lines else np.zeros(len(owner), np.int64) for c in POSTING}

        held: list[Rows] = []
        for batch in batches:
            for lines, prefix in zip(unpacked(batch.column("lines"), FIRST), batch.column("prefix"), strict=True):
                rows = made(lines, np.frombuffer(prefix.as_buffer(), "<u4"))
                held += [rows] if len(rows["n"]) else []
                if sum(len(h["n"]) for h in held) >= 2 * LEAST:
                    yield by_bucket(together(held), buckets)
                    held = []
        if held:
            yield by_bucket(together(held), buckets)

    return sets.select("lines", "prefix").mapInArrow(run, f"bucket bigint, rows {schema_of(POSTING)}")


def asking(open_: DataFrame, buckets: int) -> DataFrame:
    """Postings of lines that ask their list again, packed by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = place_of(batch) | {c: batch.column(c).to_numpy() for c in ("n", "pos", "e", "cell")}
                rows |= {"bits": batch.column("bits").to_numpy().view(np.uint64), "ask": np.ones(batch.num_rows, np.int64)}
                yield by_bucket({c: rows[c] for c in POSTING}, buckets)

    return open_.select("y.*", "n", "pos", "bits", "e", "cell").mapInArrow(run, f"bucket bigint, rows {schema_of(POSTING)}")


def candidates(rows: Rows, rank: np.ndarray, lists: np.ndarray, percent: int, kept: int, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the postings, pairs (x earlier, y later) of one list that pass the filters, as row numbers, with a score that is higher
    the fewer tokens must differ; for each posting y the ``kept`` best, and the postings y that have more. With ``kept`` 0
    all, of the postings that ask. ``rows`` are in order of list and n.

    In the list of the first token that two sets share, all tokens before it differ and so do at least as many after it as
    parity bits. A pair that fails this in the list of a later token is found in that of the first."""
    n, pos, bits, ask = rows["n"], rows["pos"], rows["bits"], rows["ask"] > 0
    group = np.concatenate([[0], np.cumsum(lists[1:] != lists[:-1])])
    span = int(n.max()) + 1
    where = group * span + n
    low = np.searchsorted(where, group * span + -(-percent * n // 100))
    high = np.arange(len(n)) if kept else np.searchsorted(where, group * span + np.minimum(100 * n // max(percent, 1), span - 1), "right")
    width = np.maximum(high - low, 0) if kept else np.where(ask, high - low, 0)
    total = np.concatenate([[0], np.cumsum(width)])
    more = np.zeros(len(n), bool)
    held: list[np.ndarray] = []

    def best(found: list[np.ndarray]) -> np.ndarray:
        all_ = np.concatenate([np.zeros((3, 0), np.int64), *found], axis=1)
        if not kept:
            return all_
        all_ = all_[:, np.lexsort((rank[all_[0]], -all_[2], all_[1]))]
        number = np.arange(all_.shape[1]) - np.searchsorted(all_[1], all_[1])
        more[all_[1][number >= kept]] = True
        return all_[:, number < kept]

    first = 0
    while first < len(n):
        last = max(first + 1, int(np.searchsorted(total, total[first] + most, "right")) - 1)
        w = width[first:last]
        y = np.repeat(np.arange(first, last), w)
        x = low[y] + np.arange(len(y)) - np.repeat(total[first:last] - total[first], w)
        both = n[y] + n[x]
        need = -(-percent * both // (100 + percent))
        good = (np.minimum(n[y] - pos[y], n[x] - pos[x]) >= need) & ((rank[x] != rank[y]) if kept else (rank[x] < rank[y]) & ~ask[x])
        x, y, slack = x[good], y[good], (both - 2 * need)[good]
        score = slack - pos[x] - pos[y] - np.bitwise_count(bits[y] ^ bits[x])
        good = score >= 0
        x, y, score = x[good], y[good], score[good]
        turn = rank[x] > rank[y]
        held.append(np.stack([np.where(turn, y, x), np.where(turn, x, y), score]))
        if sum(h.shape[1] for h in held) > most and kept:
            held = [best(held)]
        first = last
    x, y, score = best(held)
    return x, y, score, np.flatnonzero(more)


def pairs_of(postings: DataFrame, buckets: int, percent: int, kept: int) -> DataFrame:
    """Candidate pairs (x earlier, y later) of all lists with a score; rows without x tell a posting y with more candidates than kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(held: list[Rows]) -> Iterator[pa.RecordBatch]:
            rows = together(held)
            of = lists_of(rows)
            order = np.lexsort((rows["n"], of)) if rows["cell"].any() else np.argsort(of | rows["n"].astype(np.uint64))
            rows, of = taken(rows, order), of[order]
            rank = ranks(rows)
            x, y, score, more = candidates(rows, rank, of, percent, kept)
            if len(x):
                order = np.lexsort((rank[x], rank[y]))
                x, y, score = x[order], y[order], score[order]
                new = np.concatenate([[True], (rank[x[1:]] != rank[x[:-1]]) | (rank[y[1:]] != rank[y[:-1]])])
                x, y, score = x[new], y[new], score[new]
            pair = np.arange(len(x) + len(more)) < len(x)
            y, names = np.concatenate([y, more]), [*KEY, "ln"]
            left = pa.StructArray.from_arrays(keys(rows, np.concatenate([x, more])), names, mask=pa.array(~pair))
            facts = [pa.array(rows[c][y].view(np.int64), mask=pair) for c in ("n", "pos", "bits", "e", "cell")]
            yield pa.RecordBatch.from_arrays([left, pa.StructArray.from_arrays(keys(rows, y), names), pa.array(np.concatenate([score, 0 * more])), *facts,
                                              pa.array(spots(of[y]), mask=pair)], ["x", "y", "score", "n", "pos", "bits", "e", "cell", "spot"])

        held: list[Rows] = []
        open_ = None
        for batch in batches:
            for bucket, rows in zip(batch.column("bucket").to_pylist(), unpacked(batch.column("rows"), POSTING), strict=True):
                if held and bucket != open_:
                    yield from lists(held)
                    held = []
                open_ = bucket
                held.append(rows)
        if held:
            yield from lists(held)

    line = "struct<doc_id:bigint,th:bigint,ln:bigint>"
    return postings.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(
        run, f"x {line}, y {line}, score bigint, n bigint, pos bigint, bits bigint, e bigint, cell bigint, spot bigint")


def line_texts(docs: DataFrame, wanted: DataFrame, repeats: bool) -> DataFrame:
    """Text of the wanted lines (key: doc_id, th, ln) as (key, line)."""
    wanted = stored(wanted.distinct(), "wanted-lines")
    docs = maybe_in(docs, wanted.select("key.*"), KEY).where("_maybe")
    rows = docs.select(*KEY, F.posexplode(F.split("text", "\n", -1)).alias("ln", "line")).withColumn("ln", F.col("ln").cast("bigint"))
    rows = maybe_in(rows, wanted.select("key.*"), [*KEY, "ln"]).where("_maybe")
    rows = rows.select(F.struct(*KEY, "ln").alias("key"), "line").join(wanted, "key", "left_semi")
    # Rows that repeat a document give the same lines again; one of each is enough.
    return rows.dropDuplicates(["key"]) if repeats else rows


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, repeats: bool) -> DataFrame:
    """The later lines y of pairs (x, y) whose token sets are similar."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for p, q in zip(*(batch.column(c).to_pylist() for c in ("text_x", "text_y")), strict=True):
                s, t = (set(v.encode("utf-8", "surrogatepass").lower().split()) for v in (p, q))
                overlap = len(s & t)
                good.append(100 * overlap >= percent * (len(s) + len(t) - overlap))
            yield pa.RecordBatch.from_arrays([batch.column("y").filter(pa.array(good, pa.bool_()))], ["y"])

    texts = stored(line_texts(docs, pairs.select(F.col("x").alias("key")).union(pairs.select("y")), repeats), "line-texts")
    often = pairs.groupBy("x").agg(F.count(F.lit(1)).alias("many"))
    left = often.join(texts.select(F.col("key").alias("x"), F.col("line").alias("text_x")), "x")
    both = join_counted(pairs.join(texts.select(F.col("key").alias("y"), F.col("line").alias("text_y")), "y"), stored(left, "left-lines"), "x", "many")
    return both.select("y", "text_x", "text_y").mapInArrow(run, "y struct<doc_id:bigint,th:bigint,ln:bigint>").distinct()


def bits_of(open_: DataFrame) -> np.ndarray:
    """A bit map of fixed size (at most 1024 rows of 4 kB) of the lists that open lines ask again."""
    out = np.zeros((1024, 4096), np.uint8)
    marks = open_.groupBy(F.floor(F.col("spot") / 32768).alias("part")).agg(F.bitmap_construct_agg(F.col("spot") % 32768).alias("bits"))
    for row in marks.collect():
        out[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def later_lines(docs: DataFrame, percent: int = PERCENT, buckets: int = BUCKETS, list_rows: int = LIST_ROWS,
                kept: int = KEPT, repeats: bool = True) -> DataFrame:
    """The lines to remove, as (doc_id, th, removed: sorted line numbers from 0); ``docs`` has doc_id, th and text, and doc_id and
    th of a row only once if ``repeats`` is false."""
    common = commonness(docs, tokens, buckets)
    groups = stored(line_groups(describe(docs, common, percent, list_rows)), "line-groups")
    sets = groups.where("lines is not null")
    # At most (number of postings) / list_rows tokens, each with a small number.
    long = sets.select(F.explode(F.arrays_zip("hot", "many")).alias("s")).groupBy("s.hot").agg(F.sum("s.many").alias("many")).where(F.col("many") > list_rows).orderBy("hot").collect()
    hot = np.array([r["hot"] for r in long], np.int64), np.array([-(-r["many"] // list_rows) for r in long], np.int64)
    total = sets.agg(F.sum("postings")).first()[0] or 0
    parts = max(1, min(total // LEAST, 256), total // (4 * LEAST))
    found = stored(pairs_of(postings_of(sets, hot, parts), parts, percent, kept), "candidates")
    pairs = found.where("x is not null")
    best = stored(pairs.groupBy("y").agg(F.max(F.struct("score", "x")).alias("top")).select("top.x", "y"), "best")
    similar = stored(confirmed(best, docs, percent, repeats), "similar")
    rest = pairs.join(similar, "y", "left_anti").select("x", "y")
    open_ = stored(found.where("x is null").join(similar, "y", "left_anti"), "open")
    if not open_.isEmpty():
        # Only lists in which an open line has more candidates than were kept.
        again = postings_of(sets, hot, parts, bits_of(open_)).union(asking(open_, parts))
        rest = rest.union(pairs_of(again, parts, percent, 0).select("x", "y"))
    rest = stored(rest.distinct().join(best, ["x", "y"], "left_anti"), "more-candidates")
    if not rest.isEmpty():
        similar = similar.union(confirmed(rest, docs, percent, repeats))
    gone = groups.where("lines is null").select(*KEY, "ln").union(similar.select("y.*"))
    return gone.groupBy(*KEY).agg(F.array_sort(F.collect_set("ln")).alias("removed"))


def deduplicated(docs: DataFrame, percent: int = PERCENT, buckets: int = BUCKETS, list_rows: int = LIST_ROWS,
                 kept: int = KEPT, keep: list[str] | None = None) -> DataFrame:
    """Remove every line that is similar to an earlier line of the corpus; adds n_lines and removed (line numbers).

    Lines end at line breaks. A line's set is its distinct words (runs without ASCII white space, A-Z lower-cased). A line is
    removed when an earlier line, removed or not, has 100 * intersection >= ``percent`` * union; only lines
    without words stay in any case. Earlier means less by doc_id (null first), then by a hash of the text,
    then by line number. Rows that agree in doc_id and text are one document and are treated alike, so they all keep the
    same lines. Null text stays null with no line; other columns come along (``keep`` limits them), and columns called
    n_lines or removed are replaced. An empty table gives no rows.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_lines", "removed", "text")]
    # Where no doc_id repeats it names its text, and the hash is not needed.
    repeats = not docs.groupBy(F.col("doc_id").cast("bigint")).count().where("count > 1").isEmpty()
    th = F.xxhash64("text") if repeats else F.lit(0).cast("bigint")
    rows = docs.select(*keep, "text", F.col("doc_id").cast("bigint").alias("_id"), th.alias("_th"))
    gone = later_lines(docs.select(F.col("doc_id").cast("bigint"), th.alias("th"), "text").where("text is not null"), percent, buckets, list_rows, kept,
                       repeats)
    gone = stored(gone.withColumnsRenamed({"doc_id": "_id", "th": "_th"}), "removed")
    marked = maybe_in(rows, gone, ["_id", "_th"])
    rows = marked.where("_maybe")
    found = rows.join(gone, rows["_id"].eqNullSafe(gone["_id"]) & (rows["_th"] == gone["_th"]), "left").select(*[rows[c] for c in keep], rows["text"], "removed")
    count = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("bigint")
    whole = marked.where("not _maybe").select(*keep, "text", count.alias("n_lines"), F.array().cast("array<bigint>").alias("removed"))
    schema = T.StructType([*found.schema.fields[:-2], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()),
                           T.StructField("removed", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, lists = [], [], []
            for text, removed in zip(batch.column("text").to_pylist(), batch.column("removed").to_pylist(), strict=True):
                lines = [] if text is None else text.split("\n")
                drop = set(removed or ())
                texts.append(text if not drop else "\n".join(line for k, line in enumerate(lines) if k not in drop))
                counts.append(len(lines))
                lists.append(removed or [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(lists, pa.list_(pa.int64()))],
                                             [f.name for f in schema])

    return found.mapInArrow(run, schema).unionByName(whole)
