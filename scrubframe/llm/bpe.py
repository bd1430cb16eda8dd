"""BPE: distinct words go into a trie whose nodes hold the last token of the path to them; shared prefixes are encoded once."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

CHUNK_BYTES = 1 << 20
PIECES, NODES = 1 << 20, 1 << 20
GROUP = 200
#: White space as the library's patterns see it: without the separators 1C to 1F.
SPACE = re.compile(r"[^\S\x1c-\x1f]+")


def _sizes(table: dict[str, int]) -> dict[str, tuple[int, ...]]:
    """Lengths of the tokens that may end a text, by its last three symbols (or the last two), the longest first."""
    found: dict[str, set[int]] = {}
    for word in table:
        if len(word) > 1:
            found.setdefault(word[-3:], {1}).add(len(word))
    for tail, sizes in found.items():
        if tail[1:] in found:
            sizes.add(2)
    return {tail: tuple(sorted(sizes, reverse=True)) for tail, sizes in found.items()}


class Merges:
    """The merge rules: for two tokens, whether BPE ever joins the end of one with the start of the other."""

    def __init__(self, model: dict) -> None:
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        size = max(self.vocab.values()) + 1
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.pairs: dict[tuple[int, int], int] = {}
        usable = [True] * size
        for rank, rule in enumerate(model["merges"]):
            a, b = rule if isinstance(rule, list) else rule.split(" ")
            x, y, both = self.vocab[a], self.vocab[b], self.vocab[a + b]
            if self.rank[both] >= 0 or (x, y) in self.pairs:
                raise ValueError(f"token {a + b!r} has two merges")
            if any(self.rank[z] < 0 and z not in self._symbols() for z in (x, y)):
                raise ValueError(f"token {a + b!r} is merged before its parts")
            self.pairs[x, y], self.rank[both], self.left[both], self.right[both] = rank, rank, x, y
        for token in sorted((t for t in self.vocab.values() if self.rank[t] >= 0), key=self.rank.__getitem__):
            x, y = self.left[token], self.right[token]
            usable[token] = usable[x] and usable[y] and self.apart(x, y, self.rank[token])
        #: Tokens that BPE gives for their own text; no other can be the last one of an encoding.
        self.plain = {w: t for w, t in self.vocab.items() if usable[t] and not (self.suffix and w.endswith(self.suffix))}
        self.final = {w[:-len(self.suffix)]: t for w, t in self.vocab.items() if usable[t] and w.endswith(self.suffix)} if self.suffix else self.plain
        self.plain_sizes, self.final_sizes = _sizes(self.plain), _sizes(self.final)
        self.size = size
        self.known: dict[int, bool] = {}

    def _symbols(self) -> frozenset[int]:
        if not hasattr(self, "_base"):
            self._base = frozenset(t for w, t in self.vocab.items() if len(w) == 1 or self.suffix and len(w) == 1 + len(self.suffix) and w.endswith(self.suffix))
        return self._base

    def apart(self, u: int, t: int, limit: int | None = None) -> bool:
        """Whether no merge before rank ``limit`` joins the end of ``u`` with the start of ``t``.

        The merges are undone from the last one back. A rule makes its token later than both parts, so the one of higher
        rank was made last, of two equal ones the right one. What then met at the border was merged if its rule is earlier.
        """
        rank, before = self.rank, len(self.pairs) if limit is None else limit
        while True:
            if self.pairs.get((u, t), before) < before:
                return False
            if rank[t] >= rank[u]:
                if rank[t] < 0:
                    return True
                before, t = rank[t] + 1, self.left[t]
            else:
                before, u = rank[u], self.right[u]


class Trie:
    """Words by their symbols. A node knows the last token of the encoding of its path and the node before that token."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.child: dict[int, int] = {}
        self.last, self.back = array("q", [-1]), array("q", [0])
        self.known: dict[str, bytes] = {}

    def _state(self, word: str, depth: int, path: list[int], table: dict[str, int], sizes: dict[str, tuple[int, ...]]) -> tuple[int, int]:
        """The last token of the first ``depth`` symbols and the node before it: exactly one token is apart from its predecessor."""
        merges, tail = self.merges, word[depth - 3:depth] if depth > 2 else word[:depth]
        for length in sizes.get(tail) or sizes.get(tail[1:]) or (1,):
            token = table.get(word[depth - length:depth]) if length <= depth else None
            if token is not None:
                node = path[depth - length]
                if not node:
                    return token, node
                pair = self.last[node] * merges.size + token
                follows = merges.known.get(pair)
                if follows is None:
                    follows = merges.known[pair] = merges.apart(self.last[node], token)
                if follows:
                    return token, node
        raise ValueError(f"no token for symbol {word[depth - 1]!r}")

    def encode(self, words: Iterable[str]) -> None:
        """Put the token ids of new distinct words into ``known``. Words come in order, so nodes are made and given their
        state depth first."""
        child, merges = self.child, self.merges
        if len(merges.known) > NODES:
            merges.known.clear()
        for word in sorted(words):
            path, node = [0], 0
            for depth, symbol in enumerate(word[:-1], 1):
                edge = node << 21 | ord(symbol)
                node = child.get(edge)
                if node is None:
                    token, before = self._state(word, depth, path, merges.plain, merges.plain_sizes)
                    node = child[edge] = len(self.last)
                    self.last.append(token)
                    self.back.append(before)
                path.append(node)
            token, node = self._state(word, len(word), path, merges.final, merges.final_sizes)
            ids = [token]
            while node:
                ids.append(self.last[node])
                node = self.back[node]
            self.known[word] = array("I", reversed(ids)).tobytes()


class Codec:
    """A tokenizer file (its JSON text): the library's normalizer and word splitter, merges by the trie, and the way back.

    Encodings of distinct pieces between ASCII white space are remembered up to ``PIECES``, trie nodes up to ``NODES``;
    beyond that both start anew, which changes no result.
    """

    def __init__(self, text: str) -> None:
        spec, tokenizer = json.loads(text), Tokenizer.from_str(text)
        model = spec["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("only plain BPE files are supported")
        if spec["decoder"] is not None or spec["post_processor"] is not None:
            raise ValueError("only files without decoder and post-processor are supported")
        self.normal, self.splitter = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.merges = Merges(model)
        self.special = {}
        for added in spec["added_tokens"]:
            if added["normalized"] or added["lstrip"] or added["rstrip"] or added["single_word"] or re.search(r"\s", added["content"]):
                raise ValueError(f"unsupported added token {added['content']!r}")
            self.special[added["content"]] = added["id"]
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.special else None
        strings = {t: w for w, t in [*self.merges.vocab.items(), *self.special.items()]}
        self.strings = pa.array([strings.get(k) for k in range(max(strings) + 1)], pa.string())
        self._forget()

    def _forget(self) -> None:
        self.trie = Trie(self.merges)
        self.pieces: dict[bytes, int] = {}
        self.flat, self.begins = bytearray(), array("q", [0])

    def _words(self, pieces: list[str]) -> list[list[str]]:
        """Words of pieces without white space, as the library splits them."""
        out = []
        for low in range(0, len(pieces), GROUP):
            group = pieces[low:low + GROUP]
            normal = self.normal.normalize_str(" ".join(group))
            ends = [i for i, c in enumerate(normal) if c == " "] + [len(normal)]
            if len(ends) != len(group):
                raise ValueError("the normalizer does not keep single spaces")
            found: list[list[str]] = [[] for _ in group]
            k = 0
            for word, (start, _) in self.splitter.pre_tokenize_str(normal):
                while start >= ends[k]:
                    k += 1
                found[k].append(word)
            out += found
        return out

    def _learn(self, pieces: list[bytes]) -> None:
        """Remember the encodings of new pieces."""
        parts: list[list[str | int]] = []
        texts, places = [], []
        for piece in pieces:
            if piece.isalpha():
                # ASCII letters only: nothing to normalize but capitals, and one word.
                parts.append([piece.lower().decode()])
                continue
            text = piece.decode()
            if self.cut is not None and self.cut.search(text):
                mixed: list[str | int] = []
                for part in self.cut.split(text):
                    if part in self.special:
                        mixed.append(self.special[part])
                    else:
                        mixed += [w for ws in self._words(list(filter(None, SPACE.split(part)))) for w in ws]
                parts.append(mixed)
                continue
            subs = [text] if text.isascii() else list(filter(None, SPACE.split(text)))
            texts += subs
            places += [len(parts)] * len(subs)
            parts.append([])
        for k, words in zip(places, self._words(texts), strict=True):
            parts[k] += words
        known = self.trie.known
        self.trie.encode({w for part in parts for w in part if not isinstance(w, int) and w not in known})
        for piece, part in zip(pieces, parts, strict=True):
            for w in part:
                self.flat += known[w] if not isinstance(w, int) else w.to_bytes(4, "little")
            self.pieces[piece] = len(self.begins) - 1
            self.begins.append(len(self.flat) // 4)

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in a row, and where each text begins (with the end)."""
        split = [(t or b"").split() for t in texts]
        n = np.array([len(s) for s in split], np.int64)
        coded = pa.array([p for s in split for p in s], pa.binary()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.pieces) > PIECES or len(self.trie.last) > NODES or len(self.flat) > 64 * PIECES:
            self._forget()
        self._learn([p for p in distinct if p not in self.pieces])
        flat, begins = np.frombuffer(self.flat, "<u4"), np.array(self.begins)
        which = np.array([self.pieces[p] for p in distinct], np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if distinct else np.zeros(0, np.int64)
        sizes = begins[which + 1] - begins[which]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat[np.repeat(begins[which] - ends[:-1], sizes) + np.arange(int(ends[-1]))]
        return ids, ends[np.concatenate([[0], np.cumsum(n)])]

    def decode(self, ids: np.ndarray, begins: np.ndarray) -> pa.Array:
        """The tokens' strings, joined by spaces; numbers that are no token are left out."""
        token = pa.array(ids).cast(pa.int64())
        known = pc.fill_null(pc.less(token, len(self.strings)), False)
        strings = self.strings.take(pc.if_else(known, token, 0))
        good = (known.to_numpy(zero_copy_only=False)) & strings.is_valid().to_numpy(zero_copy_only=False)
        if not good.all():
            strings = strings.filter(pa.array(good))
            begins = np.concatenate([[0], np.cumsum(good)])[begins]
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(begins, pa.int32()), strings), " ")


_CODECS: dict[int, tuple[str, Codec]] = {}


def codec(text: str) -> Codec:
    """The codec of a tokenizer file, made once per worker process."""
    found = _CODECS.get(hash(text))
    if found is None or found[0] != text:
        _CODECS.clear()
        found = _CODECS[hash(text)] = (text, Codec(text))
    return found[1]


def _file(docs: DataFrame, path: str):
    """The tokenizer file, broadcast: a vocabulary of fixed size, read by the driver alone."""
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def _portions(sizes: list[int]) -> Iterator[tuple[int, int]]:
    first, total = 0, 0
    for k, size in enumerate(sizes):
        total += size
        if total >= CHUNK_BYTES:
            yield first, k + 1
            first, total = k + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def encoded(docs: DataFrame, path: str, decode: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Encode ``text`` with the BPE file at ``path`` (no special tokens are added; their strings in a text are those tokens).

    Adds n_tokens and ids (32-bit little-endian numbers in one binary), with ``decode`` also decoded, the way back from the
    ids. Null and empty texts have no tokens. Rows are encoded one by one, repeated rows alike, an empty table gives none.
    A very long text takes the memory of one task, a word of any length time in proportion to it. Other columns come along
    (``keep`` limits them); columns called text, n_tokens, ids or decoded are replaced.
    """
    shared, added = _file(docs, path), ["n_tokens", "ids", "decoded"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("text", *added)]
    rows = docs.select(*keep, F.col("text").cast("string").cast("binary").alias("text"))
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), *([T.StructField("decoded", T.StringType())] if decode else [])]
    schema = T.StructType([*rows.select(*keep).schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for batch in batches:
            texts = batch.column(len(keep))
            for low, high in _portions(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                ids, begins = own.encode(texts.slice(low, high - low).to_pylist())
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), high - low, [None, pa.py_buffer(begins * 4), pa.py_buffer(ids.astype("<u4"))])
                columns = [pa.array(np.diff(begins)), raw.cast(pa.binary()), *([own.decode(ids, begins)] if decode else [])]
                yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns[:-1], *columns], [f.name for f in schema])

    return rows.mapInArrow(run, schema)


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """Add decoded: the text of the tokens in ``ids`` (as ``encoded`` gives them). Null ids give an empty text; an existing
    column called decoded is replaced."""
    shared, keep = _file(rows, path), [c for c in rows.columns if c not in ("ids", "decoded")]
    schema = T.StructType([*rows.select(*keep, "ids").schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for batch in batches:
            ids = batch.column(len(keep))
            for low, high in _portions(pc.fill_null(pc.binary_length(ids), 0).to_pylist()):
                part = [np.frombuffer(b or b"", "<u4") for b in ids.slice(low, high - low).to_pylist()]
                begins = np.concatenate([[0], np.cumsum([len(p) for p in part])])
                yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns, own.decode(np.concatenate(part), begins)], [f.name for f in schema])

    return rows.select(*keep, "ids").mapInArrow(run, schema)
