"""Byte-level BPE encoding by speculation and verification.

Texts are cut at spaces, and each new distinct piece into words by the tokenizer's pattern. Each new distinct word is encoded once: greedy longest match proposes
tokens, all adjacent pairs of all proposed words are tested at once for compatibility (a sequence is what BPE gives exactly if
each adjacent pair is), and only words with a failing pair undergo exact merging. Pieces repeat, so a text is mostly look-ups.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Where the public tokenizers' files are.
TOKENIZERS = "/opt/tokenizers"
#: Pieces that a worker keeps; when there are more, it starts anew (results don't depend on it).
CACHE_PIECES = 400_000


# Fixed: the public pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A lone surrogate, which no text holds: marks a text's first piece, which has no space before it.
_FIRST = "\ud800"
_SPACED = re.compile(r" (?=\S)")
_RUN = re.compile(r"\s \s|\s\s\Z")


def pieces(text: str) -> list[str]:
    """``text`` cut before each space that a non-space follows (the space is left out): no word of the pattern crosses these cuts."""
    found = _SPACED.split(text) if _RUN.search(text) else text.split(" ")
    found[0] = _FIRST + found[0]
    return found


class Encoder:
    """Encodes texts with the vocabulary of one ranks file (``base64 rank`` per line; ids below 256 are the bytes)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = ranks
        self.tokens = [b""] * len(ranks)
        for t, i in ranks.items():
            self.tokens[i] = t
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.pattern = regex.compile(PATTERN)
        self._build_trie()
        self._build_pairs()
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self._flat: list[np.ndarray] = []
        self._lens: list[np.ndarray] = []
        self._table: tuple[np.ndarray, np.ndarray] | None = None
        self.exact = 0

    # --- vocabulary -----------------------------------------------------------------------------------------------------

    def _build_trie(self) -> None:
        """Edges (node, byte) -> node as sorted codes; ``accept``: the token that ends in a node, or -1."""
        nodes: dict[bytes, int] = {b"": 0}
        codes, targets = [], []
        for token in self.tokens:
            for n in range(1, len(token) + 1):
                prefix = token[:n]
                if prefix not in nodes:
                    nodes[prefix] = len(nodes)
                    codes.append((nodes[prefix[:-1]] << 8) | prefix[-1])
                    targets.append(nodes[prefix])
        order = np.argsort(codes)
        self.edge, self.target = np.array(codes, np.int64)[order], np.array(targets, np.int64)[order]
        self.accept = np.full(len(nodes), -1, np.int64)
        for token, i in self.ranks.items():
            self.accept[nodes[token]] = i
        self.root = np.zeros(256, np.int64)
        self.root[self.edge[self.edge < 256]] = self.target[self.edge < 256]

    def _build_pairs(self) -> None:
        """``split``: the two tokens whose merge gives a token (itself for bytes); the merges as sorted codes."""
        n = len(self.tokens)
        self.split = np.stack([np.arange(n), np.arange(n)])
        codes, merged = [], []
        for i, token in enumerate(self.tokens):
            if len(token) > 1 and (parts := self.merge(token, limit=i)) and len(parts) == 2:
                self.split[:, i] = parts
                codes.append(parts[0] * n + parts[1])
                merged.append(i)
        order = np.argsort(codes)
        self.pair, self.merged = np.array(codes, np.int64)[order], np.array(merged, np.int64)[order]

    def merge(self, word: bytes, limit: int | None = None) -> list[int]:
        """Exact BPE of one word: merges of lowest rank first, from the left; only ranks below ``limit`` if given."""
        if limit is None and (one := self.ranks.get(word)) is not None:
            return [one]
        parts = [word[i : i + 1] for i in range(len(word))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[int, int, bytes]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts):
                both = parts[i] + parts[j]
                rank = self.ranks.get(both)
                if rank is not None and (limit is None or rank < limit):
                    heapq.heappush(heap, (rank, i, both))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i] if parts[i] else len(parts)
            if j >= len(parts) or len(parts[i]) + len(parts[j]) != len(both) or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, b""
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [self.ranks[p] for p in parts if p]

    # --- words ----------------------------------------------------------------------------------------------------------

    def _speculate(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words at once: tokens and their words, in order."""
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lens)
        at = ends - lens
        word = np.flatnonzero(lens)
        at, ends = at[word], ends[word]
        out_word, out_token, out_round, step = [], [], [], 0
        while len(word):
            node = self.root[data[at]]
            best, best_at = self.accept[node], at + 1
            live, pos = np.flatnonzero(best_at < ends), at + 1
            while len(live):
                code = (node[live] << 8) | data[pos[live]]
                where = np.minimum(np.searchsorted(self.edge, code), len(self.edge) - 1)
                hit = self.edge[where] == code
                live = live[hit]
                node[live] = self.target[where[hit]]
                pos[live] += 1
                done = self.accept[node[live]]
                ok = done >= 0
                best[live[ok]], best_at[live[ok]] = done[ok], pos[live[ok]]
                live = live[pos[live] < ends[live]]
            out_word.append(word)
            out_token.append(best)
            out_round.append(np.full(len(word), step))
            step += 1
            more = best_at < ends
            word, at, ends = word[more], best_at[more], ends[more]
        if not out_word:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        w, t = np.concatenate(out_word), np.concatenate(out_token)
        order = np.lexsort((np.concatenate(out_round), w))
        return w[order], t[order]

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether BPE keeps the border between each left and right token.

        Undoes the later merge of the two sides step by step; the border falls if a merge across it would have come first.
        """
        n = len(self.tokens)
        ok = np.ones(len(left), bool)
        live = np.arange(len(left))
        a, b = left.copy(), right.copy()
        limit = np.full(len(left), np.iinfo(np.int64).max)
        while len(live):
            code = a * n + b
            where = np.minimum(np.searchsorted(self.pair, code), len(self.pair) - 1)
            broken = (self.pair[where] == code) & (self.merged[where] < limit)
            ok[live[broken]] = False
            keep = ~broken
            live, a, b, limit = live[keep], a[keep], b[keep], limit[keep]
            first = a > b  # undo the left side's merge, else the right side's; if that is a byte, the other's
            left_to, right_to = self.split[1][a], self.split[0][b]
            use_left = np.where(first, left_to != a, right_to == b)
            ended = (left_to == a) & (right_to == b)
            limit = np.where(use_left, a, b + 1)
            a, b = np.where(use_left, left_to, a), np.where(use_left, b, right_to)
            go = ~ended
            live, a, b, limit = live[go], a[go], b[go], limit[go]
        return ok

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, flat, and the number of each word's tokens."""
        word, token = self._speculate(words)
        counts = np.bincount(word, minlength=len(words))
        near = np.flatnonzero(word[1:] == word[:-1])
        bad = np.unique(word[near[~self._compatible(token[near], token[near + 1])]])
        self.exact += len(bad)
        if not len(bad):
            return token, counts
        starts = np.cumsum(counts) - counts
        pieces, done = [], 0
        for w in bad:
            exact = np.array(self.merge(words[w]), np.int64)
            pieces += [token[done : starts[w]], exact]
            done = starts[w] + counts[w]
            counts[w] = len(exact)
        return np.concatenate([*pieces, token[done:]]), counts

    # --- texts ----------------------------------------------------------------------------------------------------------

    def _encode_pieces(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of pieces, flat, and the number of each piece's tokens: each distinct word is encoded once."""
        cut = self.pattern.findall
        lists = [cut(p[1:] if p[:1] == _FIRST else " " + p) for p in new]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        number: dict[str, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in chain.from_iterable(lists)], np.int64)
        flat, lens = self.encode_words([w.encode("utf-8", "replace") for w in number])
        out, ends = _gather(flat, np.cumsum(lens) - lens, lens, ids)
        return out, np.diff(np.append(0, ends)[np.append(0, np.cumsum(counts))])

    def encode_batch(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, flat (int32), and the number of each text's tokens; none for null and empty texts."""
        if len(self.index) > CACHE_PIECES:
            self.clear()
        lists = [pieces(t) if t else () for t in texts]
        index = self.index
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        total = int(counts.sum())
        new = [w for w in set(chain.from_iterable(lists)) if w not in index]
        if new:
            flat, lens = self._encode_pieces(new)
            start = len(index)
            index.update(zip(new, range(start, start + len(new))))
            self._flat.append(flat.astype(np.int32))
            self._lens.append(lens)
            self._table = None
        if self._table is None:
            self._flat, self._lens = [np.concatenate([np.empty(0, np.int32), *self._flat])], [np.concatenate([np.empty(0, np.int64), *self._lens])]
            self._table = np.cumsum(self._lens[0]) - self._lens[0], self._lens[0]
        ids = np.fromiter(map(index.__getitem__, chain.from_iterable(lists)), np.int64, total)
        out, ends = _gather(self._flat[0], *self._table, ids)
        edges = np.append(0, ends)[np.append(0, np.cumsum(counts))]
        return out, np.diff(edges)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()


def _gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``ids`` of ``flat`` one after the other, and where each ends."""
    sizes = lens[ids]
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts[ids] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)], ends


@lru_cache(maxsize=2)
def encoder(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Encoder:
    """The process's encoder of a public vocabulary."""
    return Encoder(f"{folder}/{name}.tiktoken")


#: Characters that are encoded at once, about.
_SLICE = 2_000_000


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= _SLICE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_column(documents: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key`` and ``ids`` (array<int>): the token ids of each text, whole, without special tokens.

    Null and empty texts give an empty list; blank texts are encoded as they are; rows with the same key each give a row;
    other columns are ignored. One pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _slices(texts):
                flat, counts = enc.encode_batch(texts[a:b])
                offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["key", "ids"])

    kind = documents.schema[key].dataType.simpleString()
    found = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, ids array<int>")
    return found.withColumnRenamed("key", key)


def count_column(documents: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key``, the columns ``keep`` and ``tokens`` (long): the number of each text's tokens, 0 for null and empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            counts = [enc.encode_batch(texts[a:b])[1] for a, b in _slices(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate([np.empty(0, np.int64), *counts]))], names=[*others, "tokens"])

    others = list(dict.fromkeys([key, *keep]))
    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in others)
    return documents.select(F.col(text).cast("string").alias("__text"), *others).mapInArrow(run, f"{kinds}, tokens long")
