"""Byte-level BPE over whole corpora: length-bucketed padded numpy matrices, one leftmost merge a row and round.

The vocabulary is a public rank file (base64 token, rank); its path is a parameter and must be
readable on every executor. Within an Arrow batch every distinct pretoken is encoded once.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.session import spread

#: Pretokens of more bytes than this take the heap path: the matrix rounds are quadratic in the length.
LONG_BYTES = 512
CACHE_WORDS = 200_000
_NONE = np.int32(2**31 - 1)


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class PairTable:
    """Open-addressing hash table from a pair of ids to the merged id (which is also its rank)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 4))))
        self.mask = np.int64((1 << bits) - 1)
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, _NONE, np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at, todo = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.keys[at[todo]] == -1
            slot, first = np.unique(at[todo[free]], return_index=True)
            placed = todo[free][first]
            self.keys[slot], self.values[slot] = keys[placed], merged[placed]
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            at[todo] = (at[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        flat = keys.ravel()
        at = self._slot(flat)
        found = self.keys[at]
        out = np.where(found == flat, self.values[at], _NONE)
        open_ = np.flatnonzero((found != flat) & (found != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == flat[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out.reshape(keys.shape)


class BpeEncoder:
    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.pattern = regex.compile(pattern)
        ranks: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(merged, np.int32))
        self.cache: dict[str, np.ndarray] = {}

    def _matrix(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words of similar length: each round merges every row's leftmost minimum-rank pair."""
        width = max(map(len, words))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        column = np.arange(width)
        ids = np.where(column < lengths[:, None], self.byte_ids[raw], np.int32(-1))
        rank = np.full((len(words), width), _NONE, np.int32)
        if width > 1:
            inside = column[1:] < lengths[:, None]
            rank[:, :-1] = np.where(inside, self.pairs.lookup(np.maximum(ids[:, :-1], 0), np.maximum(ids[:, 1:], 0)), _NONE)
        out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        rows = np.arange(len(words))
        while len(rows):
            best = rank.argmin(axis=1)
            value = rank[np.arange(len(rows)), best]
            done = value == _NONE
            if done.any():
                for k in np.flatnonzero(done):
                    out[rows[k]] = ids[k, : lengths[k]]
                keep = ~done
                rows, lengths, best, value = rows[keep], lengths[keep], best[keep], value[keep]
                if not len(rows):
                    break
                width = int(lengths.max())
                ids, rank = ids[keep, :width], rank[keep, :width]
            here = np.arange(len(rows))
            ids[here, best] = value
            columns = np.arange(ids.shape[1] - 1)
            shift = columns > best[:, None]
            ids[:, :-1] = np.where(shift, ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(shift, rank[:, 1:], rank[:, :-1])
            ids[:, -1], rank[:, -1] = -1, _NONE
            lengths = lengths - 1
            right = best + 1 < lengths
            nxt = ids[here, np.minimum(best + 1, ids.shape[1] - 1)]
            rank[here, best] = np.where(right, self.pairs.lookup(value, np.maximum(nxt, 0)), _NONE)
            left = np.flatnonzero(best > 0)
            rank[left, best[left] - 1] = self.pairs.lookup(ids[left, best[left] - 1], value[left])
        return out

    def _long(self, word: bytes) -> np.ndarray:
        """The same merges for one very long pretoken, over a linked list with a heap."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n)) + [-1], [-1, *range(n - 1)]
        rank = self.pairs.lookup(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        none = int(_NONE)
        heap = [(r, i) for i, r in enumerate(rank) if r != none]
        heapq.heapify(heap)
        rank.append(none)
        merged, ranks = {}, self.pairs

        def pair(a: int, b: int) -> int:
            if (a, b) not in merged:
                merged[a, b] = int(ranks.lookup(np.array([a]), np.array([b]))[0])
            return merged[a, b]

        while heap:
            r, i = heapq.heappop(heap)
            if rank[i] != r:
                continue
            j = after[i]
            ids[i], after[i], rank[j], ids[j] = r, after[j], none, -1
            if after[i] >= 0:
                before[after[i]] = i
                rank[i] = pair(r, ids[after[i]])
                if rank[i] != none:
                    heapq.heappush(heap, (rank[i], i))
            else:
                rank[i] = none
            if (p := before[i]) >= 0:
                rank[p] = pair(ids[p], r)
                if rank[p] != none:
                    heapq.heappush(heap, (rank[p], p))
        return np.array([x for x in ids if x >= 0], np.int32)

    def _encode_words(self, words: list[str]) -> None:
        if len(self.cache) + len(words) > CACHE_WORDS:
            self.cache.clear()
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            data = word.encode()
            if (whole := self.ranks.get(data)) is not None:
                self.cache[word] = np.array([whole], np.int32)
            elif len(data) > LONG_BYTES:
                self.cache[word] = self._long(data)
            else:
                buckets.setdefault((len(data) - 1).bit_length(), []).append((word, data))
        for bucket in buckets.values():
            for start in range(0, len(bucket), 4096):
                part = bucket[start : start + 4096]
                for (word, _), ids in zip(part, self._matrix([data for _, data in part]), strict=True):
                    self.cache[word] = ids.copy()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts; a null or empty text has no ids."""
        split = [self.pattern.findall(t) if t else [] for t in texts]
        unique: dict[str, int] = {}
        index = np.fromiter((unique.setdefault(w, len(unique)) for words in split for w in words), np.int64)
        words = list(unique)
        known = self.cache
        new = [w for w in words if w not in known]
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = words
        self._encode_words(new)
        parts = [known[w] for w in words]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        lengths = sizes[index]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        take = np.arange(total) + np.repeat(starts[index] - (ends - lengths), lengths)
        counts = np.fromiter(map(len, split), np.int64, len(split))
        stops = np.concatenate([[0], np.cumsum(counts)])
        offsets = np.concatenate([[0], ends])[stops]
        return offsets, flat[take]


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> BpeEncoder:
    return BpeEncoder(path, pattern)


#: Texts handled at once in a worker, by number of characters: bounds the memory of a batch.
BATCH_CHARS = 4_000_000


def _blocks(texts: list[str | None]) -> Iterator[list[str | None]]:
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t) if t else 0
        if size >= BATCH_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def bpe_ids(text: Column | str, path: str | None = None, pattern: str | None = None) -> Column:
    """ARRAY<INT> of the ids of ``text`` without special tokens; null and empty texts give an empty list."""

    path, pattern = path or default_tokenizer_path(), pattern or default_pattern()

    @F.arrow_udf("array<int>")
    def ids(column: pa.Array) -> pa.Array:
        bpe = encoder(path, pattern)
        chunks = []
        for block in _blocks(column.to_pylist()):
            offsets, flat = bpe.encode(block)
            chunks.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())))
        return pa.concat_arrays(chunks) if chunks else pa.array([], pa.list_(pa.int32()))

    return ids(F.col(text) if isinstance(text, str) else text)


def bpe_count(text: Column | str, path: str | None = None, pattern: str | None = None) -> Column:
    """INT number of ids of ``text``; 0 for null and empty texts."""

    path, pattern = path or default_tokenizer_path(), pattern or default_pattern()

    @F.arrow_udf("int")
    def count(column: pa.Array) -> pa.Array:
        bpe = encoder(path, pattern)
        sizes = [np.diff(bpe.encode(block)[0]) for block in _blocks(column.to_pylist())]
        return pa.array(np.concatenate(sizes) if sizes else np.empty(0), pa.int32())

    return count(F.col(text) if isinstance(text, str) else text)


def encode_corpus(documents: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``documents`` with the column ``ids`` added (a column of that name is replaced).

    Nulls and empty texts: empty list. Special-token strings are ordinary text. Other columns pass
    through; an empty table gives an empty table. No shuffle: one narrow Arrow stage
    (a table in fewer partitions than there are cores is spread over them first).
    """
    return spread(documents).withColumn(ids, bpe_ids(F.col(text), path, pattern))
