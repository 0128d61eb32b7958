"""Operator 3: byte-level BPE encoding and decoding.

Pre-tokens are cut with whole-array operations. Each distinct pre-token is
resolved in two tiers: a minimal perfect hash over the vocabulary finds whole
pre-tokens; the rest are merged with a heap of pair ranks over a linked list of
bytes. Resolved pre-tokens are remembered, up to a bound, by the Python worker.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import END, SPACE, Runs, chunks, hash_runs, mix, packed

#: Remembered pre-tokens of one worker; at the bound the memory is emptied.
MEMORY = 500_000
_U = np.uint64


class MinimalPerfectHash:
    """Maps n distinct 64-bit keys to 0..n-1, one key to one place.

    Keys fall into small buckets; from the largest bucket on, a displacement is
    sought that puts all keys of the bucket on free places.
    """

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 3)
        bucket = (keys % _U(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.displacement = np.zeros(self.buckets, dtype=np.uint64)
        taken = np.zeros(n, dtype=bool)
        for b in np.argsort(-np.diff(bounds), kind="stable"):
            own = keys[order[bounds[b] : bounds[b + 1]]]
            if not len(own):
                break
            d = 0
            while True:
                tried = np.arange(d, d + 64, dtype=np.uint64)
                places = self._place(own[None, :], tried[:, None])
                good = ~taken[places].any(axis=1)
                for k in np.flatnonzero(good):
                    if len(set(places[k].tolist())) == len(own):
                        taken[places[k]] = True
                        self.displacement[b] = tried[k]
                        break
                else:
                    d += 64
                    continue
                break

    def _place(self, keys: np.ndarray, displacement: np.ndarray) -> np.ndarray:
        return (mix(keys ^ (displacement * _U(0x9E3779B97F4A7C15))) % _U(self.n)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        return self._place(keys, self.displacement[(keys % _U(self.buckets)).astype(np.int64)])


def _hash_bytes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in words), dtype=np.uint64, count=len(words))


class Vocabulary:
    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        words = list(ranks)
        self.whole = MinimalPerfectHash(_hash_bytes(words))
        self.token_at: list[bytes] = [b""] * len(words)
        self.id_at = [0] * len(words)
        for place, word in zip(self.whole(_hash_bytes(words)).tolist(), words, strict=True):
            self.token_at[place], self.id_at[place] = word, ranks[word]
        #: (left id, right id) as one integer -> id of both together
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        #: first byte, second byte -> id of both together, or -1
        self.byte_pairs = [[self.pairs.get(a << 32 | b, -1) for b in self.byte_ids] for a in self.byte_ids]
        self.memory = Memory()

    def resolve(self, words: list[str]) -> list[list[int]]:
        raw = [w.encode() for w in words]
        out = []
        for word, place in zip(raw, self.whole(_hash_bytes(raw)).tolist(), strict=True):
            out.append([self.id_at[place]] if self.token_at[place] == word else self.merged(word))
        return out

    def merged(self, word: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        ids = [self.byte_ids[b] for b in word]
        n = len(ids)
        #: Of the pair that begins at each place, the rank; -1 if it isn't merged.
        best = [self.byte_pairs[a][b] for a, b in pairwise(word)]
        best.append(-1)
        pairs, pop, push = self.pairs.get, heapq.heappop, heapq.heappush
        heap = [rank << 32 | i for i, rank in enumerate(best) if rank >= 0]
        heapq.heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while heap:
            top = pop(heap)
            rank, i = top >> 32, top & 0xFFFFFFFF
            if best[i] != rank:
                continue
            j = after[i]
            ids[i], ids[j], best[i], best[j] = rank, -1, -1, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                new = best[i] = pairs(rank << 32 | ids[k], -1)
                if new >= 0:
                    push(heap, new << 32 | i)
            h = before[i]
            if h >= 0:
                new = best[h] = pairs(ids[h] << 32 | rank, -1)
                if new >= 0:
                    push(heap, new << 32 | h)
        return [x for x in ids if x >= 0]


class Memory:
    """Resolved words of one worker: sorted hashes with their ids end to end.

    A word is known by two independent hashes, 128 bits together. Words that
    share the first alone are told apart by the second and resolved by
    themselves.
    """

    def __init__(self, bound: int = MEMORY):
        self.bound = bound
        self.empty()

    def empty(self) -> None:
        self.keys = np.empty(0, dtype=np.uint64)
        self.second = np.empty(0, dtype=np.uint64)
        self.at = np.empty(0, dtype=np.uint32)
        self.n = np.empty(0, dtype=np.uint32)
        self.ids = np.empty(0, dtype=np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return place if len(self.keys) else np.zeros(len(keys), dtype=np.int64)

    def known(self, keys: np.ndarray) -> np.ndarray:
        return self.keys[self.find(keys)] == keys if len(self.keys) else np.zeros(len(keys), dtype=bool)

    def add(self, keys: np.ndarray, second: np.ndarray, found: list[list[int]]) -> None:
        """``keys``: ascending, none of them known."""
        n = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        ids = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(n.sum()))
        at = np.cumsum(n) - n + len(self.ids)
        place = np.searchsorted(self.keys, keys) + np.arange(len(keys))
        old = np.ones(len(self.keys) + len(keys), dtype=bool)
        old[place] = False

        def both(held: np.ndarray, new: np.ndarray) -> np.ndarray:
            out = np.empty(len(old), dtype=held.dtype)
            out[old], out[place] = held, new
            return out

        self.keys, self.second = both(self.keys, keys), both(self.second, second)
        self.at, self.n = both(self.at, at), both(self.n, n)
        self.ids = np.concatenate([self.ids, ids])

    def ids_of(self, hashes: np.ndarray, second: np.ndarray, word_at, resolve) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, how many ids each word has). ``word_at(i)``: the i-th
        word; ``resolve(words)``: the ids of each."""
        order = np.argsort(hashes)
        ordered = hashes[order]
        new = np.concatenate([np.ones(min(1, len(hashes)), dtype=bool), ordered[1:] != ordered[:-1]])
        distinct, first = ordered[new], order[new]
        inverse = np.empty(len(hashes), dtype=np.int64)
        inverse[order] = np.cumsum(new) - 1
        if len(self.keys) > self.bound:
            self.empty()
        known = self.known(distinct)
        if (self.second[self.find(distinct[known])] != second[first[known]]).any():
            self.empty()
            known[:] = False
        new = np.flatnonzero(~known)
        if len(new):
            self.add(distinct[new], second[first[new]], resolve([word_at(i) for i in first[new].tolist()]))
        place = self.find(distinct)[inverse]
        counts, at, pool = self.n[place].astype(np.int64), self.at[place].astype(np.int64), self.ids
        others = np.flatnonzero(self.second[place] != second)
        if len(others):  # another word has the same first hash
            found = resolve([word_at(i) for i in others.tolist()])
            n = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            counts[others], at[others] = n, np.cumsum(n) - n + len(pool)
            pool = np.concatenate([pool, np.fromiter((i for x in found for i in x), dtype=np.int32, count=int(n.sum()))])
        total = np.cumsum(counts)
        index = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(at - (total - counts), counts)
        return pool[index], counts


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class PreTokens(Runs):
    """The matches of the byte-level pattern: contractions, words, numbers and
    other runs with one space before them, white space."""

    def __init__(self, texts: list[str], table: np.ndarray | None = None):
        super().__init__(texts, after_space=True, table=table)
        k, p, cut = self.kind, self.points, self.cut
        b = np.flatnonzero((k[:-1] == SPACE) & (k[1:] != SPACE) & (k[1:] != END)) + 1
        cut[b - 1] = True
        cut[b[p[b - 1] == 32]] = False
        bounds = np.flatnonzero(cut)
        keep = k[bounds[:-1]] != END
        self.starts, self.stops = bounds[:-1][keep], bounds[1:][keep]
        blocks = packed(p)
        self.hashes, self.second = (hash_runs(blocks, p, self.starts, self.stops, kind) for kind in (0, 1))
        self.first = np.searchsorted(self.starts, np.append(self.begins, len(p)))


def encode(texts: list[str], vocab: Vocabulary) -> list[list[int]]:
    """The ids of each text, without special tokens."""
    t = PreTokens(texts)
    starts, stops, joined = t.starts, t.stops, t.joined
    ids, counts = vocab.memory.ids_of(t.hashes, t.second, lambda i: joined[starts[i] : stops[i]], vocab.resolve)
    bounds = np.concatenate([[0], np.cumsum(counts)])[t.first]
    ids = ids.tolist()
    return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def decode(ids: list[int], vocab: Vocabulary) -> bytes:
    return b"".join(map(vocab.bytes_of.__getitem__, ids))


def encoded(docs: DataFrame, vocab_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column of token ids, array<int>.

    Null and empty texts get an empty array. All columns of ``docs`` stay; a
    column already named ``ids`` is replaced. Long texts are encoded whole.
    """
    keep = [c for c in docs.columns if c != ids]
    out = docs.select(*keep)
    schema = T.StructType([*out.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for batch in batches:
            for at, part in chunks(batch.column(text).to_pylist()):
                rows = batch.slice(at, len(part))
                column = pa.array(encode(part, vocab), type=pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*rows.columns, column], names=[*rows.schema.names, ids])

    return out.mapInArrow(run, schema)


def digests(docs: DataFrame, vocab_path: str) -> DataFrame:
    """Per document: n_tokens, ids_sha256 over the decimal ids joined by commas,
    decoded_sha256 over the bytes that the ids decode to.

    Null and empty texts have no tokens and the digests of no bytes. Repeated
    rows give repeated results; other columns of ``docs`` play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        said = vocab.text_of.__getitem__
        for batch in batches:
            doc_ids, n, of_ids, of_bytes = batch.column(0), [], [], []
            for _, part in chunks(batch.column(1).to_pylist()):
                for ids in encode(part, vocab):
                    n.append(len(ids))
                    of_ids.append(hashlib.sha256(",".join(map(said, ids)).encode()).hexdigest())
                    of_bytes.append(hashlib.sha256(decode(ids, vocab)).hexdigest())
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
