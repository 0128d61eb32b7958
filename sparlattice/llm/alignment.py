"""Operator 12: alignment of two tokenizers over the same bytes.

Tokenizer A is a byte-level BPE of the tokenizers library, B a sentencepiece
model with byte fallback. Each batch is aligned by two ``merge_asof`` keyed by
document: every token start finds the other side's token that covers it. The
union of both directions is all overlapping pairs; offsets where tokens of both
sides end cut them into groups.

How many documents hold a pair linked needs the whole corpus. Tasks gather
documents into chunks; a chunk keeps its distinct pairs once, and its links as
places among them. Pairs are counted over these dictionaries, and each chunk
gets the counts of its own pairs back, so that no shuffle carries a row a link.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import Scan, chunks, hash_runs, library_classes, packed, unpacked_classes
from .bpe import Memory, PreTokens
from .shared import Scratch

#: Links after which a task closes a chunk; a chunk holds whole documents, so a longer one is a chunk of its own.
CHUNK_LINKS = 3_000_000
#: How sentencepiece writes a space. Fixed value.
SPACE_PIECE = "▁"
#: Stands for the tokens of a piece of text whose bytes a tokenizer changes.
CHANGED = -1


def _byte_letters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable
    Latin-1 characters stand for themselves, other bytes for U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class _Side:
    """Tokens of one tokenizer: their bytes, and the ids of independent pieces of text."""

    def __init__(self, token_bytes: dict[int, bytes]):
        n = max(token_bytes) + 1
        #: The last place, which CHANGED names too, holds nothing.
        self.bytes_of = [token_bytes.get(i, b"") for i in range(n + 1)]
        self.sizes = np.fromiter(map(len, self.bytes_of), dtype=np.int64, count=n + 1)
        self.memory = Memory()

    def ids_of(self, scan: Scan, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, bounds of each text)."""
        blocks = packed(scan.points)
        hashes, second = (hash_runs(blocks, scan.points, starts, stops, kind) for kind in (0, 1))
        joined = scan.joined
        ids, counts = self.memory.ids_of(hashes, second, lambda i: joined[starts[i] : stops[i]], self.resolve)
        first = np.searchsorted(starts, np.append(scan.begins, len(scan.points)))
        return ids, np.concatenate([[0], np.cumsum(counts)])[first]

    def resolve(self, words: list[str]) -> list[list[int]]:
        """The ids of each piece of text, or ``[CHANGED]`` where their bytes aren't its own."""
        found = self.library(words)
        raw = self.bytes_of.__getitem__
        return [ids if b"".join(map(raw, ids)) == w.encode() else [CHANGED] for w, ids in zip(words, found, strict=True)]

    def library(self, words: list[str]) -> list[list[int]]:
        raise NotImplementedError


class ByteLevel(_Side):
    """A tokenizers file of byte-level BPE. Strings of special tokens are plain text."""

    def __init__(self, path: str, classes: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.classes = unpacked_classes(classes)
        letters = _byte_letters()
        super().__init__({i: bytes(map(letters.__getitem__, token)) for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items()})

    def library(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        t = PreTokens(texts, self.classes)
        return self.ids_of(t, t.starts, t.stops)


class Pieces(_Side):
    """A sentencepiece model that leaves characters as they are and adds a space in front.

    No piece has a space behind another character, so merges never cross a place
    where a run of spaces begins, and what lies between two of these is encoded by itself.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        of = {}
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                of[i] = bytes([int(piece[1:-1], 16)])
            elif not self.model.is_control(i) and not self.model.is_unknown(i):
                if SPACE_PIECE in piece.lstrip(SPACE_PIECE):
                    raise ValueError("a piece has a space behind another character")
                of[i] = piece.replace(SPACE_PIECE, " ").encode()
        self.lone_space = self.model.piece_to_id(SPACE_PIECE)
        super().__init__(of)

    def library(self, words: list[str]) -> list[list[int]]:
        """``words`` begin with a space, which the model adds itself."""
        found = self.model.encode([w[1:] for w in words], num_threads=1)
        return [ids if w != " " else [self.lone_space] for w, ids in zip(words, found, strict=True)]

    def encode(self, spaced: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``spaced``: texts with the space in front."""
        s = Scan(spaced)
        p = s.points
        cut = p == 32
        cut[1:] &= p[:-1] != 32
        cut[s.begins] = True
        cut[s.ends] = True
        bounds = np.append(np.flatnonzero(cut), len(p))
        keep = np.ones(len(bounds) - 1, dtype=bool)
        keep[np.searchsorted(bounds, s.ends)] = False
        return self.ids_of(s, bounds[:-1][keep], bounds[1:][keep])


@lru_cache(maxsize=2)
def byte_level(path: str, classes: bytes) -> ByteLevel:
    return ByteLevel(path, classes)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(maxsize=4)
def byte_level_classes(path: str) -> bytes:
    from tokenizers import Tokenizer

    return library_classes(Tokenizer.from_file(path).pre_tokenizer)


@dataclass
class Alignment:
    """Tokens of some texts end to end, side A and side B.

    ``bounds_*``: first token of each text and the total; ``group_*``: the group of
    each token, numbered over all texts; ``first_group``: as ``bounds``; ``link_*``:
    positions of linked tokens, one entry a link, in no order.
    """

    a: np.ndarray
    b: np.ndarray
    bounds_a: np.ndarray
    bounds_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    first_group: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    doc_of_link: np.ndarray


def overlaps(doc_a: np.ndarray, start_a: np.ndarray, doc_b: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of all tokens whose byte ranges overlap, in no order.

    Of two overlapping tokens the later start lies in the other one; equal starts
    are found from A alone, so that the union holds each pair once.
    """
    a = pd.DataFrame({"doc": doc_a, "at": start_a, "a": np.arange(len(start_a))})
    b = pd.DataFrame({"doc": doc_b, "at": start_b, "b": np.arange(len(start_b))})
    from_a = pd.merge_asof(a, b, on="at", by="doc")
    from_b = pd.merge_asof(b, a, on="at", by="doc")
    from_b = from_b[start_a[from_b["a"]] != from_b["at"]]
    return (np.concatenate([from_a[c].to_numpy(), from_b[c].to_numpy()]) for c in ("a", "b"))


def _kept(ids: np.ndarray, bounds: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(bounds)
    return ids[np.repeat(good, n)], np.concatenate([[0], np.cumsum(np.where(good, n, 0))])


def align(texts: list[str | None], a: ByteLevel, b: Pieces) -> Alignment:
    """Null and empty texts, and those whose bytes a side doesn't give back, have no tokens."""
    spaced = [" " + t if t else "" for t in texts]
    ids_a, bounds_a = a.encode(spaced)
    ids_b, bounds_b = b.encode(spaced)
    good = np.ones(len(texts), dtype=bool)
    for ids, bounds in ((ids_a, bounds_a), (ids_b, bounds_b)):
        good[np.searchsorted(bounds, np.flatnonzero(ids == CHANGED), "right") - 1] = False
    if not good.all():
        (ids_a, bounds_a), (ids_b, bounds_b) = _kept(ids_a, bounds_a, good), _kept(ids_b, bounds_b, good)
    docs = np.arange(len(texts))
    doc_a, doc_b = np.repeat(docs, np.diff(bounds_a)), np.repeat(docs, np.diff(bounds_b))
    end_a, end_b = np.cumsum(a.sizes[ids_a]), np.cumsum(b.sizes[ids_b])
    link_a, link_b = overlaps(doc_a, end_a - a.sizes[ids_a], doc_b, end_b - b.sizes[ids_b])
    common = np.intersect1d(end_a, end_b, assume_unique=True)
    group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
    # A text ends both sides, so its groups are those up to its last token's.
    last = np.concatenate([[0], group_a + 1])[bounds_a]
    return Alignment(ids_a, ids_b, bounds_a, bounds_b, group_a, group_b, last, link_a, link_b, doc_a[link_a])


def _last_of_group(group: np.ndarray) -> np.ndarray:
    return np.append(group[1:] != group[:-1], True)[: len(group)]


def group_texts(x: Alignment) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of each text: decimal ids of its groups in order."""
    total = len(x.a) + len(x.b)
    # A token stands behind all tokens of earlier groups; within its group A comes first.
    place_a = np.arange(len(x.a)) + np.searchsorted(x.group_b, x.group_a, "left")
    place_b = np.arange(len(x.b)) + np.searchsorted(x.group_a, x.group_b, "right")
    code = np.empty(total, dtype=np.int64)
    code[place_a] = 3 * x.a + _last_of_group(x.group_a)
    code[place_b] = 3 * x.b + 2 * _last_of_group(x.group_b)
    bounds = (x.bounds_a + x.bounds_b).tolist()
    said = list(map(_ids_with_marks(int(code.max(initial=0)) // 3 + 1).__getitem__, code.tolist()))
    return ["".join(said[i:j])[:-1] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]


@lru_cache(maxsize=1)
def _marks(n: int) -> list[str]:
    return [f"{i}{mark}" for i in range(n) for mark in ",|;"]


def _ids_with_marks(n: int) -> list[str]:
    return _marks(1 << max(16, n.bit_length()))


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, a, b, a_groups, b_groups, a_links, b_links), one row a row of ``docs``.

    ``a``, ``b``: token ids; ``*_groups``: the group of each token, from 0; links:
    positions of tokens, from 0, whose bytes overlap. Null and empty texts, and
    texts whose bytes a tokenizer changes (such as U+2581 with B), have empty
    arrays. Repeated rows give repeated results; other columns play no part; long texts are whole.
    """
    classes = byte_level_classes(a_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(a_path, classes), pieces(b_path)
        for batch in batches:
            for at, part in chunks(batch.column(1).to_pylist()):
                x = align(part, a, b)
                order = np.lexsort((x.link_b, x.link_a))
                per_link = np.searchsorted(x.doc_of_link[order], np.arange(len(part) + 1))

                def lists(values: np.ndarray, bounds: np.ndarray, base: np.ndarray | None = None) -> pa.Array:
                    own = values if base is None else values - np.repeat(base[:-1], np.diff(bounds))
                    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(own, pa.int32()))

                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(part)), lists(x.a, x.bounds_a), lists(x.b, x.bounds_b), lists(x.group_a, x.bounds_a, x.first_group), lists(x.group_b, x.bounds_b, x.first_group),
                        lists(x.link_a[order], per_link, x.bounds_a), lists(x.link_b[order], per_link, x.bounds_b),
                    ],
                    names=["doc_id", "a", "b", "a_groups", "b_groups", "a_links", "b_links"],
                )

    schema = "doc_id long, a array<int>, b array<int>, a_groups array<int>, b_groups array<int>, a_links array<int>, b_links array<int>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


#: A chunk: columns by document, the distinct pairs with the number of its documents that hold
#: them, and its links, document by document, as ascending places among the pairs (``_steps``).
CHUNK = "chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, pairs array<long>, documents array<int>, steps binary, far array<int>"


def _steps(places: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Differences of successive places as bytes; 255 stands for the next of the others."""
    d = np.diff(places, prepend=0)
    near = (d >= 0) & (d < 255)
    return np.where(near, d, 255).astype(np.uint8).tobytes(), d[~near].astype(np.int32)


def _places(steps: bytes, far: np.ndarray) -> np.ndarray:
    d = np.frombuffer(steps, dtype=np.uint8).astype(np.int64)
    d[d == 255] = far
    return np.cumsum(d)


class _Chunk:
    def __init__(self):
        self.columns: list[list] = [[] for _ in range(6)]
        self.pairs: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.links = self.n = 0

    def add(self, doc_ids: list, x: Alignment) -> None:
        n = len(doc_ids)
        shas = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in group_texts(x)]
        counts = [np.diff(x.bounds_a), np.diff(x.bounds_b), np.diff(x.first_group), np.bincount(x.doc_of_link, minlength=n)]
        for held, new in zip(self.columns, [doc_ids, *(c.tolist() for c in counts), shas], strict=True):
            held += new
        self.pairs.append(x.a[x.link_a].astype(np.int64) << 32 | x.b[x.link_b])
        self.docs.append(x.doc_of_link + self.n)
        self.n += n
        self.links += len(x.link_a)

    def row(self, chunk: int) -> pa.RecordBatch:
        code, found = pd.factorize(np.concatenate(self.pairs))
        order = np.argsort(found)
        pairs, place = found[order], np.empty(len(found), dtype=np.int64)
        place[order] = np.arange(len(found))
        n = max(1, len(found))
        keys = np.sort(np.concatenate(self.docs) * n + place[code])
        place, first = keys % n, np.diff(keys, prepend=-1) != 0
        steps, far = _steps(place)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32()]
        lists = [pa.array([v], pa.list_(t)) for v, t in zip([*self.columns, pairs, np.bincount(place[first], minlength=len(pairs))], kinds, strict=True)]
        names = [c.split()[0] for c in CHUNK.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *lists, pa.array([steps], pa.binary()), pa.array([far], pa.list_(pa.int32()))], names=names)


def chunked(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The documents of each task aligned and gathered into chunks (see ``CHUNK``).

    Chunks are numbered by partition and order, which tells them apart within one
    written table.
    """
    classes = byte_level_classes(a_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(a_path, classes), pieces(b_path)
        number, held = TaskContext.get().partitionId() << 32, _Chunk()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, part in chunks(batch.column(1).to_pylist()):
                held.add(ids[at : at + len(part)], align(part, a, b))
                if held.links >= CHUNK_LINKS:
                    yield held.row(number)
                    number, held = number + 1, _Chunk()
        if held.n:
            yield held.row(number)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, CHUNK)


def pair_counts(gathered: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents the tokens of each pair are linked, and
    whether no pair of its A token has more. ``pair``: the A id in the upper, the B
    id in the lower 32 bits. A token has no more pairs than B has ids."""
    each = gathered.select(F.inline(F.arrays_zip("pairs", "documents")))
    n = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("documents").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", 32)))
    return n.select("pair", "n", (F.col("n") == most).alias("best"))


def _judged(chunk: pa.Table, found: pa.Table) -> pa.Table:
    """A chunk's documents with the sums over their links of ``found`` (place, n, best)."""
    row = {name: chunk.column(name).combine_chunks() for name in chunk.schema.names}
    place = found.column("place").to_numpy()
    n, best = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
    n[place], best[place] = found.column("n").to_numpy(), found.column("best").to_numpy(zero_copy_only=False)
    places = _places(row["steps"][0].as_py(), row["far"].flatten().to_numpy())
    bounds = np.concatenate([[0], np.cumsum(row["n_links"].flatten().to_numpy())])
    sums = [np.concatenate([[0], np.cumsum(v[places])])[bounds] for v in (best, n)]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    columns = [row[name].flatten() for name in names] + [pa.array(np.diff(s), pa.int64()) for s in sums]
    return pa.Table.from_arrays(columns, names=[*names, "n_best", "count_sum"])


def alignment_digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum), one row a row of ``docs``.

    ``n_best``: links whose pair is in as many documents as any pair of its A
    token; ``count_sum``: sum over links of how many documents hold their pair.
    Texts without tokens (see ``aligned``) have zeros and an empty digest; rows
    with one doc_id are documents of their own.
    """
    gathered = Scratch(docs.sparkSession).write(chunked(docs, a_path, b_path), "aligned")
    places = gathered.select("chunk", F.posexplode("pairs").alias("place", "pair"))
    found = places.join(pair_counts(gathered), "pair").select(F.col("chunk").alias("of_chunk"), "place", "n", "best")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    whole = gathered.drop("pairs", "documents").groupBy("chunk")
    return whole.cogroup(found.groupBy("of_chunk")).applyInArrow(_judged, schema)
