"""Operator 9: benchmark decontamination.

An item is the multiset of its word shingles, and its SimHash is taken over
them, the second and later copies of a shingle counting as shingles of their
own: so the distance of two fingerprints depends on the similarity alone,
whatever words repeat. A text's windows of exactly an item's number of words are
fingerprinted where enough of their shingles belong to items of that size (a
window that has fewer can't reach the similarity, so nothing is lost).
Multi-index Hamming blocks find all items of the window's size within the
radius, and the weighted similarity of the shingles, exact, confirms them.

A benchmark of up to ``PASS_WORDS`` words is held by every task. A larger one
stays a table: windows that pass a bounded bit table of its shingles meet
blocks of items of their size in a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import SHINGLE_WORDS, Words, chunks, mix, windows_of
from .shared import Scratch, having_ids, written

#: 100 * shared weight >= PERCENT * weight of both together.
PERCENT = 75
BITS, BLOCKS = 128, 8
#: Two multisets of one size at the similarity have a cosine of 6 / 7 or more, so
#: that a bit differs with a probability of at most arccos(6 / 7) / pi = 0.172: 22
#: bits of 128 on average. Beyond 47 lies one such pair in 26 million.
RADIUS = 47
#: Words of the items that a task holds: all of a small benchmark, or one block.
PASS_WORDS = 200_000
#: Bits of the table of shingles of a large benchmark: 16 for each word, 64 MB at most.
WORD_BITS, MOST_BITS = 16, 1 << 29
#: Windows that meet one block of items in one task.
PIECE = 100_000
#: Windows that are fingerprinted at once.
AT_ONCE = 1024
_U = np.uint64


def features_of(shingles: np.ndarray) -> np.ndarray:
    """Each row's multiset of shingles as a set: copies beyond the first are marked by their number."""
    rows = np.sort(shingles, axis=1)
    order = np.arange(rows.shape[1])
    new = np.ones(rows.shape, dtype=bool)
    np.not_equal(rows[:, 1:], rows[:, :-1], out=new[:, 1:])
    copy = order - np.maximum.accumulate(np.where(new, order, 0), axis=1)
    return np.where(copy > 0, mix(rows ^ mix(copy.astype(np.uint64))), rows)


def prints_of(features: np.ndarray) -> np.ndarray:
    """Fingerprints as BLOCKS unsigned 16-bit blocks: the sign of each bit's sum."""
    halves = np.stack([mix(features ^ _U(0xA5A5A5A5)), mix(features + _U(0x5A5A5A5A))], axis=-1)
    bits = np.unpackbits(np.ascontiguousarray(halves).view(np.uint8), axis=-1, bitorder="little").reshape(*features.shape, BITS)
    sums = 2 * bits.sum(axis=1, dtype=np.int32) - features.shape[1]
    return np.packbits(sums > 0, axis=-1, bitorder="little").view(np.uint16)


def _within(errors: int) -> list[int]:
    return [sum(1 << b for b in c) for e in range(errors + 1) for c in combinations(range(16), e)]


def shingles_of(hashes: np.ndarray) -> np.ndarray:
    """Shingles in order, with repetitions; fewer words than a shingle has make one."""
    size = min(SHINGLE_WORDS, len(hashes))
    return windows_of(hashes, np.array([0, len(hashes)]), size)[1] if size else np.empty(0, dtype=np.uint64)


def least_shared(n: int, percent: int = PERCENT) -> int:
    """Fewest shingles that two runs of ``n`` shingles share at the similarity."""
    return -(-2 * n * percent // (100 + percent))


@dataclass
class Index:
    """Items of one number of words: fingerprints in multi-index tables, and their features."""

    ids: list
    prints: np.ndarray
    features: np.ndarray
    known: np.ndarray
    tables: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, ids: list, shingles: np.ndarray, radius: int = RADIUS) -> Index:
        features = np.sort(features_of(shingles), axis=1)
        prints = np.concatenate([prints_of(features[k : k + AT_ONCE]) for k in range(0, len(ids), AT_ONCE)])
        # By pigeonhole one block differs in at most radius // BLOCKS bits. Half of
        # these errors are spelled out for the items and half for the windows.
        variants = np.array(_within((radius // BLOCKS + 1) // 2), dtype=np.uint16)
        tables = []
        for b in range(BLOCKS):
            keys = (prints[:, b, None] ^ variants[None, :]).ravel()
            order = np.argsort(keys, kind="stable")
            tables.append((keys[order], np.repeat(np.arange(len(ids), dtype=np.int32), len(variants))[order]))
        return cls(ids, prints, features, np.unique(shingles), tables)

    def near(self, prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
        """All (print, item) pairs within the radius."""
        variants = np.array(_within(radius // BLOCKS // 2), dtype=np.uint16)
        found = []
        for b, (keys, items) in enumerate(self.tables):
            probe = (prints[:, b, None] ^ variants[None, :]).ravel()
            low, high = np.searchsorted(keys, probe), np.searchsorted(keys, probe, side="right")
            n = high - low
            if not n.any():
                continue
            left = np.repeat(np.repeat(np.arange(len(prints)), len(variants)), n)
            at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            found.append(np.unique(left * len(self.ids) + items[at]))
        pairs = np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.int64)
        left, item = pairs // len(self.ids), pairs % len(self.ids)
        apart = np.bitwise_count(prints[left] ^ self.prints[item]).sum(axis=1)
        return left[apart <= radius], item[apart <= radius]

    def matches(self, features: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[int, object]]:
        """(row, item id) of the windows, one a row, that repeat an item."""
        least = least_shared(features.shape[1], percent)
        for row, item in zip(*(x.tolist() for x in self.near(prints_of(features))), strict=True):
            if np.isin(features[row], self.features[item], assume_unique=True).sum() >= least:
                yield row, self.ids[item]


def window_starts(w: Words, size: int, at: np.ndarray, percent: int) -> np.ndarray:
    """Starts of the windows of ``size`` words with enough of the shingles that
    begin at the ascending words ``at`` to reach the similarity."""
    n = max(1, size - SHINGLE_WORDS + 1)
    least = least_shared(n, percent)
    if len(at) < least:
        return np.empty(0, dtype=np.int64)
    # Windows that hold the j-th to the (j + least - 1)-th of these shingles.
    first, last = at[: len(at) - least + 1], at[least - 1 :]
    low = np.maximum(last - n + 1, w.first[w.doc[first]])
    high = np.minimum(first, w.first[w.doc[first] + 1] - size)
    count = np.maximum(high - low + 1, 0)
    starts = np.unique(np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum())))
    return starts[w.doc[starts] == w.doc[starts + size - 1]]


class Spans:
    """Shingle hashes of some texts by length in words, and windows of them."""

    def __init__(self, texts: list[str]):
        self.words = Words(texts)
        self.of_span: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, hashes, hash by start) of the shingles in windows of ``size`` words."""
        span = min(SHINGLE_WORDS, size)
        if span not in self.of_span:
            at, hashes = self.words.windows(span)
            full = np.zeros(len(self.words.hashes), dtype=np.uint64)
            full[at] = hashes
            self.of_span[span] = at, hashes, full
        return self.of_span[span]

    def features(self, size: int, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(starts, features) of the windows, some at a time."""
        full, n = self.shingles(size)[2], max(1, size - SHINGLE_WORDS + 1)
        for k in range(0, len(starts), AT_ONCE):
            part = starts[k : k + AT_ONCE]
            yield part, features_of(full[part[:, None] + np.arange(n)])


@dataclass
class Items:
    """The items that a task holds, by their number of words."""

    of_size: dict[int, Index]

    @classmethod
    def of(cls, ids: list, words: list[np.ndarray]) -> Items:
        sizes = np.array([len(w) for w in words])
        out = {}
        for n in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == n).tolist()
            out[n] = Index.of([ids[i] for i in own], np.stack([shingles_of(words[i]) for i in own]))
        return cls(out)

    def hits(self, texts: list[str], percent: int = PERCENT) -> list[set]:
        """For each text the ids of the items that one of its windows repeats."""
        spans = Spans(texts)
        w = spans.words
        out: list[set] = [set() for _ in texts]
        known = {}
        for size, index in self.of_size.items():
            span = min(SHINGLE_WORDS, size)
            at, hashes, _ = spans.shingles(size)
            if span not in known:  # what no item of any size has is dropped once
                every = np.unique(np.concatenate([x.known for n, x in self.of_size.items() if min(SHINGLE_WORDS, n) == span]))
                held = _among(every, hashes)
                known[span] = at[held], hashes[held]
            at, hashes = known[span]
            starts = window_starts(w, size, at[_among(index.known, hashes)], percent)
            for part, features in spans.features(size, starts):
                for row, item in index.matches(features, percent):
                    out[w.doc[part[row]]].add(item)
        return out


def _among(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, size, shingles) of the items that have an id and words; equal rows count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in chunks(batch.column(1).to_pylist()):
                w = Words(part)
                lists = [shingles_of(w.hashes[a:b]).view(np.int64) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
                rows = pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(w.counts, pa.int32()), pa.array(lists, pa.list_(pa.int64()))], names=["item_id", "size", "shingles"])
                yield rows.filter(pa.array(w.counts > 0))

    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(run, "item_id long, size int, shingles array<long>").distinct()


def _held(items: DataFrame) -> Items:
    """``items``, whose size is checked before, as what a task holds."""
    rows = items.orderBy("item_id", "size").collect()
    sizes: dict[int, list] = {}
    for r in rows:
        sizes.setdefault(r["size"], []).append(r)
    return Items({n: Index.of([r["item_id"] for r in own], np.array([r["shingles"] for r in own], dtype=np.int64).view(np.uint64)) for n, own in sorted(sizes.items())})


def _bit_table(items: DataFrame, words: int) -> np.ndarray:
    """Bits set for the (size, shingle) pairs of the items, as 64-bit words: their number is bounded."""
    bits = min(MOST_BITS, 1 << max(10, (WORD_BITS * words).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.repeat(batch.column(0).to_numpy(), np.diff(lists.offsets.to_numpy()))
            places = np.unique(_places(lists.flatten().to_numpy().view(np.uint64), sizes, bits))
            yield pa.RecordBatch.from_arrays([pa.array((places >> 6).astype(np.int64)), pa.array(np.left_shift(_U(1), (places & 63).astype(np.uint64)).view(np.int64))], names=["word", "mask"])

    masks = items.select("size", "shingles").mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    table = np.zeros(bits // 64, dtype=np.int64)
    table[masks["word"].to_numpy()] = masks["mask"].to_numpy()
    return table.view(np.uint64)


def _places(shingles: np.ndarray, sizes, bits: int) -> np.ndarray:
    return (mix(shingles ^ mix(np.asarray(sizes).astype(np.uint64))) % _U(bits)).astype(np.int64)


def _candidate_windows(docs: DataFrame, sizes: list[int], table: np.ndarray, percent: int) -> DataFrame:
    """(key, size, features) of the windows that may repeat an item of their size."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for first, texts in chunks(batch.column(1).to_pylist()):
                spans = Spans(texts)
                for size in sizes:
                    at, hashes, _ = spans.shingles(size)
                    places = _places(hashes, size, 64 * len(bits))
                    held = (bits[places >> 6] >> (places & 63).astype(np.uint64)) & _U(1) > 0
                    for part, features in spans.features(size, window_starts(spans.words, size, at[held], percent)):
                        n = features.shape[1]
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * n, pa.int32()), pa.array(features.ravel().view(np.int64)))
                        yield pa.RecordBatch.from_arrays([pa.array(keys[first + spans.words.doc[part]]), pa.array(np.full(len(part), size), pa.int32()), lists], names=["key", "size", "features"])

    return docs.select(_row_key(docs), "text").mapInArrow(run, "key long, size int, features array<long>").distinct()


def _row_key(docs: DataFrame):
    return F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key")


def _met(windows: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """(key, item_id): windows and blocks of items of their size, joined by a
    shuffle. A size with many items is cut into blocks of ``PASS_WORDS`` words,
    one with many windows into pieces, and each piece meets each block."""
    blocks = items.groupBy("size").agg(F.ceil(F.count("*") * F.col("size") / PASS_WORDS).cast("int").alias("blocks"))
    pieces = windows.groupBy("size").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    plan = F.broadcast(blocks.join(pieces, "size"))  # one row for each number of words
    of_items = items.join(plan, "size").select("size", F.pmod(F.xxhash64("item_id", "shingles"), F.col("blocks").cast("long")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.lit(0).alias("kind"), F.col("item_id").alias("id"), F.col("shingles").alias("x"))
    of_windows = windows.join(plan, "size").select("size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"), F.pmod(F.xxhash64("key", "features"), "pieces").cast("int").alias("piece"), F.lit(1).alias("kind"), F.col("key").alias("id"), F.col("features").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, rows, index = None, [], [], None
        for batch in batches:
            tags = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            cuts = [0, *(np.flatnonzero((tags[1:] != tags[:-1]).any(axis=1)) + 1).tolist(), len(tags)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if group != (now := tuple(tags[a, :3].tolist())):
                    group, ids, rows, index = now, [], [], None
                x = batch.column(5).slice(a, b - a).flatten().to_numpy().view(np.uint64).reshape(b - a, -1)
                own = batch.column(4).slice(a, b - a).to_numpy()
                if tags[a, 3] == 0:
                    ids += own.tolist()
                    rows.append(x)
                elif rows:
                    index = index or Index.of(ids, np.concatenate(rows))
                    found = [m for k in range(0, b - a, AT_ONCE) for m in ((int(own[k + r]), i) for r, i in index.matches(x[k : k + AT_ONCE], percent))]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["key", "item_id"])

    rows = of_items.union(of_windows).repartition("size", "block", "piece").sortWithinPartitions("size", "block", "piece", "kind")
    return rows.mapInArrow(run, "key long, item_id long").distinct()


def _found(docs: DataFrame, benchmark: DataFrame, percent: int, pass_words: int) -> Items | DataFrame:
    """What a task can hold of a small benchmark, or the (key, item_id) pairs that a large one gives."""
    scratch = Scratch(docs.sparkSession)
    items = scratch.write(_items(benchmark), "items")
    words = items.agg(F.coalesce(F.sum(F.col("size").cast("long")), F.lit(0))).first()[0]
    if words <= pass_words:
        held = _held(items)
        scratch.drop()
        return held
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())
    windows = scratch.write(_candidate_windows(docs, sizes, _bit_table(items, words), percent), "windows")
    found = written(_met(windows, items, percent), "leaks")
    scratch.drop()
    return found


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, pass_words: int = PASS_WORDS) -> DataFrame:
    """(doc_id, item_ids): the benchmark items that each text repeats, ascending.

    A window of as many words as the item has, in A-Z lower-cased words, with a
    weighted Jaccard of 5-word shingles of 0.75 or more. One row for every row
    of ``docs``; null and empty texts repeat nothing. Items without words or
    with a null id are left out.
    """
    found = _found(docs, benchmark, percent, pass_words)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if isinstance(found, DataFrame):
        lists = found.groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
        out = rows.select("doc_id", _row_key(rows)).join(lists, "key", "left")
        return out.select("doc_id", F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"))
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [sorted(x) for _, part in chunks(batch.column(1).to_pylist()) for x in shared.value.hits(part, percent)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "item_ids"])

    return rows.mapInArrow(run, "doc_id long, item_ids array<long>")


def cleaned(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, pass_words: int = PASS_WORDS) -> DataFrame:
    """The rows of ``docs`` that repeat no item, all columns as they are."""
    found = _found(docs, benchmark, percent, pass_words)
    if isinstance(found, DataFrame):
        keyed = docs.withColumn("__row_key", _row_key(docs))
        return having_ids(keyed, found.select("key"), "__row_key", "left_anti").drop("__row_key")
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [not x for _, part in chunks(batch.column("text").to_pylist()) for x in shared.value.hits(part, percent)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
