"""Operator 1: MinHash near-duplicate groups by a multi-index Hamming join.

A document is its set of word shingles. Equal sets form one class; each class
has a signature of ``COMPONENTS`` b-bit minima. The signature is split into
chunks, and every way of leaving ``ERRORS`` components of a chunk out makes a
key: by pigeonhole two signatures that differ in at most ``GUARANTEED``
components agree on a key, and of two sets at the threshold similarity fewer
than one pair in a million agrees on none. Links are confirmed on full sets, in two
rounds. First the classes of a key are compared in blocks, each together with
the smallest class of the key, which takes of the order of n comparisons for n
near copies and joins most of them. Then classes that meet in a key, are not yet
in one component and have near sketches are compared in cells of two blocks.
What a block or cell emits is a spanning set of its links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Words, chunks, mix, shingle_sets
from .shared import BROADCAST_IDS, Scratch, checkpointed, having_ids

#: Linked where 100 * shared >= PERCENT * both together.
PERCENT = 75
COMPONENTS, CHUNK, ERRORS = 126, 6, 1
CHUNKS = COMPONENTS // CHUNK
#: Largest signature distance at which a shared key is certain.
GUARANTEED = CHUNKS * (ERRORS + 1) - 1
#: Sketches have one bit a component, so that signatures within the guaranteed
#: distance have sketches within it. Those of two sets at the threshold differ
#: in 15.75 bits of 126 on average, with a deviation of 3.7.
SKETCH_RADIUS = GUARANTEED
#: Classes of a block; rows of a key, or edges of a node, that meet in one piece.
BLOCK, PART = 256, 4096
#: Pairs of rows that are looked at in one piece.
PAIRS = 1_000_000
#: Shingle columns that a cell multiplies at once.
COLUMNS = 8192
_U = np.uint64
_FACTORS = mix(np.arange(1, COMPONENTS + 1, dtype=np.uint64)) | _U(1)
_KEPT = [(c, [c * CHUNK + i for i in kept]) for c in range(CHUNKS) for kept in combinations(range(CHUNK), CHUNK - ERRORS)]


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(two 64-bit class hashes, COMPONENTS 16-bit components) of non-empty sets."""
    flat, second = (np.concatenate(x) for x in zip(*sets, strict=True))
    at = np.cumsum([0] + [len(s) for s, _ in sets[:-1]])
    a = np.add.reduceat(mix(flat ^ _U(0x1234567)), at)
    b = np.add.reduceat(mix(second + _U(0x89ABCDEF)), at)
    out = np.empty((len(sets), COMPONENTS), dtype=np.uint16)
    scaled = np.empty_like(flat)
    for k in range(COMPONENTS):
        np.multiply(flat, _FACTORS[k], out=scaled)
        out[:, k] = mix(np.minimum.reduceat(scaled, at)) >> _U(48)
    return a, b, out


def keys_of(components: np.ndarray) -> np.ndarray:
    """One key for each chunk and each choice of ERRORS components left out."""
    wide = components.astype(np.uint64)
    out = np.empty((len(wide), len(_KEPT)), dtype=np.uint64)
    for k, (_, kept) in enumerate(_KEPT):
        key = np.full(len(wide), k + 1, dtype=np.uint64)
        for c in kept:
            key = mix(key * _U(0xD6E8FEB86659FD93) + wide[:, c])
        out[:, k] = key
    return out.view(np.int64)


def sketch(components: np.ndarray) -> np.ndarray:
    bits = np.zeros((len(components), 128), dtype=np.uint8)
    bits[:, :COMPONENTS] = components & 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64)


def _binary(rows: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(rows)
    return pa.Array.from_buffers(pa.binary(raw.shape[1] * raw.itemsize), len(raw), [None, pa.py_buffer(raw)]).cast(pa.binary())


def shingled(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, c1 and c2 (equal for equal sets) and the signature; no signature for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in chunks(batch.column(1).to_pylist()):
                sets = shingle_sets(Words(part))
                full = np.flatnonzero([len(s) > 0 for s, _ in sets])
                a, b = np.zeros(len(sets), dtype=np.uint64), np.zeros(len(sets), dtype=np.uint64)
                c = np.zeros((len(sets), COMPONENTS), dtype=np.uint16)
                if len(full):
                    a[full], b[full], c[full] = signatures([sets[i] for i in full.tolist()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array([len(s) for s, _ in sets], pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), _binary(c)],
                    names=["doc_id", "n_shingles", "c1", "c2", "signature"],
                )

    schema = "doc_id long, n_shingles long, c1 long, c2 long, signature binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _components_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), COMPONENTS)


def meetings(classes: DataFrame) -> DataFrame:
    """(key, id, lead, seat) for the keys that two classes or more share.

    ``lead``: the smallest id of the key; ``seat``: counts pieces of ``BLOCK``
    rows of a key with many. The rows of a key pass as a sorted stream; no more
    than a batch is held.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = keys_of(_components_of(batch.column(1)))
            offsets = np.arange(0, keys.size + 1, keys.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.ravel()))], names=["id", "keys"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_id, lead, count, pending = None, None, None, 0, False
        for batch in batches:
            key, ident = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            if not len(key):
                continue
            new = np.concatenate([[last_key is None or key[0] != last_key], key[1:] != key[:-1]])
            start = np.flatnonzero(new)
            run = np.cumsum(new) - 1  # -1: goes on from the batch before
            order = np.arange(len(key))
            position = np.where(run >= 0, order - start[np.maximum(run, 0)] if len(start) else 0, order + count)
            first = np.where(run >= 0, ident[start[np.maximum(run, 0)]] if len(start) else 0, lead if lead is not None else 0)
            follows = np.concatenate([~new[1:], [False]])
            keep = (position > 0) | follows  # the last row, if alone so far, waits for the next batch
            out_key, out_id, out_lead, out_seat = key[keep], ident[keep], first[keep], position[keep] // BLOCK
            if pending and not new[0]:
                out_key, out_id, out_lead, out_seat = np.append(out_key, last_key), np.append(out_id, last_id), np.append(out_lead, last_id), np.append(out_seat, 0)
            last_key, last_id, lead, count, pending = key[-1], ident[-1], first[-1], int(position[-1]) + 1, not keep[-1]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (out_key, out_id, out_lead, out_seat)], names=["key", "id", "lead", "seat"])

    rows = classes.select("id", "signature").mapInArrow(keyed, "id long, keys array<long>").select("id", F.explode("keys").alias("key")).select("key", "id")
    return rows.repartition("key").sortWithinPartitions("key", "id").mapInArrow(runs, "key long, id long, lead long, seat long")


def _grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """The rows of each group of equal leading columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(i)) for i in range(n_keys)], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            key = tuple(keys[a].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _may_link(left: np.ndarray, right: np.ndarray, rows: dict[str, np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of rows have near sketches and sizes that allow the similarity."""
    # Unsigned, since the bits of negative numbers are counted after taking their size.
    apart = sum(np.bitwise_count((rows[s][left] ^ rows[s][right]).view(np.uint64)) for s in ("s0", "s1"))
    a, b = rows["n"][left], rows["n"][right]
    return (apart <= SKETCH_RADIUS) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))


def _near_pairs(rows: dict[str, np.ndarray], bounds: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left, right) rows of the groups between ``bounds`` that may be linked, PAIRS or so at a time."""
    ends = np.repeat(bounds[1:], np.diff(bounds))
    partners = ends - np.arange(bounds[-1]) - 1
    total = np.concatenate([[0], np.cumsum(partners)])
    at = 0
    while at < len(partners):
        to = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, side="right")) - 1)
        n = partners[at:to]
        left = np.repeat(np.arange(at, to), n)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        # Of two pieces of a key, rows of one piece meet those of the other alone.
        ok = (rows["low"][left] == rows["high"][left]) | (rows["part"][left] != rows["part"][right])
        ok &= rows["component"][left] != rows["component"][right]
        left, right = left[ok], right[ok]
        ok = _may_link(left, right, rows, percent)
        yield left[ok], right[ok]
        at = to


def blocks_of(met: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, lead, block, n, s0, s1): classes that meet, in blocks of at most ``BLOCK`` that share a key.

    A class takes, of its keys with the smallest ``lead``, the first one.
    """

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = sketch(_components_of(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits[:, 0]), pa.array(bits[:, 1])], names=["id", "n", "s0", "s1"])

    first = met.groupBy("id").agg(F.min(F.struct("lead", "key", "seat")).alias("f"))
    first = first.select("id", F.col("f.lead").alias("lead"), F.xxhash64("f.key", "f.seat").alias("block"))
    return classes.select("id", "n", "signature").mapInArrow(sketched, "id long, n long, s0 long, s1 long").join(first, "id")


def own_cells(members: DataFrame) -> DataFrame:
    """(left, right, id): each block by itself, and the lead of its key with it."""
    both = members.select("block", "id").union(members.select("block", F.col("lead").alias("id"))).distinct()
    return both.select(F.col("block").alias("left"), F.col("block").alias("right"), "id")


def settled(members: DataFrame, linked: DataFrame) -> DataFrame:
    """``members`` with the ``component``, the class that ``linked`` (id, component) joins them with, or their own.

    Classes that those didn't join with their lead get blocks of their own, so
    that few of them don't bring the blocks of all others together.
    """
    out = members.join(linked, "id", "left").withColumn("component", F.coalesce("component", "id"))
    apart = F.col("component") > F.col("lead")
    sizes = _checked(out.where(apart).groupBy("lead").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where("blocks > 1"))
    own = F.xxhash64("lead", F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))), F.lit("apart"))
    return out.join(sizes, "lead", "left").withColumn("block", F.when(apart, own).otherwise(F.col("block"))).drop("blocks")


def _checked(rows: DataFrame) -> DataFrame:
    """``rows``, broadcast if there are no more than ``BROADCAST_IDS``."""
    rows = checkpointed(rows)
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def pieces(met: DataFrame, members: DataFrame) -> DataFrame:
    """(key, low, high, part, n, s0, s1, block, component): rows of a key that meet in one task.

    A key of up to ``PART`` rows is one piece, 0. Of a larger one the rows of
    its commonest component don't meet each other: they are cut into pieces
    that meet the pieces of all other rows alone. A key whose rows are one
    component isn't sent at all.
    """
    seats = -(-PART // BLOCK)
    hot = _checked(met.where(F.col("seat") >= seats).select("key").distinct())
    known = met.select("key", "id").join(members.select("id", "component"), "id")
    counts = known.join(hot, "key").groupBy("key", "component").count()
    counts = counts.groupBy("key").agg(F.max(F.struct("count", "component")).alias("most"), F.sum("count").alias("total"))
    cut = [F.ceil(x / PART).alias(a) for x, a in ((F.col("most.count"), "mains"), (F.col("total") - F.col("most.count"), "others"))]
    counts = _checked(counts.select("key", F.col("most.component").alias("main"), *cut))
    rows = met.select("key", "id").join(members, "id").join(counts, "key", "left").where("others is null or others > 0")
    at = F.xxhash64("id")
    is_main = F.col("component") == F.col("main")
    part = F.when(F.col("main").isNull(), 0).when(is_main, F.col("others") + F.pmod(at, "mains")).otherwise(F.pmod(at, "others"))
    last = F.when(F.col("main").isNull(), 0).when(is_main, F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1)
    rows = rows.withColumn("part", part.cast("long")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    return rows.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "n", "s0", "s1", "block", "component")


def near_blocks(met: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(left, right): blocks with classes of different components that meet in a key and may be linked."""
    names = ("key", "low", "high", "part", "n", "s0", "s1", "block", "component")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.empty((0, 2), dtype=np.int64)
        held: dict[str, np.ndarray] = {c: np.empty(0, dtype=np.int64) for c in names}

        def found(rows: dict[str, np.ndarray], last: bool) -> Iterator[np.ndarray]:
            new = (rows["key"][1:] != rows["key"][:-1]) | (rows["low"][1:] != rows["low"][:-1]) | (rows["high"][1:] != rows["high"][:-1])
            bounds = np.concatenate([[0], np.flatnonzero(new) + 1, [len(rows["key"])] if last else np.empty(0, dtype=np.int64)]).astype(np.int64)
            done = int(bounds[-1])
            for c in names:
                held[c] = rows[c][done:]
            if not done:
                return
            component, sizes = rows["component"][:done], np.diff(bounds)
            mixed = np.minimum.reduceat(component, bounds[:-1]) < np.maximum.reduceat(component, bounds[:-1])
            kept = np.flatnonzero(np.repeat(mixed, sizes))
            rows = {c: v[kept] for c, v in rows.items()}
            for left, right in _near_pairs(rows, np.concatenate([[0], np.cumsum(sizes[mixed])]), percent):
                yield np.sort(np.stack([rows["block"][left], rows["block"][right]], axis=1), axis=1)

        def fresh(pairs: np.ndarray) -> pa.RecordBatch:
            nonlocal seen
            pairs = np.unique(pairs, axis=0)
            both, first = np.unique(np.concatenate([seen, pairs]), axis=0, return_index=True)
            pairs = both[first >= len(seen)]
            seen = both if len(both) <= 100_000 else both[:0]
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["left", "right"])

        for batch in batches:
            if batch.num_rows:
                rows = {c: np.concatenate([held[c], batch.column(i).to_numpy()]) for i, c in enumerate(names)}
                yield from (fresh(p) for p in found(rows, False) if len(p))
        if len(held["key"]):
            yield from (fresh(p) for p in found(dict(held), True) if len(p))

    rows = pieces(met, members).repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return rows.mapInArrow(run, "left long, right long").distinct()


def _spanning(table: pa.Table, percent: int) -> list[tuple[int, int]]:
    """(class, smallest class that it is linked with within the cell)."""
    ids, texts = table.column("id").to_pylist(), table.column("text").to_pylist()
    sets: list[tuple[np.ndarray, np.ndarray]] = []
    for _, part in chunks(texts):
        sets += shingle_sets(Words(part))
    sizes = np.array([len(s) for s, _ in sets])
    flat, second = (np.concatenate(x) for x in zip(*sets, strict=True))
    row = np.repeat(np.arange(len(sets)), sizes)
    _, first, column, count = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
    if (second[first][column] != second).any():
        _, column, count = np.unique(np.stack([flat, second], axis=1), axis=0, return_inverse=True, return_counts=True)
    shared = count > 1
    column, row = (np.cumsum(shared) - 1)[column[shared[column]]], row[shared[column]]
    both = np.zeros((len(sets), len(sets)), dtype=np.float64)
    for at in range(0, int(shared.sum()), COLUMNS):
        here = (column >= at) & (column < at + COLUMNS)
        x = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        x[row[here], column[here] - at] = 1
        both += x @ x.T
    linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    order = np.argsort(np.array(ids), kind="stable")
    linked = linked[np.ix_(order, order)]
    lowest = np.arange(len(ids))
    while True:
        new = np.where(linked, lowest[None, :], len(ids)).min(axis=1, initial=len(ids))
        new = np.minimum(lowest, new)
        new = new[new]
        if (new == lowest).all():
            break
        lowest = new
    ids = np.array(ids)[order]
    return [(int(a), int(b)) for a, b in zip(ids, ids[lowest], strict=True) if a != b]


def links(cells: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(a, b): links, confirmed on full sets, that span the links of each cell (left, right) of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, 2):
            if table.num_rows > 1 and (found := _spanning(table, percent)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = having_ids(texts, cells.select("id"), "doc_id", "left_semi")
    rows = cells.join(texts, cells["id"] == texts["doc_id"]).select("left", "right", "id", "text")
    return rows.repartition("left", "right").sortWithinPartitions("left", "right", "id").mapInArrow(run, "a long, b long").distinct()


def joined(rows: DataFrame, lookup: DataFrame, on: list[str], by: str) -> DataFrame:
    """``rows`` left-joined with ``lookup``, unique in ``on``, whose column n counts its rows.

    A key with more than ``PART`` rows is cut by ``by`` into pieces, each with a
    copy of its row of ``lookup``, so that no task holds all rows of a key.
    """
    cut = F.ceil(F.col("n") / PART).cast("int")
    hot = lookup.where(F.col("n") > PART).select(*on, cut.alias("__cut"))
    if hot.count() <= BROADCAST_IDS:
        hot = F.broadcast(hot)
    left = rows.join(hot, on, "left").withColumn("__piece", F.coalesce(F.pmod(F.xxhash64(by), F.col("__cut")), F.lit(0)).cast("int")).drop("__cut")
    right = lookup.withColumn("__piece", F.explode(F.sequence(F.lit(0), cut - 1))).drop("n")
    return left.join(right, [*on, "__piece"], "left").drop("__piece")


def connected(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id of an edge reaches.

    Alternating large-star and small-star steps on a table of edges, which is
    checkpointed after every round, until it no longer changes.
    """
    edges = checkpointed(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")))
        large = checkpointed(joined(edges, low.withColumnRenamed("a", "b"), ["b"], "a").select("a", F.col("m").alias("b")).where("a != b").distinct())
        low = checkpointed(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = joined(large, low, ["a"], "b")
        edges = checkpointed(small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct())
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
        state = new


def near_duplicates(docs: DataFrame, percent: int = PERCENT, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    ``component_id`` is the smallest doc_id that links reach, the row's own
    included; ``kept`` tells whether that is the row itself. Null, empty and
    blank texts have no shingles and are linked with nothing. Equal texts are
    one class, so repeated rows are kept or not together. A row without a
    doc_id is kept, without a component. Other columns play no part. Two
    tables of ``scratch`` stay until the result has been read.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = scratch.write(shingled(docs), "shingled")
    full = rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = full.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "n_shingles", "signature")).alias("r"), F.count("*").alias("copies"))
    classes = classes.select("c1", "c2", F.col("r.doc_id").alias("id"), F.col("r.n_shingles").alias("n"), F.col("r.signature").alias("signature"), "copies")
    classes = scratch.write(classes, "classes")
    met = scratch.write(meetings(classes), "met")
    members = scratch.write(blocks_of(met, classes), "members")
    first = scratch.write(links(own_cells(members), docs, percent), "first")
    # A lead is the smallest of its cell, so that what is linked with it has it as its smallest link.
    linked = first.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    members_now = scratch.write(settled(members, linked), "settled")
    near = scratch.write(near_blocks(met, members_now, percent), "near")
    sides = near.select("left", "right", F.explode(F.array_distinct(F.array("left", "right"))).alias("block"))
    cells = scratch.write(sides.join(members_now.select("id", "block"), "block").select("left", "right", "id"), "cells")
    second = links(cells, docs, percent)
    joins = members_now.where("id != component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    groups = connected(scratch.write(second.union(joins), "links"))
    scratch.drop("met", "members", "first", "settled", "near", "cells", "links")
    of_class = classes.select("c1", "c2", "id", F.col("copies").alias("n")).join(groups, "id", "left").select("c1", "c2", F.coalesce("component", "id").alias("component"), "n")
    # Rows without shingles have a class of their own, so that they don't meet in one task.
    own = F.col("n_shingles") == 0
    left = rows.select("doc_id", "n_shingles", F.when(own, F.col("doc_id")).otherwise(F.col("c1")).alias("c1"), F.when(own, F.lit(None)).otherwise(F.col("c2")).alias("c2"))
    out = joined(left, of_class, ["c1", "c2"], "doc_id")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they are."""
    scratch = Scratch(docs.sparkSession)
    gone = near_duplicates(docs, percent, scratch).where("not kept").select("doc_id")
    out = having_ids(docs, gone, "doc_id", "left_anti")
    scratch.drop()
    return out
