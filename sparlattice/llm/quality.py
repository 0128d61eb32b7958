"""Operator 10: quality rules with an isolation forest on their statistics.

Fixed rules fail short and repetitive texts. The rest are judged by how soon
random splits of the statistics' ranges isolate them from good rows; the forest
is grown from labelled rows, and the path length that rejects is calibrated on
their labels, all of them: ranges, separations and costs are counted by Spark,
and only the rows that trees are grown from are gathered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import Words, chunks, mix
from .shared import Scratch, having_ids

TREES, SAMPLE, SEED, FOLDS = 200, 256, 10, 5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Rejecting a good row counts as much as keeping so many bad ones.
GOOD_WEIGHT = 50
REPEAT_WINDOW = 3
#: Groups of good rows in which they are numbered, and ranges in which ordered values are summed.
GROUPS, RANGES = 1_000, 256
SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_BLANK = "\t\n\v\f\r "
_U = np.uint64


def text_stats(texts: list[str]) -> dict[str, np.ndarray]:
    w = Words(texts, lower=False)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[w.ends] - total[w.begins]

    lengths = np.concatenate([[0], np.cumsum(w.ends_of_words - w.starts)])
    symbols = np.zeros(128, dtype=bool)
    symbols[[ord(c) for c in SYMBOLS]] = True
    at, hashes = w.windows(REPEAT_WINDOW)
    _, inverse, counts = np.unique(mix(hashes ^ mix(w.doc[at].astype(np.uint64))), return_inverse=True, return_counts=True)
    covered = np.zeros(len(w.hashes), dtype=np.int64)
    twice = at[counts[inverse] > 1] if len(at) else at
    for j in range(REPEAT_WINDOW):
        covered[twice + j] = 1
    repeats = np.concatenate([[0], np.cumsum(covered)])
    dup = []
    for text in texts:
        lines = [x for x in text.split("\n") if x.strip(_BLANK)]
        dup.append(len(lines) - len(set(lines)))
    return {
        "n_words": w.counts,
        "word_chars": lengths[w.first[1:]] - lengths[w.first[:-1]],
        "n_symbols": per_text((w.points < 128) & symbols[np.minimum(w.points, 127)]),
        "n_dup_lines": np.array(dup, dtype=np.int64),
        "n_repeat_words": repeats[w.first[1:]] - repeats[w.first[:-1]],
    }


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def rates(s: dict[str, np.ndarray]) -> np.ndarray:
    """The statistics per word, as the forest sees them."""
    n = np.maximum(1, s["n_words"]).astype(float)
    return np.column_stack([s["word_chars"] / n, np.log1p(100 * s["n_symbols"] / n), np.log1p(100 * s["n_dup_lines"] / n), s["n_repeat_words"] / n])


@dataclass
class Forest:
    """Isolation trees as arrays: node k of a tree splits column ``column[k]`` at
    ``cut[k]`` and has its children at ``child[k]`` and ``child[k] + 1``;
    leaves have child -1 and the path length they stand for."""

    column: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    length: np.ndarray
    roots: list[int]

    def path_lengths(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while (inner := self.child[node] >= 0).any():
                k = node[inner]
                node[inner] = self.child[k] + (x[rows[inner], self.column[k]] >= self.cut[k])
            total += self.length[node]
        return total / len(self.roots)


def _average_path(n: int) -> float:
    """Mean path of an unsuccessful search in a binary tree of n points."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(samples: list[np.ndarray], low: np.ndarray, high: np.ndarray, odds: np.ndarray, seed: int = SEED) -> Forest:
    """A tree over each of ``samples``, split at random within the box ``low``..``high``.

    The box spans all rows, anomalous ones too, and is halved with each split,
    so that a split may part empty space from the sample: what lies there is
    isolated at once. ``odds``: how often each statistic is the one to split by.
    """
    rng = np.random.default_rng(seed)
    column, cut, child, length, roots = [], [], [], [], []

    def node() -> int:
        for a, v in ((column, 0), (cut, 0.0), (child, -1), (length, 0.0)):
            a.append(v)
        return len(child) - 1

    deepest = int(np.ceil(np.log2(SAMPLE))) + 2
    for x in samples:
        roots.append(node())
        todo = [(roots[-1], np.arange(len(x)), 0, low, high)]
        while todo:
            k, rows, depth, lo, hi = todo.pop()
            open_columns = np.flatnonzero((hi > lo) & (odds > 0))
            if len(rows) < 2 or depth >= deepest or not len(open_columns):
                length[k] = depth + _average_path(len(rows))
                continue
            c = column[k] = int(rng.choice(open_columns, p=odds[open_columns] / odds[open_columns].sum()))
            cut[k] = float(rng.uniform(lo[c], hi[c]))
            right = x[rows, c] >= cut[k]
            child[k] = node()
            node()
            left_hi, right_lo = hi.copy(), lo.copy()
            left_hi[c] = right_lo[c] = cut[k]
            todo += [(child[k], rows[~right], depth + 1, lo, left_hi), (child[k] + 1, rows[right], depth + 1, right_lo, hi)]
    return Forest(np.array(column), np.array(cut), np.array(child), np.array(length), roots)


@dataclass
class Model:
    forest: Forest | None
    shortest: float

    def kept(self, s: dict[str, np.ndarray]) -> np.ndarray:
        good = ~base_failed(s)
        if self.forest is not None and good.any():
            at = np.flatnonzero(good)
            good[at] = self.forest.path_lengths(rates(s)[at]) >= self.shortest
        return good


STATS_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in STATS)


def _stats_batch(doc_ids, texts: list[str]) -> tuple[list, list[str], dict[str, np.ndarray]]:
    parts = [text_stats(part) for _, part in chunks(texts)]
    s = {c: np.concatenate([p[c] for p in parts]) if parts else np.empty(0, dtype=np.int64) for c in STATS}
    return [doc_ids, *(pa.array(s[c], pa.int64()) for c in STATS)], ["doc_id", *STATS], s


def stats(docs: DataFrame) -> DataFrame:
    """doc_id and the five statistics of every whole text; null and empty texts have zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, names, _ = _stats_batch(batch.column(0), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, STATS_SCHEMA)


def labelled_stats(docs: DataFrame, labels: DataFrame, fit_rows: int | None = None) -> DataFrame:
    """(doc_id, statistics, quality): one row, the first in order, for each labelled doc_id; of
    those of lowest hash if ``fit_rows`` bounds them."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    chosen = usable.groupBy(F.col("doc_id").alias("__doc")).agg(F.max("quality").cast("int").alias("quality"))
    if fit_rows is not None:
        chosen = chosen.orderBy(F.xxhash64("__doc"), "__doc").limit(fit_rows)
    # Joined first: only labelled rows' texts reach Python.
    rows = having_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), chosen.select("__doc"), "doc_id", "left_semi")
    one = stats(rows).groupBy("doc_id").agg(F.min(F.struct(*STATS)).alias("s"))
    return one.join(chosen, F.col("doc_id") == F.col("__doc")).select("doc_id", "s.*", "quality")


RATES = ("x0", "x1", "x2", "x3")


def passed_rates(found: DataFrame) -> DataFrame:
    """(doc_id, good, fold, rates) of the labelled rows that pass the rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, quality, *columns = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "quality", *STATS))
            s = dict(zip(STATS, columns, strict=True))
            at = ~base_failed(s)
            fold = (mix(ids.astype(np.uint64)) % _U(FOLDS)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(v[at]) for v in (ids, quality > 0, fold, *rates(s).T)], names=["doc_id", "good", "fold", *RATES])

    return found.mapInArrow(run, "doc_id long, good boolean, fold int, " + ", ".join(f"{c} double" for c in RATES))


def _range(value: Column, cuts: list[float]) -> Column:
    return F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c <= value))


def _cuts(value: str) -> Column:
    return F.percentile_approx(value, [k / RANGES for k in range(1, RANGES)], 10_000)


def pairs_in_order(rows: DataFrame, scratch: Scratch) -> np.ndarray:
    """For each rate, fold of bad rows and fold of good rows: twice the number of pairs with the
    good row's rate below the bad one's, equal ones counting half.

    Running sums over equal values take two levels, ranges and the values inside them.
    """
    folds = range(FOLDS)
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("c"), F.col(c).alias("v")) for k, c in enumerate(RATES)))).alias("r")
    counts = [F.count_if((F.col("good") == kind) & (F.col("fold") == f)).alias(f"{name}{f}") for name, kind in (("g", True), ("b", False)) for f in folds]
    values = scratch.write(rows.select("good", "fold", each).groupBy("r.c", "r.v").agg(*counts), "quality-values")
    part = F.lit(0)
    for r in values.groupBy("c").agg(_cuts("v").alias("cuts")).collect():
        part = F.when(F.col("c") == r["c"], _range(F.col("v"), r["cuts"])).otherwise(part)
    so_far = Window.partitionBy("c", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = values.withColumn("part", part).select("*", *((2 * F.sum(f"g{g}").over(so_far) - F.col(f"g{g}")).alias(f"w{g}") for g in folds))
    sums = [F.sum(F.col(f"b{f}") * F.col(f"w{g}")).alias(f"s{f}{g}") for f in folds for g in folds]
    out = np.zeros((len(RATES), FOLDS, FOLDS))
    before = np.zeros((len(RATES), FOLDS))
    for r in sorted(below.groupBy("c", "part").agg(*sums, *(F.sum(f"{k}{f}").alias(f"{k}{f}") for k in "gb" for f in folds)).collect(), key=lambda r: (r["c"], r["part"])):
        c, bad = r["c"], np.array([r[f"b{f}"] for f in folds], dtype=float)
        out[c] += np.array([[r[f"s{f}{g}"] for g in folds] for f in folds]) + 2 * np.outer(bad, before[c])
        before[c] += [r[f"g{f}"] for f in folds]
    return out


def gathered(rows: DataFrame, good: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The rates of the good rows of the numbers ``wanted``, ascending, as they are numbered by fold.

    ``good``: how many of each fold. Rows are numbered in groups by hash, whose sizes are counted first.
    """
    spark = rows.sparkSession
    grouped = rows.where("good").withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS)))
    start, first = 0, []
    for r in grouped.groupBy("fold", "grp").count().orderBy("fold", "grp").collect():
        first.append((r["fold"], r["grp"], start))
        start += r["count"]
    assert start == good.sum()
    at = F.row_number().over(Window.partitionBy("fold", "grp").orderBy("doc_id")) - 1
    numbered = grouped.withColumn("at", at).join(F.broadcast(spark.createDataFrame(first, "fold int, grp long, first long")), ["fold", "grp"])
    few = F.broadcast(spark.createDataFrame(pa.table({"number": wanted})))
    found = numbered.withColumn("number", F.col("first") + F.col("at")).join(few, "number", "left_semi").select("number", *RATES).toArrow()
    order = np.argsort(found["number"].to_numpy())
    return np.column_stack([found[c].to_numpy() for c in RATES])[order]


def shortest_kept(rows: DataFrame, forests: list[Forest], scratch: Scratch) -> float:
    """The path length, by the forest grown without a row's fold, below which rejecting costs
    least: bad rows kept plus ``GOOD_WEIGHT`` times good rows rejected; midway between two rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, fold = np.column_stack([batch.column(c).to_numpy() for c in RATES]), batch.column("fold").to_numpy()
            lengths = np.empty(len(x))
            for f, forest in enumerate(forests):
                lengths[fold == f] = forest.path_lengths(x[fold == f])
            yield pa.RecordBatch.from_arrays([pa.array(lengths), batch.column("good")], names=["length", "good"])

    cost = F.sum(F.when(F.col("good"), GOOD_WEIGHT).otherwise(-1)).alias("cost")
    lengths = scratch.write(rows.mapInArrow(run, "length double, good boolean").groupBy("length").agg(cost), "quality-lengths")
    part = _range(F.col("length"), lengths.agg(_cuts("length").alias("cuts")).first()["cuts"])
    so_far = Window.partitionBy("part").orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = lengths.withColumn("part", part).withColumn("sum", F.sum("cost").over(so_far))
    best, last, total = 0, None, 0
    for r in running.groupBy("part").agg(F.min(F.struct("sum", "length")).alias("least"), F.sum("cost").alias("cost")).orderBy("part").collect():
        if total + r["least"]["sum"] < best:
            best, last = total + r["least"]["sum"], r["least"]["length"]
        total += r["cost"]
    if last is None:
        return -math.inf
    after = lengths.where(F.col("length") > last).agg(F.min("length")).first()[0]
    return math.inf if after is None else (last + after) / 2


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int | None = None) -> Model:
    """Grow and calibrate on the labelled rows that pass the rules.

    The path length that rejects is chosen on rows whose forest was grown
    without them, in ``FOLDS`` folds; the forest that judges is grown from all.
    A forest is one of the good rows, in the box of all, split more often by what parts them: how
    far a statistic alone parts good from bad rows, from 0 to 1, is twice the distance of the
    share of pairs in order from a half. Each tree draws its ``SAMPLE`` rows from all good ones.
    Rows with a null doc_id or quality are left out. Without labelled rows of
    both kinds in every fold nothing but the rules rejects.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(passed_rates(labelled_stats(docs, labels, fit_rows)), "quality-fit")
    n, low, high = np.zeros((2, FOLDS), dtype=np.int64), np.full((FOLDS, len(RATES)), np.inf), np.full((FOLDS, len(RATES)), -np.inf)
    for r in rows.groupBy("fold").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"), *(f(c).alias(f"{c}{f.__name__}") for c in RATES for f in (F.min, F.max))).collect():
        n[:, r["fold"]] = r["bad"], r["good"]
        low[r["fold"]], high[r["fold"]] = ([r[f"{c}{f}"] for c in RATES] for f in ("min", "max"))
    without = [np.arange(FOLDS) != f for f in range(FOLDS)]
    if any(not n[kind, own].sum() for kind in (0, 1) for own in without):
        scratch.drop()
        return Model(None, -np.inf)
    order = pairs_in_order(rows, scratch)
    ends = np.cumsum(n[1])
    drawn = []
    for k, own in enumerate([*without, np.ones(FOLDS, dtype=bool)]):
        rng = np.random.default_rng([SEED, k])
        size = n[1, own].sum()
        picks = [rng.choice(size, min(SAMPLE, size), replace=False) for _ in range(TREES)]
        # Numbers run over all folds: those from the left out one on lie behind it.
        drawn.append([p if own.all() else np.where(p < ends[k] - n[1, k], p, p + n[1, k]) for p in picks])
    wanted = np.unique(np.concatenate([p for picks in drawn for p in picks]))
    x = gathered(rows, n[1], wanted)
    forests = []
    for own, picks in zip([*without, np.ones(FOLDS, dtype=bool)], drawn, strict=True):
        share = order[:, own][:, :, own].sum(axis=(1, 2)) / (2 * n[0, own].sum() * n[1, own].sum())
        forests.append(grow([x[np.searchsorted(wanted, p)] for p in picks], low[own].min(axis=0), high[own].max(axis=0), abs(2 * share - 1) + 0.01))
    model = Model(forests[-1], shortest_kept(rows, forests[:-1], scratch))
    scratch.drop()
    return model


def judged(docs: DataFrame, model: Model) -> DataFrame:
    """The statistics, base_failed and kept of every whole text.

    Null and empty texts fail for want of words; repeated rows give repeated results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, names, s = _stats_batch(batch.column(0), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(base_failed(s)), pa.array(model.kept(s))], names=[*names, "base_failed", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, STATS_SCHEMA + ", base_failed boolean, kept boolean")


def filtered(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text is kept, all columns as they are, in one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, s = _stats_batch(pa.nulls(batch.num_rows), batch.column("text").to_pylist())
            yield batch.filter(pa.array(model.kept(s)))

    return docs.mapInArrow(run, docs.schema)
