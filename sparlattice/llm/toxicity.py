"""Operator 6: toxicity by compression distance.

Two zstandard dictionaries are built from labelled rows: one of passages that
toxic documents hold far more often than ordinary ones, one of ordinary words.
Each word of a text is a window, a very long one several that overlap and
together cover it. A window is compressed with both dictionaries
between fixed carrier bytes that both dictionaries hold, so that a window of a
few bytes isn't stored raw; the gain is how many bytes the toxic dictionary
saves. The shares of windows by gain give the score through a logistic curve
calibrated on labelled rows, each against dictionaries made without it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Words, chunks
from .bpe import Memory
from .shared import Scratch

#: Most labelled rows that the fit uses: those of lowest hash.
FIT_ROWS = 20_000
THRESHOLD = 0.3
#: Bytes of each dictionary: the best passages and the commonest words that fit.
DICTIONARY_BYTES = 32_000
PREFIXES = range(4, 13)
GAINS = range(3, 10)
CARRIER = bytes([0, 1, 2, 3, 4, 5, 6, 7, 8, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28])
#: Characters of the longest window; longer words, as in scripts without spaces, are cut into several.
#: In windows of some thousand characters the coding of the rest drowns a passage's gain.
WINDOW_CHARS = 200


def _words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def windows(word: str) -> list[str]:
    """The word, or windows of ``WINDOW_CHARS`` that cover it; any passage is whole in one of them."""
    step = WINDOW_CHARS - PREFIXES[-1]
    return [word[i : i + WINDOW_CHARS] for i in range(0, max(1, len(word) - PREFIXES[-1]), step)]


def passage_contrast(toxic: int, toxic_docs: int, ordinary: int, ordinary_docs: int) -> float:
    """Log-likelihood ratio of a passage's document frequencies, 0 if it isn't far commoner in toxic documents."""
    if not toxic or toxic / toxic_docs < 6 * (ordinary + 0.5) / (ordinary_docs + 1):
        return 0.0

    def likelihood(k: float, n: float, p: float) -> float:
        return k * np.log(max(p, 1e-12)) + (n - k) * np.log(max(1 - p, 1e-12))

    both = (toxic + ordinary) / (toxic_docs + ordinary_docs)
    return float(2 * (likelihood(toxic, toxic_docs, toxic / toxic_docs) + likelihood(ordinary, ordinary_docs, ordinary / max(1, ordinary_docs)) - likelihood(toxic, toxic_docs, both) - likelihood(ordinary, ordinary_docs, both)))


@dataclass
class Gauge:
    """Bytes that the toxic dictionary saves on each window of a word."""

    toxic: bytes
    ordinary: bytes
    memory: Memory = field(default_factory=Memory)

    def __post_init__(self):
        self.compressors = None

    def __getstate__(self):
        return {"toxic": self.toxic, "ordinary": self.ordinary}

    def __setstate__(self, state):
        self.__init__(**state)

    def _open(self):
        import zstandard as zs

        params = zs.ZstdCompressionParameters(window_log=17, chain_log=14, hash_log=15, search_log=4, min_match=4, strategy=zs.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False, format=zs.FORMAT_ZSTD1_MAGICLESS)
        self.compressors = []
        for content in (self.toxic, self.ordinary):
            d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.compressors.append(zs.ZstdCompressor(dict_data=d, compression_params=params).compress)

    def gains(self, words: list[str]) -> list[list[int]]:
        if self.compressors is None:
            self._open()
        toxic, ordinary = self.compressors
        out = []
        for word in words:
            framed = [CARRIER + b" " + w.lower().encode() + b" " + CARRIER for w in windows(word)]
            out.append([len(ordinary(w)) - len(toxic(w)) for w in framed])
        return out

    def features(self, texts: list[str]) -> np.ndarray:
        """For each text: percentages of windows by gain, then log(1 + windows)."""
        w = Words(texts, lower=False)
        joined, starts, stops = w.joined, w.starts, w.ends_of_words
        if len(self.memory.ids) > self.memory.bound:  # words of many windows
            self.memory.empty()
        gain, cut = self.memory.ids_of(w.hashes, w.second, lambda i: joined[starts[i] : stops[i]], self.gains)
        doc = np.repeat(w.doc, cut)
        n = np.bincount(doc, minlength=w.n)
        k = len(GAINS)
        level = np.clip(gain - GAINS.start, -1, k - 1)
        hit = level >= 0
        counts = np.bincount(doc[hit] * k + level[hit], minlength=w.n * k).reshape(w.n, k)
        shares = np.minimum(100 * counts / np.maximum(1, n)[:, None], 10)
        return np.column_stack([shares, np.log1p(n)])


def dictionaries(passages: dict[str, tuple[int, int]], ordinary: list[str], toxic_docs: int, ordinary_docs: int, size: int = DICTIONARY_BYTES) -> Gauge:
    """passages: document frequencies (toxic, ordinary); ordinary: words, commonest first.

    The best that fit in ``size`` bytes stay; what stands last is nearest, and
    the carrier closes both.
    """
    scored = {p: s for p, (k, n) in passages.items() if (s := passage_contrast(k, max(1, toxic_docs), n, ordinary_docs)) >= 15}
    covered = {p[:i] for p in scored for i in range(1, len(p)) if p[:i] in scored and passages[p][0] >= 0.9 * passages[p[:i]][0]}
    best = sorted((p for p in scored if p not in covered), key=lambda p: (-scored[p], p))
    taken = set(best)
    close = b"\x00" + CARRIER + b"\x00" * 16
    made = []
    for items in (best, [w for w in ordinary if w not in taken]):
        held: list[bytes] = []
        room = size - 2
        for word in map(str.encode, items):
            room -= len(word) + 1
            if room < 0:
                break
            held.append(word)
        made.append(b" " + b" ".join(reversed(held)) + b" " + close)
    return Gauge(made[0], made[1])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 50) -> np.ndarray:
    """Weights, with the constant last, of a ridge-penalised logistic regression by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    gauge: Gauge
    weights: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        x = self.gauge.features(texts)
        return 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ self.weights, -30, 30)))


def _words_of(text: str | None) -> set[str]:
    """The distinct windows of a text."""
    return {x for w in set(_words(text)) for x in windows(w)}


def _passages(words: set[str]) -> set[str]:
    return {w[:k] for w in words for k in PREFIXES}


def labelled_rows(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """(__id, text, __toxic, __fold): one text, the first in order, for each of the chosen doc_ids."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("__toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    chosen = F.broadcast(chosen.withColumnRenamed("doc_id", "__doc"))
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), "text").join(chosen, F.col("__id") == F.col("__doc"))
    rows = rows.groupBy("__id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("__toxic").alias("__toxic"))
    return rows.select("__id", "text", (F.col("__toxic") > 0).cast("int").alias("__toxic"), F.pmod(F.xxhash64(F.col("__id"), F.lit(7)), F.lit(2)).cast("int").alias("__fold"))


def counted(rows: DataFrame, items_of) -> DataFrame:
    """(item, n0, n1): how many texts of each fold hold an item. Tasks add up
    what they see and drop nothing, so that partitions make no difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, fold in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[fold].update(items_of(text))
        for fold, c in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([fold] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["item", "fold", "n"])

    parts = rows.select("text", "__fold").mapInArrow(run, "item string, fold int, n long")
    return parts.groupBy("item").agg(*(F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"n{f}") for f in (0, 1)))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, dictionary_bytes: int = DICTIONARY_BYTES) -> Model:
    """Fit on at most ``fit_rows`` labelled rows, without those that are held out.

    ``labels``: doc_id, toxic; rows with a null in either, and all rows of a
    doc_id whose crc32 modulo 4 is 2, are left out. Without labelled rows of
    both kinds every score is the share of toxic ones. Bounds of the fit: the
    rows, the bytes of a dictionary, and passages of ``PREFIXES`` characters at
    the start of a window that one in a hundred toxic rows hold. How rows are
    partitioned makes no difference.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(labelled_rows(docs, labels, fit_rows), "toxic-fit")
    sizes = {(r["__toxic"], r["__fold"]): r["n"] for r in rows.groupBy("__toxic", "__fold").agg(F.count("*").alias("n")).collect()}

    def docs_of(toxic: int, folds: tuple[int, ...]) -> int:
        return sum(sizes.get((toxic, f), 0) for f in folds)

    least = max(3, docs_of(1, (0, 1)) // 100)
    both = F.col("n0") + F.col("n1")
    toxic = counted(rows.where("__toxic = 1"), lambda text: _passages(_words_of(text))).where(both >= least)
    toxic_n = {r["item"]: (r["n0"], r["n1"]) for r in toxic.collect()}
    wanted = frozenset(toxic_n)
    ordinary = counted(rows.where("__toxic = 0"), lambda text: _passages(_words_of(text)) & wanted)
    ordinary_n = {r["item"]: (r["n0"], r["n1"]) for r in ordinary.collect()}
    # A word and its space take two bytes or more, so that no more words than this fit in a dictionary.
    common = counted(rows.where("__toxic = 0"), _words_of).orderBy(both.desc(), "item").limit(dictionary_bytes // 2)
    common_words = [r["item"] for r in common.collect()]

    def gauge_of(folds: tuple[int, ...]) -> Gauge:
        none = (0, 0)
        passages = {p: (sum(n[f] for f in folds), sum(ordinary_n.get(p, none)[f] for f in folds)) for p, n in toxic_n.items()}
        return dictionaries(passages, common_words, docs_of(1, folds), docs_of(0, folds), dictionary_bytes)

    others = [gauge_of((1,)), gauge_of((0,))]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, y = (np.asarray(batch.column(c)) for c in ("__fold", "__toxic"))
            for at, part in chunks(batch.column("text").to_pylist()):
                own = fold[at : at + len(part)]
                x = np.where(own[:, None] == 0, others[0].features(part), others[1].features(part))
                yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(y[at : at + len(part)], pa.int32())], names=["x", "y"])

    found = rows.mapInArrow(features, "x array<double>, y int").collect()
    scratch.drop()
    y = np.array([r["y"] for r in found], dtype=float)
    full = gauge_of((0, 1))
    if len(y) == 0 or y.min() == y.max():
        w = np.zeros(len(GAINS) + 2)
        w[-1] = -30.0 if len(y) == 0 or y.max() == 0 else 30.0
        return Model(full, w)
    x = np.array(sorted((r["x"] + [r["y"]] for r in found)))  # in one order, whatever the tasks' order
    return Model(full, logistic(x[:, :-1], x[:, -1]))


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted for every whole text.

    Null and empty texts count as texts without windows. Repeated rows give
    repeated results. A null doc_id isn't held out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.scores(part) for _, part in chunks(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts or [np.empty(0)]), pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    return scored(docs, fit(docs, labels, fit_rows))
