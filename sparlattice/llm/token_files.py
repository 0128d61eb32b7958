"""Operator 5: token-ID output as Parquet list columns.

Documents are range-partitioned and sorted by id, encoded, and written with
delta-packed (or dictionary) integer encoding, bounded row groups and small
pages whose indexes allow reading single documents.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import END, NUMBER, SPACE, Runs, chunks, hash_runs, library_classes, packed, unpacked_classes
from .bpe import Memory
from .shared import shared_dir

END_ID = 1
ROW_GROUP_BYTES = 32 << 20
PAGE_ROWS = 2_000
#: Most files whose offsets, one row a file, are broadcast; more are joined by a shuffle.
BROADCAST_FILES = 1_000_000
FILE_SCHEMA = "doc_id long, start_in_file long, n_tokens int, ids array<int>"
#: Characters that normal forms leave alone and that have one-character lower cases lie below it.
PLAIN_BELOW = 0x300
DOTTED_I = "İ"


def _is_latin1(text: str) -> bool:
    """Whether all characters lie below U+0100; much sooner known than the largest one."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordTokenizer:
    """A tokenizer file whose words are independent of each other.

    Each distinct word is encoded once by the library; texts are cut into
    words with whole-array operations by the file's own rule: letters, single
    digits, other characters, contractions; white space is dropped.
    """

    def __init__(self, path: str, classes: bytes | None = None):
        """``classes``: the character table of the file's own pre-tokenizer; found here if it isn't given."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.classes = unpacked_classes(word_classes(path) if classes is None else classes)
        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: (i, t) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for _, t in added.values()):
            raise ValueError("added tokens that aren't plain strings")
        self.added = {content: i for content, (i, _) in added.items()}
        # Longest first, as the library prefers among those that begin at one place.
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        # Added tokens are cut out of texts before; words between them are never taken for one.
        self.tokenizer.encode_special_tokens = True
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(vocab.values()) + 3, dtype=bool)
        self.closes[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.memory = Memory()

    def normal(self, text: str) -> str:
        if text.isascii() or _is_latin1(text) or (max(text) < chr(PLAIN_BELOW) and DOTTED_I not in text):
            return text.lower()
        return self.tokenizer.normalizer.normalize_str(text)

    def resolve(self, words: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for i in range(0, len(words), 5_000):
            part = words[i : i + 5_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=np.int64)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                flat = ids.tolist()
                out += [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            else:
                out += [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, bounds of each text). Strings of added tokens have the ids of these, as the library has it."""
        if not any(a in t for a in self.added for t in texts):
            return self._encode(texts)
        pieces = [self.parts.split(t) if self.parts else [t] for t in texts]
        flat = [p for of in pieces for p in of]
        ids, bounds = self._encode(["" if k % 2 else p for of in pieces for k, p in enumerate(of)])
        n = np.diff(bounds)
        special = np.array([self.added.get(p, -1) if k % 2 else -1 for of in pieces for k, p in enumerate(of)], dtype=np.int64)
        at = np.flatnonzero(special >= 0)
        ids = np.insert(ids, bounds[at], special[at])
        n[at] = 1
        ends = np.concatenate([[0], np.cumsum(n)])
        return ids, ends[np.concatenate([[0], np.cumsum([len(of) for of in pieces])])] if flat else bounds

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        r = Runs([self.normal(t) for t in texts], after_space=False, table=self.classes)
        digits = np.flatnonzero(r.kind == NUMBER)
        r.cut[digits] = True
        r.cut[digits + 1] = True
        bounds = np.flatnonzero(r.cut)
        keep = (r.kind[bounds[:-1]] != END) & (r.kind[bounds[:-1]] != SPACE)
        starts, stops, joined = bounds[:-1][keep], bounds[1:][keep], r.joined
        blocks = packed(r.points)
        hashes, second = (hash_runs(blocks, r.points, starts, stops, kind) for kind in (0, 1))
        ids, counts = self.memory.ids_of(hashes, second, lambda i: joined[starts[i] : stops[i]], self.resolve)
        first = np.searchsorted(starts, np.append(r.begins, len(r.points)))
        return ids, np.concatenate([[0], np.cumsum(counts)])[first]


@lru_cache(maxsize=2)
def word_tokenizer(path: str, classes: bytes) -> WordTokenizer:
    return WordTokenizer(path, classes)


@lru_cache(maxsize=4)
def word_classes(path: str) -> bytes:
    """The class of every character as the file's pre-tokenizer has it, found by the driver."""
    from tokenizers import Tokenizer

    return library_classes(Tokenizer.from_file(path).pre_tokenizer)


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, encoding: str = "delta", row_group_bytes: int = ROW_GROUP_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Write the ids of every whole text to ``path``, ascending in doc_id.

    Columns: doc_id, start_in_file (ids before it in its file), n_tokens, ids
    (with ``END_ID`` behind the last). ``encoding``: "delta" or "dictionary". Null
    and empty texts have the end id alone; rows of one doc_id follow each other
    in the order of their texts; a null doc_id comes first.
    """
    if encoding not in ("delta", "dictionary"):
        raise ValueError(f"unknown encoding {encoding!r}")

    classes = word_classes(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = word_tokenizer(tokenizer_path, classes)
        start = 0
        for batch in batches:
            for at, part in chunks(batch.column(1).to_pylist()):
                ids, bounds = t.encode(part)
                n = np.diff(bounds)
                ids = np.insert(ids, bounds[1:], END_ID).astype(np.int32)
                offsets = np.concatenate([[0], np.cumsum(n + 1)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(start + offsets[:-1], pa.int64()), pa.array(n + 1, pa.int32()), lists], names=["doc_id", "start_in_file", "n_tokens", "ids"])
                start += int(offsets[-1])

    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(files_for(docs), "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(run, FILE_SCHEMA)
        .write.option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("compression", "zstd")
        .parquet(path)
    )


def files_for(docs: DataFrame) -> int:
    """How many range partitions, each one file: as many as the input is read in,
    so that files stay of one size however much there is, and not fewer than the
    session's number."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document; filters on doc_id reach the
    row groups and pages, and columns that aren't asked for aren't read.

    Files are numbered in the order of their ids. One row for each gives the
    ids before it, without reading the lists of ids.
    """
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    rows = rows.select("*", number.alias("__file"))
    files = rows.groupBy("__file").agg(F.sum("n_tokens").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select("__file", before.alias("__before"))
    if len(rows.inputFiles()) <= BROADCAST_FILES:
        files = F.broadcast(files)
    return rows.join(files, "__file").select("doc_id", (F.col("__before") + F.col("start_in_file")).alias("start"), "n_tokens", "ids")


#: Bytes of a batch in which lists of ids are handed to Python.
READ_BYTES = 8 << 20


def bounded_batches(spark: SparkSession, size: int = READ_BYTES) -> SparkSession:
    """A session of its own with the settings of ``spark``, but batches for Python of at most ``size`` bytes.

    Lists of ids vary in length, so that rows don't bound a batch; at the usual
    limit the vectors of a task, grown by doubling, and their copies in Python take hundreds of megabytes.
    """
    out = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            out.conf.set(name, value)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name, f"{size}b").lower().rstrip("b")
    out.conf.set(name, f"{min(size, int(held)) if held.isdigit() else size}b")
    return out


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets = np.asarray(lists.offsets)
            raw = memoryview(np.asarray(lists.values).astype("<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and digest what is read back."""
    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer_path, path)
    return checksums(read_tokens(bounded_batches(docs.sparkSession), path))
